"""Where operators put what must outlive a stage.

The cluster names a folder that the driver and all executors share in
``spark.checkpoint.dir``. Where it is unset a temporary folder is made if all
runs on this machine, as in tests; elsewhere that is an error, as executors
would write to folders that nobody else sees. ``localCheckpoint`` is never used.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


#: Bytes of an Arrow batch on the way to Python while a table is written; only a single longer row goes beyond it.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder as a URI or path."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="loomspan-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def local_folder(spark: SparkSession) -> str:
    """The shared folder as a path that all machines can map."""
    where = urlparse(shared_dir(spark))
    if where.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped files need a mounted folder, not {where.scheme}://")
    return where.path


def new_table(spark: SparkSession) -> str:
    """A path in the shared folder that nothing has yet; what is written there goes when the application ends."""
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches limited by bytes, so that long texts don't add up to 10,000 rows of them in the executor and its workers; the session's own setting is put back."""
    own = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, f"{BATCH_BYTES}b")
    try:
        yield
    finally:
        spark.conf.set(_BATCH, own)


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """df through a Parquet table in the shared folder: computed once (a checkpoint computes it twice), cut from its lineage, of a known size."""
    path = path or new_table(df.sparkSession)
    with _small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


materialise = written


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of tables that are no longer used; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()
