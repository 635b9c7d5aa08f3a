"""Evidence as a stream: values generated from arriving instructions, appended exactly once for each batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from loomspan.operators import generate


def append_evidence(instructions: DataFrame, path: str, checkpoint: str, mode: str = "GENERATE") -> StreamingQuery:
    """Starts a query that writes the scalar values of a stream of instructions to Parquet below ``path``.

    A batch that is run again after a failure overwrites its own folder, so no evidence is written twice.
    """
    from pyspark.sql import functions as F

    def write(batch: DataFrame, number: int) -> None:
        values = generate.scalars(batch).withColumn("runMode", F.lit(mode))
        values.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return instructions.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
