"""Reading and writing staged files: all-text CSV, instructions, evidence, DOM rows, HTML folders, constrained tables."""

from __future__ import annotations

import os
import re
import tarfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.functions.coercion import clean_int, clean_text, host_trim

QUOTED = {"quote": '"', "escape": '"', "multiLine": "true"}


def staged(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV file whose header is skipped: columns by position, all text, empty cells ''."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("enforceSchema", "true").options(header="true", **QUOTED).csv(path).na.fill("")


def by_header(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """A CSV file by its header, all text; short rows are filled with '' and blank rows dropped. ``strict`` fails on malformed rows."""
    rows = spark.read.options(header="true", inferSchema="false", mode="FAILFAST" if strict else "PERMISSIVE", **QUOTED).csv(path).na.fill("")
    filled = [F.col(f"`{c}`") != "" for c in rows.columns]
    some = filled[0]
    for f in filled[1:]:
        some = some | f
    return rows.where(some)


def written(df: DataFrame, path: str) -> str:
    """df as CSV with header; CR is taken out of texts, quotes are doubled. One file for each partition, so it is as distributed as df."""
    text = [F.regexp_replace(F.col(f"`{f.name}`"), "\r", "").alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema.fields]
    df.select(*text).write.options(header="true", quote='"', escape='"', emptyValue="").mode("overwrite").csv(path)
    return path


def missing_columns(df: DataFrame, required: Iterable[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


INSTRUCTION_COLUMNS = [
    "CaseNo", "dataId", "targetId", "dataRole", "convModel", "mirrorX", "mirrorY", "mirrorZ", "validationMin", "validationMax", "nullable", "referenceType", "fixedValue", "referenceValues",
]
EVIDENCE_COLUMNS = [*INSTRUCTION_COLUMNS[:12], "elementIndex", "valueState", "actualValue", "actualLength", "runMode"]


def instructions(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Checked instruction rows with referenceValues as an array, and the keys that occur more than once (none may)."""
    if lost := missing_columns(df, INSTRUCTION_COLUMNS):
        raise ValueError(f"columns missing: {lost}")
    values = F.filter(F.split(F.trim(F.coalesce("referenceValues", F.lit(""))), r"\s+/\s+"), lambda x: x != "")
    return df.withColumn("referenceValues", values), df.groupBy("CaseNo", "dataId").agg(F.count("*").alias("n")).where("n > 1")


def evidence(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Checked evidence rows with a numeric elementIndex, and their repeated keys (CaseNo, dataId, elementIndex)."""
    if lost := missing_columns(df, EVIDENCE_COLUMNS):
        raise ValueError(f"columns missing: {lost}")
    out = df.withColumn("elementIndex", F.col("elementIndex").try_cast("bigint"))
    return out, out.groupBy("CaseNo", "dataId", "elementIndex").agg(F.count("*").alias("n")).where("n > 1")


def blank_to_null(c: Column) -> Column:
    return F.nullif(host_trim(c), F.lit(""))


def finite_or_zero(c: Column) -> Column:
    value = host_trim(c).try_cast("double")
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), 0.0).otherwise(value)


def html_folder(spark: SparkSession, path: str) -> DataFrame:
    """(screenName, html) of every *.html file of a folder."""
    rows = spark.read.text(path, wholetext=True, pathGlobFilter="*.html")
    return rows.select(F.regexp_replace("_metadata.file_name", r"\.html$", "").alias("screenName"), F.col("value").alias("html"))


def screen_file_name(name: Column) -> Column:
    """A file name for a captured screen: anything but letters, digits, '.', '_' and '-' becomes '_'."""
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_")


def cleaned(df: DataFrame, integers: Iterable[str]) -> tuple[DataFrame, DataFrame]:
    """Columns with sentinels for blanks, and the rows with an integer column that is no number (they are in neither form)."""
    names = set(integers)
    out = df.select(*((clean_int if c in names else clean_text)(F.col(c).cast("string")).alias(c) for c in df.columns))
    bad = F.lit(False)
    for c in names:
        bad = bad | clean_int(F.col(c).cast("string")).isNull()
    good = F.lit(True)
    for c in names:
        good = good & F.col(c).isNotNull()
    return out.where(good), df.where(bad)


def judged(df: DataFrame, key: list[str], checks: dict[str, Column], required: Iterable[str] = ()) -> DataFrame:
    """df with ``reasons``, empty for accepted rows: NOT NULL columns, CHECKs (NULL passes) and a primary key, of which the first row by value stays.

    One shuffle by the key; rows that break a check don't count for it.
    """
    reasons = [F.when(F.col(f"`{c}`").isNull(), f"{c} is null") for c in required]
    reasons += [F.when(~F.coalesce(ok, F.lit(True)), name) for name, ok in checks.items()]
    rows = df.withColumn("__reasons", F.array_compact(F.array(*reasons)) if reasons else F.array().cast("array<string>")).withColumn("__fine", F.size("__reasons") == 0)
    names = [F.col(f"`{c}`") for c in df.columns]
    order = Window.partitionBy(*(F.col(f"`{c}`") for c in key), "__fine").orderBy(*([n for n, c in zip(names, df.columns) if c not in key] or [F.lit(0)]))
    again = F.col("__fine") & (F.col("__row") > 1)
    return rows.withColumn("__row", F.row_number().over(order)).select(*names, F.when(again, F.array(F.lit("primary key"))).otherwise(F.col("__reasons")).alias("reasons"))


def constrained(df: DataFrame, key: list[str], checks: dict[str, Column], required: Iterable[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reasons) of ``judged``."""
    rows = judged(df, key, checks, required)
    return rows.where(F.size("reasons") == 0).drop("reasons"), rows.where(F.size("reasons") > 0)


def fill_template(text: str, values: dict[str, str]) -> str:
    """A prompt from a text with {{NAME}} placeholders; one without a value is an error, values aren't read for placeholders."""
    lost = sorted(set(re.findall(r"\{\{(\w+)\}\}", text)) - set(values))
    if lost:
        raise ValueError(f"no value for {lost}")
    return re.sub(r"\{\{(\w+)\}\}", lambda m: values[m[1]], text)


def bundle(files: Iterable[str], path: str) -> str:
    """A tar.gz of input files, all of which must be there and not empty."""
    names = list(files)
    for name in names:
        if not os.path.isfile(name) or not os.path.getsize(name):
            raise ValueError(f"missing or empty: {name}")
    with tarfile.open(path, "w:gz") as tar:
        for name in names:
            tar.add(name, os.path.basename(name))
    return path


class Store:
    """A folder of tables that are replaced together: readers see all of the old tables or all of the new ones.

    Each refresh writes a version of its own; a pointer file is then put in place by one rename. ``vacuum``
    deletes the versions that the pointer doesn't name, ``reset`` all rows, ``drop`` the store.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _version(self) -> str | None:
        pointers = [x.getPath().getName() for x in self._fs.listStatus(self._path(self.folder))] if self._fs.exists(self._path(self.folder)) else []
        named = sorted(x for x in pointers if x.startswith("current-"))
        return named[-1].split("-", 2)[2] if named else None

    def refresh(self, tables: dict[str, DataFrame]) -> None:
        """Write all tables, then make them the current ones; a failure before the end leaves the old ones."""
        version = uuid.uuid4().hex
        for name, df in tables.items():
            df.write.parquet(f"{self.folder}/v-{version}/{name}")
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path(self.folder))]
        number = 1 + max([int(x.split("-")[1]) for x in names if x.startswith("current-")], default=0)
        made = self._path(f"{self.folder}/new-{version}")
        self._fs.create(made).close()
        self._fs.rename(made, self._path(f"{self.folder}/current-{number:012d}-{version}"))

    def table(self, name: str) -> DataFrame:
        version = self._version()
        if version is None:
            raise ValueError(f"nothing is stored in {self.folder}")
        return self.spark.read.parquet(f"{self.folder}/v-{version}/{name}")

    def reset(self, *names: str) -> None:
        """The named tables without rows."""
        self.refresh({n: self.table(n).limit(0) for n in names})

    def vacuum(self) -> None:
        version = self._version()
        for x in self._fs.listStatus(self._path(self.folder)):
            if not x.getPath().getName().endswith(version or "-"):
                self._fs.delete(x.getPath(), True)

    def drop(self) -> None:
        self._fs.delete(self._path(self.folder), True)
