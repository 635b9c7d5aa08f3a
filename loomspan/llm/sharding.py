"""Sharding into contiguous ranges of almost equal bytes (law ``bytes``).

Documents are range-sorted by a hash of the text and then doc_id, so equal
texts are neighbours. Every partition of that layout gives its total; the
prefix sums of the totals place each partition in the whole, and a running sum
within the partition places each document. The whole is cut at equal targets;
a document belongs to the shard in which its middle lies. A cut that falls into
a group of equal texts moves to the group's nearer edge if the group is small
(``hold`` of a shard's bytes at most); a larger group is cut, so that shards
stay balanced however large a group is.

Equal texts of one doc_id are ordered by a hash of the whole row, and fully equal
rows by their number in the input, so that very many of them are many ranges.

Defined results: null text has no bytes, its size is 1 and its CRC that of no
bytes. Fully equal rows are interchangeable. An empty table gives no rows. With
fewer documents than shards some shards are empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.llm import rows as r
from loomspan.llm.storage import written

SHARDS = 8
#: Rows of a partition of the sorted layout, about.
PARTITION_ROWS = 250_000
#: The same, if rows carry their whole document.
PARTITION_DOCUMENTS = 20_000
HOLD = 0.01


def _running(batches):
    """Adds to each row the bytes and rows of its partition up to and including it."""
    size_sum = row_sum = 0
    at = None
    for batch in batches:
        size, part = batch.column("size").to_numpy(), batch.column("part").to_numpy()
        change = np.flatnonzero(np.concatenate([[len(part) > 0 and part[0] != at], part[1:] != part[:-1]])) if len(part) else []
        ends, rows = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
        for a, b in zip([0, *change], [*change, len(size)]):
            if a in change:
                size_sum = row_sum = 0
            ends[a:b] = size_sum + np.cumsum(size[a:b])
            rows[a:b] = row_sum + np.arange(1, b - a + 1)
            if b > a:
                size_sum, row_sum, at = int(ends[b - 1]), int(rows[b - 1]), part[b - 1]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends), pa.array(rows)], [*batch.schema.names, "end", "row"])


def shard(docs: DataFrame, shards: int = SHARDS, hold: float = HOLD, whole: bool = False) -> DataFrame:
    """A row for each document: doc_id, size, text_crc32, shard, slot (its place in the shard), and with ``whole`` the row itself as a struct of that name."""
    text = F.coalesce("text", F.lit(""))
    order = ["text_hash", "text_crc32", "doc_id", "tie", "nth"]
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), *([r.packed(docs).alias("whole")] if whole else []),
        (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"),
        (r.row_hash(docs) if whole else F.lit(0).cast("bigint")).alias("tie"), F.monotonically_increasing_id().alias("nth"),
    )
    parts = max(1, -(-docs.count() // (PARTITION_DOCUMENTS if whole else PARTITION_ROWS)), docs.sparkSession.sparkContext.defaultParallelism)
    laid = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).drop("tie", "nth")
    # Written with the number of its partition, so the layout stays as it is whatever is computed again.
    schema = T.StructType([*laid.schema.fields, T.StructField("end", T.LongType()), T.StructField("row", T.LongType())])
    laid = written(laid.mapInArrow(_running, schema))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = laid.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    offsets = offsets.select(
        "part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before")
    )
    placed = laid.join(F.broadcast(offsets), "part").withColumn("end", F.col("end") + F.col("bytes_before")).withColumn("row", F.col("row") + F.col("n_before"))
    total = laid.agg(F.sum("size")).first()[0] or 0
    placed = placed.withColumn("middle", F.col("end") * 2 - F.col("size"))  # doubled, to stay with whole numbers
    cuts = _cuts(placed, total, shards, hold)
    number = F.lit(0)
    for cut in cuts:  # one fewer than shards
        number = number + (F.col("middle") >= cut).cast("int")
    placed = placed.withColumn("shard", number)
    first = placed.groupBy("shard").agg(F.min("row").alias("first_row"))  # a row for each shard
    placed = placed.join(F.broadcast(first), "shard").withColumn("slot", F.col("row") - F.col("first_row"))
    return placed.select("doc_id", *(["whole"] if whole else []), "size", "text_crc32", "shard", "slot")


def sharded_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The documents with all their columns, and ``shard`` and ``slot`` (with "_" behind a name that the documents have)."""
    names = {}
    for new in ("shard", "slot"):
        names[new] = new
        while names[new].lower() in (c.lower() for c in docs.columns):
            names[new] += "_"
    out = shard(docs, shards, whole=True)
    return out.select("whole.*", F.col("shard").cast("int").alias(names["shard"]), F.col("slot").cast("bigint").alias(names["slot"]))


def _cuts(placed: DataFrame, total: int, shards: int, hold: float) -> list[int]:
    """Doubled byte positions of the shards - 1 cuts."""
    even = [2 * total * k // shards for k in range(1, shards)]
    if not total or not even:
        return even
    hit = F.lit(False)
    for cut in even:
        hit = hit | ((F.col("end") * 2 > cut) & ((F.col("end") - F.col("size")) * 2 <= cut))
    # The document at each cut, hence at most shards - 1 groups of equal texts.
    groups = placed.where(hit).select("text_hash", "text_crc32").distinct()
    edges = (
        placed.join(F.broadcast(groups), ["text_hash", "text_crc32"])
        .groupBy("text_hash", "text_crc32")
        .agg(F.min(F.col("end") - F.col("size")).alias("low"), F.max("end").alias("high"))
        .collect()
    )
    cuts = []
    for cut in even:
        for e in edges:
            if 2 * e.low <= cut < 2 * e.high and e.high - e.low <= hold * total / shards:
                cut = 2 * e.low if cut - 2 * e.low < 2 * e.high - cut else 2 * e.high
                break
        cuts.append(cut)
    return cuts


def shard_digest(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    return shard(docs, shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
