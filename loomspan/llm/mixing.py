"""Mixing sources to target weights, on native operations only.

Sources in code point order (null last) weigh 1, 2, 3, 1, 2, 3, ... and share
the words of the whole corpus by weight. No source gives more than three times
its words; what is beyond that is shared by weight among the others.

Each document gets a hash-random key. Its place in its source is the prefix sum
of words in the order of the keys: the key's leading digits cut each source
into ranges, range totals give each range its offset, and only within a range
are rows sorted. A source gives whole epochs while its target allows, and then
the documents from the front of the order up to the target's rest: a document
is taken if its middle lies before that cut, so a source misses its target by
half of one document at most.

The key hashes doc_id and text, so rows without an id, or of one id, are dealt
over all ranges as well; the number of ranges follows the number of rows. One
task holds a row for each source, and one the ranges of each.

Defined results: null text has no words; documents without words are taken 0
words. A null source is a source of its own. Rows of the same id, source and
text that differ in other columns are ordered by a hash of the whole row; fully
equal rows are interchangeable. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm import rows as r
from loomspan.llm.storage import materialise

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = 3
MOST_EPOCHS = 3
SEED = "mix"
#: Rows of a range, at most about.
RANGE_ROWS = 100_000


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def source_targets(sources: DataFrame, epochs: int = MOST_EPOCHS) -> DataFrame:
    """source, sk, source_size to source, sk, source_size, target; one row for each source."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = sources.withColumn("rank", F.row_number().over(order)).withColumn("weight", (F.col("rank") - 1) % WEIGHTS + 1)
    w = w.withColumn("most", F.col("source_size") * epochs)
    # In the order of most / weight, those before the first that stays below its limit are at their limit.
    fill = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    w = w.withColumn("full", F.coalesce(F.sum("most").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    w = w.withColumn("open", F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    everything = Window.partitionBy()
    w = w.withColumn("level", (F.sum("source_size").over(everything) - F.col("full")) / F.col("open"))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("most") / F.col("weight"))
    w = w.withColumn("level", F.min_by("level", F.struct(fits.isNull(), fits, "rank")).over(everything))
    target = F.least(F.col("most").cast("double"), F.col("weight") * F.col("level"))
    return w.select("source", "sk", "source_size", target.alias("target"))


def digits_for(n: int) -> int:
    """Hexadecimal digits that name ranges of RANGE_ROWS of n rows at most; 3 at least."""
    digits = 3
    while 16**digits * RANGE_ROWS < n:
        digits += 1
    return digits


def mix(docs: DataFrame, seed: str = SEED, digits: int | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """A row for each document: doc_id, size, source_size, target, copies (times the mix takes it), and the columns ``keys``.

    ``digits``: hexadecimal digits of the key that name its range; results don't depend on it.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        *(["doc_id"] if "doc_id" not in keys else []), *keys, *(["source"] if "source" not in keys else []),
        F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source")).alias("sk"),
        n_words(F.col("text")).alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(text))).alias("key"),
    )
    rows = materialise(rows)
    rows = rows.withColumn("range", F.substring("key", 1, digits or digits_for(rows.count())))
    ranges = rows.groupBy("sk", "range").agg(F.first("source").alias("source"), F.sum("size").alias("words"))
    before = Window.partitionBy("sk").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("offset", F.coalesce(F.sum("words").over(before), F.lit(0)))
    sources = ranges.groupBy("sk").agg(F.first("source").alias("source"), F.sum("words").alias("source_size"))
    ranges = ranges.select("sk", "range", "offset").join(source_targets(sources).drop("source"), "sk")
    within = Window.partitionBy("sk", "range").orderBy("key", *(k for k in keys if k not in ("doc_id", "source")))
    running = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.join(ranges, ["sk", "range"]).withColumn("end", F.col("offset") + F.sum("size").over(running))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    placed = placed.withColumn("epochs", epochs)
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    more = (F.col("end") - F.col("size") / 2 <= rest).cast("bigint")
    names = ["doc_id", *(k for k in keys if k != "doc_id")]
    return placed.select(
        *names, "size", "source_size", "target", F.when(F.col("size") > 0, F.col("epochs") + more).otherwise(0).cast("bigint").alias("copies")
    )


def mixed_words(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted)."""
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: each document with all its columns, as often as it is taken."""
    hashed = docs.select(
        r.packed(docs).alias("whole"), r.row_hash(docs).alias("hash_1"), r.row_hash(docs, 1).alias("hash_2"), "doc_id", "source", "text"
    )
    copies = mix(hashed, keys=("hash_1", "hash_2")).where("copies > 0").groupBy("hash_1", "hash_2").agg(F.sum("copies").alias("copies"))
    # Rows of one hash are equal in all columns: one of them stands for all, as often as they are taken together.
    once = hashed.select("whole", "hash_1", "hash_2").join(copies, ["hash_1", "hash_2"]).dropDuplicates(["hash_1", "hash_2"])
    repeated = once.select("whole", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("nth"))
    return repeated.select("whole.*")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS rank FROM s),
w AS (SELECT *, (rank - 1) % 3 + 1 AS weight, source_size * 3 AS most FROM r),
f AS (
  SELECT *, coalesce(sum(most) OVER (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done,
         sum(weight) OVER (ORDER BY most / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
         sum(source_size) OVER () AS total
  FROM w),
l AS (SELECT *, (total - done)::DOUBLE / open::DOUBLE AS level FROM f),
t AS (
  SELECT source, source_size, least(most::DOUBLE, weight *
    (SELECT level FROM l WHERE level * weight <= most ORDER BY most / weight, rank LIMIT 1)) AS target FROM l),
p AS (
  SELECT doc_id, d.source, size, source_size, target,
         sum(size) OVER (PARTITION BY d.source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS place,
         CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN place - size / 2 <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p"""
