"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.storage import materialise, release


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("m"))


def _large(edges: DataFrame) -> DataFrame:
    """Edges lead from the greater node to the lesser; each now leads to the least that its end leads to."""
    # Written first: the join's sides then have shuffles of their own, so the edges of a centre of very many are split.
    least = materialise(_least(edges)).withColumnRenamed("a", "b")
    return edges.join(least, "b", "left").select("a", F.coalesce("m", "b").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    least = _least(edges)
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def _are_stars(edges: DataFrame) -> bool:
    """Whether no node leads to two, or both leads to one and is led to."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("out")).unionByName(edges.select(F.col("b").alias("x"), F.lit(0).alias("out")))
    return ends.groupBy("x").agg(F.sum("out").alias("out"), F.count("*").alias("n")).where("out > 1 or out = 1 and n > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(a, root) for every node of ``edges`` (a, b) that isn't itself its root.

    The root is the least node of the component. Loops and repeated edges do no
    harm; no edges give no rows. Edge lists stay distributed; only a yes or no
    of each round reaches the driver.
    """
    current = materialise(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    while not _are_stars(current):
        current = materialise(_small(_large(current).distinct()).distinct())
        release(current.sparkSession)
    return current.select("a", F.col("b").alias("root"))
