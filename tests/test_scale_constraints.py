"""Constrained loads: one shuffle, and no row in neither part."""

from pyspark.sql import functions as F

from loomspan.sources import staging


def test_every_row_is_accepted_or_rejected_once(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 1, "a"), (1, -1, "a"), (2, 5, None), (None, 1, "x"), (None, 2, "y")], "k int, n int, s string")
    good, bad = staging.constrained(df, ["k"], {"n > 0": F.col("n") > 0})
    assert sorted(map(tuple, good.where("k is not null").collect())) == [(1, 1, "a"), (2, 5, None)]
    assert sorted((r.k, r.n, tuple(r.reasons)) for r in bad.where("k is not null").collect()) == [(1, -1, ("n > 0",)), (1, 1, ("primary key",)), (1, 2, ("primary key",))]
    assert good.count() + bad.count() == df.count()
    assert staging.judged(df, ["k"], {})._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
