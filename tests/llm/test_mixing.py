import random
from collections import Counter

import duckdb
import pytest

from loomspan.llm import mixing

from .common import DOCS, frame, odd_rows, words


def expected_targets(rows):
    """Fill by weight, cap, share the rest again."""
    size = Counter()
    for r in rows:
        size[r[3]] += len(words(r[1]))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, full = sum(size.values()), set()
    while True:
        left = total - sum(3 * size[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in order if x not in full) for s in order if s not in full}
        over = {s for s, t in share.items() if t > 3 * size[s]}
        if not over:
            return size, {s: float(3 * size[s]) if s in full else share[s] for s in order}
        full |= over


def skewed(seed=3):
    rng = random.Random(seed)
    rows = [(i, "w " * rng.randrange(0, 30), "en", rng.choice(["big"] * 8 + ["a", "b", "Z", "é", None]), 0) for i in range(600)]
    return [*rows, (601, "x", "en", "tiny", 1), (602, None, None, "none", None)]


@pytest.mark.parametrize("rows", [odd_rows(), skewed(), [], [(1, None, None, None, None)], [(1, "", "", "a", 0)]])
def test_targets_and_taken_words(spark, rows):
    docs = frame(spark, rows, clashing=True)
    out = mixing.mix(docs, keys=("source",)).collect()
    size, target = expected_targets(rows) if rows else ({}, {})
    assert Counter((r.doc_id, r.size) for r in out) == Counter((r[0], len(words(r[1]))) for r in rows)
    for s in target:
        mine = [r for r in out if r.source == s]
        assert all(r.target == pytest.approx(target[s]) and r.source_size == size[s] for r in mine)
        assert all(0 <= r.copies <= 3 for r in mine)
        assert abs(sum(r.size * r.copies for r in mine) - target[s]) <= max(r.size for r in mine) / 2 + 1e-6


def test_reruns_ranges_and_layouts_agree_with_sql(spark):
    rows = skewed()
    digest = lambda df: sorted(map(repr, (tuple(r) for r in df.collect())))
    first = digest(mixing.mixed_words(frame(spark, rows)))
    assert first == digest(mixing.mixed_words(frame(spark, rows[::-1]).repartition(7)))
    a = mixing.mix(frame(spark, rows), digits=1).select("doc_id", "size", "source_size", "target", (mixing.F.col("size") * mixing.F.col("copies")).alias("taken"))
    assert digest(a) == first
    con = duckdb.connect()
    documents = frame(spark, rows).toPandas()  # noqa: F841
    con.execute("CREATE TABLE documents AS SELECT doc_id::BIGINT AS doc_id, text, lang, source, n_chars FROM documents")
    assert sorted(map(repr, con.execute(mixing.SQL).fetchall())) == first


def test_the_mix_repeats_whole_documents(spark):
    rows = odd_rows()
    docs = frame(spark, rows, clashing=True)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    want = Counter()
    for r in mixing.mix(docs, keys=("source",)).collect():
        want[r.doc_id, r.source, r.size] += r.copies
    got = Counter((r.doc_id, r.source, len(words(r.text))) for r in mixed.collect())
    assert got == +want
    assert spark.createDataFrame([], DOCS).transform(mixing.mixed_documents).count() == 0


def test_rows_that_differ_in_other_columns_are_all_there(spark):
    """Equal ids and texts, null ids, equal sizes, odd names: no row is lost or stands for another, and reruns agree."""
    rows = [(1, "a b c", lang, "s", n) for lang in ("en", "fr", None) for n in (1, 2, None)]
    rows += [(None, f"w{i} x", "en", "s", 0) for i in range(400)] + [(7, f"v{i} y", "en", "t", 0) for i in range(50)]
    docs = frame(spark, rows).withColumn("a.b", mixing.F.lit(1)).withColumn("__hash", mixing.F.col("n_chars")).withColumn("whole", mixing.F.lit(2)).withColumn("hash_1", mixing.F.lit("x"))
    docs = docs.withColumn("m", mixing.F.create_map(mixing.F.lit(1), mixing.F.lit(2)))
    got = [Counter((r.doc_id, r.text, r.lang, r.n_chars, r["a.b"], r["__hash"]) for r in mixing.mixed_documents(d).collect()) for d in (docs, docs.orderBy("text", ascending=False).repartition(5))]
    assert got[0] == got[1]
    copies = Counter()
    size, target = expected_targets(rows)
    for (_, text, *_), n in got[0].items():
        copies["s" if text[0] in "aw" else "t"] += n * len(text.split())
    assert all(abs(copies[s] - target[s]) <= 1.5 for s in target)
    most = {s: -(-target[s] // size[s]) for s in size}
    assert all(n <= most["t" if k[1][0] == "v" else "s"] for k, n in got[0].items())
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_ranges_follow_the_number_of_rows():
    assert [mixing.digits_for(n) for n in (0, 10**6, 16**3 * mixing.RANGE_ROWS, 16**3 * mixing.RANGE_ROWS + 1, 3 * 10**10)] == [3, 3, 3, 4, 5]
