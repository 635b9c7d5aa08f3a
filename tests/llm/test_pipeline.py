import random
from collections import Counter

import corpus_pipeline
from loomspan.llm import queries

from .common import frame, odd_rows, prose, words
from .test_jaccard import sets_of
from .test_mixing import expected_targets
from .test_quality import base


def tables(spark, path):
    rng = random.Random(11)
    item = prose(rng, 30, 5000)
    rows = odd_rows() + [(7000, prose(rng, 40) + " " + item + " " + prose(rng, 40), "en", "s", 0)]
    frame(spark, rows, clashing=True).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return rows


def test_each_stage_equals_brute_force(spark, tmp_path):
    rows = tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, out = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        out.append(docs.collect())
        assert k == 4 or docs.columns == columns
    pair = lambda rs: Counter((r[0], r[1]) for r in rs)
    kept = [r for r in rows if not base(r[1])[-1]]
    assert pair(out[0]) == pair(kept)
    left = sets_of(out[1])
    assert not any(len(a & b) >= 0.8 * len(a | b) for i, a in enumerate(left) for b in left[:i])
    for s in sets_of(kept):
        assert any(len(s & x) >= 0.8 * len(s | x) for x in left)
    assert pair(out[2]) == pair(r for r in out[1] if r[0] != 7000)
    _, target = expected_targets(out[2])
    for s, t in target.items():
        mine = [len(words(r[1])) for r in out[3] if r[3] == s]
        assert abs(sum(mine) - t) <= max(len(words(r[1])) for r in out[2] if r[3] == s) / 2 + 1e-6
    assert Counter(r.doc_id for r in out[4]) == Counter(r.doc_id for r in out[3])


def test_run_writes_between_stages_and_queries_are_registered(spark, tmp_path):
    tables(spark, tmp_path)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    names = queries.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(queries.oracle_sql()) <= set(names) and corpus_pipeline.ORACLE_SQL is None


def test_empty_tables_pass(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
