import zlib
from collections import Counter, defaultdict

import pytest

from loomspan.llm import sharding

from .common import frame, odd_rows


def check(rows, out, shards):
    size = [len((r[1] or "").encode()) + 1 for r in rows]
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((r[0], s, zlib.crc32((r[1] or "").encode())) for r, s in zip(rows, size))
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r)
    for n, mine in by.items():
        assert 0 <= n < shards and sorted(r.slot for r in mine) == list(range(len(mine)))
    if rows:
        largest, even = max(size), sum(size) / shards
        for n in range(shards):
            assert abs(sum(r.size for r in by[n]) - even) <= largest + 2 * sharding.HOLD * even + 2


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards_are_even_and_slots_gapless(spark, shards):
    rows = odd_rows()
    check(rows, sharding.shard(frame(spark, rows, clashing=True), shards).collect(), shards)


def test_a_large_group_of_copies_is_cut_and_small_ones_are_held_together(spark):
    rows = [(i, "the same text", "en", "s", 1) for i in range(3000)] + [(10_000 + i, f"text {i // 2} " * 3, "en", "s", 1) for i in range(4000)]
    out = sharding.shard(frame(spark, rows)).collect()
    check(rows, out, 8)
    texts = {r[0]: r[1] for r in rows}
    homes = defaultdict(set)
    for r in out:
        homes[texts[r.doc_id]].add(r.shard)
    assert len(homes.pop("the same text")) > 1
    assert all(len(h) == 1 for h in homes.values())


def test_reruns_agree_and_shards_are_contiguous(spark):
    rows = odd_rows()
    a = sorted((r.doc_id is None, r.doc_id or 0, r.text_crc32, r.shard, r.slot) for r in sharding.shard_digest(frame(spark, rows)).collect())
    b = sorted((r.doc_id is None, r.doc_id or 0, r.text_crc32, r.shard, r.slot) for r in sharding.shard_digest(frame(spark, rows[::-1]).repartition(2)).collect())
    assert a == b
    assert set(sharding.shard_digest(frame(spark, rows)).columns) == {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}


def test_layout_equals_brute_force(spark):
    """Places, sizes and shards by sorting all rows at once; hashes of texts taken from Spark."""
    rows = odd_rows()
    docs = frame(spark, rows)
    hashed = docs.select("doc_id", "text", sharding.F.xxhash64(sharding.F.coalesce("text", sharding.F.lit(""))).alias("h")).collect()
    order = sorted(((r.h, zlib.crc32((r.text or "").encode()), r.doc_id is not None, r.doc_id or 0, len((r.text or "").encode()) + 1) for r in hashed))
    total, end, want = sum(r[-1] for r in order), 0, []
    even = [2 * total * k / 8 for k in range(1, 8)]
    for h, crc, known, doc_id, size in order:
        end += size
        want.append((doc_id if known else None, crc, sum(2 * end - size >= c for c in even)))
    out = sharding.shard(docs, hold=0.0).orderBy("shard", "slot").collect()
    assert [(r.doc_id, r.text_crc32, r.shard) for r in out] == want


def test_documents_keep_their_columns_and_rows(spark):
    rows = odd_rows() + [(7, "the same", lang, "s", n) for lang in ("en", "fr") for n in range(50)] + [(None, "x", None, None, None)] * 500
    docs = frame(spark, rows, clashing=True).withColumn("a.b", sharding.F.lit(1)).withColumn("whole", sharding.F.lit(2))
    out = sharding.sharded_documents(docs)
    assert out.columns == [*docs.columns, "shard_", "slot_"]
    assert Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in out.collect()) == Counter(rows)
    assert {r.shard_ for r in out.select("shard_").distinct().collect()} <= set(range(8))


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)], [(1, "a", "", "", 0)] * 3])
def test_fewer_documents_than_shards(spark, rows):
    assert sharding.shard_digest(frame(spark, rows)).count() == len(rows)
