import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomspan.llm import jaccard

from .common import frame, odd_rows, prose, words


def sets_of(rows):
    out = []
    for r in rows:
        w = words(r[1])
        out.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None)
    return out


def brute(rows):
    sets = sets_of(rows)
    link = [[j for j, b in enumerate(sets) if j != i and a and b and len(a & b) >= 0.8 * len(a | b)] for i, a in enumerate(sets)]
    group = list(range(len(rows)))
    for _ in rows:
        group = [min([group[i], *(group[j] for j in link[i])]) for i in range(len(rows))]
    ids = defaultdict(list)
    for i, g in enumerate(group):
        ids[g].append(rows[i][0])
    least = {g: min([x for x in v if x is not None], default=None) for g, v in ids.items()}
    return Counter((rows[i][0], least[g], len(link[i]), len(ids[g])) for i, g in enumerate(group))


def got(df):
    return Counter((r.doc_id, r.class_id, r.n_links, r.class_size) for r in df.collect())


def test_links_and_classes_equal_brute_force(spark):
    rows = odd_rows()
    assert got(jaccard.jaccard_classes(frame(spark, rows, clashing=True))) == brute(rows)


def test_large_groups_are_cut_into_blocks(spark, monkeypatch):
    rng = random.Random(9)
    base = prose(rng, 300).split()
    rows = []
    for i in range(40):
        w = list(base)
        w[rng.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(w), "en", "s", 1))
    monkeypatch.setattr(jaccard, "GROUP_SHINGLES", 2000)
    assert got(jaccard.jaccard_classes(frame(spark, rows))) == brute(rows)


def test_one_of_each_group_stays(spark):
    rows = odd_rows()
    kept = jaccard.one_of_each(frame(spark, rows, clashing=True))
    assert len(kept.columns) == len(frame(spark, rows, clashing=True).columns)
    texts = [(r.doc_id, r.text) for r in kept.collect()]
    sets = sets_of(rows)
    worded = [(i, t) for i, t in texts if words(t)]
    assert len(texts) - len(worded) == sum(s is None for s in sets)
    linked = {c for (_, c, n, _), k in brute(rows).items() if n}
    alone = sum(k for (_, _, n, _), k in brute(rows).items() if not n)
    assert len(texts) == alone + len(linked)
    left = sets_of([(i, t) for i, t in worded])
    assert not any(len(a & b) >= 0.8 * len(a | b) for k, a in enumerate(left) for b in left[:k])
    assert set().union(*left) and {t for _, t in worded} <= {r[1] for r in rows}


def test_depth_shortens_until_the_recall_is_met():
    assert jaccard.prefix_depth(0.8, 24, 6, 0.9) == 6
    assert jaccard.prefix_depth(0.8, 24, 6, 0.9999) == 5
    assert jaccard.prefix_depth(0.2, 4, 6, 0.9999) == 1
    # Few links seen, or unlike ones, call for the threshold's depth; many alike ones for whole labels.
    assert jaccard.needed_depth(0, None) == jaccard.needed_depth(10, 0.99) == jaccard.needed_depth(10_000, 0.8) == 5
    assert jaccard.needed_depth(10_000, 0.95) == 8 and 5 < jaccard.needed_depth(10_000, 0.86) < 8


def test_depth_follows_the_links_of_each_length_and_near_pairs_are_met(spark):
    """Long texts are linked by near copies only: whole labels do. Short ones are linked near the threshold."""
    rng = random.Random(21)
    rows = []
    for i in range(130):
        w = [f"u{rng.randrange(10**9)}" for _ in range(300)]
        rows += [(10 * i, " ".join(w), "en", "s", 1), (10 * i + 1, " ".join([*w[:-1], "other"]), "en", "s", 1)]
    near = []
    for i in range(300):
        w = [f"u{rng.randrange(10**9)}" for _ in range(50)]
        # One word changed in the middle changes five of 46 shingles: similarity 41 / 51; at the end it changes fewer.
        rows += [(100_000 + 10 * i, " ".join(w), "en", "s", 1), (100_001 + 10 * i, " ".join([*w[:20], "other", *w[21:]]), "en", "s", 1)]
        near.append(100_000 + 10 * i)
    searched = []
    docs = frame(spark, rows)
    sketch, links, _ = jaccard.linked(docs, depths=searched)
    assert searched[0] == (jaccard.DEPTH, None) and [d for d, _ in searched][1:] == [5]
    assert 8 not in searched[1][1] and 5 in searched[1][1]  # 296 shingles are of order 8, 46 of order 5
    found = {x.doc_id for x in sketch.join(links, "node").select("doc_id").collect()}
    assert len([x for x in near if x in found]) >= 0.99 * len(near)
    assert all(10 * i in found for i in range(130))


def test_matched_prefixes_of_the_sorted_trie(spark):
    rng = random.Random(3)
    labels = sorted(bytes(b for _ in range(jaccard.DEPTH) for b in (0, rng.randrange(2))) for _ in range(60))
    batches = [pa.RecordBatch.from_pydict({"tree": pa.array([0] * len(x), pa.int32()), "label": pa.array(x, pa.binary())}) for x in (labels[:20], labels[20:21], [], labels[21:])]
    out = [(r["label"], r["matched"]) for b in jaccard._matcher(0)(batches) for r in b.to_pylist()]
    assert [x for x, _ in out] == labels
    for i, (x, n) in enumerate(out[1:-1], 1):
        assert n == max(next((k for k in range(8) if x[2 * k : 2 * k + 2] != y[2 * k : 2 * k + 2]), 8) for y in (labels[i - 1], labels[i + 1]))


def test_rows_of_one_id_and_text_keep_one_whatever_the_layout(spark):
    text = prose(random.Random(4), 30)
    rows = [(1, text, lang, "s", n) for lang in ("en", "fr") for n in (1, 2, None)]
    kept = [jaccard.one_of_each(frame(spark, x)).collect() for x in (rows, rows[::-1])]
    assert len(kept[0]) == 1 and kept[0] == kept[1]
    odd = frame(spark, rows[:1]).withColumn("a.b", F.lit(1)).withColumn("__hash", F.lit(2)).withColumn("whole", F.lit(3)).withColumn("tie", F.create_map(F.lit(1), F.lit(2)))
    out = jaccard.one_of_each(odd)
    assert out.columns == odd.columns and out.collect() == odd.collect()


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)], [(1, "", "", "", 0), (1, "", "", "", 0)]])
def test_nothing_to_link(spark, rows):
    assert jaccard.jaccard_classes(frame(spark, rows)).count() == len(rows)
    assert jaccard.one_of_each(frame(spark, rows)).count() == len(rows)
