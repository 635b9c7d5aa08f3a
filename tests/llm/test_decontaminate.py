import random

import pyarrow as pa
import pytest

from loomspan.llm import decontaminate as d

from .common import frame, odd_rows, prose

ITEMS = "item_id bigint, text string"


def world(seed=1):
    rng = random.Random(seed)
    items = [(i, prose(rng, rng.randrange(15, 50), 5000)) for i in range(30)] + [(100, None), (101, ""), (102, "only three words"), (103, "only three words"), (104, "a, b! c?")]
    rows, want = list(odd_rows()), set()
    for k, (i, text) in enumerate(items[:30]):
        w = text.split()
        for p in random.Random(k).sample(range(len(w)), len(w) // 6 if k % 2 else 0):
            w[p] = f"changed{p}"
        if k % 3 == 0:
            w.insert(len(w) // 2, "inserted")
        rows.append((2000 + k, prose(rng, 40, 5000) + " " + "".join(c.upper() if c.isascii() else c for c in " ".join(w)) + "! " + prose(rng, 30, 5000), "en", "s", 0))
        want.add((2000 + k, i))
    rows += [(3000, "they said only three words. then", "en", "s", 0), (3001, "only three other words", "en", "s", 0), (3002, "A b - c", "en", "s", 0)]
    return items, rows, want | {(3000, 102), (3002, 104)}


@pytest.mark.parametrize("block", [d.BLOCK_WORDS, 200, 30])
def test_planted_passages_are_found_and_nothing_else(spark, block):
    items, rows, want = world()
    docs, bench = frame(spark, rows, clashing=True), spark.createDataFrame(items, ITEMS)
    got = {(r.doc_id, r.item_id) for r in d.passages(docs, bench, block).collect()}
    assert got == want
    clean = d.clean_documents(docs, bench, block)
    assert clean.columns == docs.columns
    assert clean.count() == len(rows) - len({x for x, _ in want})


def brute(doc, item, seeds):
    """Every alignment, word by word."""
    for shift in range(-len(item) + 1, len(doc)):
        equal = [0 <= j + shift < len(doc) and doc[j + shift] == item[j] for j in range(len(item))]
        if sum(equal) >= min(d.LEAST_EQUAL, -(-4 * len(item) // 5)):
            return True
    return False


def test_substitutions_are_tolerated_as_by_brute_force():
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(3000)]
    found = wanted = 0
    for _ in range(150):
        item = rng.choices(vocabulary, k=rng.randrange(20, 40))
        copy = list(item)
        for p in rng.sample(range(len(item)), len(item) // 5):
            copy[p] = "other"
        doc = rng.choices(vocabulary, k=30) + copy + rng.choices(vocabulary, k=30)
        index = d.build([1], [" ".join(item)])
        got = bool(list(d._matches(d._words(pa.array([" ".join(doc)])), index)))
        wanted += brute(doc, item, index.seeds)
        found += got and brute(doc, item, index.seeds)
    assert wanted > 140 and found >= 0.98 * wanted


def seeded(doc, item):
    """Whether a mask fits an alignment that has enough equal words."""
    for shift in range(-len(item) + 1, len(doc)):
        equal = [0 <= j + shift < len(doc) and doc[j + shift] == item[j] for j in range(len(item))]
        if sum(equal) >= min(d.LEAST_EQUAL, -(-4 * len(item) // 5)) and any(
            all(equal[p + k] for k, c in enumerate(m) if c == "1") for m in d.MASKS for p in range(len(item) - len(m) + 1)
        ):
            return True
    return False


def held(doc, item):
    return bool(list(d._matches(d._words(pa.array([" ".join(doc)])), d.build([1], [" ".join(item)]))))


@pytest.mark.parametrize("rate", [0.2, 0.25, 0.3, 0.35])
def test_nothing_is_lost_in_verification(rate):
    rng = random.Random(int(rate * 100))
    vocabulary = [f"v{i}" for i in range(3000)]
    wanted = with_seed = 0
    for _ in range(300):
        item = rng.choices(vocabulary, k=rng.randrange(15, 26))
        copy = [w if rng.random() >= rate else "other" for w in item]
        doc = rng.choices(vocabulary, k=20) + copy + rng.choices(vocabulary, k=20)
        wanted += brute(doc, item, None)
        if seeded(doc, item):
            with_seed += 1
            assert held(doc, item)
        elif not brute(doc, item, None):
            assert not held(doc, item)
    assert wanted >= 20 and with_seed >= (1 if rate == 0.2 else 0.97) * wanted


@pytest.mark.parametrize("put_in", range(9, 16))
def test_a_middle_that_is_replaced(put_in):
    item = [f"v{i}" for i in range(36)]
    assert held(["a"] * 10 + item[:12] + ["other"] * put_in + item[24:] + ["b"] * 10, item)
    assert not held(["a"] * 10 + item[:6] + ["other"] * put_in + item[30:] + ["b"] * 10, item)


@pytest.mark.parametrize("kind", ["smallint", "string", "decimal(10,2)", "date"])
@pytest.mark.parametrize("block", [d.BLOCK_WORDS, 20])
def test_items_of_any_type_and_documents_of_any_columns(spark, kind, block):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    ids = {"smallint": "7", "string": "é'7", "decimal(10,2)": "7.25", "date": "2024-02-29"}
    bench = spark.createDataFrame([(ids[kind], text), (ids[kind], text + " " + prose(random.Random(1), 30))], "item_id string, text string")
    bench = bench.withColumn("item_id", bench.item_id.cast(kind))
    docs = frame(spark, [(1, "x " + text, "en", "s", 0), (2, "y", "en", "s", 0)]).withColumn("a.b", d.F.lit(1)).withColumn("whole", d.F.lit(2))
    got = d.passages(docs, bench, block).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, bench.first().item_id)}
    clean = d.clean_documents(docs, bench, block)
    assert clean.columns == docs.columns and [r.doc_id for r in clean.collect()] == [2]


@pytest.mark.parametrize("items", [[], [(1, None)], [(1, " "), (2, "!!")]])
def test_no_items(spark, items):
    bench = spark.createDataFrame(items, ITEMS)
    assert d.passages(frame(spark), bench).count() == 0
    assert d.clean_documents(frame(spark), bench).count() == len(odd_rows())
    assert d.passages(frame(spark, []), spark.createDataFrame([(1, "a b c")], ITEMS)).count() == 0
