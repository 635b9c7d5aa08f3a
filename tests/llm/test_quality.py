import random
from collections import Counter

import numpy as np
import pytest

from loomspan.llm import quality

from .common import WORD, frame, odd_rows, prose, words

LABELS = "doc_id bigint, quality int, toxic int"


def base(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if n[tuple(w[i : i + 8])] > 1 for k in range(8)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def texts_with_repeats():
    rng = random.Random(2)
    p = prose(rng, 30)
    return [p + " " + p, p + "\n" + p + "\n\n" + p, "a " * 40, "a b c d e f g h " * 2, p + " x " + p[:60], "### $$ | < > &\n###\n", "a\r\nb\ra\n", "\x0b\x0c\x1c x " * 30]


def test_base_statistics_equal_brute_force(spark):
    rows = odd_rows() + [(1000 + i, t, "en", "s", 0) for i, t in enumerate(texts_with_repeats())]
    out = quality.quality(frame(spark, rows, clashing=True), spark.createDataFrame([], LABELS)).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out)
    assert got == Counter((r[0], *base(r[1])) for r in rows)
    assert all(r.kept == (not r.base_failed) and r.rule == 0 for r in out)  # nothing learned


def labelled(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(300):
        good = i % 4 != 0
        text = prose(rng, rng.randrange(30, 90))
        rows.append((i, text if good else " ".join(w + "##" for w in text.split()), "en", "s", 0))
        labels.append((i, int(good), 0))
    return frame(spark, rows, clashing=True), spark.createDataFrame([*labels, (None, 1, 0), (5, None, 0), (9999, 0, 0)], LABELS)


def test_rules_are_learned_and_applied(spark):
    docs, labels = labelled(spark)
    rules = quality.learned_rules(docs, labels)
    assert rules and all(rules)
    out = quality.quality(docs, labels).collect()
    assert all(r.kept == (r.doc_id % 4 != 0) for r in out)
    kept = quality.kept_documents(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in out if r.kept}


def test_rules_don_t_depend_on_partitioning_and_respect_the_sample_bound(spark):
    docs, labels = labelled(spark)
    assert quality.learned_rules(docs, labels) == quality.learned_rules(docs.repartition(7), labels.repartition(5))
    assert quality.learned_rules(docs, labels, rows=60)


def test_covering_needs_more_than_one_rule():
    rng = np.random.default_rng(1)
    x = {f: rng.random(3000) for f in quality.FEATURES}
    bad = (x["mean_word"] > 0.8) | ((x["repeat_share"] < 0.2) & (x["capital_share"] > 0.5))
    rules = quality.learn(x, bad)
    said = np.zeros(3000, bool)
    for r in rules:
        said |= r.mask(x)
    assert len(rules) >= 2 and (said == bad).mean() > 0.98


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, 0, 0)]])
def test_without_two_classes_the_base_rules_decide(spark, labels):
    assert quality.learned_rules(frame(spark), spark.createDataFrame(labels, LABELS)) == []
    assert quality.quality(frame(spark, []), spark.createDataFrame(labels, LABELS)).count() == 0


def test_odd_column_names_stay(spark):
    docs = frame(spark).withColumn("a.b", quality.F.lit(1)).withColumn("whole", quality.F.lit(2)).withColumn("__all", quality.F.lit(3))
    kept = quality.kept_documents(docs, spark.createDataFrame([], LABELS))
    assert kept.columns == docs.columns and kept.count() == sum(not base(r[1])[-1] for r in odd_rows())
