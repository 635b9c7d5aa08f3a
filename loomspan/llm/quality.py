"""Quality rules: a learned decision list over text statistics.

The statistics and the verdict are native column expressions. The list is
learned by sequential covering: from labelled documents a rule (a conjunction
of thresholds) is grown for the bad class by information gain on two thirds of
the rows, pruned on the last third, kept if it is precise, and the rows it
covers are removed; then the next one is grown. The rules become one ordered
conditional expression, "reject if rule 1, else if rule 2, ..., else keep".

The learner runs on a sample of at most ``SAMPLE_ROWS`` labelled documents
(those with the least hash of doc_id, whatever the size of the table); all
statistics, and the verdict, cover all documents and whole texts.

Defined results: null text has no words and fails the base rules. Labels that
are null, or for documents that don't exist, are not used; with no labels, or
of one class only, the list is empty and the base rules decide alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm.rows import packed

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
LEAST_WORDS, MOST_REPEATED_PERCENT = 20, 30

SAMPLE_ROWS = 20_000
MAX_RULES, MAX_CONDITIONS, LEAST_PRECISION, LEAST_COVER = 16, 4, 0.95, 5
#: What the rules may use; each is a ratio or a count that is never null.
FEATURES = ("n_words", "mean_word", "symbols_per_word", "dup_line_share", "repeat_share", "capital_share", "distinct_share")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(windows: Column) -> Column:
    """Words in windows that occur twice or more, each word once."""

    def over(s: Column) -> Column:
        def shared(e: Column, i: Column) -> Column:
            return F.coalesce(F.get(s, i - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False))

        places = F.array_sort(F.transform(F.filter(s, shared), lambda e: e["i"]))
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"))
        return F.aggregate(places, start, step, lambda a: a["n"])

    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), let(ordered, over)).otherwise(0)


def statistics(text: Column) -> Column:
    """A struct of the base statistics and of those that only the rules use."""

    def of(t: Column) -> Column:
        def counted(w: Column) -> Column:
            n = F.size(w)
            windows = F.when(
                n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, F.lit(WINDOW))))
            ).otherwise(F.array().cast("array<bigint>"))
            # String sets hash their items; the statistics of a text take time in proportion to its length.
            return F.struct(
                n.cast("bigint").alias("n_words"),
                let(windows, _covered).cast("bigint").alias("n_repeat_words"),
                F.size(F.array_distinct(w)).cast("bigint").alias("n_distinct"),
            )

        def lined(lines: Column) -> Column:
            return F.struct(
                (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"), F.size(lines).cast("bigint").alias("n_lines")
            )

        return F.struct(
            let(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), counted).alias("w"),
            let(F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)), lined).alias("l"),
            F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("bigint").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
            (F.length(t) - F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("bigint").alias("n_capitals"),
        )

    return let(F.coalesce(text, F.lit("")), of)


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep``, the statistics, base_failed, and the features of the rules."""
    s = docs.select(*keep, statistics(F.col("text")).alias("s")).select(*keep, "s.w.*", "s.l.*", "s.word_chars", "s.n_symbols", "s.n_capitals")
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return s.select(
        "*", failed.alias("base_failed"), (F.col("word_chars") / words).alias("mean_word"), (F.col("n_symbols") / words).alias("symbols_per_word"),
        (F.col("n_dup_lines") / lines).alias("dup_line_share"), (F.col("n_repeat_words") / words).alias("repeat_share"),
        (F.col("n_capitals") / F.greatest("word_chars", F.lit(1))).alias("capital_share"), (F.col("n_distinct") / words).alias("distinct_share"),
    )


@dataclass(frozen=True)
class Rule:
    """Holds if every (feature, above, threshold) holds: above > threshold, or else feature <= threshold."""

    conditions: tuple[tuple[str, bool, float], ...]

    def mask(self, x: dict[str, np.ndarray]) -> np.ndarray:
        held = np.ones(len(next(iter(x.values()))), bool)
        for name, above, at in self.conditions:
            held &= (x[name] > at) if above else (x[name] <= at)
        return held

    def column(self) -> Column:
        held = F.lit(True)
        for name, above, at in self.conditions:
            held = held & ((F.col(name) > at) if above else (F.col(name) <= at))
        return held

    def __str__(self) -> str:
        return " and ".join(f"{n} {'>' if up else '<='} {at:.6g}" for n, up, at in self.conditions)


def _best(x: dict[str, np.ndarray], bad: np.ndarray, inside: np.ndarray) -> tuple[float, tuple[str, bool, float] | None]:
    """The condition with the most information gain for the bad rows inside."""
    p0, n0 = int(bad[inside].sum()), int((~bad[inside]).sum())
    base = np.log2(p0 / (p0 + n0))
    best: tuple[float, tuple[str, bool, float] | None] = (0.0, None)
    for name in FEATURES:
        v, y = x[name][inside], bad[inside]
        order = np.argsort(v, kind="stable")
        v, y = v[order], y[order]
        ends = np.flatnonzero(v[1:] != v[:-1])  # a cut lies between two different values
        low_p, low_n = np.cumsum(y)[ends], np.cumsum(~y)[ends]
        for above, p, n in ((False, low_p, low_n), (True, p0 - low_p, n0 - low_n)):
            gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1e-9) / np.maximum(p + n, 1)) - base), -1.0)
            if len(gain) and gain.max() > best[0] + 1e-9:
                k = int(gain.argmax())
                best = (float(gain[k]), (name, above, float((v[ends[k]] + v[ends[k] + 1]) / 2)))
    return best


def learn(x: dict[str, np.ndarray], bad: np.ndarray) -> list[Rule]:
    """An ordered decision list for the bad class, by sequential covering. Row order decides the growing and pruning parts."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    third = np.arange(len(bad)) % 3 == 2
    while len(rules) < MAX_RULES and (bad & left).sum() >= LEAST_COVER:
        grow, prune = left & ~third, left & third
        inside, conditions = grow.copy(), []
        while len(conditions) < MAX_CONDITIONS and bad[inside].any() and not bad[inside].all():
            _, found = _best(x, bad, inside)
            if found is None:
                break
            conditions.append(found)
            inside = grow & Rule(tuple(conditions)).mask(x)
        candidates = [Rule(tuple(conditions[: k + 1])) for k in range(len(conditions))]
        if not candidates:
            break

        def worth(rule: Rule) -> float:
            held = rule.mask(x) & prune
            p, n = int(bad[held].sum()), int((~bad[held]).sum())
            return (p - n) / (p + n) if p + n else -1.0

        rule = max(candidates, key=worth)  # the shortest of the best
        held = rule.mask(x) & left
        if bad[held].sum() < LEAST_COVER or bad[held].mean() < LEAST_PRECISION:
            rule = candidates[-1]
            held = rule.mask(x) & left
            if bad[held].sum() < LEAST_COVER or bad[held].mean() < LEAST_PRECISION:
                break
        rules.append(rule)
        left &= ~held
    return rules


def learned_rules(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The decision list for the labelled documents (quality 0 is bad)."""
    known = labels.where("doc_id is not null and quality is not null").select("doc_id", "quality")
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)  # bounded, so it may be broadcast
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    got = (
        measured(chosen, "doc_id", "quality").select("doc_id", "quality", "base_failed", *FEATURES)
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality", *FEATURES).limit(rows).collect()
    )
    # Spark would push this filter, and with it the statistics, below the join to all documents.
    got = [r for r in got if not r.base_failed]
    bad = np.array([r.quality == 0 for r in got], bool)
    if not bad.any() or bad.all():
        return []
    return learn({f: np.array([float(r[f]) for r in got]) for f in FEATURES}, bad)


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that holds (from 1), 0 if none does."""
    out = F.lit(0)
    if rules:
        out = F.when(rules[0].column(), 1)
        for i, rule in enumerate(rules[1:], 2):
            out = out.when(rule.column(), i)
        out = out.otherwise(0)
    return out


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each document: doc_id, the base statistics, base_failed, rule (that rejects it, 0: none) and kept."""
    m = measured(docs, "doc_id").withColumn("rule", verdict(learned_rules(docs, labels)))
    return m.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule",
    )


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns."""
    rules = learned_rules(docs, labels)
    m = measured(docs.select(packed(docs).alias("whole"), "text"), "whole").withColumn("rule", verdict(rules))
    return m.where(~F.col("base_failed") & (F.col("rule") == 0)).select("whole.*")
