import math
import os
import random
import resource
import zlib
from collections import Counter

import pytest

from loomspan.llm import ngram

from .common import frame, lower, odd_rows, words


def brute(rows):
    tokens = [[*words(lower(r[1])), None] for r in rows]
    key = ["" if r[0] is None else str(r[0]) for r in rows]
    train = [t for t, k in zip(tokens, key) if zlib.crc32(k.encode()) % 10]
    c1 = Counter(w for t in train for w in t)
    c2 = Counter(x for t in train for x in zip(t, t[1:]))
    c3 = Counter(x for t in train for x in zip(t, t[1:], t[2:]))
    s2, k2, s3, k3 = Counter(), Counter(), Counter(), Counter()
    for (a, b), c in c2.items():
        s2[a] += c
        k2[a] += 1
    for (a, b, _), c in c3.items():
        s3[a, b] += c
        k3[a, b] += 1
    n, v = sum(c1.values()), len(c1)
    out = []
    for r, k, t in zip(rows, key, tokens):
        base = score = 0.0
        for i, w in enumerate(t):
            p = (c1[w] + 0.1) / (n + 0.1 * (v + 1))
            base += math.log10(p)
            if i and s2[t[i - 1]]:
                a = t[i - 1]
                p = max(c2[a, w] - 0.75, 0) / s2[a] + 0.75 * k2[a] / s2[a] * p
            if i > 1 and s3[t[i - 2], t[i - 1]]:
                a = (t[i - 2], t[i - 1])
                p = max(c3[(*a, w)] - 0.75, 0) / s3[a] + 0.75 * k3[a] / s3[a] * p
            score += math.log10(p)
        out.append((r[0], zlib.crc32(k.encode()) % 10 == 0, len(t), sum(c1[w] > 0 for w in t), n, base, score))
    return out


def near(x):
    return (x[0] is not None, x[0] or 0, x[2], round(x[5], 6))


def hot_rows():
    """One word is half of all tokens, and one pair a quarter."""
    rng = random.Random(17)
    return [(i, " ".join(w for _ in range(40) for w in ("the", rng.choice(["same", f"w{rng.randrange(60)}"]))), "en", "s", 0) for i in range(60)]


@pytest.mark.parametrize("shard_bytes,pack,hot", [(1 << 24, 64, False), (2000, 64, False), (800, 64, True), (800, 8, True), (1 << 24, 64, True)])
def test_scores_equal_brute_force_up_to_quantisation(spark, shard_bytes, pack, hot):
    rows = odd_rows() + hot_rows() if hot else odd_rows()
    docs = frame(spark, rows, clashing=True)
    model = ngram.fit(docs, shard_bytes=shard_bytes, pack=pack)
    t = ngram.Trie(model)
    assert (t.pairs.parts.max() > 1 and t.triples.parts.max() > 1) == (hot and shard_bytes == 800)
    got = sorted([tuple(r) for r in ngram.score(docs, model).collect()], key=near)
    want = sorted(brute(rows), key=near)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], abs=1e-6)
        assert abs(g[6] - w[6]) <= ngram.STEP * 0.51 * g[2]


def test_context_helps_on_held_out_text(spark):
    rows = [(i, "the quick brown fox jumps over the lazy dog again and again", "en", "s", 1) for i in range(60)]
    out = ngram.fitted_scores(frame(spark, rows)).where("held_out").collect()
    assert out and all(r.score > r.base_score + 5 for r in out)


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)], [(4, "a b", "en", "s", 3)] * 2])
def test_little_or_nothing_to_learn_from(spark, rows):
    out = ngram.fitted_scores(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    if rows and rows[0][0] is None:
        assert out[0].train_tokens == 0 and out[0].score == 0 == out[0].base_score


def test_cuts_are_even_and_keys_fit_or_fail():
    import numpy as np

    lo, parts, span = ngram.Cuts.at([0, 10, 20], {12: (100, 50)}, 25, 30)
    assert lo.tolist() == [0, 10, 12, 12, 12, 12, 13, 20] and parts.tolist() == [1, 1, 4, 4, 4, 4, 1, 1]
    cuts = ngram.Cuts(lo, parts, span, 30, 50, 64)
    context, item = np.repeat(np.arange(30), 50), np.tile(np.arange(50), 30)
    shard = cuts.of(context, item)
    assert (np.diff(shard) >= 0).all() and np.bincount(shard).tolist() == [500, 100, 13, 12, 13, 12, 350, 500]
    for pack in (64, 4):
        cuts = ngram.Cuts(lo, parts, span, 30, 50, pack)
        joined = cuts.join(context, item)
        assert len(np.unique(joined)) == 1500 and (cuts.keys.split(np.sort(joined))[0] == shard).all() and cuts.keys.packs == (pack == 64)
    with pytest.raises(ValueError):
        ngram.Keys(8, 1 << 64)


def test_no_probability_is_out_of_reach():
    for most in (1, 10**6, 10**9, 10**12):
        step = ngram.step_for(most)
        p = (1 - ngram.DISCOUNT) / most
        code = int(ngram.codes(ngram.np.array([p]), step)[0])
        assert abs(math.log10(10 ** (-step * (code - 1)) / p)) <= 0.51 * step <= 0.03


def test_more_shards_than_files_may_be_open(spark):
    import numpy as np
    import pyarrow as pa

    rows = odd_rows() + hot_rows()
    model = ngram.fit(frame(spark, rows), shard_bytes=800)
    free = 40
    before = resource.getrlimit(resource.RLIMIT_NOFILE)
    held = set(map(int, os.listdir("/proc/self/fd")))
    resource.setrlimit(resource.RLIMIT_NOFILE, (max(held) + free, before[1]))
    try:
        t = ngram.Trie(model)
        assert len(t.first) + len(t.pairs.lo) + len(t.triples.lo) > 5 * free
        h, at = ngram.tokens(pa.array([r[1] for r in rows], pa.string()))
        score = np.add.reduceat(ngram.log_probabilities(t, h, at)[2], at[:-1])
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, before)
    for n, got, want in zip(np.diff(at), score, brute(rows)):
        assert abs(got - want[6]) <= ngram.STEP * 0.51 * n
