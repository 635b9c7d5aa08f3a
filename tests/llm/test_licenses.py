import random

import pytest

from loomspan.llm import licenses, tokens as tk

from .common import frame, odd_rows, prose


def world():
    rng = random.Random(3)
    rows, want = list(odd_rows()), set()
    for k, (name, text) in enumerate(licenses.TEMPLATES.items()):
        w = text.split()
        if len(w) > 40:
            w[rng.randrange(10, len(w))] = "[owner]"
        rows.append((5000 + k, prose(rng, rng.randrange(0, 300)) + "\n" + " ".join(w).upper() + "\n" + prose(rng, 50), "en", "s", 0))
        want.add((5000 + k, name))
    return rows, want


def test_templates_are_found_in_place_and_nothing_else(spark):
    rows, want = world()
    out = licenses.scan(frame(spark, rows, clashing=True)).collect()
    assert {(r.doc_id, r.license) for r in out} == want
    texts = {r[0]: r[1] for r in rows}
    for r in out:
        w = tk.words(licenses.pa.array([texts[r.doc_id]]), tk.PUNCTUATION, tk.LOWER)
        first = tk.words(licenses.pa.array([licenses.TEMPLATES[r.license]]), tk.PUNCTUATION, tk.LOWER).hash[0]
        assert r.share >= 0.8 and w.hash[r.first_word] == first


def test_containment_equals_brute_force_on_partial_texts():
    rng = random.Random(5)
    index = licenses.build(licenses.TEMPLATES)
    texts = []
    for _ in range(200):
        w = rng.choice(list(licenses.TEMPLATES.values())).split()
        cut = rng.randrange(0, max(1, len(w) // 2))
        texts.append(prose(rng, 20) + " " + " ".join(w[cut:]) + " " + prose(rng, 20))
    words = licenses._words(licenses.pa.array(texts))
    values, at = tk.shingles(words, 5)
    got = {(r, i) for r, i, *_ in licenses.find(words, index)}
    for r in range(len(texts)):
        mine = set(values[at[r] : at[r + 1]].tolist())
        full = {i for i, s in enumerate(index.sets) if len(mine & set(s.tolist())) >= 0.8 * len(s)}
        assert {i for x, i in got if x == r} <= full
        assert bool(full) == any(x == r for x, _ in got)


def test_bands_meet_the_promised_probability():
    assert 1 - (1 - licenses.LEAST) ** licenses.BANDS >= licenses.RECALL


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)], [(1, "Released under", "", "", 0)]])
def test_no_license(spark, rows):
    assert licenses.scan(frame(spark, rows)).count() == 0
