import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspan.llm import tokens as tk
from loomspan.llm.eliasfano import EliasFano

from .common import lower, odd_rows, words


def test_words_are_those_of_the_pattern_and_hash_by_value():
    texts = [r[1] for r in odd_rows()]
    w = tk.words(pa.array(texts, pa.string()), tk.BLANKS, tk.LOWER)
    assert w.counts.tolist() == [len(words(t)) for t in texts]
    flat = [x for t in texts for x in words(lower(t))]
    by_word: dict = {}
    for x, h in zip(flat, w.hash.tolist()):
        assert by_word.setdefault(x, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_long_texts_hash_like_short_ones(monkeypatch):
    text = " ".join(f"word{i}" for i in range(5000))
    whole = tk.words(pa.array([text])).hash
    monkeypatch.setattr(tk, "SLICE_BYTES", 300)
    assert (tk.words(pa.array([text])).hash == whole).all()
    batch = pa.RecordBatch.from_arrays([pa.array([text, "", None, "x y", text])], ["text"])
    assert sum(p.num_rows for p in tk.slices(batch)) == 5


def test_shingles_stay_within_rows():
    texts = ["a b c d e f", "", None, "a b", "a b", "b a", "a b c d e"]
    values, at = tk.shingles(tk.words(pa.array(texts)), 5)
    rows = [values[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
    assert [len(r) for r in rows] == [2, 0, 0, 1, 1, 1, 1]
    assert rows[3] == rows[4] != rows[5] and rows[6][0] == rows[0][0]
    assert tk.shingles(tk.words(pa.array(texts)), 5, short=False)[1].tolist() == [0, 2, 2, 2, 2, 2, 2, 3]


@pytest.mark.parametrize("n,top", [(0, 1), (1, 0), (1, 2**63), (100, 20), (5000, 2**44), (3000, 2**64 - 1)])
def test_elias_fano_round_trip(n, top, tmp_path):
    rng = np.random.default_rng(3)
    v = np.sort(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
    e = EliasFano.of(v)
    e.save(str(tmp_path / "x"))
    for x in (e, EliasFano.mapped(str(tmp_path / "x"))):
        assert (x.values() == v).all() and (x[np.arange(n)] == v).all()
        q = np.concatenate([v, rng.integers(0, top, 500, dtype=np.uint64, endpoint=True), np.array([0, top], np.uint64)])
        place, equal = x.successor(q)
        assert (place == np.searchsorted(v, q)).all() and (equal == np.isin(q, v)).all()
    assert (EliasFano.parse(e.dump()) == v).all()


def test_elias_fano_with_clusters_is_compact():
    rng = np.random.default_rng(4)
    v = np.unique(np.concatenate([rng.integers(0, 2**40, 20000, dtype=np.uint64), np.arange(2**30, 2**30 + 20000, dtype=np.uint64)]))
    e = EliasFano.of(v)
    q = np.concatenate([v, v + np.uint64(1)])
    assert (e.successor(q)[0] == np.searchsorted(v, q)).all()
    assert e.nbytes() < 5 * len(v)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2**50), max_size=200))
def test_elias_fano_any_numbers(numbers):
    v = np.sort(np.array(numbers, np.uint64))
    assert (EliasFano.of(v).values() == v).all()
