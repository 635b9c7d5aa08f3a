"""Word kernels over whole Arrow text columns.

Every function here works on the raw UTF-8 buffer of a batch with numpy, so no
Python loop runs per word. A word is a run of bytes other than the separators;
it never crosses from one row to the next. Null text counts as empty text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text handled at once; only a single longer row goes beyond it.
SLICE_BYTES = 4 << 20
_RNG = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * U(2) + U(1)
_powers: dict[int, np.ndarray] = {}

#: Space and the control characters from tab to carriage return.
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
#: Every ASCII byte that is neither a letter nor a digit.
PUNCTUATION = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(base: int, n: int) -> np.ndarray:
    if len(_powers.get(base, ())) < n:
        steps = np.full(1 << (n - 1).bit_length(), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return _powers[base][:n]


@dataclass
class Words:
    """Words of a slice: those of row r are first[r] to first[r + 1]."""

    hash: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column, offsets from 0."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def slices(batch: pa.RecordBatch, text: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of about ``size`` bytes of text."""
    _, at = buffers(batch.column(text))
    begin = 0
    while begin < batch.num_rows:
        end = int(np.searchsorted(at, at[begin] + size, "right")) - 1
        end = max(begin + 1, min(end, batch.num_rows))
        yield batch.slice(begin, end - begin)
        begin = end


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + SLICE_BYTES, "right")))
        low, high = int(start[i]), int(end[j - 1])
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTE[data[low:high]] * _power(_BASE, high - low), out=sums[1:])
        a = start[i:j] - low
        out[i:j] = (sums[end[i:j] - low] - sums[a]) * _power(_INVERSE, high - low + 1)[a]
        i = j
    return mix(out)


def words(column: pa.Array, blank: np.ndarray = BLANKS, table: np.ndarray | None = None) -> Words:
    """Words of every row with a 64-bit hash of each word's (mapped) bytes."""
    data, at = buffers(column)
    if table is not None:
        data = table[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), np.zeros(len(at), np.int64), none, none)
    inside = ~blank[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[at[:-1][at[:-1] < len(data)]] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[at[1:][at[1:] > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(_hashes(data, start, end), np.searchsorted(start, at), start, end)


def shingles(w: Words, n: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles in order, and the row offsets into them.

    A row of one to n - 1 words has a single shingle of all its words if
    ``short``, else none; a row without words has none.
    """
    counts = w.counts
    full = np.maximum(counts - n + 1, 0)
    total = np.where((counts > 0) & (full == 0), int(short), full)
    at = np.concatenate([[0], np.cumsum(total)])
    if not at[-1]:
        return np.zeros(0, np.uint64), at
    size = max(len(w.hash) - n + 1, 0)
    rolled = np.zeros(size, np.uint64)
    for k in range(n):
        rolled += w.hash[k : k + size] * _STEP[k]
    out = np.empty(at[-1], np.uint64)
    row = np.repeat(np.arange(len(counts)), total)
    place = np.arange(at[-1]) - at[:-1][row] + w.first[:-1][row]
    whole = full[row] > 0
    out[whole] = mix(rolled[place[whole]])
    for r in np.flatnonzero((counts > 0) & (full == 0)) if short else ():
        h = w.hash[w.first[r] : w.first[r + 1]]
        out[at[r]] = mix((h * _STEP[: len(h)]).sum(dtype=np.uint64, keepdims=True) ^ U(len(h)))[0]
    return out, at


def row_sets(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of each row sorted and without repeats, and their offsets."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    values = values.copy()
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    values, row = values[new], row[new]
    return values, np.searchsorted(row, np.arange(len(at)))


def row_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of each row, wrapping for unsigned values; 0 for an empty row."""
    sums = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])
    return sums[at[1:]] - sums[at[:-1]]


def row_minima(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Least value of each row; the largest value of the type for an empty row."""
    out = np.full(len(at) - 1, np.iinfo(values.dtype).max, values.dtype)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        out[some] = np.minimum.reduceat(values, at[:-1][some])
    return out
