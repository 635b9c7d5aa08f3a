"""Elias-Fano sequences: monotone 64-bit numbers in about 2 + log2(universe / n) bits each.

The low bits of each number are packed side by side; the high bits are unary in
a bit string, with a directory of the zeros before every 512 bits. Access and
successor search are vectorised over whole arrays of queries. A sequence is
four arrays, so it can be saved as plain files and memory-mapped; or the
sequences of many shards are joined in one file and asked all at once, each
query naming its shard, so that neither open files nor steps grow with the shards.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

import numpy as np

U = np.uint64
SAMPLE, BLOCK = 32, 512
_FULL = U((1 << 57) - 1)
_BYTE_SELECT = np.zeros((8, 256), np.int64)  # place of the k-th one in a byte
for _b in range(256):
    for _k, _i in enumerate(i for i in range(8) if _b >> i & 1):
        _BYTE_SELECT[_k, _b] = _i


def _select_in(w: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th one of each 64-bit word."""
    place = np.zeros(len(w), np.uint64)
    k = k.astype(np.uint8)
    for width in (32, 16, 8):
        ones = np.bitwise_count(w & U((1 << width) - 1))
        go = k >= ones
        k = k - ones * go
        step = go * U(width)
        place += step
        w = w >> step
    return place.astype(np.int64) + _BYTE_SELECT[k, (w & U(255)).astype(np.uint8)]


def _unaligned(data: np.ndarray) -> np.ndarray:
    """The 64-bit words that begin at each byte."""
    return np.lib.stride_tricks.as_strided(data.view("<u8")[:1], (len(data) - 7,), (1,))


class EliasFano:
    """Monotone numbers; equal neighbours are allowed."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, directory: np.ndarray, blocks: np.ndarray):
        self.n, self.bits, self.low, self.high, self.directory, self.blocks = n, bits, low, high, directory, blocks
        self._low, self._high = _unaligned(low), _unaligned(high)
        self._mask, self._most = U((1 << bits) - 1), None

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.ascontiguousarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = min(56, max(0, (top // max(n, 1)).bit_length() - 1))
        low = np.zeros(-(-n * bits // 64) * 8 + 16, np.uint8)
        if bits and n:
            for a in range(0, n, 1 << 18):  # a multiple of 8 numbers fills whole bytes
                part = values[a : a + (1 << 18)]
                got = np.packbits(np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :bits].ravel(), bitorder="little")
                low[a * bits // 8 : a * bits // 8 + len(got)] = got
        ups = (values >> U(bits)).astype(np.int64)
        size = n + (top >> bits) + 2
        marks = np.zeros(-(-size // BLOCK) * BLOCK + 4 * BLOCK, bool)  # zeros enough at the end
        marks[ups + np.arange(n)] = True
        zeros = np.flatnonzero(~marks)[::SAMPLE]
        kind = np.uint32 if len(marks) < 1 << 32 else np.uint64
        high = np.packbits(marks, bitorder="little")
        ones = np.bitwise_count(high.view("<u8").reshape(-1, BLOCK // 64)).sum(1, dtype=np.int64)
        blocks = np.arange(len(ones)) * BLOCK - np.concatenate([[0], np.cumsum(ones[:-1])])
        return cls(n, bits, low, high, zeros.astype(kind), blocks.astype(kind))

    def values(self) -> np.ndarray:
        """All numbers."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        return ((ones - np.arange(self.n)).astype(np.uint64) << U(self.bits)) | self._lows(np.arange(self.n))

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.bits
        return (self._low[at >> 3] >> (at & 7).astype(np.uint64)) & self._mask

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero of the high bits."""
        at = self.directory[k // SAMPLE].astype(np.int64)
        left = (k % SAMPLE).astype(np.int64)
        active = np.arange(len(k))
        for jump in range(2):
            active = self._scan(at, left, active, 2 if jump == 0 else 1 << 30, True)
            if not len(active):
                break
            block = np.searchsorted(self.blocks, k[active].astype(self.blocks.dtype), "right") - 1
            at[active] = block * BLOCK
            left[active] = k[active] - self.blocks[block].astype(np.int64)
        return at

    def _scan(self, at: np.ndarray, left: np.ndarray, active: np.ndarray, rounds: int, zero: bool) -> np.ndarray:
        """Moves ``at`` on to the place of the left-th zero (or one) from there, by 57 bits a round; what isn't there yet."""
        while len(active) and rounds:
            here = at[active]
            word = self._high[here >> 3] >> (here & 7).astype(np.uint64)
            word = (~word if zero else word) & _FULL
            n = np.bitwise_count(word)
            done = n > left[active]
            last = active[done]
            at[last] = here[done] + _select_in(word[done], left[last])
            active = active[~done]
            at[active] += 57
            left[active] -= n[~done]
            rounds -= 1
        return active

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        """The numbers at places i."""
        i = np.asarray(i, np.int64)
        ones = np.arange(len(self.blocks)) * BLOCK - self.blocks.astype(np.int64)  # before each block
        block = np.searchsorted(ones, i, "right") - 1
        at, left = block * BLOCK, i - ones[block]
        self._scan(at, left, np.arange(len(i)), 1 << 30, False)
        return ((at - i).astype(np.uint64) << U(self.bits)) | self._lows(i)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each x the first place whose number is at least x (n if there is none), and whether it equals x."""
        x = np.asarray(x, np.uint64)
        if not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        if self._most is None:
            self._most = U(self[np.array([self.n - 1])][0])
        inside = x <= self._most
        h = np.where(inside, x >> U(self.bits), U(0)).astype(np.int64)
        before = np.zeros(len(x), np.int64)  # the bit after the zero that ends the bucket before
        some = h > 0
        before[some] = self._zero(h[some] - 1) + 1
        low = before - h
        # The bucket's numbers are the ones up to the next zero.
        run = ~(self._high[before >> 3] >> (before & 7).astype(np.uint64))
        length = np.bitwise_count((run & (U(0) - run)) - U(1)).astype(np.int64)
        far = length >= 57
        length[far] = self._zero(h[far]) - before[far]
        high = low + length
        want = x & self._mask
        # Bisect the buckets together; those that are done drop out.
        active = np.flatnonzero(low < high)
        while len(active):
            middle = (low[active] + high[active]) >> 1
            less = self._lows(middle) < want[active]
            low[active] = np.where(less, middle + 1, low[active])
            high[active] = np.where(less, high[active], middle)
            active = active[low[active] < high[active]]
        low[~inside] = self.n
        # A bucket may end before x; then the next number, in a later bucket, is the successor.
        equal = inside & (low < before - h + length)
        equal[equal] = self._lows(low[equal]) == want[equal]
        return low, equal

    def save(self, stem: str) -> None:
        for name in ("low", "high", "directory", "blocks"):
            save(f"{stem}.{name}", getattr(self, name))
        save(f"{stem}.shape", np.array([self.n, self.bits]))

    @classmethod
    def mapped(cls, stem: str) -> EliasFano:
        n, bits = np.load(f"{stem}.shape.npy").tolist()
        return cls(n, bits, *(np.load(f"{stem}.{name}.npy", mmap_mode="r").view(np.ndarray) for name in ("low", "high", "directory", "blocks")))

    def nbytes(self) -> int:
        return self.low.nbytes + self.high.nbytes + self.directory.nbytes + self.blocks.nbytes

    def dump(self) -> bytes:
        """One byte string, for a shuffle."""
        head = np.array([self.n, self.bits, len(self.low), len(self.high)], np.int64)
        return head.tobytes() + self.low.tobytes() + self.high.tobytes()

    @staticmethod
    def parse(blob: bytes) -> np.ndarray:
        """The numbers of a dumped sequence."""
        n, bits, a, b = np.frombuffer(blob, np.int64, 4).tolist()
        low, high = np.frombuffer(blob, np.uint8, a, 32).copy(), np.frombuffer(blob, np.uint8, b, 32 + a).copy()
        return EliasFano(n, bits, low, high, np.zeros(1, np.int64), np.zeros(1, np.int64)).values()


def _write(path: str, put: Callable) -> None:
    """The file whole or not at all, so a task that is run again or twice does no harm."""
    temporary = f"{path}.{os.getpid()}.{os.urandom(4).hex()}.tmp"
    with Path(temporary).open("wb") as f:
        put(f)
    os.replace(temporary, path)


def save(stem: str, array: np.ndarray) -> None:
    """Writes stem.npy."""
    _write(f"{stem}.npy", lambda f: np.save(f, array))


#: Bytes at which arrays of a shard begin, and shards of a joined file.
_ALIGN, _PAGE = 64, 4096
#: Queries handled at once, so that what is computed for them stays near.
_CHUNK = 1 << 15
#: Columns of a sequence in the table of the shards; those of an array are its place.
_COLUMNS = ("n", "bits", "most", "low", "high", "directory", "blocks", "n_blocks")
_PLACES = ("low", "high", "directory", "blocks")
#: The parts of a shard in order: arrays have a type, sequences None.
Layout = dict[str, str | None]


def _columns(layout: Layout) -> list[tuple[str, bool]]:
    """Names of the columns of a shard's figures, and whether they are places in its file; the last is the size of the file."""
    out = []
    for name, kind in layout.items():
        out += [(name, True)] if kind else [(f"{name}.{c}", c in _PLACES) for c in _COLUMNS]
    return [*out, ("size", False)]


def save_shard(path: str, layout: Layout, **parts: EliasFano | np.ndarray) -> list[int]:
    """Writes the parts of a shard into one file. Its figures for ``joined``."""
    arrays, figures, size = [], [], 0

    def put(array: np.ndarray) -> int:
        nonlocal size
        arrays.append(array)
        at, size = size, size + -(-array.nbytes // _ALIGN) * _ALIGN
        return at

    for name, kind in layout.items():
        part = parts[name]
        if kind:
            figures.append(put(np.ascontiguousarray(part, kind)))
            continue
        if part.blocks.dtype != np.uint32:
            raise ValueError(f"{part.n} numbers are too many for one shard; use smaller shards")
        most = part[np.array([part.n - 1])] if part.n else np.zeros(1, np.uint64)
        figures += [part.n, part.bits, int(most.view(np.int64)[0]), *(put(getattr(part, x)) for x in _PLACES), len(part.blocks)]

    def write(f):
        for array in arrays:
            f.write(array.tobytes())
            f.write(bytes(-array.nbytes % _ALIGN))

    _write(path, write)
    return [*figures, size]


def joined(layout: Layout, figures: list[list[int] | None]) -> tuple[np.ndarray, np.ndarray, int]:
    """For shards with these figures (None: nothing in it): the table of ``Joined``, where each shard begins in the joined file, and the size of that."""
    columns = _columns(layout)
    table = np.array([f or [0] * len(columns) for f in figures], np.int64).reshape(-1, len(columns))
    ends = np.cumsum(-(-table[:, -1] // _PAGE) * _PAGE)
    begin = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    for c, (_, place) in enumerate(columns):
        if place:
            table[:, c] += begin
    return table, begin, int(ends[-1]) + _PAGE


class Sequences:
    """One sequence of each shard of a joined file."""

    def __init__(self, data: np.ndarray, figures: dict[str, np.ndarray]):
        self.n, self.bits, self.n_blocks = figures["n"], figures["bits"], figures["n_blocks"]
        self.most, self.shift = figures["most"].view(np.uint64), self.bits.astype(np.uint64)
        self.mask = (U(1) << self.shift) - U(1)
        self.low, self.high = figures["low"] * 8, figures["high"] * 8  # in bits
        self.directory, self.blocks = figures["directory"] // 4, figures["blocks"] // 4
        self._high, self._fours = _unaligned(data), data.view("<u4")

    _scan = EliasFano._scan

    def _block(self, low: np.ndarray, high: np.ndarray, s: np.ndarray, k: np.ndarray, zero: bool) -> tuple[np.ndarray, np.ndarray]:
        """The last block, from ``low`` to before ``high``, with at most k zeros (or ones) before it, and how many those are."""
        begin = self.blocks[s]
        active = np.flatnonzero(high - low > 1)
        while len(active):
            middle = (low[active] + high[active]) >> 1
            here = self._fours[begin[active] + middle].astype(np.int64)
            go = (here if zero else middle * BLOCK - here) <= k[active]
            low[active[go]] = middle[go]
            high[active[~go]] = middle[~go]
            active = active[high[active] - low[active] > 1]
        before = self._fours[begin + low].astype(np.int64)
        return low, before if zero else low * BLOCK - before

    def _zero(self, s: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Place in the file, in bits, of the k-th zero of the high bits."""
        begin, sample = self.high[s], self.directory[s] + k // SAMPLE
        at = self._fours[sample] + begin
        left = k % SAMPLE
        active = self._scan(at, left, np.arange(len(k)), 2, True)
        if len(active):
            # It is between two samples; what follows the last one of a sequence is 0.
            sample, t, k = sample[active], s[active], k[active]
            low, high = (self._fours[sample + d].astype(np.int64) // BLOCK for d in (0, 1))
            high = np.where(self._fours[sample + 1] > self._fours[sample], high + 1, self.n_blocks[t])
            block, before = self._block(low, high, t, k, True)
            at[active] = begin[active] + block * BLOCK
            left[active] = k - before
            self._scan(at, left, active, 1 << 30, True)
        return at

    def _lows(self, low: np.ndarray, bits: np.ndarray, mask: np.ndarray, i: np.ndarray) -> np.ndarray:
        at = low + i * bits
        return (self._high[at >> 3] >> (at & 7).astype(np.uint64)) & mask

    def at(self, s: np.ndarray, i: np.ndarray) -> np.ndarray:
        """The numbers at places i of the sequences s."""
        block, before = self._block(np.zeros(len(i), np.int64), self.n_blocks[s], s, i, False)
        high = self.high[s]
        at, left = high + block * BLOCK, i - before
        self._scan(at, left, np.arange(len(i)), 1 << 30, False)
        return ((at - high - i).astype(np.uint64) << self.shift[s]) | self._lows(self.low[s], self.bits[s], self.mask[s], i)

    def successor(self, s: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As of one sequence, for each x in the sequence s."""
        place, equal = self.n[s], np.zeros(len(x), bool)
        for a in range(0, len(x), _CHUNK):
            part = slice(a, a + _CHUNK)
            inside = a + np.flatnonzero((place[part] > 0) & (x[part] <= self.most[s[part]]))
            place[inside], equal[inside] = self._inside(s[inside], x[inside])
        return place, equal

    def _inside(self, s: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bits, begin, lows, mask = self.bits[s], self.high[s], self.low[s], self.mask[s]
        h = (x >> self.shift[s]).astype(np.int64)
        before = begin.copy()  # the bit after the zero that ends the bucket before
        some = np.flatnonzero(h)
        before[some] = self._zero(s[some], h[some] - 1) + 1
        first = before - begin - h
        # The bucket's numbers are the ones up to the next zero.
        run = ~(self._high[before >> 3] >> (before & 7).astype(np.uint64))
        length = np.bitwise_count((run & (U(0) - run)) - U(1)).astype(np.int64)
        far = np.flatnonzero(length >= 57)
        length[far] = self._zero(s[far], h[far]) - before[far]
        low, end = first.copy(), first + length
        high, want = end.copy(), x & mask
        # Bisect the buckets together; those that are done drop out.
        active = np.flatnonzero(low < high)
        while len(active):
            middle = (low[active] + high[active]) >> 1
            less = self._lows(lows[active], bits[active], mask[active], middle) < want[active]
            low[active[less]] = middle[less] + 1
            high[active[~less]] = middle[~less]
            active = active[low[active] < high[active]]
        equal = low < end
        equal[equal] = self._lows(lows[equal], bits[equal], mask[equal], low[equal]) == want[equal]
        return low, equal


class Joined:
    """The parts of many shards side by side in one mapped file."""

    def __init__(self, path: str, layout: Layout, table: np.ndarray):
        data = np.memmap(path, np.uint8, "r").view(np.ndarray)
        figures = {name: np.ascontiguousarray(table[:, c]) for c, (name, _) in enumerate(_columns(layout))}
        self.sequences = {x: Sequences(data, {c: figures[f"{x}.{c}"] for c in _COLUMNS}) for x, kind in layout.items() if not kind}
        self.arrays = {x: data.view(kind) for x, kind in layout.items() if kind}
        self.begin = {x: figures[x] // np.dtype(kind).itemsize for x, kind in layout.items() if kind}

    def values(self, name: str, s: np.ndarray, i: np.ndarray) -> np.ndarray:
        """What is at places i of the array ``name`` of the shards s."""
        return self.arrays[name][self.begin[name][s] + i]
