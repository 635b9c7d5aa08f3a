"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive words that ignores the positions marked
0, so a substituted word there doesn't hide a copy. Every window of every item
is hashed under every mask; so is every window of every document; where the
hashes meet, item and document are aligned and the overlap is verified word by
word. A document holds a passage of an item if it has ``LEAST_EQUAL`` of the
item's words, or ``LEAST_SHARE`` of them if that is fewer, either in one
alignment (equal words within ``NEAR`` words of a window of ``WINDOW`` words of
which ``LEAST_STRETCH`` are equal) or in the stretches of several (all of those,
+1 for an equal word and -1 for a different one, that have ``LEAST_STRETCH``
equal words). What is missed has no window that a mask fits.

Test and training hashes are joined by lookup: documents are scanned once and
never shuffled. A test side of at most ``BLOCK_WORDS`` words is one index, sent
to the executors. A larger one is cut into blocks of that size, each indexed in
a task of its own and written to the shared folder; executors map the files into
memory. One filter over all blocks (``FILTER_BITS`` bits a window) leaves few
of a document's windows for the blocks, so the blocks' number hardly counts.
Answers are the same.

Words are runs of letters, digits and non-ASCII bytes, A-Z in lower case.
Defined results: null or empty texts match nothing. Items of fewer than
``SHORT_WORDS`` words match only whole and unchanged; items without words never
match. Items of equal text count as one, under the least item_id, of any type
that a string can be cast to and back. A repeated document is reported as often
as it occurs.
"""

from __future__ import annotations

import json
import math
import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm import tokens as tk
from loomspan.llm.eliasfano import save
from loomspan.llm.rows import packed
from loomspan.llm.storage import local_folder

#: Weight 5: one substitution anywhere within six words, and two within seven to nine, leave a hit of some mask.
MASKS = ("11111", "101111", "110111", "111011", "111101", "1110011", "1100111", "10110101", "101001011")
LEAST_EQUAL, LEAST_SHARE, LEAST_STRETCH, SHORT_WORDS, SIDE = 13, 0.8, 5, 8, 4
#: The longest mask; equal words so near to a window of that length count with it.
WINDOW, NEAR = 9, 32
BLOCK_WORDS = 500_000
_FILTER_BITS = 22
#: Bits of the filter over all blocks for each window of the test side, at least.
FILTER_BITS = 16
_WORD = r"[A-Za-z0-9\x{80}-\x{10FFFF}]+"


@dataclass
class Index:
    """The items of one block: their words, and their windows by hash for each seed."""

    ids: list
    words: np.ndarray
    first: np.ndarray
    seeds: list[tuple[int, ...]]
    keys: list[np.ndarray]
    item: list[np.ndarray]
    place: list[np.ndarray]
    maybe: list[np.ndarray]


def _window_hashes(hashes: np.ndarray, kept: tuple[int, ...]) -> np.ndarray:
    size = max(len(hashes) - kept[-1], 0)
    out = np.full(size, len(kept) * 977 + kept[-1], np.uint64)
    for k, p in enumerate(kept):
        out += hashes[p : p + size] * tk._STEP[k % 64]
    return tk.mix(out)


def _words(column: pa.Array) -> tk.Words:
    return tk.words(column, tk.PUNCTUATION, tk.LOWER)


#: An item of fewer words than SHORT_WORDS has one seed: all its words.
SEEDS = [tuple(i for i, c in enumerate(mask) if c == "1") for mask in MASKS] + [tuple(range(n)) for n in range(1, SHORT_WORDS)]


def build(ids: list, texts: list[str]) -> Index:
    w = _words(pa.array(texts, pa.large_string()))
    counts = w.counts
    seeds, spans = SEEDS, [s[-1] + 1 for s in SEEDS]
    index = Index(ids, w.hash, w.first, seeds, [], [], [], [])
    row = np.repeat(np.arange(len(counts)), counts)
    for k, (kept, span) in enumerate(zip(seeds, spans)):
        h = _window_hashes(w.hash, kept)
        start = np.arange(len(h))
        owner = row[: len(h)]
        fits = start + span <= w.first[owner + 1]
        fits &= (counts[owner] >= SHORT_WORDS) if k < len(MASKS) else (counts[owner] == span)
        h, start, owner = h[fits], start[fits], owner[fits]
        order = np.argsort(h, kind="stable")
        maybe = np.zeros(1 << _FILTER_BITS if len(h) else 0, bool)
        maybe[h >> tk.U(64 - _FILTER_BITS)] = True
        index.keys.append(h[order])
        index.item.append(owner[order])
        index.place.append(start[order] - w.first[owner[order]])
        index.maybe.append(maybe)
    return index


Hits = list[tuple[int, np.ndarray, np.ndarray]]  # (seed, windows of the text that may be in the index, their hashes)


def _hits(w: tk.Words, maybe: Callable[[int, np.ndarray], np.ndarray]) -> Hits:
    hits = []
    for k, kept in enumerate(SEEDS):
        h = _window_hashes(w.hash, kept)
        at = maybe(k, h)
        if len(at):
            hits.append((k, at, h[at]))
    return hits


def _in_index(index: Index) -> Callable[[int, np.ndarray], np.ndarray]:
    def maybe(k: int, h: np.ndarray) -> np.ndarray:
        return np.flatnonzero(index.maybe[k][h >> tk.U(64 - _FILTER_BITS)]) if len(index.keys[k]) else np.zeros(0, np.int64)

    return maybe


def _matches(w: tk.Words, index: Index, hits: Hits | None = None) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item, equal words, length and first word of what they share) for each verified pair of row and item."""
    found = []
    for k, at, h in _hits(w, _in_index(index)) if hits is None else hits:
        if not len(index.keys[k]):
            continue
        low, high = np.searchsorted(index.keys[k], h, "left"), np.searchsorted(index.keys[k], h, "right")
        row = np.searchsorted(w.first, at, "right") - 1
        good = (high > low) & (at + SEEDS[k][-1] < w.first[row + 1])
        at, low, n, row = at[good], low[good], (high - low)[good], row[good]
        ends = np.cumsum(n)
        if not len(ends):
            continue
        entry = np.arange(ends[-1]) - np.repeat(ends - n - low, n)
        found.append(np.stack([np.repeat(row, n), index.item[k][entry], np.repeat(at - w.first[row], n) - index.place[k][entry]], 1))
    if not found:
        return
    best: dict[tuple[int, int], tuple[set[int], int, int]] = {}  # of stretches
    alone: dict[tuple[int, int], tuple[set[int], int, int]] = {}  # of alignments that hold a passage by themselves
    for r, i, shift in np.unique(np.concatenate(found), axis=0).tolist():
        item = index.words[index.first[i] : index.first[i + 1]]
        doc = w.hash[w.first[r] : w.first[r + 1]]
        a, b = max(0, -shift), min(len(item), len(doc) - shift)
        equal = item[a:b] == doc[a + shift : b + shift]
        least = min(len(item), LEAST_STRETCH)
        if equal.sum() < least:
            continue
        # Words inserted or left out shift the alignment; equal words of its parts count together.
        for begin, end in _stretches(equal, least):
            begin, end = max(0, begin - SIDE), min(b - a, end + SIDE)
            _add(best, (r, i), np.flatnonzero(equal[begin:end]) + begin + a, shift)
        at = _near(equal, least)
        if len(at) >= _needed(len(item)):
            _add(alone, (r, i), at + a, shift)
    for r, i in best.keys() | alone.keys():
        n = int(index.first[i + 1] - index.first[i])
        same, start, end = best.get((r, i), (set(), 0, 0))
        if (r, i) in alone:
            more, low, high = alone[r, i]
            start, end = (min(low, start), max(high, end)) if same else (low, high)
            same = same | more
        if len(same) >= _needed(n):
            yield r, i, len(same), end - start, start


def _needed(n: int) -> int:
    return n if n < SHORT_WORDS else min(LEAST_EQUAL, math.ceil(n * LEAST_SHARE))


def _add(to: dict, pair: tuple[int, int], words: np.ndarray, shift: int) -> None:
    """Add equal words of an item, and the span of the document that they are in."""
    held, low, high = to.get(pair, (set(), int(words[0]) + shift, 0))
    to[pair] = held | set(words.tolist()), min(low, int(words[0]) + shift), max(high, int(words[-1]) + shift + 1)


def _stretches(equal: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """Every stretch of ``least`` equal words: from where the sum (+1 equal, -1 different) leaves its floor to its peak."""
    if equal.all():
        yield 0, len(equal)
        return
    sums = np.concatenate([[0], np.cumsum(np.where(equal, 1, -1))])
    rise = sums - np.minimum.accumulate(sums)
    floor = np.flatnonzero(rise == 0)
    for begin, after in zip(floor.tolist(), [*floor[1:].tolist(), len(rise)]):
        if after - begin > least:
            end = begin + int(rise[begin:after].argmax())
            if equal[begin:end].sum() >= least:
                yield begin, end


def _near(equal: np.ndarray, least: int) -> np.ndarray:
    """The equal words that are near a window with ``least`` equal words."""
    if equal.all():
        return np.arange(len(equal))
    size = min(WINDOW, len(equal))
    sums = np.concatenate([[0], np.cumsum(equal)])
    dense = np.flatnonzero(sums[size:] - sums[:-size] >= least)
    edges = np.zeros(len(equal) + 1, np.int64)
    np.add.at(edges, np.maximum(dense - NEAR, 0), 1)
    np.add.at(edges, np.minimum(dense + size + NEAR, len(equal)), -1)
    return np.flatnonzero(equal & (np.cumsum(edges[:-1]) > 0))


@dataclass(frozen=True)
class Blocks:
    """An index in files: the blocks, and the bits of a place in the filter over all of them, for each seed that has windows."""

    folder: str
    blocks: tuple[int, ...]
    bits: tuple[tuple[int, int], ...]

    def open(self, name: str) -> np.ndarray:
        return np.load(f"{self.folder}/{name}.npy", mmap_mode="r").view(np.ndarray)

    def index(self, b: int) -> Index:
        """A block, mapped; its windows are looked for by the filter over all blocks only."""
        if (self, b) not in _opened:
            per_seed = [[self.open(f"{b}-{k}-{part}") for k in range(len(SEEDS))] for part in ("keys", "item", "place")]
            ids = json.loads(self.open(f"{b}-ids").tobytes())
            _opened[self, b] = Index(ids, self.open(f"{b}-words"), self.open(f"{b}-first"), SEEDS, *per_seed, [])
        return _opened[self, b]

    def maybe(self, k: int, h: np.ndarray) -> np.ndarray:
        bits = dict(self.bits).get(k)
        if bits is None:
            return np.zeros(0, np.int64)
        if (self, "filter", k) not in _opened:
            _opened[self, "filter", k] = self.open(f"filter-{k}")
        slot = h >> tk.U(64 - bits)
        return np.flatnonzero(_opened[self, "filter", k][(slot >> tk.U(3)).astype(np.int64)] >> (slot & tk.U(7)).astype(np.uint8) & 1)


_opened: dict = {}  # of this worker


def _saved(items: DataFrame, n: int) -> Blocks:
    """Builds and writes n blocks, each in a task, and then the filter of each seed in a task."""
    spark = items.sparkSession
    folder = f"{local_folder(spark)}/seeds-{uuid.uuid4().hex}"
    os.makedirs(folder)

    def block(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        b, table = key[0].as_py(), table.sort_by([("item_id", "ascending"), ("text", "ascending")])
        index = build([], table.column("text").to_pylist())
        save(f"{folder}/{b}-ids", np.frombuffer(json.dumps(table.column("item_id").to_pylist()).encode(), np.uint8))
        save(f"{folder}/{b}-words", index.words)
        save(f"{folder}/{b}-first", index.first)
        for k in range(len(SEEDS)):
            for part, values in (("keys", index.keys[k]), ("item", index.item[k].astype(np.int32)), ("place", index.place[k].astype(np.int32))):
                save(f"{folder}/{b}-{k}-{part}", values)
        size = [len(x) for x in index.keys]
        return pa.table({"block": pa.array([b] * len(size), pa.int32()), "seed": pa.array(range(len(size)), pa.int32()), "n": pa.array(size, pa.int64())})

    dealt = items.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(n)).cast("int"))
    got = dealt.groupBy("block").applyInArrow(block, "block int, seed int, n bigint").collect()  # figures of each block
    there = tuple(sorted({g.block for g in got}))
    windows = {k: sum(g.n for g in got if g.seed == k) for k in range(len(SEEDS))}
    bits = {k: max(_FILTER_BITS, (FILTER_BITS * m - 1).bit_length()) for k, m in windows.items() if m}
    index = Blocks(folder, there, tuple(bits.items()))

    def filtered(batches):
        for batch in batches:
            for k in batch.column("id").to_pylist():
                marks = np.zeros(1 << bits[k] - 3, np.uint8)
                for b in there:
                    slot = index.open(f"{b}-{k}-keys") >> tk.U(64 - bits[k])
                    np.bitwise_or.at(marks, (slot >> tk.U(3)).astype(np.int64), tk.U(1).astype(np.uint8) << (slot & tk.U(7)).astype(np.uint8))
                save(f"{folder}/filter-{k}", marks)
            yield batch

    spark.createDataFrame([(k,) for k in bits], "id int").repartition(max(1, len(bits))).mapInArrow(filtered, "id int").count()
    return index


def indexed(benchmark: DataFrame, most_words: int = BLOCK_WORDS) -> Callable[[tk.Words], Iterator[tuple[str, int, int, int, int, int]]]:
    """A function from words to (item_id as text, row, item, equal words, length, first word) for each match."""
    items = benchmark.where("text is not null").groupBy("text").agg(F.min("item_id").cast("string").alias("item_id"))
    items = items.where(F.col("text").rlike("[A-Za-z0-9\\x{80}-\\x{10FFFF}]")).select("item_id", "text")
    total = items.agg(F.sum(F.regexp_count("text", F.lit(_WORD)))).first()[0] or 0
    if total <= most_words:
        part = items.orderBy("item_id", "text").collect()
        shared = benchmark.sparkSession.sparkContext.broadcast(build([r.item_id for r in part], [r.text for r in part]))

        def one(w):
            for match in _matches(w, shared.value):
                yield shared.value.ids[match[1]], *match

        return one
    saved = _saved(items, -(-2 * total // most_words))  # half full on average, as hashes deal unevenly

    def all_blocks(w):
        hits = _hits(w, saved.maybe)
        for b in saved.blocks if hits else ():
            index = saved.index(b)
            for match in _matches(w, index, hits):
                yield index.ids[match[1]], *match

    return all_blocks


def passages(docs: DataFrame, benchmark: DataFrame, most_words: int = BLOCK_WORDS) -> DataFrame:
    """A row for each document and item whose passage it holds: doc_id, item_id, n_equal, n_span, first_word."""
    matches = indexed(benchmark, most_words)

    def scan(batches):
        for batch in batches:
            for part in tk.slices(batch):
                got = sorted(matches(_words(part.column("text"))), key=lambda g: (g[1], g[0] or ""))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array([g[1] for g in got], pa.int64())), pa.array([g[0] for g in got], pa.string()),
                        *(pa.array([g[i] for g in got], pa.int64()) for i in (3, 4, 5)),
                    ],
                    ["doc_id", "item_id", "n_equal", "n_span", "first_word"],
                )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    out = rows.mapInArrow(scan, "doc_id bigint, item_id string, n_equal bigint, n_span bigint, first_word bigint")
    return out.withColumn("item_id", F.col("item_id").cast(benchmark.schema["item_id"].dataType))


def clean_documents(docs: DataFrame, benchmark: DataFrame, most_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents that hold no passage, with all their columns."""
    matches = indexed(benchmark, most_words)

    def scan(batches):
        for batch in batches:
            for part in tk.slices(batch):
                bad = {g[1] for g in matches(_words(part.column("text")))}
                kept = part.filter(pa.array([i not in bad for i in range(part.num_rows)], pa.bool_())) if bad else part
                yield kept.select(["whole"])

    rows = docs.select(packed(docs).alias("whole"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(scan, rows.select("whole").schema).select("whole.*")
