"""Language-model scoring with an Elias-Fano n-gram trie.

The model is an interpolated trigram model with absolute discounting over the
training documents (those whose crc32 of doc_id as text, modulo 10, isn't 0).
Its trie has three levels:

1. the words, as the sorted sequence of their 64-bit hashes; a word's id is its
   place. Each word has its count, the weight of its back-off, and a monotone
   pointer to its successors in level 2.
2. word pairs, as a monotone sequence of (first word, second word) keys. Each
   has a quantised probability and, as a context, a quantised back-off weight.
3. triples, each as (place of its first pair, the third word's rank among the
   successors of the second), the context-relative form: ranks are far smaller
   than ids. Each has a quantised probability.

All sequences are Elias-Fano coded and looked up by successor search. Levels are
cut into shards of about as many tokens, each built in one task from counts that
were summed before the shuffle. The shards of a level are then joined in one
plain file in the shared folder, with a table of where each is. Words are cut by their hash, pairs and triples at the words and pairs
that the shards of the level above begin with; a word or pair that has more
tokens than a shard (``SHARD_TOKENS``) is cut further, at even steps of what may
follow it. A shard's keys are relative to its first context and packed with the
shard's number into 64 bits, or side by side if they don't fit. Executors
memory-map the levels; the driver sees a few figures for each shard, and puts
them into the folder as well.

Tokens are words (A-Z in lower case) and one end for each text. Weights and
probabilities are kept in steps of ``STEP`` of their decimal logarithm, or, if
the most frequent word asks for it, in wider ones that reach the least
probability.

Defined results: null text has the end only. A null doc_id is read as the empty
text and so is held out. With no training document every token has probability
1 (a vocabulary of the unknown word alone). Repeated rows count as often as they
occur.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import tokens as tk
from loomspan.llm.eliasfano import EliasFano, Joined, Layout, joined, save, save_shard
from loomspan.llm.storage import local_folder

U = np.uint64
HELD_OUT = 10
ADDED = 0.1
DISCOUNT = 0.75
#: Text of a shard's training documents, about.
SHARD_BYTES = 16 << 20
#: Keys that a task sums before it sends them.
SUMMED_KEYS = 6_000_000
END = tk.mix(np.array([0x0E0D], np.uint64))[0]
STEP = 0.03
#: Bytes of text for each token that a shard may have, about; a word or pair with more tokens than that is cut.
TOKEN_BYTES = 8
_CACHE_BITS = 20
#: What a shard of each level holds.
WORDS: Layout = {"words": None, "counts": "<i8"}
PAIRS: Layout = {"pairs": None, "starts": None, "pair_p": "u1", "weights": "u1"}
TRIPLES: Layout = {"triples": None, "triple_p": "u1", "pair_w": "u1"}


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % HELD_OUT == 0


def step_for(most: int) -> float:
    """The step at which no probability is out of reach, with ``most`` tokens after one context at most."""
    return max(STEP, math.log10(max(most, 1) / (1 - DISCOUNT)) / 253)


def codes(p: np.ndarray, step: float = STEP) -> np.ndarray:
    """Quantised probabilities: 1 to 255; 0 means none."""
    with np.errstate(divide="ignore"):
        steps = np.rint(-np.log10(p) / step)
    return np.where(p > 0, np.clip(steps, 0, 254) + 1, 0).astype(np.uint8)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all rows, each with its end, and the row offsets."""
    w = tk.words(column, tk.BLANKS, tk.LOWER)
    at = w.first + np.arange(len(w.first))
    out = np.empty(at[-1], np.uint64)
    end = np.zeros(len(out), bool)
    end[at[1:] - 1] = True
    out[end], out[~end] = END, w.hash
    return out, at


@dataclass(frozen=True)
class Model:
    """Where the levels are, and the figures that all tasks need; what grows with the shards is in the folder."""

    folder: str
    bits: int  # words have 2 ** bits shards
    levels: int = 0  # that exist
    n_words: int = 0
    n_tokens: int = 0
    degree: int = 1  # one more than the most successors of a word
    step: float = STEP
    pack: int = 64  # bits of a packed key


class Keys:
    """Shard and key as one sortable value: packed if both fit, else side by side."""

    def __init__(self, shards: int, most: int, pack: int = 64):
        self.shift = int(most).bit_length()
        self.packs = self.shift + (shards - 1).bit_length() <= pack
        if self.shift > 64:
            raise ValueError(f"keys up to {most} don't fit into 64 bits; use smaller shards")

    def join(self, shard: np.ndarray, key: np.ndarray) -> np.ndarray:
        if self.packs:
            return key if self.shift >= 64 else (shard.astype(np.uint64) << U(self.shift)) | key
        out = np.empty(len(key), [("shard", "<u8"), ("key", "<u8")])
        out["shard"], out["key"] = shard, key
        return out

    def split(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.packs:
            return keys["shard"].astype(np.int64), keys["key"]
        if self.shift >= 64:
            return np.zeros(len(keys), np.int64), keys
        return (keys >> U(self.shift)).astype(np.int64), keys & U((1 << self.shift) - 1)


class Cuts:
    """Shards of (context, item) keys. Shard s begins at context lo[s]; a context with parts[s] > 1 has as many shards, each a share of the items up to span[s]."""

    def __init__(self, lo: np.ndarray, parts: np.ndarray, span: np.ndarray, end: int, width: int, pack: int):
        self.lo, self.parts, self.span, self.width = lo, parts, span, width
        self.contexts = np.maximum(np.diff(np.append(lo, end)), 1)
        self.keys = Keys(len(lo), int(self.contexts.max()) * width - 1, pack)
        self.cut = bool((parts > 1).any())

    @staticmethod
    def at(begins: list[int], hot: dict[int, tuple[int, int]], most: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """lo, parts and span for shards that begin at ``begins`` and a shard of its own, or several, for each hot context (its tokens and items)."""
        rows = []
        for c in sorted({*begins, *hot, *(c + 1 for c in hot if c + 1 < end)}):
            n, items = hot.get(c, (0, 1))
            k = max(1, min(-(-n // most), items))
            rows += [(c, k, items)] * k
        return tuple(np.array(x, np.int64) for x in zip(*rows))

    def of(self, context: np.ndarray, item: np.ndarray | int) -> np.ndarray:
        shard = np.searchsorted(self.lo, context, "right") - 1
        if self.cut:
            many = np.flatnonzero(self.parts[shard] > 1)
            last = shard[many]
            some = item[many] if isinstance(item, np.ndarray) else item
            shard[many] = last - (self.parts[last] - 1) + some * self.parts[last] // self.span[last]
        return shard

    def join(self, context: np.ndarray, item: np.ndarray) -> np.ndarray:
        shard = self.of(context, item)
        return self.keys.join(shard, ((context - self.lo[shard]) * self.width + item).astype(np.uint64))


class Trie:
    """The levels that exist so far, each one memory-mapped file with the tables of its shards."""

    def __init__(self, model: Model):
        self.m = model
        self.level = {x: Joined(f"{model.folder}/{x}.joined", layout, self._table(f"{x}_shards")) for x, layout in self._layouts()}
        self.value = np.concatenate([[0.0], 10.0 ** (-model.step * np.arange(255))])
        self.first = self._table("first") if model.levels else np.zeros(1, np.int64)
        self.pairs = self._cuts("pairs", model.n_words, model.n_words) if model.levels and model.n_words else None
        if model.levels > 1:
            self.base, self.hot_word, self.hot_start, self.hot_weight = (self._table(x) for x in ("base", "hot_word", "hot_start", "hot_weight"))
            self.triples = self._cuts("triples", int(self.base[-1]), model.degree)
        if model.levels > 2:
            self.hot_pair, self.hot_pair_weight = self._table("hot_pair"), self._table("hot_pair_weight")
        slots = 1 << _CACHE_BITS
        self.key, self.id = np.zeros(slots, np.uint64), np.full(slots, -1, np.int64)
        self.count, self.start, self.weight = np.zeros(slots, np.int64), np.zeros(slots, np.int64), np.zeros(slots, np.uint8)

    def _table(self, name: str) -> np.ndarray:
        return np.load(f"{self.m.folder}/{name}.npy", mmap_mode="r").view(np.ndarray)

    def _layouts(self) -> list[tuple[str, Layout]]:
        built = self.m.levels if self.m.n_words else 0
        return [("words", WORDS), ("pairs", PAIRS), ("triples", TRIPLES)][:built]

    def _cuts(self, level: str, end: int, width: int) -> Cuts:
        return Cuts(*(self._table(f"{level}_{x}") for x in ("lo", "parts", "span")), end, width, self.m.pack)

    def shard_of(self, h: np.ndarray) -> np.ndarray:
        return (h >> U(64 - self.m.bits)).astype(np.int64) if self.m.bits else np.zeros(len(h), np.int64)

    def successors(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the first pair of each word, the weight of its back-off, and the number of its successors."""
        level, s = self.level["pairs"], self.pairs.of(ids, 0)
        local, sequence = ids - self.pairs.lo[s], level.sequences["starts"]
        begin = sequence.at(s, local).astype(np.int64)
        starts, weights = begin + self.base[s], level.values("weights", s, local)
        degrees = sequence.at(s, local + 1).astype(np.int64) - begin
        if len(self.hot_word):
            place = np.minimum(np.searchsorted(self.hot_word, ids), len(self.hot_word) - 1)
            hot = np.flatnonzero(self.hot_word[place] == ids)
            starts[hot], weights[hot], degrees[hot] = self.hot_start[place[hot]], self.hot_weight[place[hot]], self._table("hot_degree")[place[hot]]
        return starts, weights, degrees

    def words(self, h: np.ndarray, whole: bool) -> tuple[np.ndarray, ...]:
        """id (-1 if unknown) and count of each token, and if ``whole`` its first successor and its back-off weight."""
        slot = (h >> U(64 - _CACHE_BITS)).astype(np.int64)
        missing = np.unique(h[(self.key[slot] != h)])
        got = {}
        if len(missing):
            ids, counts = np.full(len(missing), -1, np.int64), np.zeros(len(missing), np.int64)
            starts, weights = np.zeros(len(missing), np.int64), np.zeros(len(missing), np.uint8)
            if self.m.n_words:
                s = self.shard_of(missing)
                place, known = self.level["words"].sequences["words"].successor(s, missing & self._rest())
                ids[known] = place[known] + self.first[s[known]]
                counts[known] = self.level["words"].values("counts", s[known], place[known])
            known = np.flatnonzero(ids >= 0)
            if whole and len(known):
                starts[known], weights[known], _ = self.successors(ids[known])
            mine = (missing >> U(64 - _CACHE_BITS)).astype(np.int64)
            self.key[mine], self.id[mine], self.count[mine], self.start[mine], self.weight[mine] = missing, ids, counts, starts, weights
            lost = np.flatnonzero(self.key[slot] != h)  # words that share a slot with another of this batch
            if len(lost):
                place = np.searchsorted(missing, h[lost])
                hit = missing[np.minimum(place, len(missing) - 1)] == h[lost]
                if not hit.all():  # a cached word was overwritten in this batch
                    again = Trie(self.m)
                    found = again.words(h[lost[~hit]], whole)
                    got = {"lost": lost[~hit], "found": found}
                place = np.where(hit, np.minimum(place, len(missing) - 1), 0)
                got["batch"] = (lost[hit], place[hit])
        out = [self.id[slot], self.count[slot], self.start[slot], self.weight[slot]]
        if "batch" in got:
            where, place = got["batch"]
            for o, v in zip(out, (ids, counts, starts, weights)):
                o[where] = v[place]
        if "found" in got:
            for o, v in zip(out, got["found"]):
                o[got["lost"]] = v
        return tuple(out)

    def _rest(self) -> np.uint64:
        return U((1 << (64 - self.m.bits)) - 1)

    def find(self, level: str, context: np.ndarray, item: np.ndarray, *values: str) -> list[np.ndarray]:
        """Place of each key in its level (-1 if it isn't there), and the quantised values at the places (0 if not there).

        Keys are looked up once each and in order, so that neighbouring queries read neighbouring memory.
        """
        cuts = self.pairs if level == "pairs" else self.triples
        both = cuts.join(context, item)
        order = np.argsort(both)
        both = both[order]
        new = np.ones(len(both), bool)
        new[1:] = both[1:] != both[:-1]
        shard, keys = cuts.keys.split(both[new])
        at, found = self.level[level].sequences[level].successor(shard, keys)
        known = np.flatnonzero(found)
        place, at, shard = np.full(len(keys), -1, np.int64), at[known], shard[known]
        place[known] = at + self.base[shard] if level == "pairs" and self.m.levels > 1 else at
        got = [np.zeros(len(keys), np.uint8) for _ in values]
        for g, name in zip(got, values):
            if name != "pair_w":
                g[known] = self.level[level].values(name, shard, at)
        if "pair_w" in values:
            got[values.index("pair_w")][known] = self._pair_weights(place[known])
        back = np.empty(len(order), np.int64)
        back[order] = np.cumsum(new) - 1
        return [place[back], *(g[back] for g in got)]

    def _pair_weights(self, place: np.ndarray) -> np.ndarray:
        """Back-off weights of the pairs at ``place``, in order; they are kept with the triples."""
        shard = self.triples.of(place, 0)
        out = self.level["triples"].values("pair_w", shard, place - self.triples.lo[shard])
        if len(self.hot_pair):
            at = np.minimum(np.searchsorted(self.hot_pair, place), len(self.hot_pair) - 1)
            hot = self.hot_pair[at] == place
            out[hot] = self.hot_pair_weight[at[hot]]
        return out


_tries: dict[Model, Trie] = {}


def trie(model: Model) -> Trie:
    """This worker's view of the model; one at a time, as a later model replaces an earlier one."""
    if model not in _tries:
        _tries.clear()
        _tries[model] = Trie(model)
    return _tries[model]


def _summing(keys_of: Callable[[pa.RecordBatch], np.ndarray], keys_for: Callable[[], Keys]):
    """Counts keys and sends, for each shard, its keys coded and their counts."""

    def run(batches):
        kept: list[np.ndarray] = []

        def flush():
            unique, counts = np.unique(np.concatenate(kept), return_counts=True)
            kept.clear()
            shard, rest = keys_for().split(unique)
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(unique)]
            parts = [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]
            return pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array([int(shard[a]) for a, _ in parts], pa.int32()),
                    "keys": pa.array([EliasFano.of(rest[a:b]).dump() for a, b in parts], pa.binary()),
                    "counts": pa.array([counts[a:b].astype(np.uint32).tobytes() for a, b in parts], pa.binary()),
                }
            )

        for batch in batches:
            for part in tk.slices(batch):
                kept.append(keys_of(part))
                if sum(map(len, kept)) >= SUMMED_KEYS:
                    yield flush()
        if kept:
            yield flush()

    return run


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([EliasFano.parse(b.as_py()) for b in table.column("keys")])
    counts = np.concatenate([np.frombuffer(b.as_py(), np.uint32) for b in table.column("counts")]).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[new], np.add.reduceat(counts, new)


_COUNTED = "shard int, keys binary, counts binary"
_BUILT = "shard int, n bigint, total bigint, most bigint, hot array<bigint>, hot_n array<bigint>, hot_item array<bigint>, figures array<bigint>"


def _build(train: DataFrame, keys_of, keys_for, builder) -> dict:
    """Runs one level: count, sum before and after the shuffle, build each shard in a task. A summary of each shard."""
    counted = train.mapInArrow(_summing(keys_of, keys_for), _COUNTED)

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        n, total, most, *arrays = builder(key[0].as_py(), *_merged(table))
        lists = {x: pa.array([list(v)], pa.list_(pa.int64())) for x, v in zip(("hot", "hot_n", "hot_item", "figures"), arrays)}
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "n": [n], "total": [total], "most": [most], **lists})

    return {r.shard: r for r in counted.groupBy("shard").applyInArrow(build, _BUILT).collect()}


def _hot(keys: np.ndarray, counts: np.ndarray, most: int, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, counts and items of the keys with more tokens than a shard."""
    hot = np.flatnonzero(counts > most)
    return hot, counts[hot], items[hot].astype(np.int64)


def _pairs(t: Trie, h: np.ndarray, at: np.ndarray, whole: bool):
    """For each token: id, count, start, weight, whether it has one before it; and the tokens that end a pair of known words."""
    ids, counts, starts, weights = t.words(h, whole)
    inner = np.ones(len(h), bool)
    inner[at[:-1]] = False
    second = np.flatnonzero(inner & (ids >= 0))
    second = second[ids[second - 1] >= 0]
    return ids, counts, starts, weights, inner, second


def _join(spark: SparkSession, folder: str, level: str, layout: Layout, figures: list[list[int] | None]) -> None:
    """Copies the files of a level's shards into one, each at its place, and deletes them."""
    table, begin, size = joined(layout, figures)
    save(f"{folder}/{level}_shards", table)
    held = np.flatnonzero(table[:, -1])
    save(f"{folder}/{level}_places", np.stack([held, begin[held]]))
    path = f"{folder}/{level}.joined"
    with Path(path).open("wb") as f:
        f.truncate(size)

    def copy(batches):
        shards, places = np.load(f"{folder}/{level}_places.npy", mmap_mode="r")
        n = 0
        for batch in batches:
            for i in batch.column("id").to_numpy():
                data = Path(f"{folder}/{level}-{shards[i]}").read_bytes()
                with Path(path).open("r+b") as f:
                    f.seek(places[i])
                    f.write(data)
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    copied = spark.range(0, len(held), 1, -(-len(held) // 8)).mapInArrow(copy, "n bigint")
    if sum(r.n for r in copied.collect()) != len(held):
        raise OSError(f"the shards of {path} were not all copied")
    for s in held.tolist():
        os.remove(f"{folder}/{level}-{s}")
    os.remove(f"{folder}/{level}_places.npy")


def _put(folder: str, **tables: list | np.ndarray) -> None:
    for name, values in tables.items():
        save(f"{folder}/{name}", np.asarray(values))


def fit(docs: DataFrame, folder: str | None = None, shard_bytes: int = SHARD_BYTES, pack: int = 64) -> Model:
    """Builds the model of the training documents among docs (doc_id, text) in a new folder below ``folder``."""
    spark = docs.sparkSession
    folder = f"{folder or local_folder(spark)}/ngrams-{uuid.uuid4().hex}"
    os.makedirs(folder)
    train = docs.where(~held_out(F.col("doc_id"))).select(F.coalesce("text", F.lit("")).alias("text"))
    size = train.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, (-(-size // shard_bytes) - 1).bit_length())
    shards, most = 1 << bits, max(1, shard_bytes // TOKEN_BYTES)
    model = Model(folder, bits, pack=pack)

    def word_keys(part):
        return tokens(part.column("text"))[0]

    def of_words():
        return Keys(shards, (1 << 64 - bits) - 1)

    def build_words(shard, keys, counts):
        figures = save_shard(f"{folder}/words-{shard}", WORDS, words=EliasFano.of(keys), counts=counts)
        followed = np.where((keys == END & U((1 << 64 - bits) - 1)) & (shard == int(END) >> 64 - bits), 0, counts)  # nothing follows the end
        return len(keys), int(counts.sum()), int(counts.max()), *_hot(keys, followed, most, keys * U(0)), figures

    got = _build(train, word_keys, of_words, build_words)
    first = np.concatenate([[0], np.cumsum([got[s].n if s in got else 0 for s in range(shards)])]).astype(np.int64)
    n_words = int(first[-1])
    _put(folder, first=first)
    step = step_for(max([1, *(r.most for r in got.values())]))
    model = Model(folder, bits, 1, n_words, sum(r.total for r in got.values()), 1, step, pack)
    if not n_words:
        return model
    _join(spark, folder, "words", WORDS, [got[s].figures if s in got else None for s in range(shards)])
    hot_words = {int(first[r.shard]) + w: n for r in got.values() for w, n in zip(r.hot, r.hot_n)}
    lo, parts, span = Cuts.at(first[:-1][np.diff(first) > 0].tolist(), {w: (n, n_words) for w, n in hot_words.items()}, most, n_words)
    _put(folder, pairs_lo=lo, pairs_parts=parts, pairs_span=span)
    words_in = np.maximum(np.diff(np.append(lo, n_words)), 1)

    def pair_keys(part, model=model):
        t = trie(model)
        h, at = tokens(part.column("text"))
        ids, *_, second = _pairs(t, h, at, False)
        return t.pairs.join(ids[second - 1], ids[second])

    def of_pairs(model=model):
        return trie(model).pairs.keys

    def build_pairs(shard, keys, counts):
        n, word = int(words_in[shard]), (keys // U(n_words)).astype(np.int64)
        total, degree = np.bincount(word, counts, n), np.bincount(word, minlength=n)
        if parts[shard] > 1:
            total[:] = hot_words[int(lo[shard])]
        pair_p, weights = codes((counts - DISCOUNT) / total[word], step), codes(DISCOUNT * degree / np.maximum(total, 1), step)
        starts = EliasFano.of(np.concatenate([[0], np.cumsum(degree)]))
        figures = save_shard(f"{folder}/pairs-{shard}", PAIRS, pairs=EliasFano.of(keys), starts=starts, pair_p=pair_p, weights=weights)
        return len(keys), int(counts.sum()), int(degree.max()), *_hot(keys, counts, most, keys % U(n_words)), figures

    got = _build(train, pair_keys, of_pairs, build_pairs)
    figures = {s: r.figures for s, r in got.items()}
    none = np.zeros(0, np.uint64)
    for s in set(range(len(lo))) - set(got):  # words without successors
        n = int(words_in[s])
        starts, weights = EliasFano.of(np.zeros(n + 1, np.uint64)), np.zeros(n, np.uint8)
        figures[s] = save_shard(f"{folder}/pairs-{s}", PAIRS, pairs=EliasFano.of(none), starts=starts, pair_p=none, weights=weights)
    _join(spark, folder, "pairs", PAIRS, [figures[s] for s in range(len(lo))])
    base = np.concatenate([[0], np.cumsum([got[s].n if s in got else 0 for s in range(len(lo))])]).astype(np.int64)
    n_pairs = int(base[-1])
    cut = sorted(w for w in hot_words if parts[np.searchsorted(lo, w)] > 1)
    begin, end = np.searchsorted(lo, cut, "left"), np.searchsorted(lo, cut, "right")
    degrees = base[end] - base[begin]
    totals = np.array([hot_words[w] for w in cut], np.float64)
    _put(folder, base=base, hot_word=np.array(cut, np.int64), hot_start=base[begin], hot_degree=degrees, hot_weight=codes(DISCOUNT * degrees / np.maximum(totals, 1), step))
    if not n_pairs:
        return model
    degree = 1 + max([0, *(r.most for r in got.values()), *degrees.tolist()])
    _put(folder, triples_lo=np.zeros(1, np.int64), triples_parts=np.ones(1, np.int64), triples_span=np.ones(1, np.int64))
    model = Model(folder, bits, 2, n_words, model.n_tokens, degree, step, pack)
    hot = [(int(base[r.shard]) + p, n, w) for r in got.values() for p, n, w in zip(r.hot, r.hot_n, r.hot_item)]
    follow = Trie(model).successors(np.array([w for *_, w in hot], np.int64))[2].tolist()
    hot_pairs = {p: (n, k) for (p, n, _), k in zip(hot, follow) if k}
    lo3, parts3, span3 = Cuts.at(base[:-1][np.diff(base) > 0].tolist(), hot_pairs, most, n_pairs)
    _put(folder, triples_lo=lo3, triples_parts=parts3, triples_span=span3)
    pairs_in = np.maximum(np.diff(np.append(lo3, n_pairs)), 1)

    def triple_keys(part, model=model):
        t = trie(model)
        h, at = tokens(part.column("text"))
        _, _, context, rank = _triples(t, h, at)
        return t.triples.join(context, rank)

    def of_triples(model=model):
        return trie(model).triples.keys

    def build_triples(shard, keys, counts):
        n, pair = int(pairs_in[shard]), (keys // U(degree)).astype(np.int64)
        total, different = np.bincount(pair, counts, n), np.bincount(pair, minlength=n)
        if parts3[shard] > 1:
            total[:] = hot_pairs[int(lo3[shard])][0]
        triple_p, pair_w = codes((counts - DISCOUNT) / total[pair], step), codes(DISCOUNT * different / np.maximum(total, 1), step)
        figures = save_shard(f"{folder}/triples-{shard}", TRIPLES, triples=EliasFano.of(keys), triple_p=triple_p, pair_w=pair_w)
        return len(keys), int(counts.sum()), int(different.max()), [], [], [], figures

    got = _build(train, triple_keys, of_triples, build_triples)
    figures = {s: r.figures for s, r in got.items()}
    for s in set(range(len(lo3))) - set(got):
        pair_w = np.zeros(int(pairs_in[s]), np.uint8)
        figures[s] = save_shard(f"{folder}/triples-{s}", TRIPLES, triples=EliasFano.of(none), triple_p=none, pair_w=pair_w)
    _join(spark, folder, "triples", TRIPLES, [figures[s] for s in range(len(lo3))])
    cut = sorted(p for p in hot_pairs if parts3[np.searchsorted(lo3, p)] > 1)
    begin, end = np.searchsorted(lo3, cut, "left"), np.searchsorted(lo3, cut, "right")
    different = np.array([sum(got[s].n for s in range(a, b) if s in got) for a, b in zip(begin, end)], np.float64)
    totals = np.array([hot_pairs[p][0] for p in cut], np.float64)
    _put(folder, hot_pair=np.array(cut, np.int64), hot_pair_weight=codes(DISCOUNT * different / np.maximum(totals, 1), step))
    return Model(folder, bits, 3, n_words, model.n_tokens, degree, step, pack)


def _triples(t: Trie, h: np.ndarray, at: np.ndarray, *values: str):
    """The words, and the pairs with their values, of the tokens; then the tokens that end a triple of known pairs, with its context and rank."""
    ids, counts, starts, weights, inner, second = _pairs(t, h, at, True)
    place = np.full(len(h), -1, np.int64)
    found = t.find("pairs", ids[second - 1], ids[second], *values)
    place[second] = found[0]
    held = [np.zeros(len(h), np.uint8) for _ in values]
    for v, f in zip(held, found[1:]):
        v[second] = f
    third = np.flatnonzero(place >= 0)
    third = third[(third >= 2)]
    third = third[(place[third - 1] >= 0) & inner[third - 1]]
    rank = place[third] - starts[third - 1]  # among the successors of the second word
    return (ids, counts, weights, inner, *held), third, place[third - 1], rank


def log_probabilities(t: Trie, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token: known, log10 of its base probability, log10 of its probability in context."""
    m = t.m
    base_total = m.n_tokens + ADDED * (m.n_words + 1)
    if not m.n_words:
        zero = np.full(len(h), np.log10(ADDED / base_total))
        return np.zeros(len(h), bool), zero, zero
    if m.levels < 3:  # training texts without words: there are no pairs
        ids, counts, *_ = t.words(h, False)
        base = np.log10((counts + ADDED) / base_total)
        return ids >= 0, base, base
    (ids, counts, weights, inner, pair_p, pair_w), third, context, rank = _triples(t, h, at, "pair_p", "pair_w")
    base = (counts + ADDED) / base_total
    # By the back-off weight of the word before, and of the pair before; a token without either keeps the shorter context.
    weight = np.zeros(len(h))
    weight[1:] = t.value[weights[:-1]] * (inner[1:] & (ids[:-1] >= 0))
    p = np.where(weight > 0, t.value[pair_p] + weight * base, base)
    weight[:] = 0
    weight[1:] = t.value[pair_w[:-1]] * inner[1:]
    held = np.zeros(len(h))
    held[third] = t.value[t.find("triples", context, rank, "triple_p")[1]]
    p = np.where(weight > 0, held + weight * p, p)
    return ids >= 0, np.log10(base), np.log10(p)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """A row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""

    def run(batches):
        t = trie(model)
        for batch in batches:
            for part in tk.slices(batch):
                h, at = tokens(part.column("text"))
                known, base, p = log_probabilities(t, h, at)
                n = np.diff(at)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("held_out"), pa.array(n), pa.array(np.add.reduceat(known.astype(np.int64), at[:-1])),
                        pa.array(np.full(len(n), model.n_tokens)), pa.array(np.add.reduceat(base, at[:-1])), pa.array(np.add.reduceat(p, at[:-1])),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(
        run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    )


def fitted_scores(docs: DataFrame) -> DataFrame:
    return score(docs, fit(docs))
