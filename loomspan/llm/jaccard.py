"""N-gram Jaccard join: an LSH forest over MinHash signatures, verified exactly.

Two texts are linked if the Jaccard similarity of their sets of five-word
shingles is 0.8 or more.

1. One pass over the text gives each document its shingle set's 128-bit name
   and its signature: ``DEPTH`` MinHash values for each of ``TREES`` trees.
   Documents with the same set form one class, counted once with its size.
2. The labels of each tree are range-sorted, which is the tree's prefix trie in
   order; a label's longest prefix shared with a neighbour is its matched prefix.
   A trie node is the run of labels with one prefix. Members of a node are tied
   to its least member if their signatures are alike (a star, never all pairs);
   those that aren't nearly its copies are tied to the least of their own kind as
   well. By the triangle inequality of Jaccard distance all links of a node lie
   within the components of these ties.
3. The search begins with whole labels. For texts of each order of length the
   pairs met so far say, by their signatures, how unlike linked texts are:
   prefixes are shortened to the longest at which the least alike of them would
   meet in some tree with the target recall, and only for the lengths that need
   it. Few pairs, or pairs at the threshold, lead to the prefix at which any pair
   at the threshold meets with the target recall, where it ends.
4. Each component is verified exactly: its shingle sets meet in one group, or,
   if it is large, in the groups of pairs of its blocks, where an inverted index
   counts common shingles. A group returns the number of links of each class
   and a spanning forest of them, never the pairs.

Defined results: null text is empty text. A text of one to four words has one
shingle, of all of them. A text without words has no shingles, no links, and is
its own group (its class_id is its doc_id). Rows with the same text link to each
other, repeated ids or null ids included; class_id is the least id that is not
null in the group. Further columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm import rows as r
from loomspan.llm import tokens as tk
from loomspan.llm.graph import components
from loomspan.llm.storage import materialise, written

WORDS, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 24, 8, 0.9999
#: Similarity by signature from which a member of a trie node counts as a copy of the node's head, and from which it is tied to it.
#: With 192 values the estimate is within 0.1 of the truth (three standard errors), so a link of a copy is tied to the head as well.
COPY, TIED = 0.85, 0.45
#: Pairs so much below the threshold by signature (two standard errors) may be linked all the same.
NOISE = 0.06
#: Shingles that meet in one verifying group, about.
GROUP_SHINGLES = 1_000_000
#: Bytes of text handled at once.
SLICE_BYTES = 1 << 20
_A_WORD = r"[^\x20\x09-\x0D]"


def missed(similarity: float, depth: int, trees: int = TREES) -> float:
    """The chance that a pair shares no prefix of ``depth`` values in any tree."""
    return (1 - similarity**depth) ** trees


def prefix_depth(similarity: float = THRESHOLD, trees: int = TREES, longest: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix at which a pair is met with the target recall (1 if none reaches it)."""
    depth = longest
    while depth > 1 and missed(similarity, depth, trees) > 1 - recall:
        depth -= 1
    return depth


def needed_depth(n_seen: int, least: float | None, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The depth that ``n_seen`` texts in pairs, of which the least alike has similarity ``least``, call for.

    With so many seen that a single pair at the threshold, unseen at full depth, is no more than the
    target leaves open, the least alike pair stands for all; else the threshold does.
    """
    enough = n_seen * (1 - recall) >= missed(threshold, DEPTH)
    return prefix_depth(max(threshold, least) if enough and least is not None else threshold, recall=recall)


def _sketcher(n: int, trees: int, depth: int):
    rng = np.random.Generator(np.random.PCG64(7))
    flips = rng.integers(0, 1 << 63, trees * depth, dtype=np.uint64) * tk.U(2)
    odds = rng.integers(0, 1 << 63, trees * depth, dtype=np.uint64) * tk.U(2) + tk.U(1)

    def sketch(batches):
        for batch in batches:
            for part in tk.slices(batch, size=SLICE_BYTES):
                values, at = tk.shingles(tk.words(part.column("text")), n)
                unique, begin = tk.row_sets(values, at)
                size = np.diff(begin)
                name = np.stack([tk.row_sums(tk.mix(unique), begin), tk.row_sums(tk.mix(unique ^ tk.U(0xA5A5A5A5)), begin)], 1)
                name = [x.tobytes() if k else None for x, k in zip(name, size.tolist())]
                signature = np.empty((len(size), trees * depth), ">u2")
                for k in range(trees * depth):
                    signature[:, k] = tk.mix(tk.row_minima((unique ^ flips[k]) * odds[k], begin)) >> tk.U(48)
                signature = [x.tobytes() for x in signature]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("row_hash"), pa.array(name, pa.binary()), pa.array(size), pa.array(signature, pa.binary())],
                    ["doc_id", "row_hash", "node", "n_shingles", "signature"],
                )

    return sketch


def sketches(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """A row for each document: doc_id, row_hash, node (its set's name), n_shingles and the signature: the labels of all trees, one after the other."""
    return _keyed(docs).drop("doc_key").mapInArrow(
        _sketcher(n, TREES, DEPTH), "doc_id bigint, row_hash bigint, node binary, n_shingles bigint, signature binary"
    )


def _fixed(column: pa.Array, width: int) -> np.ndarray:
    """A binary column of values of one width as a matrix of 16-bit numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), ">u2").reshape(len(column), width // 2)


def _matcher(least: int):
    def matched(batches):
        """Adds the longest prefix that a label shares with a neighbour in its sorted partition, and leaves out those that share less than ``least``.

        The neighbours of a partition's first and last label are unknown; these count as wholly shared.
        """

        def out(rows: pa.RecordBatch, longest: np.ndarray):
            keep = longest >= least
            rows = rows.append_column("matched", pa.array(longest.astype(np.int32)))
            return rows.filter(pa.array(keep))

        held, before = None, DEPTH
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.concat_batches([held, batch])
            label, tree = _fixed(rows.column("label"), 2 * DEPTH), rows.column("tree").to_numpy()
            same = (label[1:] == label[:-1]) & (tree[1:] == tree[:-1])[:, None]
            ahead = np.cumprod(same, axis=1).sum(1)
            if rows.num_rows > 1:
                yield out(rows.slice(0, rows.num_rows - 1), np.maximum(np.concatenate([[before], ahead[:-1]]), ahead))
                before = int(ahead[-1])
            held = rows.slice(rows.num_rows - 1, 1)
        if held is not None:
            yield out(held, np.full(1, DEPTH))

    return matched


def _scale() -> Column:
    """A text's order of length."""
    return F.floor(F.log2("n_shingles")).cast("int").alias("scale")


def tries(classes: DataFrame, least: int) -> DataFrame:
    """tree, label, node, scale and matched (the longest shared prefix) of the labels that share ``least`` values or more, each tree in order."""
    labels = classes.select(
        "node", _scale(), "signature", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    )
    cut = F.substr("signature", F.col("tree") * (2 * DEPTH) + 1, F.lit(2 * DEPTH))
    labels = labels.select("tree", cut.alias("label"), "node", "scale")
    # The node is part of the order, so that one label of very many members is many ranges.
    ordered = labels.repartitionByRange("tree", "label", "node").sortWithinPartitions("tree", "label", "node")
    return ordered.mapInArrow(_matcher(least), "tree int, label binary, node binary, scale int, matched int")


def _alike(batches):
    """node, head, scale and the share of equal values of their signatures."""
    for batch in batches:
        if batch.num_rows:
            a, b = (_fixed(batch.column(x), 2 * TREES * DEPTH) for x in ("own", "other"))
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("node", "head", "scale")), pa.array((a == b).mean(1))], ["node", "head", "scale", "alike"])


def _ties(members: DataFrame, signatures: DataFrame, scales: list[int] | None, threshold: float) -> tuple[list[DataFrame], dict[int, int]]:
    """Ties (a, b) that hold all links within the nodes (tree, prefix) of ``members`` together, and the depth that each order of length needs.

    With ``scales`` only nodes with a member of these orders of length count.
    """
    asked = F.lit(True) if scales is None else F.max(F.col("scale").isin(scales))
    heads = members.groupBy("tree", "prefix").agg(F.min("node").alias("head"), F.count("*").alias("n"), asked.alias("asked")).where("n > 1 and asked")
    # Written first, so that the join may split the members of a node of very many.
    held = members.join(materialise(heads.select("tree", "prefix", "head")), ["tree", "prefix"]).where("node <> head").drop("scale")
    own = signatures.select("node", F.col("signature").alias("own"), "scale")
    other = signatures.select(F.col("node").alias("head"), F.col("signature").alias("other"), F.col("scale").alias("other_scale"))
    pairs = held.select("node", "head").distinct().join(own, "node").join(other, "head")
    alike = materialise(
        pairs.select("node", "head", "own", "other", F.least("scale", "other_scale").alias("scale")).mapInArrow(_alike, "node binary, head binary, scale int, alike double")
    )
    ties = [alike.where(F.col("alike") >= TIED).select(F.col("node").alias("a"), F.col("head").alias("b"))]
    rest = held.join(alike.where(F.col("alike") < COPY), ["node", "head"]).select("tree", "prefix", "node")
    least = materialise(rest.groupBy("tree", "prefix").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n"))
    ties.append(rest.join(least, ["tree", "prefix"]).where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")))
    seen = alike.where(F.col("alike") >= threshold - NOISE).groupBy("scale").agg(F.count_distinct("node").alias("n"), F.min("alike").alias("least"))
    return ties, {x.scale: needed_depth(x.n, x.least, threshold) for x in seen.collect()}  # a row for each order of length


def _verifier(threshold: float):
    def verify(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Links in one group. Columns: node, comp, block, size, shingles; key: (bin, block, other block)."""
        first, second = key[1].as_py(), key[2].as_py()
        table = table.combine_chunks()
        comp = table.column("comp").to_numpy()
        order = np.lexsort((table.column("block").to_numpy(), comp))
        node = table.column("node").take(pa.array(order)).to_pylist()
        blob = table.column("shingles").take(pa.array(order)).to_pylist()
        size, block, comp = table.column("size").to_numpy()[order], table.column("block").to_numpy()[order], comp[order]
        length = np.array([len(b) // 8 for b in blob])
        owner = np.repeat(np.arange(len(blob)), length)
        value = np.frombuffer(b"".join(blob), np.uint64)
        span = np.searchsorted(comp, comp, "left"), np.searchsorted(comp, comp, "right")
        value = tk.mix(value ^ tk.mix(span[0].astype(np.uint64))[owner])  # shingles count within a component only
        by = np.argsort(value, kind="stable")
        sorted_owner, sorted_value = owner[by], value[by]
        change = np.flatnonzero(np.concatenate([[True], sorted_value[1:] != sorted_value[:-1]])) if len(value) else np.zeros(0, np.int64)
        run = np.searchsorted(change, np.arange(len(value)), "right") - 1
        begin, end = np.empty(len(value), np.int64), np.empty(len(value), np.int64)
        begin[by] = change[run]
        end[by] = np.append(change[1:], len(value))[run]
        at = np.concatenate([[0], np.cumsum(length)])
        links, tied = np.zeros(len(blob), np.int64), np.arange(len(blob))

        for i in range(len(blob)):
            a, b = begin[at[i] : at[i + 1]], end[at[i] : at[i + 1]]
            keep = b - a > 1
            a, k = a[keep], (b - a)[keep]
            if not len(a):
                continue
            base, top = span[0][i], span[1][i]
            ends = np.cumsum(k)
            hit = sorted_owner[np.arange(ends[-1]) - np.repeat(ends - k - a, k)]
            common = np.bincount(hit - base, minlength=top - base)
            union = length[base:top] + length[i] - common
            near = common >= threshold * union - 1e-9
            near[i - base] = False
            if first == second:
                found = np.flatnonzero(near) + base
            else:  # the other block only: pairs within a block have a group of their own
                found = np.flatnonzero(near & (block[base:top] != block[i])) + base
            if not len(found):
                continue
            links[i] += size[found].sum()
            for q in np.unique(tied[found]).tolist():
                if q != tied[i]:
                    tied[base:top][tied[base:top] == q] = tied[i]
        some = np.flatnonzero(links)
        heads: dict[int, bytes] = {}
        for i in some.tolist():
            heads[int(tied[i])] = min(node[i], heads.get(int(tied[i]), node[i]))
        edges = [(node[i], heads[int(tied[i])]) for i in some.tolist() if node[i] != heads[int(tied[i])]]
        return pa.table(
            {
                "a": pa.array([node[i] for i in some] + [a for a, _ in edges], pa.binary()),
                "b": pa.array([None] * len(some) + [b for _, b in edges], pa.binary()),
                "links": pa.array(links[some].tolist() + [None] * len(edges), pa.int64()),
            }
        )

    return verify


def _sets(n: int):
    def sets(batches):
        for batch in batches:
            for part in tk.slices(batch, size=SLICE_BYTES):
                unique, begin = tk.row_sets(*tk.shingles(tk.words(part.column("text")), n))
                blob = [unique[a:b].tobytes() for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]
                names = [x for x in part.schema.names if x != "text"]
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in names), pa.array(blob, pa.binary())], [*names, "shingles"])

    return sets


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a key of the row that is never null; equal rows have equal keys."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("row_hash", F.xxhash64("doc_id", "text")).withColumn("doc_key", F.coalesce("doc_id", F.lit(0)))


def _components(ties: DataFrame) -> DataFrame:
    """(node, comp) of all nodes of the ties."""
    tied = components(ties)
    return tied.select(F.col("a").alias("node"), F.col("root").alias("comp")).unionByName(
        tied.select(F.col("root").alias("node"), F.col("root").alias("comp")).distinct()
    )


def _verified(chosen: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links within the components of ``chosen`` (node, comp): see the verifier."""
    chosen = chosen.join(sets.select("node", "n_shingles"), "node")
    comps = chosen.groupBy("comp").agg(F.sum("n_shingles").alias("total"))
    bins = max(1, -(-(chosen.agg(F.sum("n_shingles")).first()[0] or 0) // GROUP_SHINGLES))
    # A large component gets a bin of its own, cut into blocks; small ones share bins.
    # Written first, so that the join may split a component of very many.
    placed = materialise(comps.select(
        "comp",
        F.ceil(F.col("total") / GROUP_SHINGLES).cast("int").alias("blocks"),
        F.xxhash64("comp").alias("comp_hash"),
        F.when(F.col("total") > GROUP_SHINGLES, F.hex("comp")).otherwise(F.pmod(F.xxhash64("comp"), F.lit(bins)).cast("string")).alias("bin"),
    ))
    wanted = chosen.join(placed, "comp").select(
        "node", F.col("comp_hash").alias("comp"), "bin", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")
    )
    paired = wanted.join(sets.select("node", "size", "shingles"), "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = paired.select("node", "comp", "size", "block", "shingles", "bin", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    return materialise(
        paired.groupBy("bin", "low", "high").applyInArrow(_verifier(threshold), "a binary, b binary, links bigint")
    )


def linked(
    docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, depths: list | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sketch rows (doc_id, row_hash, node), links (node, links of its class beyond its own copies), and groups (node, root).

    ``depths``, if given, gets the prefix lengths searched, with the orders of length (None: all) that they were searched for.
    """
    sketch = written(sketches(docs, n))
    spare = F.struct(F.coalesce("doc_id", F.lit(0)).alias("doc_key"), "row_hash")
    classes = materialise(sketch.where("node is not null").groupBy("node").agg(
        F.min(spare).alias("one"), F.count("*").alias("size"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")
    ))
    shortest = prefix_depth(threshold)
    trie = written(tries(classes, shortest))
    kept = classes.join(trie.select("node").distinct(), "node", "left_semi")
    signatures = materialise(kept.select("node", _scale(), "signature"))
    texts = kept.select("node", "size", "n_shingles", "one.*").join(_keyed(docs).select("row_hash", "doc_key", "text"), ["row_hash", "doc_key"])
    sets = written(
        texts.dropDuplicates(["row_hash", "doc_key"]).select("node", "size", "n_shingles", "text")
        .mapInArrow(_sets(n), "node binary, size bigint, n_shingles bigint, shingles binary")
    )
    depth, scales, joined = DEPTH, None, None
    while True:
        if depths is not None:
            depths.append((depth, scales))
        members = trie.where(F.col("matched") >= depth).select("tree", F.substr("label", F.lit(1), F.lit(2 * depth)).alias("prefix"), "node", "scale")
        ties, want = _ties(members, signatures, scales, threshold)
        for more in ties:
            joined = more if joined is None else joined.unionByName(more)
        if depth <= shortest:
            break
        if scales is None:
            scales = [x.scale for x in trie.select("scale").distinct().collect()]  # at most one for each power of two
        scales = [x for x in scales if want.get(x, shortest) < depth]
        if not scales:
            break
        depth = max(max(want.get(x, shortest) for x in scales), shortest)
    found = _verified(_components(joined), sets, threshold)
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = components(found.where("b is not null").select("a", "b"))
    return sketch.select("doc_id", "row_hash", "node"), links, roots.select(F.col("a").alias("node"), "root")


def jaccard_classes(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document: doc_id, class_id (least id of its group of linked texts), n_links (documents linked to it), class_size."""
    sketch, links, roots = linked(docs, n, threshold)
    per_node = sketch.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("copies"))
    per_node = per_node.join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    groups = per_node.groupBy("root").agg(F.min("least_id").alias("class_id"), F.sum("copies").alias("class_size"))
    per_node = per_node.join(groups, "root").select(
        "node", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "class_size"
    )
    some = sketch.where("node is not null").select("doc_id", "node").join(per_node, "node")
    none = sketch.where("node is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), F.lit(1).cast("bigint").alias("class_size"))
    return some.select("doc_id", "class_id", "n_links", "class_size").unionByName(none)


def one_of_each(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """The documents of ``docs`` with all their columns, one of each group: the least id, then the least hash of the text.

    Documents without words all stay.
    """
    sketch, _, roots = linked(docs, n, threshold)
    tied = sketch.where("node is not null").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.coalesce("doc_id", F.lit(0)).alias("doc_key"), "row_hash")
    kept = tied.groupBy("root").agg(F.min(order).alias("one")).select("one.doc_key", "one.row_hash")
    text = F.coalesce("text", F.lit(""))
    marked = docs.select(
        r.packed(docs).alias("whole"), r.row_hash(docs).alias("tie"), text.rlike(_A_WORD).alias("worded"),
        F.xxhash64(F.col("doc_id").cast("bigint"), text).alias("row_hash"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("doc_key"),
    )
    # Of rows of one id and text that differ in other columns, the one with the least hash stays.
    once = marked.where("worded").join(kept, ["row_hash", "doc_key"], "left_semi").groupBy("row_hash", "doc_key").agg(F.min_by("whole", "tie").alias("whole"))
    return once.select("whole").unionByName(marked.where("not worded").select("whole")).select("whole.*")
