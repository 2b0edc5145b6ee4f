"""Near-duplicate texts by a MinHash LSH forest (p5).

A text is its set of sequences of three consecutive words. Each of ``TREES`` trees labels it with ``DEEPEST`` MinHash values, and a tree is the trie
of the label sequences: rows sorted by their labels, in which the common prefix of neighbours gives every node. Two texts of similarity s
have a common prefix of d labels with probability s ** d, so a text matched at depth d in each tree meets a partner at the threshold with
probability 1 - (1 - threshold ** d) ** trees. Prefixes are matched from the longest on and shortened until that reaches ``RECALL`` (3 labels
at 0.6), or until the node of the shorter prefix is full: with more than ``cap`` texts it is boilerplate and would make pairs of all, so the
text stays at the longest prefix whose node is not full, or leaves the tree. All pairs of the nodes found so are candidates; one pass over the
sorted rows finds them.

What full nodes hide cannot be made good by shorter prefixes in other trees: two texts with the same boilerplate meet where it gives their
labels, and there the nodes are full. So all texts with a full node take the exact way among themselves: ordered by how rare they are, the
first n - ceil(t n) + 1 sequences of a text are indexed, and any two texts that reach the threshold share one of these. A pair is missed
by chance alone (1 - RECALL at the threshold, less above it), never because of a full node.

All candidates are verified on their words. The rows of a node are one task's; nodes above ``big`` texts are full at any rate and are not
scanned at all.

Defined results: null texts and texts below ``min_words`` words give nothing; texts with equal sets of sequences are one class and all
pairs of its names are results; repeated rows change nothing; two rows of a name with different text both count, no name pairs with
itself. Input columns other than name and text are not read.
"""

from __future__ import annotations

import math
import re
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.llm.hashing import MULTIPLIER, WordDigests, mix
from tessel.llm.pairs import block_pairs, expand, shared_keys
from tessel.llm.spans import join_texts
from tessel.operators.graph import connected_components
from tessel.session import materialize

WORD = re.compile(r"\w+")
SHINGLE = 3
THRESHOLD = 0.6
MIN_WORDS = 30
TREES = 32
DEEPEST = 6
RECALL = 0.999
CAP = 64
BIG = 100_000


def depth_for(threshold: float, trees: int = TREES, recall: float = RECALL) -> int:
    """The longest prefix that gives a text without full nodes the target probability of meeting a partner at the threshold."""
    for depth in range(DEEPEST, 0, -1):
        if 1 - (1 - threshold**depth) ** trees >= recall:
            return depth
    raise ValueError(f"{trees} trees cannot reach recall {recall} at {threshold}")


class Shingler:
    """64-bit digests of the distinct word sequences of a text; word digests are kept between texts."""

    def __init__(self, size: int):
        self.size, self.digests = size, WordDigests()

    def words(self, text: str) -> np.ndarray:
        return self.digests.of(WORD.findall(text))

    def sequences(self, words: np.ndarray) -> np.ndarray:
        n = len(words) - self.size + 1
        out = words[:n].copy()
        for k in range(1, self.size):
            out = mix(out * MULTIPLIER + words[k : k + n])
        return np.unique(out)


def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    seed = (mix(np.arange(1, 2 * n + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
    return seed[:n] | np.uint32(1), seed[n:]


def _sign(size: int, min_words: int, trees: int):
    """The labels of a text in each tree: the first two in ``head``, 32 bits each, the others in ``tail``, 16 bits each, the first uppermost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _factors(trees * DEEPEST)
        shingler = Shingler(size)
        for batch in batches:
            names, ids, sets = [], [], []
            for name, cid, text in zip(*(batch.column(c).to_pylist() for c in ("file", "cid", "text"))):
                words = shingler.words(text)
                if len(words) >= min_words:
                    s = shingler.sequences(words)
                    names.append(name)
                    ids.append(cid)
                    sets.append(s)
            for i in range(0, len(sets), 512):
                part = sets[i : i + 512]
                at = np.cumsum([0, *(len(s) for s in part[:-1])])
                x = (np.concatenate(part) >> np.uint64(32)).astype(np.uint32)
                value = np.empty_like(x)
                label = np.empty((DEEPEST, trees, len(part)), np.uint64)
                for k in range(trees * DEEPEST):
                    np.multiply(x, a[k], out=value)
                    np.add(value, b[k], out=value)
                    label[k // trees, k % trees] = np.minimum.reduceat(value, at)
                head = label[0] << np.uint64(32) | label[1]
                tail = np.zeros_like(head)
                for k in range(2, DEEPEST):
                    tail = tail << np.uint64(16) | mix(label[k]) >> np.uint64(48)
                edges = pa.array(np.arange(0, trees * len(part) + 1, trees, dtype=np.int32))
                head, tail = (pa.ListArray.from_arrays(edges, pa.array(y.T.ravel().view(np.int64))) for y in (head, tail))
                digest = [xxhash.xxh3_128_digest(s.tobytes()) for s in part]
                yield pa.RecordBatch.from_arrays([pa.array(names[i : i + 512], pa.string()), pa.array(ids[i : i + 512], pa.binary()), pa.array(digest, pa.binary()), head, tail], names=["file", "cid", "id", "head", "tail"])

    return run


def _runs(cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row, number of rows) of the stretches that begin where ``cut`` is set."""
    first = np.flatnonzero(cut)
    return first, np.diff(np.r_[first, len(cut)])


def trie_matches(node: np.ndarray, tail: np.ndarray, least: int, cap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows a, rows b, depths) of sorted trie rows: all pairs below nodes that are not full, and each row's least depth with such a node (DEEPEST + 1: none).

    ``node`` tells the prefixes of ``least`` labels apart, ``tail`` holds the third label and those after it."""
    other = tail[1:] ^ tail[:-1]
    common = np.full(len(other), 2)
    for k in range(2, DEEPEST):
        common += (other >> np.uint64(16 * (DEEPEST - 1 - k))) == 0
    common = np.where(node[1:] == node[:-1], np.maximum(common, least), -1)
    depth = np.full(len(node), DEEPEST + 1)
    pairs: list[np.ndarray] = [np.empty((2, 0), np.int64)]
    for d in range(DEEPEST, least - 1, -1):
        _, size = _runs(np.r_[True, common < d])
        depth[np.repeat(size <= cap, size)] = d
    for d in range(least, DEEPEST + 1):
        first, size = _runs(np.r_[True, common < d])
        own = (depth[first] == d) & (size > 1)
        for m in np.unique(size[own]).tolist():
            i, j = np.triu_indices(m, 1)
            at = first[own & (size == m)][:, None]
            pairs.append(np.stack([(at + i).ravel(), (at + j).ravel()]))
    a, b = np.concatenate(pairs, 1)
    return a, b, depth


def _binary(high: np.ndarray, low: np.ndarray) -> pa.Array:
    both = np.ascontiguousarray(np.stack([high, low], 1).astype(">i8"))
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(high), [None, pa.py_buffer(both)]).cast(pa.binary())


def _scan(cap: int, least: int):
    """Sorted trie rows in; out come candidate pairs (a, b), and (a, null) of each row whose node at depth ``least`` is full."""

    def emit(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts)
        node, tail, high, low = (rows.column(c).to_numpy() for c in ("node", "tail", "high", "low"))
        a, b, depth = trie_matches(node, tail.view(np.uint64), least, cap)
        swap = (high[a] > high[b]) | (high[a] == high[b]) & (low[a] > low[b])
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        full = np.flatnonzero(depth > least)
        left = _binary(np.r_[high[a], high[full]], np.r_[low[a], low[full]])
        right = pa.concat_arrays([_binary(high[b], low[b]), pa.nulls(len(full), pa.binary())])
        return pa.RecordBatch.from_arrays([left, right], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []  # rows of the last node so far, at most BIG of them
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column("node").to_numpy()
            new = np.flatnonzero(node[1:] != node[:-1])
            last = int(new[-1]) + 1 if len(new) else 0
            if not last and kept and kept[-1].column("node")[-1].as_py() != node[0]:
                yield emit(kept)
                kept = []
            if last:
                yield emit([*kept, batch.slice(0, last)])
                kept = []
            kept.append(batch.slice(last))
        if kept:
            yield emit(kept)

    return run


def _all_sequences(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for batch in batches:
            for cid, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                s = shingler.sequences(shingler.words(text)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array([cid] * len(s), pa.binary()), pa.array(np.full(len(s), len(s), np.int32))], names=["key", "id", "size"])

    return run


class _Sets:
    """Word-sequence sets of recent texts."""

    def __init__(self, size: int, kept: int = 256):
        self.size, self.kept, self.sets = size, kept, OrderedDict()

    def of(self, cid: bytes, text: str) -> set:
        found = self.sets.get(cid)
        if found is None:
            words = WORD.findall(text)
            found = self.sets[cid] = set(zip(*(words[k:] for k in range(self.size))))
            if len(self.sets) > self.kept:
                self.sets.popitem(last=False)
        return found


def _verify(size: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _Sets(size)
        for batch in batches:
            rows: list[list] = [[], [], []]
            for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "x", "y"))):
                s, t = sets.of(a, x), sets.of(b, y)
                both = len(s & t)
                either = len(s) + len(t) - both
                if both >= threshold * either - 1e-9:
                    rows[0].append(a)
                    rows[1].append(b)
                    rows[2].append(both / either)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.binary()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.float64())], names=["a", "b", "similarity"])

    return run


class NearDuplicates:
    def __init__(self, df: DataFrame, name: Column, text: Column, size: int = SHINGLE, threshold: float = THRESHOLD, min_words: int = MIN_WORDS, trees: int = TREES, cap: int = CAP, big: int = BIG):
        if min_words < size:
            raise ValueError("a text needs at least one sequence")
        if big < cap:
            raise ValueError("a node above big must be full")
        self.trees, self.cap, self.big, self.threshold = trees, cap, big, threshold
        rows = df.select(name.cast("string").alias("file"), text.alias("text")).filter("file is not null and text is not null").withColumn("cid", F.unhex(F.md5("text")))
        self.texts = rows.select(F.col("cid").alias("id"), "text")
        signed = materialize(rows.mapInArrow(_sign(size, min_words, trees), "file string, cid binary, id binary, head array<bigint>, tail array<bigint>"), "signed")
        self.members = signed.select("id", "file").distinct()
        # a class of equal sets is represented by one of its texts
        self.classes = signed.groupBy("id").agg(F.min("cid").alias("cid"))
        pairs, exact = self._forest(signed.groupBy("id").agg(F.first("head").alias("head"), F.first("tail").alias("tail")))
        rep = lambda c: self.classes.select(F.col("id").alias(c), F.col("cid").alias(f"c{c}"))
        candidates = pairs.join(rep("a"), "a").join(rep("b"), "b").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"))
        if not exact.isEmpty():
            candidates = candidates.union(self._exact(exact, size, threshold, cap))
        candidates = materialize(candidates.distinct(), "candidates")
        verified = join_texts(candidates, self.texts).mapInArrow(_verify(size, threshold), "a binary, b binary, similarity double")
        back = lambda c: self.classes.select(F.col("cid").alias(c), F.col("id").alias(f"i{c}"))
        self.found = materialize(verified.join(back("a"), "a").join(back("b"), "b").select(F.col("ia").alias("a"), F.col("ib").alias("b"), "similarity"), "found")

    def _forest(self, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Candidate pairs (a, b) of ids, and the ids in full nodes, which must take the exact way."""
        least = depth_for(self.threshold, self.trees)
        half = lambda k: F.conv(F.hex(F.substring("id", k, 8)), 16, -10).cast("bigint")
        rows = classes.select("id", half(1).alias("high"), half(9).alias("low"), F.posexplode(F.arrays_zip("head", "tail")).alias("tree", "l")).select("id", "high", "low", "tree", "l.head", "l.tail")
        label = lambda k: F.shiftright("tail", 16 * (DEEPEST - 1 - k)).bitwiseAND(65535)
        prefix = [F.col("tree"), F.shiftright("head", 32), F.col("head").bitwiseAND((1 << 32) - 1), *map(label, range(2, DEEPEST))]
        rows = rows.select(F.xxhash64(*prefix[: least + 1]).alias("node"), "tail", "id", "high", "low")
        big = materialize(rows.groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") > self.big).select("node"), "big")
        below, hidden = rows, None
        if not big.isEmpty():
            below, hidden = rows.join(big, "node", "left_anti"), rows.join(big, "node", "left_semi").select("id")
        ordered = below.select("node", "tail", "high", "low").repartition("node").sortWithinPartitions("node", "tail")
        scanned = materialize(ordered.mapInArrow(_scan(self.cap, least), "a binary, b binary"), "matches")
        full = scanned.filter("b is null").select(F.col("a").alias("id"))
        return scanned.filter("b is not null"), (full if hidden is None else full.union(hidden)).distinct()

    def _exact(self, hot: DataFrame, size: int, threshold: float, cap: int) -> DataFrame:
        """Candidate pairs (of representative texts) among the texts of full nodes, by indexing each text's rarest sequences."""
        chosen = self.texts.join(self.classes.join(hot, "id", "left_semi").select(F.col("cid").alias("id")), "id", "left_semi").dropDuplicates(["id"])
        tokens = materialize(chosen.mapInArrow(_all_sequences(size), "key bigint, id binary, size int"), "sequences")
        ranked = tokens.join(tokens.groupBy("key").agg(F.count("*").alias("df")), "key")
        place = F.row_number().over(Window.partitionBy("id").orderBy("df", "key"))
        first = F.col("size") - F.ceil(F.col("size") * F.lit(threshold) - F.lit(1e-9)) + 1
        indexed = ranked.withColumn("place", place).filter((F.col("place") <= first) & (F.col("df") > 1)).select("key", "id")
        return block_pairs(shared_keys(indexed), cap)

    def pairs(self) -> DataFrame:
        """(file_a, file_b), file_a < file_b."""
        return expand(self.found.select("a", "b"), self.members, "file")

    def groups(self) -> DataFrame:
        """(file, grp, links) of every file with a near-duplicate: its group (the least name among all it is linked to, directly or not) and how many names it is linked to directly."""
        sizes = self.members.groupBy("id").agg(F.count("*").alias("n"), F.min("file").alias("least"))
        both = self.found.select("a", "b").union(self.found.select(F.col("b").alias("a"), F.col("a").alias("b")))
        links = both.join(sizes.select(F.col("id").alias("b"), "n"), "b").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("outside"))
        parts = connected_components(self.found.select(F.hex("a").alias("src"), F.hex("b").alias("dst")))
        classes = sizes.withColumn("node", F.hex("id")).join(parts, "node", "left").join(links, "id", "left")
        classes = classes.withColumn("component", F.coalesce("component", "node")).withColumn("links", (F.coalesce("outside", F.lit(0)) + F.col("n") - 1).cast("bigint")).filter("links > 0")
        least = classes.groupBy("component").agg(F.min("least").alias("grp"))
        return self.members.join(classes.select("id", "component", "links"), "id").join(least, "component").select("file", "grp", "links")
