"""Long exact spans shared between texts (p4).

A gear rolling hash runs over each text; the text is cut where the hash is least among its neighbours (any window of ``WINDOW``
consecutive positions has a cut). Cuts depend on the 64 characters before them alone, so an insertion shifts no cut but those
next to it. The digest of the 64 characters before a cut is the key by which texts meet. A run of at least
``MIN_SPAN`` = 64 + WINDOW - 1 characters holds a whole window of positions, so its cut is found in both texts: no shared run is missed.
Texts that share a key are then compared exactly.

Keys that more than ``cap`` texts share (licence headers, boilerplate) give no pairs. Their occurrences are looked at with more context: a run of MIN_SPAN
around the key reaches a characters to the left and MIN_SPAN - 64 - a to the right, so one of few longer stretches (first of 144,
then of all MIN_SPAN characters) is shared too, and these meet instead. In the last step the shared stretch is itself a
run of MIN_SPAN characters, so every pair is a result.

Equal texts are one class; only classes meet. Defined results: null texts and texts shorter than MIN_SPAN give nothing; repeated
rows of a name change nothing; two rows of one name with different text both count; a text repeated under another name is a pair if it
is long enough; length is in code points, lone surrogates included. Input columns other than name and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.llm.hashing import code_points, gear, gear_hash, mix, sliding, window_hash
from tessel.llm.pairs import block_pairs, expand, shared_keys, small_pairs
from tessel.operators.intervals import interval_periods, interval_states
from tessel.session import materialize

KEY = 64
MIN_SPAN = 160
CAP = 40
_PIECE = 1 << 17


def cuts(points: list[np.ndarray], window: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(positions, gear hashes) of the cuts of each text; each text is at least KEY + window - 1 long."""
    at = np.cumsum([0, *(len(p) for p in points)])
    raw = gear_hash(gear(np.concatenate(points)))
    order = (mix(raw) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)  # 0 marks what is outside
    n = len(order)
    whole = np.zeros(n - window + 1, bool)  # windows inside one text, clear of what the text before left in the hash
    for a, b in zip(at[:-1], at[1:]):
        whole[a + KEY - 1 : b - window + 1] = True
    least = np.where(whole, sliding(order, window, np.minimum), np.uint32(0))
    edge = np.zeros(window - 1, np.uint32)
    padded = np.concatenate([edge, least, edge])
    chosen = np.flatnonzero(sliding(padded, window, np.maximum) == order)
    split = np.searchsorted(chosen, at)
    return [(chosen[i:j] - a, raw[chosen[i:j]]) for i, j, a in zip(split[:-1], split[1:], at[:-1])]


def _batched(names: list, texts: list[str], least: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Texts of at least ``least`` characters as code points, in pieces of bounded size."""
    ids, points, size = [], [], 0
    for name, text in zip(names, texts):
        if len(text) >= least:
            ids.append(name)
            points.append(code_points(text))
            size += len(points[-1])
            if size > _PIECE:
                yield ids, points
                ids, points, size = [], [], 0
    if ids:
        yield ids, points


def _cut_rows(span: int):
    window = span - KEY + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, points in _batched(batch.column(0).to_pylist(), batch.column(1).to_pylist(), span):
                found = [np.unique(h) for _, h in cuts(points, window)]
                names = pa.array(ids, pa.binary()).take(pa.array(np.repeat(np.arange(len(ids)), [len(f) for f in found])))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), names], names=["key", "id"])

    return run


def _longer_rows(span: int, step: int, places: bool = False):
    """For each (hash, text): digests of the stretches of the text that hold a cut with that hash and reach further on either side; with ``places`` of every one of them, with a second digest."""
    total = span - KEY - (step if step > 1 else 0)
    lefts = range(0, total + 1, step)
    size, window = KEY + total, span - KEY + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, others, at_, ids = [], [], [], []
            for name, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "keys"))):
                points = code_points(text)
                ((at, hashes),) = cuts([points], window)
                at = at[np.isin(hashes.view(np.int64), np.array(wanted, np.int64))]
                digest = window_hash(gear(points), size)
                starts = np.unique(np.concatenate([at - (KEY - 1) - a for a in lefts]))
                starts = starts[(starts >= 0) & (starts < len(digest))]
                found = digest[starts] if places else np.unique(digest[starts])
                keys.append(found.view(np.int64))
                ids.extend([name] * len(found))
                if places:
                    others.append(window_hash(mix(gear(points)), size)[starts].view(np.int64))
                    at_.append(starts)
            if keys:
                columns = [pa.array(np.concatenate(keys)), pa.array(ids, pa.binary())]
                if places:
                    columns += [pa.array(np.concatenate(others)), pa.array(np.concatenate(at_).astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "id", "other", "at"][: len(columns)])

    return run


def common_runs(a: str, b: str, span: int = MIN_SPAN) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """The stretches of each text that lie in a common run of at least ``span`` characters, compared literally."""
    ha, hb = window_hash(gear(code_points(a)), span), window_hash(gear(code_points(b)), span)
    out = []
    for x, hx, hy, y in ((a, ha, hb, b), (b, hb, ha, a)):
        runs: list[tuple[int, int]] = []
        at = np.flatnonzero(np.isin(hx, hy))
        if len(at):
            breaks = np.flatnonzero(np.diff(at) != 1)
            for s, e in zip(at[np.r_[0, breaks + 1]].tolist(), at[np.r_[breaks, len(at) - 1]].tolist()):
                if x[s : s + span] in y:
                    runs.append((s, e + span))
        out.append(runs)
    return out[0], out[1]


def _agree(a: str, b: str, most: int) -> int:
    """How many leading characters two strings have in common, at most ``most``."""
    low, high = 0, min(most, len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid
    return low


def share_run(x: str, y: str, at_x: dict[int, int], at_y: dict[int, int], span: int) -> bool:
    """Whether the texts have a common run of ``span`` characters around a cut they share, compared literally."""
    for h in at_x.keys() & at_y.keys():
        p, q = at_x[h] + 1, at_y[h] + 1
        right = _agree(x[p : p + span], y[q : q + span], span)
        left = _agree(x[max(0, p - span) : p][::-1], y[max(0, q - span) : q][::-1], span)
        if left + right >= span:
            return True
    return False


def _compare(span: int):
    """Candidate pairs with their texts in, the pairs that do share a run out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (batch.column(c).to_pylist() for c in ("a", "b", "x", "y"))
            texts = dict(zip(a, x)) | dict(zip(b, y))
            found, again = {}, set()
            for ids, points in _batched(list(texts), list(texts.values()), span):
                for name, (at, hashes) in zip(ids, cuts(points, span - KEY + 1)):
                    found[name] = dict(zip(hashes.tolist(), at.tolist()))
                    if len(found[name]) < len(at):
                        again.add(name)  # the same 64 characters more than once: which of them is meant is open
            keep = []
            for i, j in zip(a, b):
                ok = share_run(texts[i], texts[j], found[i], found[j], span)
                if not ok and (i in again or j in again):
                    ok = bool(common_runs(texts[i], texts[j], span)[0])
                keep.append(ok)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _runs(span: int):
    """(id, start, end) of the common runs in either text of each pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bounds = [], []
            for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "x", "y"))):
                for name, runs in zip((a, b), common_runs(x, y, span)):
                    ids.extend([name] * len(runs))
                    bounds.extend(runs)
            s, e = zip(*bounds) if bounds else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(s, pa.int64()), pa.array(e, pa.int64())], names=["id", "s", "e"])

    return run


def texts_of(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, text) of the wanted ids, once each."""
    return texts.join(ids.distinct(), "id", "left_semi").dropDuplicates(["id"])


def join_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, x, y): both texts beside each pair of ids."""
    wanted = materialize(texts_of(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))), texts), "texts")
    return pairs.join(wanted.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").join(wanted.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")


class SharedSpans:
    """The classes of equal texts; the exact pairs of classes that share a run, or how much of each is shared."""

    def __init__(self, df: DataFrame, name: Column, text: Column, span: int = MIN_SPAN, cap: int = CAP):
        if span < KEY:
            raise ValueError(f"spans are at least {KEY} characters")
        self.span, self.cap = span, cap
        rows = df.select(name.cast("string").alias("file"), text.alias("text")).filter("file is not null and text is not null")
        rows = rows.withColumn("id", F.unhex(F.md5("text")))
        self.texts = rows.filter(F.length("text") >= span).select("id", "text")
        self.members = rows.filter(F.length("text") >= span).select("id", "file").distinct()
        self.sizes = rows.select("file", "id", F.length("text").cast("bigint").alias("n_chars")).distinct()

    @cached_property
    def _candidates(self) -> tuple[DataFrame, DataFrame | None]:
        """Pairs of classes that share a key few share; and, if there are any, the texts with keys too many share, even with more context: (id, text, keys)."""
        keys = first = materialize(shared_keys(self.texts.mapInArrow(_cut_rows(self.span), "key bigint, id binary").distinct()), "keys")
        pairs, rest = small_pairs(keys, self.cap), None
        hot = keys.filter(F.col("n") > self.cap)
        if not hot.isEmpty():
            rest = self._with_text(hot)
            keys = materialize(shared_keys(rest.mapInArrow(_longer_rows(self.span, 16), "key bigint, id binary").distinct()), "longer")
            pairs = pairs.union(small_pairs(keys, self.cap))
            still = keys.filter(F.col("n") > self.cap)
            # cuts by their gear hash: the second step starts from them again
            rest = None if still.isEmpty() else self._with_text(first.filter(F.col("n") > self.cap).join(still.select("id").distinct(), "id", "left_semi"))
        return materialize(pairs.distinct(), "candidates"), rest

    def _with_text(self, keys: DataFrame) -> DataFrame:
        return keys.groupBy("id").agg(F.collect_set("key").alias("keys")).join(self.texts.dropDuplicates(["id"]), "id")

    @cached_property
    def found(self) -> DataFrame:
        """All pairs (a, b) of classes that share a run."""
        pairs, rest = self._candidates
        if rest is not None:
            keys = materialize(shared_keys(rest.mapInArrow(_longer_rows(self.span, 1), "key bigint, id binary").distinct()), "whole")
            pairs = materialize(pairs.union(block_pairs(keys, self.cap)).distinct(), "pairs")
        return materialize(join_texts(pairs, self.texts).mapInArrow(_compare(self.span), "a binary, b binary"), "found")

    def pairs(self) -> DataFrame:
        """(file_a, file_b), file_a < file_b."""
        return expand(self.found, self.members, "file")

    def shared(self) -> DataFrame:
        """(file, n_chars, shared_chars): how many characters of each text lie in a run that a text of another name holds too."""
        pairs, rest = self._candidates
        runs = join_texts(pairs, self.texts).mapInArrow(_runs(self.span), "id binary, s bigint, e bigint")
        if rest is not None:
            # what very many share needs no pairs: a stretch of ``span`` characters is shared if two texts have its digests
            places = materialize(rest.mapInArrow(_longer_rows(self.span, 1, True), "key bigint, id binary, other bigint, at bigint"), "places")
            shared = places.groupBy("key", "other").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b").select("key", "other")
            runs = runs.union(places.join(shared, ["key", "other"]).select("id", F.col("at").alias("s"), (F.col("at") + self.span).alias("e")))
        states = interval_states(runs, F.hex("id"), F.col("s"), F.col("e"))
        partly = interval_periods(states).groupBy("key").agg(F.sum(F.col("period_end") - F.col("period_start")).alias("part"))
        copies = self.members.groupBy("id").agg(F.count("*").alias("copies"))
        rows = self.sizes.join(copies, "id", "left").join(partly.withColumn("id", F.unhex("key")).drop("key"), "id", "left")
        shared = F.when(F.col("copies") > 1, F.col("n_chars")).otherwise(F.coalesce("part", F.lit(0)))
        return rows.select("file", "n_chars", shared.cast("bigint").alias("shared_chars"))
