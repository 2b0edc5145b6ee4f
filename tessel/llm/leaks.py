"""Held-out passages inside a corpus by greedy string tiling (p8).

Seeds are runs of ``least`` words, known by a Karp-Rabin hash of their words. The seeds of all items and those of all documents are two tables, and their join
gives the documents and items that share a seed. A sieve of at most ``MOST_BITS`` bits, made of the items' seeds, keeps most seeds that no item has out of the
join; it lets every seed pass that some item has, so it only saves work. Which side is sent where is left to the optimiser: a small item table is
broadcast by its size, large ones meet the documents' seeds by hash, where adaptive execution splits a seed that very many documents hold.

The pairs found are tiled with the texts at hand: a running Karp-Rabin hash finds the seeds of document and item, seeds grow to maximal
matches, and the longest match is marked again and again, each word of document and item in one tile at most, until no match of ``least`` words is left. So
passages that were reordered or interrupted still cover their item. Of the seeds of a match only its first is formed, the one before which the words
differ, and the match is extended from there word by word; so a text that repeats one run costs as much as it has matches, not seeds, and no
occurrence is left out. Documents are read whole; the items of a document come in groups of about ``GROUP``.

Defined results: null, empty and too short texts give nothing; equal texts under several ids are all reported; repeated rows change
nothing; several texts of one id each count; word case is ignored, whatever stands between words too. Columns other than id and text are not read.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.llm.hashing import WordDigests, mix, window_hash
from tessel.session import materialize

WORD = re.compile(r"\w+")
LEAST = 15
GROUP = 16
MOST_BITS = 1 << 28
_BITS_A_SEED = 16
_PIECE = 400_000
_AHEAD = 64
_TOGETHER = 1 << 15


def words_of(text: str) -> list[str]:
    """Runs of letters, digits and underscores, lower-cased one by one where lower-casing could split a word."""
    return [w.lower() for w in WORD.findall(text)] if "İ" in text else WORD.findall(text.lower())


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The numbers of each range from low to before high, one range after the other."""
    n = high - low
    return np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())


def matches(doc: np.ndarray, item: np.ndarray, d: np.ndarray, i: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal matches (document positions, item positions, lengths) of ``least`` words or more from seeds among which is the first of each match."""
    first = (d == 0) | (i == 0) | (doc[d - 1] != item[i - 1])
    d, i = d[first], i[first]
    doc = np.lib.stride_tricks.sliding_window_view(np.r_[doc, np.zeros(_AHEAD, np.uint64)], _AHEAD)
    item = np.lib.stride_tricks.sliding_window_view(np.r_[item, np.full(_AHEAD, ~np.uint64(0))], _AHEAD)  # the ends differ from each other
    n = np.zeros(len(d), np.int64)
    for k in range(0, len(d), _TOGETHER):
        going = np.arange(k, min(k + _TOGETHER, len(d)))
        while len(going):
            differ = doc[d[going] + n[going]] != item[i[going] + n[going]]
            whole = ~differ.any(1)
            n[going] += np.where(whole, _AHEAD, differ.argmax(1))
            going = going[whole]
    long = n >= least
    return d[long], i[long], n[long]


class _Free:
    """Stretches of at least ``least`` words that no tile has taken."""

    def __init__(self, size: int, least: int):
        self.least, self.starts, self.ends = least, [0], [size]

    def take(self, at: int, n: int) -> None:
        k = bisect_right(self.starts, at) - 1
        rest = [(a, b) for a, b in ((self.starts[k], at), (at + n, self.ends[k])) if b - a >= self.least]
        self.starts[k : k + 1], self.ends[k : k + 1] = [a for a, _ in rest], [b for _, b in rest]


def tile(doc: np.ndarray, item: np.ndarray, seeds: list[tuple[int, int]] | np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (document position, item position, length), longest first, from seed positions of ``least`` equal words; the first seed of each match is enough."""
    return greedy(*matches(doc, item, *np.array(seeds, np.int64).reshape(-1, 2).T, least), len(doc), len(item), least)


def greedy(d: np.ndarray, i: np.ndarray, n: np.ndarray, doc_words: int, item_words: int, least: int) -> list[tuple[int, int, int]]:
    """Tiles from maximal matches: the longest, then the first in the document, then in the item."""
    if len(d) == 1:
        return [(int(d[0]), int(i[0]), int(n[0]))]
    order = np.lexsort((i, d, -n))
    d, i, n = d[order], i[order], n[order]
    in_doc, in_item, tiles = np.zeros(doc_words, bool), np.zeros(item_words, bool), []
    free_doc, free_item = _Free(doc_words, least), _Free(item_words, least)
    parts: list[tuple[int, int, int]] = []  # of matches that tiles have cut

    def whole() -> Iterator[tuple[int, int, int]]:
        for k in range(0, len(d), _TOGETHER):
            yield from zip((-n[k : k + _TOGETHER]).tolist(), d[k : k + _TOGETHER].tolist(), i[k : k + _TOGETHER].tolist())

    rest = whole()
    top = next(rest, None)
    while (top or parts) and free_doc.starts and free_item.starts:
        if parts and (top is None or parts[0] < top):
            m, at, to = heapq.heappop(parts)
        else:
            (m, at, to), top = top, next(rest, None)
        m = -m
        taken = in_doc[at : at + m] | in_item[to : to + m]
        if not taken.any():
            in_doc[at : at + m] = in_item[to : to + m] = True
            free_doc.take(at, m)
            free_item.take(to, m)
            tiles.append((at, to, m))
            continue
        edges = np.flatnonzero(np.diff(np.r_[True, taken, True].astype(np.int8)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a >= least:
                heapq.heappush(parts, (a - b, at + a, to + a))
    return tiles


class Items:
    """A block of items as numbers, with the place of every run of ``least`` words, ordered by run and the word before it (0: none)."""

    def __init__(self, rows: list[tuple[int, str]], least: int):
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        number = self.vocabulary.setdefault
        for key, text in rows:
            words = words_of(text)
            if len(words) >= least:
                self.items.append((key, np.array([number(w, len(self.vocabulary) + 1) for w in words], np.uint64)))
        runs = [len(x) - least + 1 for _, x in self.items]
        owner = np.repeat(np.arange(len(runs)), runs)
        place = _ranges(np.zeros(len(runs), np.int64), np.array(runs, np.int64))
        h = np.concatenate([np.empty(0, np.uint64), *(window_hash(mix(x), least) for _, x in self.items)])
        before = np.concatenate([np.empty(0, np.int64), *(np.r_[0, x[: len(x) - least].astype(np.int64)] for _, x in self.items)])
        order = np.lexsort((before, h))
        self.owner, self.place = owner[order].astype(np.int32), place[order].astype(np.int32)
        self.hashes, slot, times = np.unique(h[order], return_inverse=True, return_counts=True)
        self.at = np.r_[0, np.cumsum(times)]
        self.base = len(self.vocabulary) + 1
        self.key = slot * self.base + before[order]

    def by_item(self, p: np.ndarray, slot: np.ndarray, before: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Each item's number with the document's and the item's positions of seeds before which the words differ, for a document of very many; p, slot, before: of its runs."""
        by = np.argsort(slot, kind="stable")
        p, slot, before = p[by], slot[by], before[by]
        present = np.unique(slot)
        places = _ranges(self.at[present], self.at[present + 1])
        owner = self.owner[places]
        places = places[np.argsort(owner, kind="stable")]
        for own in np.split(places, np.cumsum(np.unique(owner, return_counts=True)[1])[:-1]):
            keys = self.key[own]
            slots = keys // self.base
            mine = np.unique(slots)
            hits = _ranges(np.searchsorted(slot, mine), np.searchsorted(slot, mine, "right"))
            a, b = np.searchsorted(slots, slot[hits]), np.searchsorted(slots, slot[hits], "right")
            same = slot[hits] * self.base + before[hits]
            lo, hi = np.searchsorted(keys, same), np.searchsorted(keys, same, "right")
            hi = np.where(before[hits] == 0, lo, hi)
            pairs = [(np.repeat(p[hits], y - x), self.place[own[_ranges(x, y)]]) for x, y in ((a, lo), (hi, b))]
            yield int(self.owner[own[0]]), *map(np.concatenate, zip(*pairs))


def search(block: Items, doc: np.ndarray, least: int) -> Iterator[tuple]:
    """(item, tiles, longest, covered, item words) of a document given by its words' numbers in the block, 0 where it has none, the last one too."""
    unknown = np.cumsum(np.r_[0, doc == 0])
    inside = np.flatnonzero(unknown[least:] == unknown[:-least]) if len(doc) >= least else np.empty(0, int)
    if not len(inside) or not len(block.hashes):
        return
    h = window_hash(mix(doc), least)[inside]
    slot = np.minimum(np.searchsorted(block.hashes, h), len(block.hashes) - 1)
    hit = block.hashes[slot] == h
    inside, slot = inside[hit], slot[hit]
    if not len(inside):
        return
    for k, d, i in block.by_item(inside, slot, np.r_[np.uint64(0), doc][inside].astype(np.int64)):
        key, item = block.items[k]
        d, i, n = matches(doc, item, d, i, least)
        if len(d):
            tiles = greedy(d, i, n, len(doc), len(item), least)
            yield key, len(tiles), max(t[2] for t in tiles), sum(t[2] for t in tiles), len(item)


def _seeds(least: int, sieve: np.ndarray | None = None):
    """(key, id) of the distinct seeds of each text that pass the sieve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = WordDigests()
        shift = np.uint64(64 - (64 * len(sieve)).bit_length() + 1) if sieve is not None else None

        def flush(ids: list, parts: list[np.ndarray]) -> pa.RecordBatch:
            at = np.cumsum([0, *(len(p) for p in parts)])
            runs = np.diff(at) - least + 1
            key = mix(window_hash(np.concatenate(parts), least)[_ranges(at[:-1], at[:-1] + runs)])
            owner = np.repeat(np.arange(len(parts)), runs)
            if sieve is not None:
                slot = key >> shift
                passed = np.flatnonzero(sieve[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1))
                key, owner = key[passed], owner[passed]
            order = np.lexsort((key, owner))
            key, owner = key[order], owner[order]
            first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])]) if len(key) else np.empty(0, int)
            return pa.RecordBatch.from_arrays([pa.array(key[first].view(np.int64)), pa.array(ids, pa.int64()).take(pa.array(owner[first]))], names=["key", "id"])

        for batch in batches:
            ids, parts, size = [], [], 0
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                if len(words) < least:
                    continue
                ids.append(id_)
                parts.append(digests.of(words))
                size += len(words)
                if size > _PIECE:
                    yield flush(ids, parts)
                    ids, parts, size = [], [], 0
            if ids:
                yield flush(ids, parts)

    return run


def _sieve(seeds: DataFrame) -> np.ndarray:
    """A set of seeds as bits at the leading digits of their keys, in 64-bit words; ``MOST_BITS`` bits at most, however many seeds there are."""
    n = seeds.count()
    bits = min(MOST_BITS, max(1 << 16, 1 << (_BITS_A_SEED * n - 1).bit_length()))
    slot = F.shiftrightunsigned("key", 64 - bits.bit_length() + 1).alias("slot")
    words = seeds.select(slot).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("mask")).toArrow()
    out = np.zeros(bits >> 6, np.uint64)
    out[words.column("word").to_numpy()] = words.column("mask").to_numpy().view(np.uint64)
    return out


def _tile(least: int):
    """Documents with the items they share a seed with, in; tilings out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stop = np.zeros(1, np.uint64)  # an unknown word after each document: no run crosses it
        for batch in batches:
            rows: list[tuple] = []
            for id_, text, items in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "items"))):
                block = Items([(i["item_id"], i["text"]) for i in items], least)
                number = block.vocabulary.get
                rows.extend((id_, *found) for found in search(block, np.concatenate([np.array([number(w, 0) for w in words_of(text)], np.uint64), stop]), least))
            columns = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "tiles", "longest", "covered", "item_words"])

    return run


def leaks(items: DataFrame, docs: DataFrame, item_id: Column, item_text: Column, doc_id: Column, doc_text: Column, least: int = LEAST, group: int = GROUP) -> DataFrame:
    """(doc_id, item_id, tiles, longest, covered, item_words) of every document and item that share a run of at least ``least`` words."""
    items = items.select(item_id.cast("bigint").alias("item_id"), item_text.alias("text")).filter("item_id is not null and text is not null").distinct()
    docs = docs.select(doc_id.cast("bigint").alias("doc_id"), doc_text.alias("text")).filter("doc_id is not null and text is not null")
    wanted = materialize(items.mapInArrow(_seeds(least), "key bigint, item_id bigint").distinct(), "item_seeds")
    found = docs.mapInArrow(_seeds(least, _sieve(wanted)), "key bigint, doc_id bigint")
    pairs = materialize(found.join(wanted, "key").select("doc_id", "item_id").distinct(), "pairs")
    # the items of one document in groups of bounded expected size, so that no row holds them all
    per = pairs.groupBy("doc_id").agg(F.ceil(F.count("*") / group).alias("parts"))
    grouped = pairs.join(per, "doc_id").join(items, "item_id").groupBy("doc_id", F.pmod(F.xxhash64("item_id"), F.col("parts")).alias("part")).agg(F.collect_list(F.struct("item_id", "text")).alias("items"))
    texts = docs.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi").distinct()
    return grouped.join(texts, "doc_id").select("doc_id", "text", "items").mapInArrow(_tile(least), "doc_id bigint, item_id bigint, tiles bigint, longest bigint, covered bigint, item_words bigint").distinct()
