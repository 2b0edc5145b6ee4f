"""Packing items into containers of fixed capacity by shortest-pack-first over the length histogram (p7).

Lengths are tokens of a public tokenizer. Only the histogram of lengths, at most capacity + 1 numbers per profile, reaches the driver.
There lengths are placed longest first, each into the packs with the most room left, whole counts of equal packs at a time; a new
pack opens only where none has room. The result is a list of packing patterns with counts, again independent of the number of items. Each item is then
joined to its container by its rank among the items of its length; ranks are counted per salt and offset, so
no task sees all items of one length.

An item above the capacity is split into full containers and a remainder; the remainder is packed like any item. Defined results: null and empty texts have length 0,
take no room and go to the first container; repeated rows are items of their own; a capacity that is null or below 1 is an error; an
empty table gives no containers. Input columns other than id and text are not read.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tessel.session import materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: how the published byte-level vocabulary splits text
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PIECE = 100_000
_SALT_ROWS = 50_000
_RANK_BITS = 44
MAX_PROFILES = 1000


def load_tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, key: Column, text: Column, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, tokens) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_tokenizer(tokenizer).encode_ordinary
        for batch in batches:
            counts = [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["id", "tokens"])

    return df.select(key.cast("bigint").alias("id"), text.alias("text")).mapInArrow(run, "id bigint, tokens bigint")


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(count, {length: how often in each such pack}) for item lengths 1..capacity."""
    room: dict[int, list[list]] = defaultdict(list)  # free room -> [count, pack as a chain (length, rest)]
    most = 0
    for length in sorted((k for k, n in histogram.items() if k > 0 and n > 0), reverse=True):
        left = histogram[length]
        while left:
            while most >= length and not room.get(most):
                most -= 1
            if most < length:
                # no open pack takes this length: as many new ones as items, unless a new pack takes several
                each = capacity // length
                packs, rest = divmod(left, each)
                for count, times in ((packs, each), (1 if rest else 0, rest)):
                    if count:
                        chain = None
                        for _ in range(times):
                            chain = (length, chain)
                        room[capacity - times * length].append([count, chain])
                        most = max(most, capacity - times * length)
                break
            entry = room[most][-1]
            used = min(left, entry[0])
            left -= used
            if used == entry[0]:
                room[most].pop()
            else:
                entry[0] -= used
            room[most - length].append([used, (length, entry[1])])
    out: dict[tuple, int] = defaultdict(int)
    for entries in room.values():
        for count, chain in entries:
            pack: dict[int, int] = defaultdict(int)
            while chain:
                pack[chain[0]] += 1
                chain = chain[1]
            out[tuple(sorted(pack.items(), reverse=True))] += count
    return [(count, dict(pack)) for pack, count in sorted(out.items(), reverse=True)]


def _ranges(patterns: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """For the items of each length, by rank: the first rank of a pattern's items, its first container and how many containers it has."""
    rows, taken, base = [], defaultdict(int), 0
    for count, pack in patterns:
        for length, times in pack.items():
            rows.append((length, taken[length], base, count))
            taken[length] += count * times
        base += count
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return {"at": (table[:, 0] << _RANK_BITS) + table[:, 1], "first": table[:, 1], "base": table[:, 2], "count": table[:, 3]}


def _assign(tables: dict[str, dict[str, np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            profile = np.array(batch.column("profile").to_pylist(), object)
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            container = np.zeros(len(profile), np.int64)
            for name, t in tables.items():
                i = np.flatnonzero((profile == name) & (length > 0))
                j = np.searchsorted(t["at"], (length[i] << _RANK_BITS) + rank[i], "right") - 1
                container[i] = t["base"][j] + (rank[i] - t["first"][j]) % t["count"][j]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("profile", "id", "pieces", "length")] + [pa.array(container)], names=["profile", "id", "pieces", "length", "packed"])

    return run


def pack(counts: DataFrame, profiles: dict[str, int]) -> DataFrame:
    """(profile, id, piece_ix, tokens, container) for every item (id, tokens), for each profile's capacity. ``container`` starts with ``p`` for shared ones, with ``f`` for a full one of a split item."""
    if len(profiles) > MAX_PROFILES or any(c is None or c < 1 for c in profiles.values()):
        raise ValueError("profiles need capacities of 1 or more")
    counts = materialize(counts.select("id", "tokens"), "lengths")
    salts = max(1, counts.count() // _SALT_ROWS)
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("profile"), F.lit(c).cast("bigint").alias("capacity")) for p, c in profiles.items()))).alias("p")
    items = counts.select("id", "tokens", each).select("id", "tokens", "p.*")
    full = F.when(F.col("tokens") > F.col("capacity"), F.expr("tokens div capacity")).otherwise(F.lit(0))
    items = items.withColumn("pieces", full).withColumn("length", F.col("tokens") - F.col("pieces") * F.col("capacity"))
    items = items.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    rest = items.filter("length > 0 or tokens = 0")
    by_salt = materialize(rest.groupBy("profile", "length", "salt").agg(F.count("*").alias("n")), "histogram")
    histograms: dict[str, dict[int, int]] = {p: {} for p in profiles}
    for r in by_salt.groupBy("profile", "length").agg(F.sum("n").alias("n")).toLocalIterator():
        histograms[r.profile][r.length] = r.n
    tables = {p: _ranges(pack_histogram(h, profiles[p])) for p, h in histograms.items()}
    before = F.sum("n").over(Window.partitionBy("profile", "length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = by_salt.select("profile", "length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    inner = F.row_number().over(Window.partitionBy("profile", "length", "salt").orderBy("id")) - 1
    # the offsets grow with the items; Spark judges them by their compressed files, a small part of what a broadcast takes, and the items are sorted by these keys anyway
    ranked = rest.withColumn("inner", inner).join(offsets.hint("merge"), ["profile", "length", "salt"]).withColumn("rank", (F.col("inner") + F.col("before")).cast("bigint"))
    packed = ranked.select("profile", "id", "pieces", "length", "rank").mapInArrow(_assign(tables), "profile string, id bigint, pieces bigint, length bigint, packed bigint")
    shared = packed.select("profile", "id", F.col("pieces").alias("piece_ix"), F.col("length").alias("tokens"), F.concat(F.lit("p"), F.col("packed")).alias("container"))
    # a number for each row: ids may repeat or be null
    split = items.filter("pieces > 0").withColumn("row", F.monotonically_increasing_id())
    whole = split.select("row", "profile", "id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1)).alias("piece_ix"), F.col("capacity").alias("tokens"))
    return shared.unionByName(whole.withColumn("container", F.concat(F.lit("f"), "row", F.lit("-"), "piece_ix")).drop("row"))


def fill(packing: DataFrame, profiles: dict[str, int]) -> DataFrame:
    """(profile, containers, tokens, fewest, fill): how many containers, the least number any packing needs by volume, and the share of room used."""
    per = packing.groupBy("profile", "container").agg(F.sum("tokens").alias("t"))
    rows = per.groupBy("profile").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"))
    capacity = F.create_map(*(F.lit(x) for p, c in profiles.items() for x in (p, c)))[F.col("profile")].cast("bigint")
    fewest = F.expr("(tokens + capacity - 1) div capacity")
    return rows.withColumn("capacity", capacity).select("profile", "capacity", "containers", "tokens", "fullest", fewest.alias("fewest"), F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 4).alias("fill"))
