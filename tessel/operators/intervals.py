"""Merged periods and gaps of half-open integer intervals per key.

The aggregate's state is a sorted list of disjoint intervals. Two states combine by a linear merge, so they are built per
Arrow batch, then combined over a reduction tree of shuffles: first per (key, block, salt), then per (key, block). A *block* is
a fixed stretch of the axis to which an interval belongs by its start, so one state never holds more than
``block`` disjoint starts, however large a key grows; a salt spreads a key that holds a large part of all rows. What an interval reaches beyond its block is
settled at the end by a running maximum over the blocks of a key, first within stretches of ``TOP`` blocks, then over these: no task
holds more of one key than a stretch's states, or one small row for each stretch.

Defined results: rows with a null key, start or end, and empty or reversed intervals are ignored; touching intervals
([1,3) and [3,5)) are one period; repeated rows change nothing; an empty table gives an empty result. Other columns of the
input are dropped first, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16
SALTS = 16
TOP = 1024
_STATE = "key string, block bigint, salt int, starts array<bigint>, ends array<bigint>"


def merge_runs(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of the intervals of every group at once: (group, start, end) sorted and disjoint.

    The input is mostly runs that are sorted already; the stable sort merges such runs in linear time."""
    if not len(group):
        return group, start, end
    order = np.argsort(start, kind="stable")
    order = order[np.argsort(group[order], kind="stable")]
    g, s, e = group[order], start[order], end[order]
    # a running maximum of ends that restarts with each group: groups are lifted onto disjoint bands
    lo = min(int(s.min()), int(e.min()))
    span = max(int(e.max()), int(s.max())) - lo + 1
    first = np.r_[True, g[1:] != g[:-1]]
    rank = np.cumsum(first) - 1
    if int(rank[-1] + 1) * span < 2**62:
        reach = np.maximum.accumulate(rank * span + (e - lo)) - rank * span + lo
    else:  # offsets too wide for bands: one group at a time
        bounds = np.flatnonzero(np.r_[first, True])
        reach = np.concatenate([np.maximum.accumulate(e[a:b]) for a, b in zip(bounds[:-1], bounds[1:])])
    opens = first | np.r_[True, s[1:] > reach[:-1]]
    at = np.flatnonzero(opens)
    return g[at], s[at], reach[np.r_[at[1:] - 1, len(s) - 1]]


def _states(key: pa.Array, block: np.ndarray, salt: int, group: np.ndarray, s: np.ndarray, e: np.ndarray, head: np.ndarray) -> pa.RecordBatch:
    """One row per group; ``head`` maps a group to a row of ``key`` and ``block``."""
    at = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    rows = head[group[at]]
    offsets = pa.array(np.r_[at, len(group)].astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [key.take(pa.array(rows)).cast(pa.string()), pa.array(block[rows]), pa.array(np.full(len(rows), salt, np.int32)), pa.ListArray.from_arrays(offsets, pa.array(s)), pa.ListArray.from_arrays(offsets, pa.array(e))],
        names=["key", "block", "salt", "starts", "ends"],
    )


def _grouped(key: pa.Array, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group number of each row by (key, block), and a row that stands for each group."""
    codes = key.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.lexsort((block, codes))
    c, b = codes[order], block[order]
    new = np.r_[True, (c[1:] != c[:-1]) | (b[1:] != b[:-1])]
    group = np.empty(len(codes), np.int64)
    group[order] = np.cumsum(new) - 1
    return group, order[new]


def _partial(block_size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, batch in enumerate(batches, TaskContext.get().partitionId()):
            if batch.num_rows:
                s, e = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
                block = s // block_size
                group, head = _grouped(batch.column(0), block)
                yield _states(batch.column(0), block, n % SALTS, *merge_runs(group, s, e), head)

    return run


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States sorted by (key, block) in; one state for each out. Only the last group of a batch is carried."""
    carry: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if carry is not None:
            batch = pa.Table.from_batches([carry, batch]).combine_chunks().to_batches()[0]
        merged = _merge_states(batch)
        carry = merged.slice(merged.num_rows - 1)
        if merged.num_rows > 1:
            yield merged.slice(0, merged.num_rows - 1)
    if carry is not None:
        yield carry


def _merge_states(batch: pa.RecordBatch) -> pa.RecordBatch:
    key, block = batch.column("key"), batch.column("block").to_numpy(zero_copy_only=False)
    codes = key.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    group = np.cumsum(np.r_[True, (codes[1:] != codes[:-1]) | (block[1:] != block[:-1])]) - 1
    starts, ends = batch.column("starts"), batch.column("ends")
    lengths = starts.value_lengths().to_numpy(zero_copy_only=False)
    head = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    return _states(key, block, 0, *merge_runs(np.repeat(group, lengths), starts.flatten().to_numpy(zero_copy_only=False), ends.flatten().to_numpy(zero_copy_only=False)), head)


def interval_states(df: DataFrame, key: Column, start: Column, end: Column, block: int = BLOCK) -> DataFrame:
    """(key, block, starts, ends, reach): the disjoint intervals that start in each block, and how far earlier blocks of the key reach."""
    rows = df.select(key.cast("string").alias("key"), start.cast("bigint").alias("s"), end.cast("bigint").alias("e")).filter("key is not null and s < e")
    states = rows.mapInArrow(_partial(block), _STATE)
    for keys in (["key", "block", "salt"], ["key", "block"]):
        states = states.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_combine, _STATE)
    states = states.withColumn("top", F.expr(f"block div {TOP}"))
    end_of = F.element_at("ends", -1)
    inner = F.max(end_of).over(Window.partitionBy("key", "top").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    tops = states.groupBy("key", "top").agg(F.max(end_of).alias("last"))
    tops = tops.select("key", "top", F.max("last").over(Window.partitionBy("key").orderBy("top").rowsBetween(Window.unboundedPreceding, -1)).alias("above"))
    return states.withColumn("inner", inner).join(tops, ["key", "top"]).select("key", "block", "starts", "ends", F.greatest("inner", "above").alias("reach"))


def _gaps() -> Column:
    """The gaps that end in a block, as (gap_start, gap_end)."""
    # the end of what lies before each interval, null before the very first
    before = F.concat(F.array("reach"), F.transform(F.slice("ends", 1, F.size("ends") - 1), lambda e: F.greatest(e, "reach")))
    return F.filter(F.arrays_zip(before.alias("gap_start"), F.col("starts").alias("gap_end")), lambda g: g["gap_start"] < g["gap_end"])


def interval_gaps(states: DataFrame) -> DataFrame:
    """(key, gap_start, gap_end): what no interval covers between the first and the last covered point of a key."""
    return states.select("key", F.inline(_gaps()).alias("gap_start", "gap_end"))


def interval_periods(states: DataFrame) -> DataFrame:
    """(key, period_start, period_end): the continuous covered periods of a key, the complement of its gaps.

    A period ends where the next gap starts: the next one in its block, else the first one in a later block, else the end of all."""
    rows = states.select("key", "block", F.expr(f"block div {TOP}").alias("top"), F.col("reach").isNull().alias("first"), F.element_at("starts", 1).alias("lo"), F.element_at("ends", -1).alias("last"), _gaps().alias("gaps"))
    rows = rows.withColumn("stop", F.get("gaps", F.lit(0))["gap_start"])
    rows = rows.withColumn("next", F.first("stop", ignorenulls=True).over(Window.partitionBy("key", "top").orderBy("block").rowsBetween(1, Window.unboundedFollowing)))
    tops = rows.groupBy("key", "top").agg(F.min(F.when(F.col("stop").isNotNull(), F.struct("block", "stop")))["stop"].alias("stop"), F.max("last").alias("last"))
    after = Window.partitionBy("key").orderBy("top").rowsBetween(1, Window.unboundedFollowing)
    tops = tops.select("key", "top", F.first("stop", ignorenulls=True).over(after).alias("later"), F.max("last").over(Window.partitionBy("key")).alias("hi"))
    none = F.array().cast("array<bigint>")
    opens = F.concat(F.when(F.col("first"), F.array("lo")).otherwise(none), F.transform("gaps", lambda g: g["gap_end"]))
    inner = F.when(F.col("first"), F.col("gaps")).otherwise(F.slice("gaps", 2, F.greatest(F.size("gaps") - 1, F.lit(0))))
    closes = F.concat(F.transform(inner, lambda g: g["gap_start"]), F.array(F.coalesce("next", "later", "hi")))
    periods = rows.join(tops, ["key", "top"]).select("key", F.inline(F.arrays_zip(opens.alias("period_start"), closes.alias("period_end"))))
    return periods.filter("period_start is not null")
