"""Execution coverage: merge, rebase, index, hot paths, cold code. Ranges are rows (file, fn, start, end, hits)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.session import materialize


def merge_ranges(ranges: DataFrame) -> DataFrame:
    """One row per (file, fn, start, end) with summed hits: duplicate scripts of several dumps become one."""
    return ranges.groupBy("file", "fn", "start", "end").agg(F.sum("hits").cast("bigint").alias("hits"))


def plain_url(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"^file://(localhost)?", ""), r"\?.*$", "")


def common_root(urls: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """(keys, root): the longest common directory of the urls of a key. The least and the greatest url of a set have the prefix all of them have, so two aggregates are enough."""
    ends = urls.groupBy(*keys).agg(F.min(column).alias("a"), F.max(column).alias("b"))
    size = F.least(F.length("a"), F.length("b"))
    same = F.filter(F.sequence(F.lit(1), size), lambda n: F.substring(F.col("a"), F.lit(1), n) == F.substring(F.col("b"), F.lit(1), n))
    length = F.when(size > 0, F.coalesce(F.array_max(same), F.lit(0))).otherwise(0)
    return ends.select(*keys, F.regexp_extract(F.substring(F.col("a"), F.lit(1), length), r"^(.*)/", 1).alias("root"))


def rebase(path: Column, old: Column, new: Column) -> tuple[Column, Column]:
    """(path below ``new``, whether it lay below ``old``); others stay."""
    inside = F.startswith(path, F.concat(old, F.lit("/")))
    return F.when(inside, F.concat(new, F.substr(path, F.length(old) + 1))).otherwise(path), inside


def function_hits(ranges: DataFrame) -> DataFrame:
    return ranges.groupBy("file", "fn").agg(F.sum("hits").cast("bigint").alias("hits"))


def hot_paths(hits: DataFrame, percent: int = 10) -> DataFrame:
    """(file, fn, hits, rank, n): the top ``percent`` of functions by hits (rounded up); none if all have equally many. Rank 0 is the hottest.

    A global rank is a sort, not one task: rows are range-partitioned by the order, ranked within partitions, and shifted by the sizes of the partitions before."""
    live = hits.filter("hits > 0")
    total = live.agg(F.count("*").alias("n"), F.min("hits").alias("low"), F.max("hits").alias("high"))
    order = [F.col("hits").desc(), F.col("file"), F.col("fn")]
    row = total.first()
    if not row.n or row.low == row.high:
        return live.limit(0).select("file", "fn", "hits", F.lit(0).cast("bigint").alias("rank"), F.lit(0).cast("bigint").alias("n"))
    k = -(-row.n * percent // 100)
    parts = live.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    inner = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    ranked = materialize(parts.withColumn("_r", inner), "ranked")  # both uses below must see the same partitions
    sizes = ranked.groupBy("_p").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifted = ranked.join(F.broadcast(sizes.select("_p", before.alias("_b"))), "_p")  # a row per partition
    rank = (F.col("_r") + F.col("_b")).cast("bigint")
    return shifted.select("file", "fn", "hits", rank.alias("rank"), F.lit(row.n).cast("bigint").alias("n")).filter(F.col("rank") < k)


def cold_code(hits: DataFrame, threshold: int = 0) -> DataFrame:
    return hits.filter(F.col("hits") <= threshold)


def coverage_missing(files: DataFrame, ranges: DataFrame) -> DataFrame:
    return files.select("file").distinct().join(ranges.select("file").distinct(), "file", "left_anti")
