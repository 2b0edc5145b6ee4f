"""Streams of changes: bursts of events, and incremental refresh of the inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessel.extract import inventory


def change_stream(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Change records (ts, project, file, content) that arrive as Parquet files in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def bursts(events: DataFrame, gap: str, lateness: str, key: str = "project", path: str = "file") -> DataFrame:
    """(key, start, end, files): the distinct paths of each burst, which ends when nothing comes for ``gap``. Append mode; what is later than ``lateness`` is dropped."""
    grouped = events.withWatermark("ts", lateness).groupBy(key, F.session_window("ts", gap).alias("w"))
    return grouped.agg(F.array_sort(F.collect_set(path)).alias("files")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "files")


def windowed_counts(events: DataFrame, width: str, slide: str, lateness: str, key: str) -> DataFrame:
    grouped = events.withWatermark("ts", lateness).groupBy(key, F.window("ts", width, slide).alias("w"))
    return grouped.agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def _marked(files: DataFrame, version: str) -> DataFrame:
    return files.withColumn("digest", F.sha2(F.coalesce("content", F.lit("")), 256)).withColumn("version", F.lit(version))


def stale(files: DataFrame, cached: DataFrame, version: str) -> DataFrame:
    """Files(ts, file, content) that the current rows of a cache(ts, file, digest, version) do not hold and that are not older than these."""
    now = cached.select("file", F.col("digest").alias("_digest"), F.col("version").alias("_version"), F.col("ts").alias("_ts"))
    same = (F.col("digest") == F.col("_digest")) & (F.col("version") == F.col("_version"))
    rows = _marked(files, version).join(now, "file", "left")
    return rows.filter(F.col("_ts").isNull() | ~same & (F.col("ts") >= F.col("_ts"))).drop("_digest", "_version", "_ts")


def current(cache: DataFrame) -> DataFrame:
    """Of each file the row that holds: the one of its latest change; of equal times the one written last."""
    order = F.struct("ts", "written")
    return cache.groupBy("file").agg(F.max_by(F.struct(*cache.columns), order).alias("_row")).select("_row.*")


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def refresh(changes: DataFrame, cache_path: str, version: str):
    """A ``foreachBatch`` function: extract what changed and append it to the inventory cache, whose ``current`` rows hold. A repeated batch adds nothing; a content that comes back is a new row."""

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        last = batch.groupBy("file").agg(F.max(F.struct("ts", "project", "content")).alias("b")).select("file", "b.ts", "b.project", "b.content")
        fresh = stale(last, current(spark.read.parquet(cache_path)), version) if _exists(spark, cache_path) else _marked(last, version)
        keys = fresh.select("file", "digest", "version", "ts").withColumn("written", F.current_timestamp())
        inventory(fresh).join(keys, "file").write.mode("append").parquet(cache_path)

    return changes.writeStream.foreachBatch(run)


def compact(spark: SparkSession, cache_path: str, to: str) -> None:
    """Write the rows of a cache that hold to another place, one small file for many."""
    current(spark.read.parquet(cache_path)).write.parquet(to)
