"""Re-exports: names that flow along barrels, star symbols, cycles, and what an entry re-exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.operators.graph import propagate, reachable, reverse, strongly_connected


def exported_names(decls: DataFrame, reexports: DataFrame) -> DataFrame:
    """(file, name) of all names a file offers, its own and those of files it re-exports; reexports(src, dst)."""
    own = decls.filter("exported").select(F.col("file").alias("node"), F.col("name").alias("value"))
    return propagate(reverse(reexports), own).select(F.col("node").alias("file"), F.col("value").alias("name"))


def provenance(exported: DataFrame, decls: DataFrame, reexports: DataFrame) -> DataFrame:
    """(file, name, via): the least direct source of each name that is not the file's own."""
    own = decls.filter("exported").select("file", "name")
    others = exported.join(own, ["file", "name"], "left_anti")
    hop = reexports.select(F.col("src").alias("file"), F.col("dst").alias("via")).join(exported.select(F.col("file").alias("via"), "name"), "via")
    return others.join(hop, ["file", "name"]).groupBy("file", "name").agg(F.min("via").alias("via"))


def star_symbols(stars: DataFrame) -> DataFrame:
    """(file, symbol) of stars(src, dst_id, alias): the synthetic name of everything one star brings."""
    plain = F.concat(F.lit("__star_"), "dst_id", F.lit("__"))
    named = F.concat(F.lit("__star_"), "dst_id", F.lit("_as_"), "alias", F.lit("__"))
    return stars.select(F.col("src").alias("file"), F.when(F.col("alias").isNull(), plain).otherwise(named).alias("symbol")).distinct()


def reexport_cycles(reexports: DataFrame) -> DataFrame:
    return strongly_connected(reexports)


def entry_targets(reexports: DataFrame, entries: DataFrame) -> DataFrame:
    """(file, direct): what entries re-export, at once or through others."""
    direct = reexports.join(entries.select(F.col("file").alias("src")), "src", "left_semi").select(F.col("dst").alias("file")).distinct()
    every = reachable(reexports, direct.select(F.col("file").alias("node"))).select(F.col("node").alias("file"))
    return every.join(direct.withColumn("direct", F.lit(True)), "file", "left").select("file", F.coalesce("direct", F.lit(False)).alias("direct"))


def trace_export(edges: DataFrame, usages: DataFrame, name: str) -> DataFrame:
    """(file) of the importers of files that use a name, over importers that use it too; a start counts only if it is reached again."""
    using = usages.filter(F.col("name") == name).select("file").distinct()
    links = edges.filter("resolvable and dst is not null").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    links = links.join(using.select(F.col("file").alias("src")), "src", "left_semi").join(using.select(F.col("file").alias("dst")), "dst", "left_semi").select("src", "dst")
    first = links.join(using.select(F.col("file").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
    return reachable(links, first).select(F.col("node").alias("file"))
