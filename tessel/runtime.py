"""The runtime report: coverage checked, moved to the project, and set against its files and metrics."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.engine import Codebase
from tessel.functions import scores
from tessel.operators import coverage as cov

SCHEMA_VERSION = 1


def validate(text: str) -> dict:
    """A coverage dump, or a ``ValueError`` that names the first entry that is wrong."""
    try:
        data = json.loads(text)
    except ValueError as e:
        raise ValueError(f"coverage is not JSON: {e}") from e
    if not isinstance(data, dict) or not isinstance(data.get("result"), list):
        raise ValueError("coverage needs an array named result")
    for n, script in enumerate(data["result"]):
        if not isinstance(script, dict) or not isinstance(script.get("url"), str) or not isinstance(script.get("functions"), list):
            raise ValueError(f"result[{n}] needs a url and an array of functions")
        for k, fn in enumerate(script["functions"]):
            if not isinstance(fn, dict) or not isinstance(fn.get("functionName"), str) or not isinstance(fn.get("ranges"), list):
                raise ValueError(f"result[{n}].functions[{k}] needs a functionName and an array of ranges")
            for i, r in enumerate(fn["ranges"]):
                if not isinstance(r, dict) or any(not isinstance(r.get(x), int) or isinstance(r.get(x), bool) for x in ("startOffset", "endOffset", "count")):
                    raise ValueError(f"result[{n}].functions[{k}].ranges[{i}] needs whole numbers startOffset, endOffset and count")
    return data


def rows_of(data: dict) -> list[tuple[str, str, int, int, int]]:
    """(file, fn, start, end, hits) of a validated dump."""
    return [(s["url"], f["functionName"] or "<anonymous>", r["startOffset"], r["endOffset"], r["count"]) for s in data["result"] for f in s["functions"] for r in f["ranges"]]


def placed(ranges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ranges(file, fn, start, end, hits) with both ends, and (file, lost) of the files that have others: some writers leave columns null, which must not cost the rest of the dump."""
    whole = F.col("start").isNotNull() & F.col("end").isNotNull()
    return ranges.filter(whole), ranges.filter(~whole).groupBy("file").agg(F.count("*").alias("lost"))


def rebase_to(ranges: DataFrame, files: DataFrame, root: str, old: str | None = None) -> DataFrame:
    """ranges with files below ``root``: from ``old``, or from the common directory of all urls. It is an error if less than half of the scripts then are files of the project."""
    rows = ranges.withColumn("file", cov.plain_url(F.col("file")))
    urls = rows.select("file").distinct()
    if old is None:
        old = cov.common_root(urls.withColumn("k", F.lit(1)), "file", ["k"]).first()
        old = old.root if old else ""
    if not old:
        raise ValueError("coverage urls have no common directory: name the one to move")
    path, _ = cov.rebase(F.col("file"), F.lit(old.rstrip("/")), F.lit(root.rstrip("/")))
    moved = rows.withColumn("file", path)
    n = moved.select("file").distinct().join(files.select("file", F.lit(1).alias("_known")), "file", "left").agg(F.count("*").alias("all"), F.count("_known").alias("known")).first()
    if 2 * n.known < n["all"]:
        raise ValueError(f"only {n.known} of {n['all']} covered scripts are files below {root}")
    return moved


def weighted_targets(base: Codebase, ranges: DataFrame, k: int = 10) -> DataFrame:
    """(file, score) of the k files with the lowest score when complexity counts by how often functions ran."""
    hits = cov.function_hits(ranges).withColumnRenamed("fn", "name")
    f = base.table("functions").join(hits, ["file", "name"], "left")
    weight = F.sum(F.col("cyclomatic") * F.log10(1 + F.coalesce("hits", F.lit(0)).cast("double")))
    per = f.groupBy("file").agg(F.round(weight, 6).alias("w"), F.avg("cognitive").alias("g"), F.avg("mi").alias("m"))
    return per.select("file", scores.health(F.col("w"), F.col("g"), F.col("m")).alias("score")).orderBy("score", "file").limit(k)


def runtime_report(base: Codebase, ranges: DataFrame, percent: int = 10, threshold: int = 0, k: int = 10) -> dict:
    """schemaVersion, hotPaths, coldCode, coverageMissing and weightedRefactorTargets, the last four as DataFrames. ranges(file, fn, start, end, hits)."""
    merged = cov.merge_ranges(ranges)
    hits = cov.function_hits(merged)
    return {
        "schemaVersion": SCHEMA_VERSION, "hotPaths": cov.hot_paths(hits, percent), "coldCode": cov.cold_code(hits, threshold),
        "coverageMissing": cov.coverage_missing(base.files, merged), "weightedRefactorTargets": weighted_targets(base, merged, k),
    }
