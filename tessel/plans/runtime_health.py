"""Coverage analytics, complexity and health over the project's coverage, files and findings tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.functions import scores
from tessel.functions.globs import path_glob
from tessel.operators import coverage as cov
from tessel.plans.codebase import codebase
from tessel.session import table


def ranges(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "coverage").filter("path is not null and start_off is not null and end_off is not null and hit_count >= 0").drop("ingested_at").distinct()
    fn = F.coalesce("function_name", F.lit("<anonymous>"))
    return raw.select(cov.plain_url(F.col("path")).alias("file"), fn.alias("fn"), F.col("start_off").alias("start"), F.col("end_off").alias("end"), F.col("hit_count").alias("hits"))


def coverage_merge(spark, d):
    return cov.merge_ranges(ranges(spark, d))


def coverage_rebase(spark, d):
    """Script urls per project, moved from their common directory to ``/repo``."""
    urls = table(spark, d, "coverage").filter("path is not null").select("project", cov.plain_url(F.col("path")).alias("url")).distinct()
    moved = urls.join(cov.common_root(urls, "url", ["project"]), "project")
    path, mapped = cov.rebase(F.col("url"), F.col("root"), F.lit("/repo"))
    return moved.select("project", "root", path.alias("path"), mapped.alias("mapped"))


def hits(spark, d):
    return cov.function_hits(ranges(spark, d))


def hot_paths(spark, d):
    return cov.hot_paths(hits(spark, d)).withColumn("percentile", F.round(F.col("rank") * 100.0 / F.col("n"), 4))


def cold_code(spark, d):
    return cov.cold_code(hits(spark, d))


def coverage_missing(spark, d):
    return cov.coverage_missing(table(spark, d, "files"), ranges(spark, d))


def function_keys(spark, d):
    """The index key of each function: ``path::name``, with a number from the second one of a name on."""
    fns = table(spark, d, "coverage").filter("path is not null").select(cov.plain_url(F.col("path")).alias("file"), F.coalesce("function_name", F.lit("")).alias("fn"), "fn_ix").distinct()
    n = F.row_number().over(Window.partitionBy("file", "fn").orderBy("fn_ix")) - 1
    keyed = fns.withColumn("n", n)
    return keyed.select("file", "fn_ix", F.concat(F.col("file"), F.lit("::"), F.col("fn"), F.when(F.col("n") > 0, F.concat(F.lit("::"), F.col("n"))).otherwise("")).alias("key"))


def sources(spark, d):
    """One row per file: its latest arrived content."""
    rows = table(spark, d, "files").filter("content is not null")
    return rows.groupBy("file").agg(F.max(F.struct("ingested_at", "project", "content")).alias("b")).select("file", "b.project", "b.content")


def _functions(spark, d):
    return codebase(spark, d).table("functions")


def complexity_hotspot(spark, d):
    """Functions with more than ten ways through them."""
    return _functions(spark, d).filter("cyclomatic > 10").select("file", "name", "line", "cyclomatic")


def cognitive_complexity(spark, d):
    """Functions that are hard to follow."""
    return _functions(spark, d).filter("cognitive > 15").select("file", "name", "line", "cognitive")


def maintainability_index(spark, d):
    return _functions(spark, d).select("file", "name", "line", "loc", "mi")


def file_health(spark, d):
    return codebase(spark, d).health().select("file", "score")


def project_score(spark, d):
    scored = codebase(spark, d).health()
    return scored.groupBy("project").agg(F.coalesce(F.round(F.avg("score")), F.lit(100)).cast("int").alias("score"), F.count("*").alias("files"))


def refactor_targets(spark, d):
    """The ten files with the lowest score."""
    return codebase(spark, d).refactor_targets(10).select("file", "score")


def weighted_health(spark, d):
    """Scores in which the complexity of a file counts by how often it ran."""
    per_file = ranges(spark, d).groupBy("file").agg(F.sum("hits").cast("double").alias("hits"))
    rows = codebase(spark, d).health().join(per_file, "file", "left")
    weight = F.col("cyclomatic") * F.log10(1 + F.coalesce("hits", F.lit(0.0)))
    return rows.select("file", scores.health(F.round(weight, 6), F.col("cognitive"), F.col("mi")).alias("score"))


def rule_priority(spark, d):
    """Findings per project with its score, most findings first."""
    found = table(spark, d, "findings_actual").select("finding_id", "run_id").distinct().join(table(spark, d, "runs").select("run_id", "project").distinct(), "run_id")
    return found.groupBy("project").agg(F.countDistinct("finding_id").alias("findings")).join(project_score(spark, d), "project").select("project", "findings", "score")


PLUGINS = [("pages", "src/{views,api}/**/*.{tsx,jsx}"), ("tests", "tests/**"), ("tests", "**/*.spec.*"), ("workspace", "packages/*/src/**/*.ts"), ("scripts", "src/jobs/*.py")]


def plugin_glob_match(spark, d):
    """Which plugin's patterns each file matches. Patterns are few and driver-side: one expression per plugin, no join."""
    names = sorted({n for n, _ in PLUGINS})
    hit = lambda n: F.when(F.col("rel_path").rlike("|".join(path_glob(g) for m, g in PLUGINS if m == n)), F.lit(n))
    found = F.explode(F.array_compact(F.array(*(hit(n) for n in names)))).alias("plugin")
    return table(spark, d, "files").select("file", found).distinct()


QUERIES = {
    "coverage_merge": coverage_merge, "coverage_rebase": coverage_rebase, "hot_paths": hot_paths, "cold_code": cold_code, "coverage_missing": coverage_missing, "function_keys": function_keys,
    "complexity_hotspot": complexity_hotspot, "cognitive_complexity": cognitive_complexity, "maintainability_index": maintainability_index, "file_health": file_health, "project_score": project_score,
    "refactor_targets": refactor_targets, "weighted_health": weighted_health, "rule_priority": rule_priority, "plugin_glob_match": plugin_glob_match,
}

_RANGES = r"""c AS (SELECT DISTINCT project, regexp_replace(regexp_replace(path, '^file://(localhost)?', ''), '\?.*$', '') AS file, coalesce(function_name, '<anonymous>') AS fn, fn_ix, range_ix, start_off AS s, end_off AS e, hit_count AS hits, taken_at, path
  FROM coverage WHERE path IS NOT NULL AND start_off IS NOT NULL AND end_off IS NOT NULL AND hit_count >= 0), h AS (SELECT file, fn, sum(hits)::BIGINT AS hits FROM c GROUP BY ALL)"""
_PLUG = " UNION ".join(f"SELECT DISTINCT file, '{n}' AS plugin FROM files WHERE regexp_matches(rel_path, '{path_glob(g)}')" for n, g in PLUGINS)

ORACLES = {
    "coverage_merge": f'WITH {_RANGES} SELECT file, fn, s AS start, e AS "end", sum(hits)::BIGINT AS hits FROM c GROUP BY ALL',
    "coverage_rebase": r"""WITH u AS (SELECT DISTINCT project, regexp_replace(regexp_replace(path, '^file://(localhost)?', ''), '\?.*$', '') AS url FROM coverage WHERE path IS NOT NULL),
p AS (SELECT project, min(url) AS a, max(url) AS b FROM u GROUP BY project),
r AS (SELECT project, regexp_extract(substr(a, 1, (SELECT coalesce(max(n), 0) FROM unnest(range(1, least(length(a), length(b)) + 1)) t(n) WHERE substr(a, 1, n) = substr(b, 1, n))::BIGINT), '^(.*)/', 1) AS root FROM p)
SELECT project, root, CASE WHEN starts_with(url, root || '/') THEN '/repo' || substr(url, length(root) + 1) ELSE url END AS path, starts_with(url, root || '/') AS mapped FROM u JOIN r USING (project)""",
    "hot_paths": f"WITH {_RANGES}, l AS (SELECT * FROM h WHERE hits > 0), k AS (SELECT *, row_number() OVER (ORDER BY hits DESC, file, fn) - 1 AS rank, count(*) OVER () AS n, min(hits) OVER () AS lo, max(hits) OVER () AS hi FROM l) SELECT file, fn, hits, rank, n, round(rank * 100.0::DOUBLE / n, 4) AS percentile FROM k WHERE lo <> hi AND rank < (n * 10 + 99) // 100",
    "cold_code": f"WITH {_RANGES} SELECT * FROM h WHERE hits <= 0",
    "coverage_missing": f"WITH {_RANGES} SELECT DISTINCT file FROM files WHERE file NOT IN (SELECT file FROM c)",
    "function_keys": r"""WITH f AS (SELECT DISTINCT regexp_replace(regexp_replace(path, '^file://(localhost)?', ''), '\?.*$', '') AS file, coalesce(function_name, '') AS fn, fn_ix FROM coverage WHERE path IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY file, fn ORDER BY fn_ix) - 1 AS n FROM f) SELECT file, fn_ix, file || '::' || fn || CASE WHEN n > 0 THEN '::' || n ELSE '' END AS key FROM n""",
    "plugin_glob_match": _PLUG,
}
