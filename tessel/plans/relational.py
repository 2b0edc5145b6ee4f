"""Set operations, grouping sets, approximate aggregates and views over the findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.session import table


def _findings(spark: SparkSession, d: str, name: str = "findings_actual") -> DataFrame:
    return table(spark, d, name).select("finding_id", "run_id", "kind", "severity", "file").distinct()


def cube_report(spark, d):
    """Findings by severity and kind, by either, and in all; ``level`` tells which columns are summed over."""
    rows = _findings(spark, d).cube("severity", "kind").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"), F.grouping_id("severity", "kind").cast("int").alias("level"))
    return rows.select("level", "severity", "kind", "n", "files")


def grouping_sets_report(spark, d):
    """Findings by project, and by kind and severity, in one pass."""
    runs = table(spark, d, "runs").select("run_id", "project").distinct()
    rows = _findings(spark, d).join(runs, "run_id")
    sets = rows.groupingSets([["project"], ["kind", "severity"]], "project", "kind", "severity")
    return sets.agg(F.count("*").alias("n"))


def kept_findings(spark, d):
    """What both copies say alike."""
    columns = ["finding_id", "kind", "severity"]
    return _findings(spark, d, "findings_expected").select(*columns).intersect(_findings(spark, d).select(*columns))


def repeated_findings(spark, d):
    """Kinds and severities that the actual copy has more often than the expected one, as often as it has."""
    columns = ["kind", "severity"]
    return _findings(spark, d).select(*columns).exceptAll(_findings(spark, d, "findings_expected").select(*columns)).groupBy(*columns).agg(F.count("*").alias("more"))


def approximate_counts(spark, d):
    """Exact numbers beside estimates by sketches of bounded size, and whether these are within 10 %."""
    near = lambda a, b: (F.abs(a - b) <= F.lit(0.1) * b).alias("near")
    e = table(spark, d, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.approx_count_distinct("user_id", 0.02).alias("about"), F.percentile("value", 0.5).alias("median"), F.percentile_approx("value", 0.5, 10_000).alias("middle"))
    return e.select("event_type", "users", near(F.col("about"), F.col("users")), (F.abs(F.col("middle") - F.col("median")) <= F.lit(0.1) * F.abs("median") + 0.1).alias("median_near"))


def view_report(spark, d):
    """Kinds with more findings than kinds have on average: a view, a common table expression and a scalar subquery."""
    sql = "WITH c AS (SELECT kind, count(*) AS n FROM {f} GROUP BY kind) SELECT kind, n FROM c WHERE n > (SELECT avg(n) FROM c)"
    return spark.sql(sql, f=_findings(spark, d))


QUERIES = {"cube_report": cube_report, "grouping_sets_report": grouping_sets_report, "kept_findings": kept_findings, "repeated_findings": repeated_findings, "approximate_counts": approximate_counts, "view_report": view_report}

_F = "f AS (SELECT DISTINCT finding_id, run_id, kind, severity, file FROM findings_actual), x AS (SELECT DISTINCT finding_id, run_id, kind, severity, file FROM findings_expected)"
ORACLES = {
    "cube_report": f"WITH {_F} SELECT grouping(severity, kind)::INT AS level, severity, kind, count(*) AS n, count(DISTINCT file) AS files FROM f GROUP BY CUBE (severity, kind)",
    "grouping_sets_report": f"WITH {_F} SELECT project, kind, severity, count(*) AS n FROM f JOIN (SELECT DISTINCT run_id, project FROM runs) USING (run_id) GROUP BY GROUPING SETS ((project), (kind, severity))",
    "kept_findings": f"WITH {_F} SELECT finding_id, kind, severity FROM x INTERSECT SELECT finding_id, kind, severity FROM f",
    "repeated_findings": f"WITH {_F}, r AS (SELECT kind, severity FROM f EXCEPT ALL SELECT kind, severity FROM x) SELECT kind, severity, count(*) AS more FROM r GROUP BY ALL",
    "approximate_counts": "SELECT event_type, count(DISTINCT user_id) AS users, true AS near, true AS median_near FROM events GROUP BY event_type",
    "view_report": f"WITH {_F}, c AS (SELECT kind, count(*) AS n FROM f GROUP BY kind) SELECT kind, n FROM c WHERE n > (SELECT avg(n) FROM c)",
}
