"""Queries p2, p3 and p6 over the project's own tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.operators.intervals import interval_gaps, interval_periods, interval_states
from tessel.operators.nested import leaf_paths, node_table, with_parents
from tessel.operators.reconcile import differences, latest, strip_root
from tessel.session import table

COVERAGE_LEVELS = ["result", "functions", "ranges"]
COVERAGE_FIELDS = {"scriptId": "string", "url": "string", "functionName": "string", "isBlockCoverage": "boolean", "startOffset": "bigint", "endOffset": "bigint", "count": "bigint"}


def coverage_nodes(spark: SparkSession, d: str) -> DataFrame:
    return node_table(table(spark, d, "coverage_raw"), F.col("dump_id"), F.col("payload"), COVERAGE_LEVELS, COVERAGE_FIELDS)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per range object of a dump, with the positions of its script and function; -1 where a level has no object."""
    nodes = node_table(table(spark, d, "coverage_raw"), F.col("dump_id"), F.col("payload"), COVERAGE_LEVELS, {})
    return leaf_paths(nodes, 3, ["key", "record"]).select(F.col("key").alias("dump_id"), F.col("ix1").alias("script_ix"), F.col("ix2").alias("fn_ix"), F.col("ix3").alias("range_ix")).distinct()


def _coverage_level(level: int):
    columns = [["scriptId", "url"], ["functionName", "isBlockCoverage"], ["startOffset", "endOffset", "count"]][level - 1]
    names = ["script_ix", "fn_ix", "range_ix"][:level]

    def query(spark: SparkSession, d: str) -> DataFrame:
        nodes = with_parents(coverage_nodes(spark, d), level, ["key", "record"]).filter(F.col("level") == level)
        return nodes.select(F.col("key").alias("dump_id"), *(F.col(f"ix{i + 1}").alias(n) for i, n in enumerate(names)), *(F.col(c).alias("hits" if c == "count" else c) for c in columns), "pre", "post").distinct()

    query.__doc__ = f"Table of level {level}: {', '.join(columns)} with the keys of the parents."
    return query


p2_scripts, p2_functions, p2_ranges = (_coverage_level(n) for n in (1, 2, 3))


def p2_dumps(spark: SparkSession, d: str) -> DataFrame:
    """Table of the dumps themselves: their label interval, and how many objects lie below."""
    nodes = node_table(table(spark, d, "coverage_raw"), F.col("dump_id"), F.col("payload"), COVERAGE_LEVELS, {}).filter("level = 0")
    return nodes.select(F.col("key").alias("dump_id"), "pre", "post", F.expr("(post - pre - 1) div 2").alias("objects")).distinct()


def executed_states(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "coverage").filter("hit_count > 0 and start_off < end_off and path is not null")
    path = F.regexp_replace("path", "^file://", "")
    return interval_states(rows, path, F.col("start_off"), F.col("end_off"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The gaps between the executed periods of each script."""
    return interval_gaps(executed_states(spark, d)).select(F.col("key").alias("path"), "gap_start", "gap_end")


def p3_periods(spark: SparkSession, d: str) -> DataFrame:
    """The continuous executed periods of each script."""
    return interval_periods(executed_states(spark, d)).select(F.col("key").alias("path"), "period_start", "period_end")


def finding_copies(spark: SparkSession, d: str) -> list[DataFrame]:
    """The expected and the actual copy: the latest row of each finding, paths relative, the project root written as ``<root>``."""
    roots = table(spark, d, "runs").filter("run_id is not null and project_root is not null").groupBy("run_id").agg(F.max(F.struct("ingested_at", F.regexp_replace("project_root", "/+$", "").alias("root")))["root"].alias("root"))
    out = []
    for name in ("findings_expected", "findings_actual"):
        rows = table(spark, d, name).select("finding_id", "run_id", "kind", "file", "message", F.col("loc.start_pos.line").alias("start_line"), "recorded_at", "ingested_at")
        rows = latest(rows, "finding_id", ["recorded_at", "ingested_at"], ["run_id", "kind", "file", "message", "start_line"]).join(roots, "run_id", "left")
        has = F.length("root") > 0
        out.append(rows.select("finding_id", "kind", F.when(has, strip_root(F.col("file"), F.col("root"))).otherwise(F.col("file")).alias("file"), F.when(has, F.replace("message", "root", F.lit("<root>"))).otherwise(F.col("message")).alias("message"), "start_line"))
    return out


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Findings missing in either copy, and each field that differs."""
    expected, actual = finding_copies(spark, d)
    return differences(expected, actual, "finding_id", ["kind", "file", "message", "start_line"], ("missing_in_actual", "missing_in_expected"))


QUERIES = {"p2_found": p2_found, "p2_scripts": p2_scripts, "p2_functions": p2_functions, "p2_ranges": p2_ranges, "p2_dumps": p2_dumps, "p3_found": p3_found, "p3_periods": p3_periods, "p6_found": p6_found}

_ISLANDS = r"""
WITH x AS (SELECT regexp_replace(path, '^file://', '') AS path, start_off::BIGINT AS s, end_off::BIGINT AS e FROM coverage WHERE hit_count > 0 AND start_off < end_off AND path IS NOT NULL),
m AS (SELECT path, s, e, max(e) OVER (PARTITION BY path ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x),
"""

# every object with its place; the labels follow from the order of the places: a node is entered after twice the nodes before it, less those around it
_NODES = r"""
WITH d AS (SELECT DISTINCT dump_id, payload, payload::JSON AS j FROM coverage_raw WHERE payload IS NOT NULL AND json_valid(payload)), d0 AS (SELECT * FROM d WHERE json_type(j) = 'OBJECT'),
s AS (SELECT dump_id, payload, unnest(range(json_array_length(j, '$.result')::BIGINT)) AS a, j->'result' AS x FROM d0 WHERE json_type(j, '$.result') = 'ARRAY'),
s3 AS (SELECT * FROM (SELECT dump_id, payload, a, json_extract(x, '$[' || a || ']') AS o FROM s) WHERE json_type(o) = 'OBJECT'),
f AS (SELECT dump_id, payload, a, unnest(range(json_array_length(o, '$.functions')::BIGINT)) AS b, o->'functions' AS x FROM s3 WHERE json_type(o, '$.functions') = 'ARRAY'),
f3 AS (SELECT * FROM (SELECT dump_id, payload, a, b, json_extract(x, '$[' || b || ']') AS o FROM f) WHERE json_type(o) = 'OBJECT'),
r AS (SELECT dump_id, payload, a, b, unnest(range(json_array_length(o, '$.ranges')::BIGINT)) AS c, o->'ranges' AS x FROM f3 WHERE json_type(o, '$.ranges') = 'ARRAY'),
r3 AS (SELECT * FROM (SELECT dump_id, payload, a, b, c, json_extract(x, '$[' || c || ']') AS o FROM r) WHERE json_type(o) = 'OBJECT'),
n AS (SELECT dump_id, payload, 0 AS level, -1 AS a, -1 AS b, -1 AS c, j AS o FROM d0 UNION ALL SELECT dump_id, payload, 1, a, -1, -1, o FROM s3 UNION ALL SELECT dump_id, payload, 2, a, b, -1, o FROM f3 UNION ALL SELECT dump_id, payload, 3, a, b, c, o FROM r3),
m AS (SELECT *, 2 * (row_number() OVER (PARTITION BY dump_id, payload ORDER BY a, b, c) - 1) - level + 1 AS pre, CASE level WHEN 0 THEN count(*) OVER (PARTITION BY dump_id, payload) WHEN 1 THEN count(*) OVER (PARTITION BY dump_id, payload, a)
  WHEN 2 THEN count(*) OVER (PARTITION BY dump_id, payload, a, b) ELSE 1 END - 1 AS below FROM n),
l AS (SELECT *, (pre + 2 * below + 1)::BIGINT AS post FROM m)
"""
_TEXT = lambda k: f"CASE WHEN json_type(o, '$.{k}') = 'VARCHAR' THEN o->>'{k}' END AS \"{k}\""
_WHOLE = lambda k, name: f"CASE WHEN json_type(o, '$.{k}') IN ('BIGINT', 'UBIGINT', 'HUGEINT', 'DOUBLE') AND (o->>'{k}')::DOUBLE = floor((o->>'{k}')::DOUBLE) AND abs((o->>'{k}')::DOUBLE) < 9223372036854775808 THEN (o->>'{k}')::DOUBLE::BIGINT END AS \"{name}\""

ORACLES = {
    "p2_dumps": _NODES + "SELECT DISTINCT dump_id, pre, post, below AS objects FROM l WHERE level = 0",
    "p2_scripts": _NODES + f"SELECT DISTINCT dump_id, a AS script_ix, {_TEXT('scriptId')}, {_TEXT('url')}, pre, post FROM l WHERE level = 1",
    "p2_functions": _NODES + f"SELECT DISTINCT dump_id, a AS script_ix, b AS fn_ix, {_TEXT('functionName')}, CASE WHEN json_type(o, '$.isBlockCoverage') = 'BOOLEAN' THEN (o->>'isBlockCoverage')::BOOLEAN END AS \"isBlockCoverage\", pre, post FROM l WHERE level = 2",
    "p2_ranges": _NODES + f"SELECT DISTINCT dump_id, a AS script_ix, b AS fn_ix, c AS range_ix, {_WHOLE('startOffset', 'startOffset')}, {_WHOLE('endOffset', 'endOffset')}, {_WHOLE('count', 'hits')}, pre, post FROM l WHERE level = 3",
    "p3_found": _ISLANDS + "g AS (SELECT path, reach AS gap_start, s AS gap_end FROM m WHERE reach < s) SELECT * FROM g",
    "p3_periods": _ISLANDS + "n AS (SELECT *, sum(CASE WHEN reach IS NULL OR reach < s THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT path, min(s) AS period_start, max(e) AS period_end FROM n GROUP BY path, k",
    "p2_found": r"""
WITH d AS (SELECT DISTINCT dump_id, payload::JSON AS j FROM coverage_raw WHERE payload IS NOT NULL AND json_valid(payload)),
s AS (SELECT dump_id, unnest(range(json_array_length(j, '$.result')::BIGINT)) AS script_ix, j->'result' AS a FROM d WHERE json_type(j, '$.result') = 'ARRAY'),
s2 AS (SELECT dump_id, script_ix, json_extract(a, '$[' || script_ix || ']') AS o FROM s),
s3 AS (SELECT * FROM s2 WHERE json_type(o) = 'OBJECT'),
f AS (SELECT dump_id, script_ix, unnest(range(json_array_length(o, '$.functions')::BIGINT)) AS fn_ix, o->'functions' AS a FROM s3 WHERE json_type(o, '$.functions') = 'ARRAY'),
f2 AS (SELECT dump_id, script_ix, fn_ix, json_extract(a, '$[' || fn_ix || ']') AS o FROM f),
f3 AS (SELECT * FROM f2 WHERE json_type(o) = 'OBJECT'),
r AS (SELECT dump_id, script_ix, fn_ix, unnest(range(json_array_length(o, '$.ranges')::BIGINT)) AS range_ix, o->'ranges' AS a FROM f3 WHERE json_type(o, '$.ranges') = 'ARRAY'),
r3 AS (SELECT dump_id, script_ix, fn_ix, range_ix FROM r WHERE json_type(json_extract(a, '$[' || range_ix || ']')) = 'OBJECT')
SELECT DISTINCT * FROM (
SELECT dump_id, script_ix, fn_ix, range_ix FROM r3
UNION ALL SELECT dump_id, script_ix, fn_ix, -1 FROM f3 WHERE NOT EXISTS (SELECT 1 FROM r3 WHERE r3.dump_id = f3.dump_id AND r3.script_ix = f3.script_ix AND r3.fn_ix = f3.fn_ix)
UNION ALL SELECT dump_id, script_ix, -1, -1 FROM s3 WHERE NOT EXISTS (SELECT 1 FROM f3 WHERE f3.dump_id = s3.dump_id AND f3.script_ix = s3.script_ix))
""",
    "p6_found": r"""
WITH roots AS (SELECT run_id, arg_max(rtrim(project_root, '/'), ingested_at) AS root FROM runs WHERE project_root IS NOT NULL GROUP BY run_id),
raw AS (SELECT 'e' AS side, * FROM findings_expected UNION ALL SELECT 'a', * FROM findings_actual),
top AS (SELECT * FROM raw WHERE finding_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY side, finding_id ORDER BY recorded_at DESC NULLS LAST, ingested_at DESC NULLS LAST) = 1),
n AS (SELECT side, finding_id, kind, CASE WHEN root <> '' AND starts_with(file, root || '/') THEN substr(file, length(root) + 2) ELSE file END AS file,
  CASE WHEN root <> '' THEN replace(message, root, '<root>') ELSE message END AS message, loc.start_pos.line AS start_line FROM top LEFT JOIN roots USING (run_id)),
j AS (SELECT coalesce(e.finding_id, a.finding_id) AS finding_id, e.finding_id AS ei, a.finding_id AS ai, e.kind AS ek, a.kind AS ak, e.file AS ef, a.file AS af, e.message AS em, a.message AS am, e.start_line AS el, a.start_line AS al
  FROM (SELECT * FROM n WHERE side = 'e') e FULL JOIN (SELECT * FROM n WHERE side = 'a') a ON e.finding_id = a.finding_id)
SELECT finding_id, 'missing_in_actual' AS field FROM j WHERE ai IS NULL
UNION ALL SELECT finding_id, 'missing_in_expected' FROM j WHERE ei IS NULL
UNION ALL SELECT finding_id, 'kind' FROM j WHERE ei IS NOT NULL AND ai IS NOT NULL AND ek IS DISTINCT FROM ak
UNION ALL SELECT finding_id, 'file' FROM j WHERE ei IS NOT NULL AND ai IS NOT NULL AND ef IS DISTINCT FROM af
UNION ALL SELECT finding_id, 'message' FROM j WHERE ei IS NOT NULL AND ai IS NOT NULL AND em IS DISTINCT FROM am
UNION ALL SELECT finding_id, 'start_line' FROM j WHERE ei IS NOT NULL AND ai IS NOT NULL AND el IS DISTINCT FROM al
""",
}
