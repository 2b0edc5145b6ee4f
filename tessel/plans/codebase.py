"""The whole pipeline over the files table: extraction, graph, rules and scores of real source text."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.engine import Codebase
from tessel.extract import exploded, file_metrics
from tessel.operators import rules
from tessel.session import table


def latest_files(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "files")
    best = F.max(F.struct("ingested_at", "project", "content")).alias("b")
    return rows.groupBy("file").agg(best).select("b.project", F.concat(F.lit("/work/"), F.col("b.project")).alias("root"), "file", "b.content")


def codebase(spark: SparkSession, d: str) -> Codebase:
    return Codebase(latest_files(spark, d))


def inventory_declarations(spark, d):
    return codebase(spark, d).decls.select("file", "kind", "name", "exported", "start_off", "line", F.size("members").alias("members"))


def inventory_imports(spark, d):
    return codebase(spark, d).table("imports").select("file", "kind", "source", "resolvable", "start_off", "line")


def inventory_usages(spark, d):
    return codebase(spark, d).table("usages").groupBy("file", "kind", "name").agg(F.count("*").alias("n"))


def function_complexity(spark, d):
    return codebase(spark, d).table("functions").select("file", "name", "cyclomatic", "cognitive", "mi", "loc", "line")


def file_complexity(spark, d):
    return file_metrics(codebase(spark, d).inventory)


def module_edges(spark, d):
    return codebase(spark, d).edges.select("src", "dst", "kind", "spec", "resolvable")


def entry_points(spark, d):
    return codebase(spark, d).entries.select("project", "file")


def findings_all(spark, d):
    """All findings of a full analysis of every project."""
    return codebase(spark, d).findings("full")


def findings_counts(spark, d):
    base = codebase(spark, d)
    return base.counts(base.findings("dead-code-only"), "dead-code-only")


def clones_merged(spark, d):
    """The families of all clone types, without those that a stronger one covers."""
    return codebase(spark, d).clone_families().select("type", "file", F.col("pos").cast("bigint").alias("pos"), "members", F.col("length").cast("bigint").alias("length"))


def codebase_health(spark, d):
    return codebase(spark, d).health()


def exported_declarations(spark, d):
    """What each file exports."""
    return codebase(spark, d).decls.filter("exported").select("file", "kind", "name", "start_off", "line")


def script_functions(spark, d):
    """Ways through, and lines of, every declared function of the scripts whose brackets match: elsewhere nothing says where a function ends."""
    whole = codebase(spark, d).inventory.filter("whole and lang = 'ts'")
    declared = exploded(whole, "decls").filter("kind = 'function'").select("file", "name", "line")
    return exploded(whole, "functions").join(declared, ["file", "name", "line"], "left_semi").select("file", "name", "line", "cyclomatic", "loc")


def import_resolution(spark, d):
    """Every relative script import with the file it means, or null."""
    edges = codebase(spark, d).edges.filter(F.col("spec").rlike(r"^\.\.?/") & ~F.col("src").rlike(r"\.pyi?$"))
    return edges.select(F.col("src").alias("file"), "spec", "dst").distinct()


def python_import_resolution(spark, d):
    """Every Python import with the module file it means, or null."""
    return codebase(spark, d).edges.filter(F.col("src").rlike(r"\.pyi?$")).select(F.col("src").alias("file"), F.col("spec").alias("module"), "dst").distinct()


def _plain(found: DataFrame) -> DataFrame:
    return found.select("kind", "file", F.coalesce(F.col("off").cast("bigint"), F.lit(-1)).alias("off"), F.coalesce("name", F.lit("")).alias("name"), "message")


def _rule(kind: str):
    def query(spark, d):
        return _plain(codebase(spark, d).rule(kind))

    query.__doc__ = f"The findings of the rule {kind} over the source text."
    return query


def code_counts(spark, d):
    """Findings by rule of the rules that need no manifest, with those of unused files left out."""
    base = codebase(spark, d)
    kinds = ["unused-files", "unused-exports", "unused-types", "circular-dependencies", "unresolved-imports", "unlisted-dependencies", "duplicate-exports"]
    found = None
    for kind in kinds:
        rows = base.rule(kind)
        found = rows if found is None else found.unionByName(rows)
    return rules.counts_by_rule(rules.cross_reference(found), kinds)


QUERIES = {
    "inventory_declarations": inventory_declarations, "inventory_imports": inventory_imports, "inventory_usages": inventory_usages, "function_complexity": function_complexity, "file_complexity": file_complexity,
    "module_edges": module_edges, "entry_points": entry_points, "findings_all": findings_all, "findings_counts": findings_counts, "codebase_health": codebase_health,
    "clones_merged": clones_merged, "exported_declarations": exported_declarations, "code_counts": code_counts, "script_functions": script_functions, "import_resolution": import_resolution, "python_import_resolution": python_import_resolution,
    **{f"code_{k.replace('-', '_')}": _rule(k) for k in ("unused-files", "unused-exports", "unused-types", "unresolved-imports", "unlisted-dependencies")},
}

# The same relations by SQL: the statements of these sources stand on lines of their own, so patterns over lines find them.
_LINES = r"""f AS (SELECT file, b.project AS project, regexp_replace(b.content, '^\x{FEFF}', '') AS content FROM (SELECT file, max({'i': ingested_at, 'project': project, 'content': content}) AS b FROM files GROUP BY file)),
l AS (SELECT file, project, ends_with(file, '.py') AS py, t, n::INT AS line, (coalesce(sum(length(t) + 1) OVER (PARTITION BY file ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(t) - length(ltrim(t, ' ')))::INT AS start_off
  FROM (SELECT file, project, unnest(string_split(content, chr(10))) AS t, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM f)),
i AS (SELECT * FROM (SELECT file, project, py, line, start_off, CASE WHEN NOT py THEN regexp_extract(t, '^import \{ [^}]* \} from ''([^'']+)'';\r?$', 1) WHEN regexp_matches(t, '^\s*import [\w.]+( as \w+)?\r?$') THEN regexp_extract(t, '^\s*import ([\w.]+)', 1)
  ELSE regexp_extract(t, '^\s*from (\.*[\w.]*) import [\w, ]+\r?$', 1) END AS spec, CASE WHEN py AND regexp_matches(t, '^\s*from ') THEN string_split(regexp_extract(rtrim(t, chr(13)), ' import (.+)$', 1), ', ') ELSE []::VARCHAR[] END AS names FROM l) WHERE spec <> ''),
x AS (SELECT * FROM (SELECT file, line, start_off + length(CASE WHEN py THEN '' WHEN regexp_matches(t, '^export (const|let|var) \w') THEN regexp_extract(t, '^export (const|let|var) ') ELSE regexp_extract(t, '^export (default )?') END) AS start_off, CASE
  WHEN py AND regexp_matches(t, '^(async )?def [A-Za-z]\w*\([^:]') THEN 'function' WHEN py AND regexp_matches(t, '^class [A-Za-z]\w*') THEN 'class' WHEN py AND regexp_matches(t, '^[A-Za-z]\w*(: [^=]+)? = ') AND NOT regexp_matches(t, '^\w+ = (''[^'']+|"[^"]+)\r?$') THEN 'variable'
  WHEN NOT py AND regexp_matches(t, '^export (default )?(async )?function\*? \w+') THEN 'function' WHEN NOT py AND regexp_matches(t, '^export (default )?(abstract )?class \w+') THEN 'class' WHEN NOT py AND regexp_matches(t, '^export (interface|type) \w+') THEN 'type'
  WHEN NOT py AND regexp_matches(t, '^export (const )?enum \w+') THEN 'enum' WHEN NOT py AND regexp_matches(t, '^export (const|let|var) \w+') THEN 'variable' END AS kind,
  CASE WHEN py THEN regexp_extract(t, '^(?:(?:async )?def |class )?(\w+)', 1) ELSE regexp_extract(t, '^export (?:default |async |abstract )*(?:function\*?|class|interface|type|const enum|enum|const|let|var) (\w+)', 1) END AS name FROM l) WHERE kind IS NOT NULL)"""
_TS = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts", ".d.ts", ".json"]  # in the order in which they are tried
_INSTEAD = [(".js", ".ts"), (".js", ".tsx"), (".js", ".d.ts"), (".jsx", ".tsx"), (".mjs", ".mts"), (".cjs", ".cts")]
_DIRS = ["/index.ts", "/index.tsx", "/index.d.ts", "/index.js", "/index.jsx"]
_PY = [".py", "/__init__.py", ".pyi"]
_EDGES = _LINES + rf""", p AS (SELECT row_number() OVER () AS id, *, string_split(regexp_replace(file, '/[^/]*$', ''), '/') AS dir FROM i),
tb AS (SELECT id, array_to_string(list_slice(dir, 1, len(dir) - len(regexp_extract_all(spec, '\.\./'))), '/') || '/' || regexp_replace(spec, '^(\.\.?/)+', '') AS base FROM p WHERE NOT py AND regexp_matches(spec, '^\.\.?/')),
tk AS ({" UNION ALL ".join(f"SELECT id, {n} AS rank, base || '{x}' AS path FROM tb" for n, x in enumerate(_TS))}
  {" ".join(f"UNION ALL SELECT id, {len(_TS) + n}, substr(base, 1, length(base) - {len(y)}) || '{x}' FROM tb WHERE ends_with(base, '{y}')" for n, (y, x) in enumerate(_INSTEAD))}
  {" ".join(f"UNION ALL SELECT id, {len(_TS) + len(_INSTEAD) + n}, base || '{x}' FROM tb" for n, x in enumerate(_DIRS))}),
tg AS (SELECT id, arg_min(path, rank) AS dst FROM tk JOIN f ON f.file = path GROUP BY id),
pm AS (SELECT id, project, dir, spec, nm, CASE WHEN nm IS NULL THEN spec WHEN ends_with(spec, '.') THEN spec || nm ELSE spec || '.' || nm END AS module FROM (SELECT *, unnest([NULL]::VARCHAR[] || names) AS nm FROM p WHERE py)),
pb AS (SELECT id, nm, dots, CASE WHEN dots > 0 THEN rtrim(array_to_string(list_slice(dir, 1, len(dir) - dots + 1), '/') || '/' || tail, '/') ELSE '/work/' || project || '/' || tail END AS here, CASE WHEN dots = 0 THEN '/work/' || project || '/src/' || tail END AS other
  FROM (SELECT *, length(regexp_extract(module, '^\.*')) AS dots, replace(regexp_replace(module, '^\.+', ''), '.', '/') AS tail FROM pm)),
pk AS ({" UNION ALL ".join(f"SELECT id, nm, {n} AS rank, here || '{x}' AS path FROM pb UNION ALL SELECT id, nm, {n + 10}, other || '{x}' FROM pb WHERE other IS NOT NULL" for n, x in enumerate(_PY))}),
pg AS (SELECT id, nm, arg_min(path, rank) AS dst FROM pk JOIN f ON f.file = path GROUP BY ALL),
e AS (SELECT p.file AS src, dst, 'static' AS kind, spec, dst IS NOT NULL AS resolvable, NULL::VARCHAR AS package FROM p LEFT JOIN tg USING (id) WHERE NOT py
  UNION ALL SELECT p.file, dst, 'static', p.spec, dst IS NOT NULL OR (NOT starts_with(p.spec, '.') AND string_split(p.spec, '.')[1] IN ({", ".join(f"'{m}'" for m in sorted(sys.stdlib_module_names))})), CASE WHEN NOT starts_with(p.spec, '.') THEN string_split(p.spec, '.')[1] END
    FROM p JOIN pm USING (id) LEFT JOIN pg ON pg.id = pm.id AND pg.nm IS NOT DISTINCT FROM pm.nm WHERE pm.nm IS NULL OR dst IS NOT NULL),
g AS (SELECT DISTINCT src, dst FROM e WHERE resolvable AND dst IS NOT NULL)"""
_ENTRIES = r"""k AS (SELECT project, file FROM (SELECT project, file, substr(file, length('/work/' || project) + 2) AS p FROM f) WHERE regexp_matches(p, '^(src/)?(index|main|cli|server|app)\.(tsx?|jsx?|[mc][jt]s)$') OR regexp_matches(p, '^(src/)?bin/.*\.(tsx?|jsx?|[mc][jt]s)$')
OR regexp_matches(p, '^(scripts|tests?)/.*\.(tsx?|jsx?|[mc][jt]s|py)$') OR regexp_matches(p, '(^|/)(preload)\.(tsx?|jsx?|[mc][jt]s)$') OR regexp_matches(p, '^src/(electron/main|main/index|renderer/index)\.(tsx?|jsx?|[mc][jt]s)$') OR regexp_matches(p, '^[^/]*\.config\.(tsx?|jsx?|[mc][jt]s)$')
OR regexp_matches(p, '^packages/[^/]*/(src/index|index|src/main)\.(tsx?|jsx?|[mc][jt]s)$') OR regexp_matches(p, '\.(test|spec)\.(tsx?|jsx?|[mc][jt]s)$') OR regexp_matches(p, '(^|/)(__tests__|__mocks__)/.*\.(tsx?|jsx?|[mc][jt]s)$') OR regexp_matches(p, '(^|/)(__main__|manage|wsgi|asgi|conftest)\.py$')
OR regexp_matches(p, '^(app|main|run|src/main|setup|noxfile|tasks)\.py$') OR regexp_matches(p, '(^|/)(test_[^/]*|[^/]*_test)\.py$'))"""
_LIVE = _EDGES + ", " + _ENTRIES + ", r(node) AS (SELECT file FROM k UNION SELECT g.dst FROM r JOIN g ON g.src = r.node)"
_CYCLES = _EDGES + """, c(a, b) AS (SELECT src, dst FROM g UNION SELECT c.a, g.dst FROM c JOIN g ON g.src = c.b), s AS (SELECT x.a AS node, min(x.b) AS scc FROM c x JOIN c y ON x.a = y.b AND x.b = y.a GROUP BY x.a),
n AS (SELECT a.scc, g.src, g.dst FROM g JOIN s a ON a.node = g.src JOIN s b ON b.node = g.dst AND b.scc = a.scc),
w(scc, node, path) AS (SELECT DISTINCT scc, scc, [scc] FROM s UNION ALL SELECT w.scc, min(n.dst), list_append(w.path, min(n.dst)) FROM w JOIN n ON n.scc = w.scc AND n.src = w.node WHERE NOT list_contains(w.path, n.dst) GROUP BY w.scc, w.node, w.path)"""
_CLOSED = "file NOT IN (SELECT dst FROM e WHERE dst IS NOT NULL) AND file NOT IN (SELECT file FROM k)"
_FOUND = {
    "unused-files": (_LIVE, "SELECT 'unused-files' AS kind, file, -1 AS off, '' AS name, 'unused-files: ' || file || ' is not reachable from any entry point' AS message FROM f WHERE file NOT IN (SELECT node FROM r) AND (SELECT count(*) FROM k) > 0"),
    "unused-exports": (_LIVE, f"SELECT 'unused-exports' AS kind, file, start_off AS off, name, 'unused-exports: ' || name || ' in ' || file || ' has no consumers' AS message FROM x WHERE kind <> 'type' AND {_CLOSED}"),
    "unused-types": (_LIVE, f"SELECT 'unused-types' AS kind, file, start_off AS off, name, 'unused-types: ' || name || ' in ' || file || ' has no consumers' AS message FROM x WHERE kind = 'type' AND {_CLOSED}"),
    "circular-dependencies": (_CYCLES, "SELECT 'circular-dependencies' AS kind, scc AS file, -1 AS off, '' AS name, 'circular-dependencies: cycle detected: ' || array_to_string(list_append(arg_max(path, len(path)), scc), ' → ') AS message FROM w GROUP BY scc"),
    "unresolved-imports": (_EDGES, "SELECT DISTINCT 'unresolved-imports' AS kind, src AS file, -1 AS off, spec AS name, 'unresolved-imports: cannot resolve ' || spec || ' from ' || src AS message FROM e WHERE NOT resolvable AND dst IS NULL AND package IS NULL"),
    "unlisted-dependencies": (_EDGES, "SELECT DISTINCT 'unlisted-dependencies' AS kind, src AS file, -1 AS off, spec AS name, 'unlisted-dependencies: ' || spec || ' is not declared in a manifest' AS message FROM e WHERE NOT resolvable AND dst IS NULL AND package IS NOT NULL"),
    "duplicate-exports": (_LINES, "SELECT 'duplicate-exports' AS kind, file, min(start_off) AS off, name, 'duplicate-exports: ' || name || ' declared ' || count(*) || ' times in ' || file AS message FROM x GROUP BY file, name HAVING count(*) > 1"),
}
# a declared function ends with the first brace at the start of a line; strings, templates, patterns and comments are single tokens
_SCRIPT = r"""'//[^\n]*|/\*[\s\S]*?\*/|''[^''\\\n]*(?:\\[\s\S][^''\\\n]*)*''|"[^"\\\n]*(?:\\[\s\S][^"\\\n]*)*"|`[^`\\]*(?:\\[\s\S][^`\\]*)*`|[(,=:\[!&|?{;] */[^/*\n][^\n]*/|&&|\|\||\?\?=?|\?\.|\? |[A-Za-z_$][\w$]*|[^\s\w]'"""
_BALANCED = " AND ".join(f"len(list_filter(toks, lambda x: x[1] = '{a}')) = len(list_filter(toks, lambda x: x[1] = '{b}'))" for a, b in ("()", "[]", "{}"))
_FUNCTIONS = _LINES + f""", q AS (SELECT file FROM (SELECT file, regexp_extract_all(content, {_SCRIPT}) AS toks FROM f WHERE NOT ends_with(file, '.py')) WHERE {_BALANCED})""" + r""", h AS (SELECT file, line, regexp_extract(t, '^(?:export )?(?:default )?(?:async )?function\*? (\w+)', 1) AS name FROM l WHERE file IN (SELECT file FROM q) AND regexp_matches(t, '^(export )?(default )?(async )?function\*? \w')),
z AS (SELECT h.file, h.line, h.name, min(x.line) AS stop FROM h LEFT JOIN l x ON x.file = h.file AND x.line > h.line AND starts_with(x.t, '}') GROUP BY ALL),
b AS (SELECT z.file, z.line, z.name, string_agg(x.t, chr(10) ORDER BY x.line) AS body FROM z JOIN l x ON x.file = z.file AND x.line BETWEEN z.line AND coalesce(z.stop, 1000000000) GROUP BY ALL)
SELECT file, name, line, 1 + len(list_filter(regexp_extract_all(body, """ + _SCRIPT + r"""),
  lambda x: x IN ('if', 'for', 'while', 'case', 'catch', '&&', '||', '??', '? '))) AS cyclomatic, len(list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '\S'))) AS loc FROM b"""

ORACLES = {
    "script_functions": "WITH " + _FUNCTIONS,
    "entry_points": f"WITH {_LINES}, {_ENTRIES} SELECT project, file FROM k",
    "inventory_imports": f"WITH {_LINES} SELECT file, 'static' AS kind, spec AS source, true AS resolvable, start_off, line FROM i",
    "exported_declarations": f"WITH {_LINES} SELECT file, kind, name, start_off, line FROM x",
    "import_resolution": rf"WITH {_EDGES} SELECT DISTINCT src AS file, spec, dst FROM e WHERE regexp_matches(spec, '^\.\.?/') AND NOT ends_with(src, '.py')",
    "python_import_resolution": f"WITH {_EDGES} SELECT DISTINCT src AS file, spec AS module, dst FROM e WHERE ends_with(src, '.py')",
    "module_edges": f"WITH {_EDGES} SELECT src, dst, kind, spec, resolvable FROM e",
    "code_counts": f"""WITH RECURSIVE {_CYCLES}, {_ENTRIES}, r(node) AS (SELECT file FROM k UNION SELECT g.dst FROM r JOIN g ON g.src = r.node), a AS ({" UNION ALL ".join(q for _, q in _FOUND.values())}),
b AS (SELECT * FROM a WHERE NOT (kind IN ('unused-exports', 'unused-types') AND file IN (SELECT file FROM a WHERE kind = 'unused-files'))) SELECT rule, count(b.kind) AS n FROM (SELECT unnest([{", ".join(f"'{x}'" for x in _FOUND)}]) AS rule) LEFT JOIN b ON b.kind = rule GROUP BY rule""",
    **{name: f"WITH RECURSIVE {_FOUND[k][0]} {_FOUND[k][1]}" for k in _FOUND if (name := f"code_{k.replace('-', '_')}") in QUERIES},
}
