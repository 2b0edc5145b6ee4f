"""Clones, text scans, source bookkeeping, reports and event windows with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.operators import clones
from tessel.operators.resolve import normal_name, package_of
from tessel.plans.runtime_health import sources
from tessel.session import table
from tessel.sources import sinks

M = 40
# fixed values: words that normalising keeps
KEYWORDS = ["import", "from", "export", "const", "let", "function", "async", "await", "class", "return", "if", "else", "for", "of", "in", "try", "catch", "except", "throw", "raise", "new", "def", "with", "as", "not", "is", "or", "and", "None", "null", "type", "interface"]


def _token_files(spark, d, renamed=False):
    toks = clones.tokens(F.col("content"), F.col("file").rlike(r"\.pyi?$"))
    return sources(spark, d).select("file", (clones.normalised(toks, KEYWORDS) if renamed else toks).alias("toks"))


def _families(renamed: bool, m: int):
    def query(spark: SparkSession, d: str) -> DataFrame:
        found = clones.families(clones.grams(_token_files(spark, d, renamed), m), m)
        return found.select("file", F.col("pos").cast("bigint").alias("pos"), "members", F.col("length").cast("bigint").alias("length"))

    return query


def clone_occurrences(spark, d):
    """Where the families of type-1 clones occur, overlaps within a file removed."""
    positions = clones.grams(_token_files(spark, d), M)
    return clones.occurrences(positions, clones.families(positions, M), M).select("family_file", F.col("family_pos").cast("bigint").alias("family_pos"), "file", F.col("pos").cast("bigint").alias("pos"), F.col("length").cast("bigint").alias("length"))


def clone_subsumption(spark, d):
    """Covered stretches of events of a user that lie inside longer ones: spans are hours with events, families their event types."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    spans = table(spark, d, "events").groupBy(F.col("event_type"), F.col("user_id").alias("file"), F.floor(at / 86_400_000_000).alias("day")).agg(F.min(at).alias("lo"), F.max(at).alias("hi"), F.count("*").alias("length"))
    spans = spans.select(F.concat_ws("/", "event_type", "file", "day").alias("id"), "length", F.concat_ws("/", "file", "day").alias("file"), "lo", "hi")
    return clones.subsumed(spans, 3_600_000_000)


def suppression_parse(spark, d):
    """Directive comments with the nearest known directive for unknown ones."""
    known = F.array(*map(F.lit, ["file", "module", "unit"]))
    line = F.posexplode(F.split("content", "\n")).alias("ix", "text")
    rows = sources(spark, d).select("file", line).withColumn("word", F.regexp_extract("text", r"^\s*(?://|#)\s*@(\w+)", 1)).filter("word <> ''")
    near = F.element_at(F.array_sort(F.transform(known, lambda k: F.struct(F.levenshtein(F.col("word"), k).alias("n"), k.alias("k")))), 1)
    return rows.select("file", (F.col("ix") + 1).cast("bigint").alias("line"), "word", F.when(~F.array_contains(known, F.col("word")) & (near["n"] <= 2), near["k"]).alias("hint"))


SKIPPED = ["node_modules", "dist", "build", "coverage", "vendor"]


def discover_files(spark, d):
    """Paths with a source extension outside skipped and dot directories, numbered per project in path order."""
    f = table(spark, d, "files").select("project", "rel_path").distinct()
    keep = F.col("rel_path").rlike(r"\.(tsx?|jsx?|mts|cts|mjs|cjs|pyi?)$") & ~F.col("rel_path").rlike(r"(^|/)(\.[^/]*|" + "|".join(SKIPPED) + ")/")
    number = F.row_number().over(Window.partitionBy("project").orderBy("rel_path"))
    return f.filter(keep).select("project", "rel_path", number.cast("bigint").alias("id"))


def lang_dispatch(spark, d):
    """Files per project and language by extension, beside what the latest run reported."""
    lang = F.when(F.col("file").rlike(r"\.pyi?$"), "py").otherwise("ts")
    counts = table(spark, d, "files").select("run_id", "file", lang.alias("l")).distinct().groupBy("run_id").agg(F.count_if(F.col("l") == "ts").alias("ts"), F.count_if(F.col("l") == "py").alias("py"))
    runs = table(spark, d, "runs").groupBy("run_id").agg(F.max(F.struct("ingested_at", F.col("files_by_lang.ts").alias("ts"), F.col("files_by_lang.py").alias("py"))).alias("r"))
    return runs.join(counts, "run_id").select("run_id", F.col("ts").alias("found_ts"), F.col("py").alias("found_py"), F.col("r.ts").cast("bigint").alias("said_ts"), F.col("r.py").cast("bigint").alias("said_py"))


def stale_cache(spark, d):
    """Files whose content is not that of the cached extraction, which holds the first arrival of each file of known language."""
    f = table(spark, d, "files").filter("content is not null").select("file", "ingested_at", F.sha2("content", 256).alias("digest"))
    cached = f.groupBy("file").agg(F.min(F.struct("ingested_at", "digest"))["digest"].alias("digest"))
    other = table(spark, d, "files").filter("content is not null and lang is not null").select("file").distinct()
    return f.select("file", "digest").distinct().join(cached.join(other, "file", "left_semi"), ["file", "digest"], "left_anti")


def changed_since(spark, d):
    """Files whose findings were recorded in the last week of the table."""
    f = table(spark, d, "findings_actual").filter("file is not null")
    last = f.agg(F.max("recorded_at").alias("last"))
    return f.join(F.broadcast(last), F.col("recorded_at") >= F.col("last") - F.expr("INTERVAL 7 DAYS")).select("file").distinct()  # one row


def package_names(spark, d):
    """The package of every specifier of a finding, as an npm and as a Python name."""
    spec = F.col("detail.specifier")
    return table(spark, d, "findings_actual").filter(spec.isNotNull()).select(spec.alias("spec"), package_of(spec).alias("npm"), normal_name(spec).alias("python")).distinct()


def _report(spark, d):
    f = table(spark, d, "findings_actual").select("finding_id", "kind", "severity", "file", "message", F.col("loc.start_pos.line").alias("line"), F.col("loc.start_pos.col").alias("col")).distinct()
    return f


def report_compact(spark, d):
    return _report(spark, d).select("finding_id", sinks.compact().alias("line"))


def codeclimate_fingerprint(spark, d):
    return _report(spark, d).select("finding_id", sinks.fingerprint().alias("fingerprint"))


def report_json(spark, d):
    return _report(spark, d).select("finding_id", sinks.json_row().alias("row"))


def report_sarif(spark, d):
    return _report(spark, d).select("finding_id", sinks.sarif_result().alias("row"))


def report_markdown(spark, d):
    return sinks.markdown_table(_report(spark, d))


def determinism_hash(spark, d):
    """One digest per project over its findings, whatever their order: a sum, modulo 2^64 where it leaves the signed 64 bits, so any number of findings has one."""
    rows = _report(spark, d).join(table(spark, d, "findings_actual").select("finding_id", "run_id").distinct(), "finding_id").join(table(spark, d, "runs").select("run_id", "project").distinct(), "run_id")
    each = rows.select("project", F.md5(F.concat_ws("|", "finding_id", "kind", "file", "line")).alias("h")).distinct()
    part = F.conv(F.substring("h", 1, 12), 16, 10).cast("decimal(15,0)")
    sums = each.groupBy("project").agg(F.sum(part).alias("s"), F.count("*").alias("n"))
    return sums.withColumn("s", F.expr(f"s % {2**64}")).select("project", F.expr(f"if(s >= {2**63}, s - {2**64}, s)").cast("bigint").alias("digest"), "n")


GAP = "6 hours"


def debounce_sessions(spark, d):
    """Bursts of events of a user: a burst ends when nothing comes for six hours."""
    e = table(spark, d, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    s = e.groupBy("user_id", F.session_window("ts", GAP).alias("w")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("types"))
    return s.select("user_id", F.unix_micros("w.start").alias("start_us"), "n", "types")


def tumbling_counts(spark, d):
    e = table(spark, d, "events").select("event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    return e.groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select("event_type", F.unix_micros("w.start").alias("start_us"), "n", "total")


QUERIES = {
    "clone_type1": _families(False, M), "clone_type2": _families(True, M), "clone_occurrences": clone_occurrences, "clone_subsumption": clone_subsumption, "suppression_parse": suppression_parse,
    "discover_files": discover_files, "lang_dispatch": lang_dispatch, "stale_cache": stale_cache, "changed_since": changed_since, "package_names": package_names, "report_compact": report_compact,
    "codeclimate_fingerprint": codeclimate_fingerprint, "report_json": report_json, "report_sarif": report_sarif, "report_markdown": report_markdown, "determinism_hash": determinism_hash,
    "debounce_sessions": debounce_sessions, "tumbling_counts": tumbling_counts,
}

_SRC = "s AS (SELECT file, b.content AS content FROM (SELECT file, max({'i': ingested_at, 'project': project, 'content': content}) AS b FROM files WHERE content IS NOT NULL GROUP BY file))"


def _clone_sql(toks: str) -> str:
    return f"""WITH {_SRC}, t AS (SELECT file, {toks} AS toks FROM s),
g0 AS (SELECT file, unnest(range(0, greatest(len(toks) - {M} + 1, 0))) AS pos, toks FROM t), g AS (SELECT file, pos, md5(array_to_string(list_slice(toks, pos + 1, pos + {M}), chr(1))) AS key FROM g0),
c AS (SELECT *, count(*) OVER (PARTITION BY key) AS members FROM g), sh AS (SELECT * FROM c WHERE members > 1),
mv AS (SELECT a.*, b.key AS after, b.members AS am FROM sh a LEFT JOIN sh b ON a.file = b.file AND b.pos = a.pos + 1),
k AS (SELECT key, max(members) AS members, min({{'file': file, 'pos': pos}}) AS fst, count(after) = count(*) AND count(DISTINCT after) = 1 AND max(am) = max(members) AS goes_on FROM mv GROUP BY key),
r AS (SELECT fst.file AS file, fst.pos AS pos, members, goes_on FROM k),
w AS (SELECT *, coalesce(lag(pos) OVER o = pos - 1 AND lag(goes_on) OVER o AND lag(members) OVER o = members, false) AS came FROM r WINDOW o AS (PARTITION BY file ORDER BY pos)),
n AS (SELECT *, sum(CASE WHEN came THEN 0 ELSE 1 END) OVER (PARTITION BY file ORDER BY pos) AS run FROM w)
SELECT file, min(pos) AS pos, min(members) AS members, count(*) + {M - 1} AS length FROM n GROUP BY file, run"""


# strings, templates and comments are one token each, and comments are left out
_STRINGS = r"""''[^''\\\n]*(?:\\[\s\S][^''\\\n]*)*''|"[^"\\\n]*(?:\\[\s\S][^"\\\n]*)*\""""
_NAMES = r"[A-Za-z_$][\w$]*|\d[\w.]*|[^\s\w]"
_TOKS = rf"""CASE WHEN regexp_matches(file, '\.pyi?$') THEN list_filter(regexp_extract_all(content, '#[^\n]*|(?:''){{3}}[\s\S]*?(?:''){{3}}|\"\"\"[\s\S]*?\"\"\"|{_STRINGS}|->|:=|[=!<>]=|\*\*|//|{_NAMES}'), lambda x: x[1] <> '#')
  ELSE list_filter(regexp_extract_all(content, '//[^\n]*|/\*[\s\S]*?\*/|{_STRINGS}|`[^`\\]*(?:\\[\s\S][^`\\]*)*`|=>|[=!]==?|&&|\|\||\?\?|\?\.|{_NAMES}'), lambda x: NOT regexp_matches(x, '^(//|/\*)')) END"""
_KEEP = ", ".join(f"'{k}'" for k in KEYWORDS)
_REPORT = "r AS (SELECT DISTINCT finding_id, kind, severity, file, message, loc.start_pos.line AS line, loc.start_pos.col AS col FROM findings_actual)"
ORACLES = {
    "clone_type1": _clone_sql(_TOKS),
    "clone_type2": _clone_sql(rf"list_transform({_TOKS}, lambda x: CASE WHEN regexp_matches(x, '^[A-Za-z_$]') AND x NOT IN ({_KEEP}) THEN 'IDENT' ELSE x END)"),
    "clone_subsumption": """WITH e AS (SELECT event_type, user_id, epoch_us(ts) AS pt, epoch_us(ts) // 86400000000 AS day FROM events),
s AS (SELECT event_type || '/' || user_id || '/' || day AS id, user_id || '/' || day AS file, min(pt) AS lo, max(pt) AS hi, count(*) AS length FROM e GROUP BY event_type, user_id, day)
SELECT DISTINCT a.id FROM s a JOIN s b ON a.file = b.file AND a.id <> b.id AND a.length < b.length AND b.lo <= a.lo AND a.hi <= b.hi""",
    "suppression_parse": rf"""WITH {_SRC}, l AS (SELECT file, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM s),
w AS (SELECT file, line, regexp_extract(text, '^\s*(?://|#)\s*@(\w+)', 1) AS word FROM l), x AS (SELECT * FROM w WHERE word <> ''),
n AS (SELECT file, line, word, (SELECT min({{'n': levenshtein(word, k), 'k': k}}) FROM unnest(['file', 'module', 'unit']) t(k)) AS near FROM x)
SELECT file, line, word, CASE WHEN word NOT IN ('file', 'module', 'unit') AND near.n <= 2 THEN near.k END AS hint FROM n""",
    "discover_files": rf"""SELECT project, rel_path, row_number() OVER (PARTITION BY project ORDER BY rel_path) AS id FROM (SELECT DISTINCT project, rel_path FROM files)
WHERE regexp_matches(rel_path, '\.(tsx?|jsx?|mts|cts|mjs|cjs|pyi?)$') AND NOT regexp_matches(rel_path, '(^|/)(\.[^/]*|{"|".join(SKIPPED)})/')""",
    "lang_dispatch": r"""WITH f AS (SELECT DISTINCT run_id, file, CASE WHEN regexp_matches(file, '\.pyi?$') THEN 'py' ELSE 'ts' END AS l FROM files),
c AS (SELECT run_id, count(*) FILTER (l = 'ts') AS ts, count(*) FILTER (l = 'py') AS py FROM f GROUP BY run_id), r AS (SELECT run_id, arg_max({'f': files_by_lang}, ingested_at).f AS b FROM runs GROUP BY run_id)
SELECT run_id, ts AS found_ts, py AS found_py, b.ts::BIGINT AS said_ts, b.py::BIGINT AS said_py FROM r JOIN c USING (run_id)""",
    "stale_cache": """WITH f AS (SELECT file, ingested_at, sha256(content) AS digest, lang FROM files WHERE content IS NOT NULL), c AS (SELECT file, min({'i': ingested_at, 'd': digest}).d AS digest FROM f GROUP BY file)
SELECT DISTINCT file, digest FROM f WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.file = f.file AND c.digest = f.digest AND c.file IN (SELECT file FROM f WHERE lang IS NOT NULL))""",
    "changed_since": "SELECT DISTINCT file FROM findings_actual WHERE file IS NOT NULL AND recorded_at >= (SELECT max(recorded_at) FROM findings_actual WHERE file IS NOT NULL) - INTERVAL 7 DAY",
    "package_names": r"""WITH p AS (SELECT DISTINCT detail.specifier AS spec FROM findings_actual WHERE detail.specifier IS NOT NULL)
SELECT spec, CASE WHEN spec <> '' AND NOT regexp_matches(spec, '^(\.|/|#|[A-Za-z][A-Za-z0-9+.\-]*:)') THEN regexp_extract(spec, '^(@[^/]+/[^/]+|[^@/][^/]*)', 1) END AS npm,
lower(regexp_replace(regexp_extract(trim(spec), '^([A-Za-z0-9][A-Za-z0-9._\-]*)', 1), '[-_.]+', '-', 'g')) AS python FROM p""",
    "report_compact": f"WITH {_REPORT} SELECT finding_id, concat_ws(':', file, line, col, severity, kind, message) AS line FROM r",
    "codeclimate_fingerprint": f"WITH {_REPORT} SELECT finding_id, sha1(concat_ws(':', kind, file, line, message)) AS fingerprint FROM r",
    "report_json": f"WITH {_REPORT} SELECT finding_id, to_json({{'kind': kind, 'severity': severity, 'file': file, 'line': line, 'column': col, 'message': message}})::VARCHAR AS row FROM r",
    "report_sarif": f"""WITH {_REPORT} SELECT finding_id, '{{"ruleId":' || to_json(kind)::VARCHAR || ',"level":' || to_json(CASE severity WHEN 'warn' THEN 'warning' ELSE severity END)::VARCHAR || ',"message":{{"text":' || to_json(coalesce(message, ''))::VARCHAR || '}},"locations":['
 || CASE WHEN file IS NULL THEN '' ELSE '{{"physicalLocation":{{"artifactLocation":{{"uri":' || to_json(file)::VARCHAR || '}}' || CASE WHEN line IS NULL THEN '' ELSE ',"region":{{"startLine":' || line || ',"startColumn":' || (col + 1) || '}}' END || '}}}}' END || ']}}' AS row FROM r""",
    "report_markdown": f"WITH {_REPORT} SELECT kind, '| ' || kind || ' | ' || count(*) || ' | ' || count(DISTINCT file) || ' |' AS line FROM r GROUP BY kind",
    "determinism_hash": f"""WITH {_REPORT}, j AS (SELECT DISTINCT project, md5(concat_ws('|', finding_id, kind, file, line)) AS h FROM r JOIN (SELECT DISTINCT finding_id, run_id FROM findings_actual) USING (finding_id) JOIN (SELECT DISTINCT run_id, project FROM runs) USING (run_id))
SELECT project, sum(('0x' || substr(h, 1, 12))::BIGINT)::BIGINT AS digest, count(*) AS n FROM j GROUP BY project""",
    "debounce_sessions": """WITH e AS (SELECT user_id, event_type, epoch_us(ts) AS t FROM events), f AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) < 21600000000 THEN 0 ELSE 1 END AS new FROM e),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM f) SELECT user_id, min(t) AS start_us, count(*) AS n, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS types FROM s GROUP BY user_id, k""",
    "tumbling_counts": "SELECT event_type, epoch_us(ts) // 86400000000 * 86400000000 AS start_us, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
}
