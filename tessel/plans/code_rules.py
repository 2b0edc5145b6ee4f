"""The rules over relations derived from the warehouse tables: orders are files, a customer's orders that follow each other are imports, order lines are declarations and uses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.operators import graph, reexports, rules
from tessel.operators.resolve import package_of
from tessel.session import table


_O = "o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderpriority AS p, o_orderstatus AS s, o_orderdate AS t, o_totalprice AS v FROM orders)"
_E = f"""{_O}, e AS (SELECT DISTINCT src, dst, CASE WHEN v >= 498000 THEN 'dynamic' ELSE 'static' END AS kind FROM (
  SELECT k AS src, v, lead(k) OVER (PARTITION BY c, p ORDER BY t, k) AS dst FROM o UNION ALL SELECT k, v, lag(k) OVER (PARTITION BY c, s ORDER BY t, k) FROM o) WHERE dst IS NOT NULL)"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Every order imports its customer's next order of the same priority and the one before it of the same status; the dearest orders import dynamically."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("src"), "o_custkey", "o_orderpriority", "o_orderstatus", "o_orderdate", "o_totalprice")
    kind = F.when(F.col("o_totalprice") >= 498_000, "dynamic").otherwise("static").alias("kind")
    after = o.select("src", F.lead("src").over(Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderdate", "src")).alias("dst"), kind)
    before = o.select("src", F.lag("src").over(Window.partitionBy("o_custkey", "o_orderstatus").orderBy("o_orderdate", "src")).alias("dst"), kind)
    return after.union(before).filter("dst is not null").distinct().withColumn("resolvable", F.lit(True))


def files(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("file"))


def entries(spark, d):
    """The dear orders start programs."""
    return table(spark, d, "orders").filter("o_totalprice >= 490000").select(F.col("o_orderkey").alias("file"))


def _cheap(spark, d):
    """The cheap orders hold what is traced; the name is the priority."""
    return table(spark, d, "orders").filter("o_totalprice < 5000").select(F.col("o_orderkey").alias("file"), F.col("o_orderpriority").alias("name"))


def decls(spark, d):
    """Every order line declares its supplier in its order; the line status says exported, the return flag the kind."""
    kind = F.when(F.col("l_returnflag") == "R", "type").when(F.col("l_returnflag") == "A", "class").otherwise("function")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("file"), F.col("l_suppkey").alias("name"), kind.alias("kind"), (F.col("l_linestatus") == "O").alias("exported"), F.col("l_linenumber").alias("start_off"),
        F.array(F.when(F.col("l_tax") >= 0.08, "Protocol").otherwise("Base")).alias("bases"), F.when(F.col("l_discount") >= 0.1, "TypeAlias").alias("annotation"), F.lit(None).cast("string").alias("callee"),
    )


def unused_files(spark, d):
    return rules.unused_files(files(spark, d), edges(spark, d), entries(spark, d))


def trace_importers(spark, d):
    """Everything that imports, directly or not, a cheap order."""
    return rules.importers(edges(spark, d), _cheap(spark, d))


def circular_dependencies(spark, d):
    return rules.circular_dependencies(edges(spark, d)).select("scc", "size", F.array_join(F.transform("cycle", lambda x: x.cast("string")), ">").alias("cycle"))


def import_components(spark, d):
    return graph.connected_components(edges(spark, d))


def reexport_fixed_point(spark, d):
    """Priorities flow from a cheap order to everything that re-exports it."""
    return graph.propagate(graph.reverse(edges(spark, d)), _cheap(spark, d).select(F.col("file").alias("node"), F.col("name").alias("value")))


def reachable_rounds(spark, d):
    """What the entries reach, by the distributed rounds at any size."""
    return graph.reachable(edges(spark, d), entries(spark, d).select(F.col("file").alias("node")), local_edges=0)


def cycles_rounds(spark, d):
    """The components of the import cycles, by the distributed rounds at any size."""
    return graph.strongly_connected(edges(spark, d), local_edges=0)


def components_rounds(spark, d):
    return graph.connected_components(edges(spark, d), local_edges=0)


def fixed_point_rounds(spark, d):
    return graph.propagate(graph.reverse(edges(spark, d)), _cheap(spark, d).select(F.col("file").alias("node"), F.col("name").alias("value")), local_edges=0)


def reverse_index(spark, d):
    return edges(spark, d).groupBy(F.col("dst").alias("file")).agg(F.countDistinct("src").alias("importers"), F.min("src").alias("first_importer"))


def unused_exports(spark, d):
    return rules.unused_exports(decls(spark, d), edges(spark, d), entries(spark, d)).select("file", "name", "start_off").distinct()


def unused_types(spark, d):
    return rules.unused_types(decls(spark, d), edges(spark, d), entries(spark, d)).select("file", "name", "start_off").distinct()


def duplicate_exports(spark, d):
    return rules.duplicate_exports(decls(spark, d)).select("file", "name", F.size("occurrences").cast("bigint").alias("n"), F.element_at("occurrences", 1).alias("first_off"), F.element_at("occurrences", -1).alias("last_off"))


def _deps(section: str):
    def query(spark, d):
        part = table(spark, d, "part").filter(F.col("p_type") == section)
        line = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("project"), F.col("l_partkey"))
        declared = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select("project", F.col("p_name").alias("name")).distinct()
        used = line.join(table(spark, d, "part").filter(F.col("p_type") != section), F.col("l_partkey") == F.col("p_partkey")).select("project", F.col("p_name").alias("name")).distinct()
        return rules.unused_deps(declared, used)

    return query


def _deps_sql(section: str) -> str:
    return f"SELECT DISTINCT l_suppkey AS project, p_name AS name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type = '{section}' EXCEPT SELECT l_suppkey, p_name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type <> '{section}'"


def _members(kind: str):
    flag = {"enum": "N", "class": "A"}[kind]

    def query(spark, d):
        """Owners are brands of an order's lines, members the words of the part names; uses are the words of the returned lines of the order and of those that import it."""
        part = table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("members"), "p_brand")
        line = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_returnflag", "l_linestatus").join(part, F.col("l_partkey") == F.col("p_partkey"))
        owners = line.filter(F.col("l_returnflag") == flag).select(F.col("l_orderkey").alias("file"), F.col("p_brand").alias("name"), F.lit(kind).alias("kind"), (F.col("l_linestatus") == "F").alias("exported"), "members")
        uses = line.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("file"), F.lit("member").alias("kind"), F.explode("members").alias("name"))
        return rules.unused_members(owners, uses, _links(spark, d), kind).distinct()

    return query


def _members_sql(kind: str) -> str:
    flag = {"enum": "N", "class": "A"}[kind]
    return f"""
WITH {_E}, line AS (SELECT l.*, p.p_brand, string_split(p.p_name, ' ') AS members FROM lineitem l JOIN part p ON l_partkey = p_partkey),
m AS (SELECT DISTINCT l_orderkey AS file, p_brand AS owner, unnest(members) AS member FROM line WHERE l_returnflag = '{flag}' AND l_linestatus = 'F'),
u AS (SELECT DISTINCT l_orderkey AS file, unnest(members) AS name FROM line WHERE l_returnflag = 'R'),
v AS (SELECT file, name FROM u UNION SELECT e.dst, u.name FROM u JOIN e ON e.src = u.file)
SELECT file, owner, member FROM m WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.file = m.file AND (v.name = m.member OR v.name = m.owner || '.' || m.member))"""


def boundary_violations(spark, d):
    """Customers order from suppliers: a region may buy from its own and, by the list, from the next one."""
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("nk"), "n_regionkey")
    buyers = table(spark, d, "customer").select(F.concat(F.lit("c/"), "c_custkey").alias("file"), F.col("c_nationkey").alias("nk")).join(nation, "nk")
    sellers = table(spark, d, "supplier").select(F.concat(F.lit("s/"), "s_suppkey").alias("file"), F.col("s_nationkey").alias("nk")).join(nation, "nk")
    paths = buyers.unionByName(sellers).select("file", F.concat(F.lit("/r"), "n_regionkey", F.lit("/"), "file").alias("path"))
    zones = table(spark, d, "region").select(F.col("r_name").alias("zone"), F.col("r_regionkey").alias("ord"), F.concat(F.lit("^/r"), "r_regionkey", F.lit("/")).alias("regex"))
    n = zones.count()
    allow = zones.alias("a").join(zones.alias("b"), F.col("b.ord") == (F.col("a.ord") + 1) % n).select(F.col("a.zone").alias("from_zone"), F.col("b.zone").alias("to_zone"))
    links = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("c/"), "o_custkey").alias("src"), F.concat(F.lit("s/"), "l_suppkey").alias("dst")).distinct().withColumn("resolvable", F.lit(True))
    found = rules.boundary_violations(links, rules.zone_of(paths, zones, "path"), allow)
    return found.groupBy("from_zone", "to_zone").agg(F.count("*").alias("n"), F.min("src").alias("first_src"))


def nearest_manifest(spark, d):
    """Each file's nearest package directory: the deepest ancestor that holds a file directly below it named like an entry."""
    paths = table(spark, d, "files").select(F.col("file").alias("path")).distinct()
    owners = paths.select(F.regexp_extract("path", r"^(/work/[^/]+(?:/packages/[^/]+)?)/", 1).alias("dir")).distinct()
    return rules.nearest_ancestor(paths, owners)


def private_type_leak(spark, d):
    """A use at an event's millisecond inside an exported declaration that lasts as long as the event's value in minutes."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("key"), at.alias("at"), "event_type", "value")
    points = e.filter("event_type = 'error'").select("key", F.col("event_id").alias("id"), "at")
    length = F.floor(F.col("value") * 60_000_000).cast("bigint")
    spans = e.filter("event_type = 'view'").select("key", F.col("event_id").alias("span"), F.col("at").alias("lo"), (F.col("at") + length).alias("hi"))
    return rules.first_enclosing(points, spans, 3_600_000_000)


def _findings(spark, d):
    """All findings of three rules over the same relations: (kind, file, name)."""
    name = F.col("name").cast("string")
    a = unused_files(spark, d).select(F.lit("unused-files").alias("kind"), "file", F.lit(None).cast("string").alias("name"))
    b = unused_exports(spark, d).select(F.lit("unused-exports").alias("kind"), "file", name.alias("name")).distinct()
    c = unused_types(spark, d).select(F.lit("unused-types").alias("kind"), "file", name.alias("name")).distinct()
    return a.unionByName(b).unionByName(c)


def cross_reference(spark, d):
    allowed = table(spark, d, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").cast("string").alias("name"))
    keep = table(spark, d, "orders").filter("o_orderpriority = '2-HIGH'").select(F.col("o_orderkey").alias("file"), F.lit(True).alias("_keep"))
    found = _findings(spark, d).join(keep, "file", "left")
    return rules.cross_reference(found, F.col("_keep"), None, allowed).select("kind", "file", F.coalesce("name", F.lit("")).alias("name"))


def diagnostics_by_rule(spark, d):
    return rules.counts_by_rule(_findings(spark, d), ["unused-files", "unused-exports", "unused-types", "unused-deps", "circular-dependencies"])


def rollup_report(spark, d):
    """Totals per section and rule, per section, and over all."""
    f = table(spark, d, "findings_actual").dropDuplicates(["finding_id", "recorded_at"])
    return f.rollup("severity", "kind").agg(F.count("*").alias("n")).select(F.coalesce("severity", F.lit("*")).alias("severity"), F.coalesce("kind", F.lit("*")).alias("kind"), "n")


def _links(spark, d):
    return edges(spark, d).select("src", "dst").distinct()


def trace_export(spark, d):
    """Importers of urgent orders that are urgent too, over importers."""
    uses = table(spark, d, "orders").select(F.col("o_orderkey").alias("file"), F.col("o_orderpriority").alias("name"))
    return reexports.trace_export(edges(spark, d), uses, "1-URGENT")


def entry_star_targets(spark, d):
    return reexports.entry_targets(_links(spark, d), entries(spark, d))


def reexport_provenance(spark, d):
    """Which direct source each re-exported priority comes from."""
    own = _cheap(spark, d).withColumn("exported", F.lit(True))
    return reexports.provenance(reexports.exported_names(own, _links(spark, d)), own, _links(spark, d))


def star_symbols(spark, d):
    alias = table(spark, d, "orders").select(F.col("o_orderkey").alias("dst"), F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).alias("alias"))
    return reexports.star_symbols(_links(spark, d).join(alias, "dst").select("src", F.col("dst").alias("dst_id"), "alias"))


def import_hygiene(spark, d):
    """Specifiers of findings as imports that resolve to nothing; what an unused dependency names is declared in its project."""
    project = table(spark, d, "runs").select("run_id", "project").distinct()
    rows = table(spark, d, "findings_actual").select("run_id", "kind", "file", F.col("detail.specifier").alias("spec")).filter("spec is not null and file is not null").join(project, "run_id")
    declared = rows.filter(F.col("kind").isin("unused-deps", "unused-dev-deps")).select("project", F.col("spec").alias("name"))
    links = rows.select("project", F.col("file").alias("src"), "spec", F.lit(None).cast("string").alias("dst"), F.lit(False).alias("resolvable"), package_of(F.col("spec")).alias("package"))
    return rules.import_hygiene(links, declared).distinct()


QUERIES = {
    "trace_export": trace_export, "entry_star_targets": entry_star_targets, "reexport_provenance": reexport_provenance, "star_symbols": star_symbols, "import_hygiene": import_hygiene,
    "unused_files": unused_files, "trace_importers": trace_importers, "circular_dependencies": circular_dependencies, "import_components": import_components, "reexport_fixed_point": reexport_fixed_point, "reverse_index": reverse_index,
    "unused_exports": unused_exports, "unused_types": unused_types, "duplicate_exports": duplicate_exports, "unused_deps": _deps("ECONOMY"), "unused_dev_deps": _deps("PROMO"), "unused_optional_deps": _deps("STANDARD"),
    "unused_enum_members": _members("enum"), "unused_class_members": _members("class"), "boundary_violations": boundary_violations, "nearest_manifest": nearest_manifest, "private_type_leak": private_type_leak,
    "reachable_rounds": reachable_rounds, "cycles_rounds": cycles_rounds, "components_rounds": components_rounds, "fixed_point_rounds": fixed_point_rounds,
    "cross_reference": cross_reference, "diagnostics_by_rule": diagnostics_by_rule, "rollup_report": rollup_report,
}

_REACH = _E + """, r(node) AS (SELECT k FROM o WHERE v >= 490000 UNION SELECT src FROM e WHERE kind = 'dynamic' UNION SELECT e.dst FROM r JOIN e ON e.src = r.node)"""
_DECLS = """x AS (SELECT l_orderkey AS file, l_suppkey AS name, CASE l_returnflag WHEN 'R' THEN 'type' WHEN 'A' THEN 'class' ELSE 'function' END AS kind, l_linestatus = 'O' AS exported, l_linenumber AS start_off, l_tax, l_discount FROM lineitem)"""
_OPEN = """exported AND file NOT IN (SELECT dst FROM e) AND file NOT IN (SELECT k FROM o WHERE v >= 490000)"""
_UNUSED_TYPE = "(kind = 'type' OR (kind = 'class' AND l_tax >= 0.08) OR l_discount >= 0.1)"
_ALL = f"""f AS (SELECT 'unused-files' AS kind, k AS file, NULL AS name FROM o WHERE k NOT IN (SELECT node FROM r)
  UNION ALL SELECT DISTINCT 'unused-exports', file, name::VARCHAR FROM x WHERE kind <> 'type' AND {_OPEN}
  UNION ALL SELECT DISTINCT 'unused-types', file, name::VARCHAR FROM x WHERE {_UNUSED_TYPE} AND {_OPEN})"""
_REACH_PAIRS = _E + ", c(a, b) AS (SELECT src, dst FROM e UNION SELECT c.a, e.dst FROM c JOIN e ON e.src = c.b)"

_SCC = _REACH_PAIRS + ", s AS (SELECT x.a AS node, min(x.b) AS scc FROM c x JOIN c y ON x.a = y.b AND x.b = y.a GROUP BY x.a)"
_LINKS = "l AS (SELECT DISTINCT src, dst FROM e)"
_COMPONENTS = f"WITH RECURSIVE {_E}, u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), c(node, low) AS (SELECT a, least(a, min(b)) FROM u GROUP BY a UNION SELECT u.a, c.low FROM u JOIN c ON u.b = c.node WHERE c.low < u.a) SELECT node, min(low) AS component FROM c GROUP BY node"
_FIXED_POINT = f"WITH RECURSIVE {_E}, r(node, value) AS (SELECT k, p FROM o WHERE v < 5000 UNION SELECT e.src, r.value FROM r JOIN e ON e.dst = r.node) SELECT node, value FROM r"
ORACLES = {
    "import_components": _COMPONENTS, "components_rounds": _COMPONENTS, "reexport_fixed_point": _FIXED_POINT, "fixed_point_rounds": _FIXED_POINT,
    "trace_export": f"""WITH RECURSIVE {_E}, {_LINKS}, u AS (SELECT k FROM o WHERE p = '1-URGENT'), x AS (SELECT dst AS a, src AS b FROM l WHERE src IN (SELECT k FROM u) AND dst IN (SELECT k FROM u)),
r(file) AS (SELECT b FROM x UNION SELECT x.b FROM r JOIN x ON x.a = r.file) SELECT file FROM r""",
    "entry_star_targets": f"""WITH RECURSIVE {_E}, {_LINKS}, s AS (SELECT DISTINCT dst AS file FROM l WHERE src IN (SELECT k FROM o WHERE v >= 490000)), r(file) AS (SELECT file FROM s UNION SELECT l.dst FROM r JOIN l ON l.src = r.file)
SELECT file, file IN (SELECT file FROM s) AS direct FROM r""",
    "reexport_provenance": f"""WITH RECURSIVE {_E}, {_LINKS}, w AS (SELECT k AS file, p AS name FROM o WHERE v < 5000), r(file, name) AS (SELECT file, name FROM w UNION SELECT l.src, r.name FROM r JOIN l ON l.dst = r.file)
SELECT r.file, r.name, min(l.dst) AS via FROM r JOIN l ON l.src = r.file JOIN r q ON q.file = l.dst AND q.name = r.name WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.file = r.file AND w.name = r.name) GROUP BY r.file, r.name""",
    "star_symbols": f"WITH {_E}, {_LINKS} SELECT DISTINCT src AS file, '__star_' || dst || CASE WHEN s = 'P' THEN '_as_' || p ELSE '' END || '__' AS symbol FROM l JOIN o ON k = dst",
    "import_hygiene": r"""WITH r AS (SELECT DISTINCT project, kind, file AS src, detail.specifier AS spec FROM findings_actual JOIN (SELECT DISTINCT run_id, project FROM runs) USING (run_id) WHERE detail.specifier IS NOT NULL AND file IS NOT NULL),
k AS (SELECT DISTINCT project, spec AS name FROM r WHERE kind IN ('unused-deps', 'unused-dev-deps')),
p AS (SELECT *, CASE WHEN spec <> '' AND NOT regexp_matches(spec, '^(\.|/|#|[A-Za-z][A-Za-z0-9+.\-]*:)') THEN regexp_extract(spec, '^(@[^/]+/[^/]+|[^@/][^/]*)', 1) END AS package FROM r)
SELECT DISTINCT src, spec, CASE WHEN package IS NOT NULL AND NOT EXISTS (SELECT 1 FROM k WHERE k.project = p.project AND k.name = p.package) THEN 'unlisted-dependencies' ELSE 'unresolved-imports' END AS rule FROM p""",
    "unused_files": f"WITH RECURSIVE {_REACH} SELECT k AS file FROM o WHERE k NOT IN (SELECT node FROM r)",
    "reachable_rounds": f"WITH RECURSIVE {_E}, r(node) AS (SELECT k FROM o WHERE v >= 490000 UNION SELECT e.dst FROM r JOIN e ON e.src = r.node) SELECT node FROM r",
    "trace_importers": f"WITH RECURSIVE {_E}, r(file) AS (SELECT src FROM e WHERE dst IN (SELECT k FROM o WHERE v < 5000) UNION SELECT e.src FROM r JOIN e ON e.dst = r.file) SELECT file FROM r",
    "circular_dependencies": f"""WITH RECURSIVE {_SCC}, n AS (SELECT a.scc, e.src, e.dst FROM e JOIN s a ON a.node = e.src JOIN s b ON b.node = e.dst AND b.scc = a.scc),
w(scc, node, path) AS (SELECT DISTINCT scc, scc, [scc] FROM s UNION ALL SELECT w.scc, min(n.dst), list_append(w.path, min(n.dst)) FROM w JOIN n ON n.scc = w.scc AND n.src = w.node WHERE NOT list_contains(w.path, n.dst) GROUP BY w.scc, w.node, w.path)
SELECT scc, any_value(size) AS size, array_to_string(list_append(arg_max(path, len(path)), scc), '>') AS cycle FROM w JOIN (SELECT scc, count(*) AS size FROM s GROUP BY scc) USING (scc) GROUP BY scc""",
    "cycles_rounds": f"WITH RECURSIVE {_SCC} SELECT node, scc FROM s",
    "reverse_index": f"WITH {_E} SELECT dst AS file, count(DISTINCT src) AS importers, min(src) AS first_importer FROM e GROUP BY dst",
    "unused_exports": f"WITH {_E}, {_DECLS} SELECT DISTINCT file, name, start_off FROM x WHERE kind <> 'type' AND {_OPEN}",
    "unused_types": f"WITH {_E}, {_DECLS} SELECT DISTINCT file, name, start_off FROM x WHERE {_UNUSED_TYPE} AND {_OPEN}",
    "duplicate_exports": f"WITH {_DECLS} SELECT file, name, count(*) AS n, min(start_off) AS first_off, max(start_off) AS last_off FROM x WHERE exported GROUP BY file, name HAVING count(*) > 1",
    "unused_deps": _deps_sql("ECONOMY"), "unused_dev_deps": _deps_sql("PROMO"), "unused_optional_deps": _deps_sql("STANDARD"),
    "unused_enum_members": _members_sql("enum"), "unused_class_members": _members_sql("class"),
    "boundary_violations": """WITH l AS (SELECT DISTINCT o_custkey AS c, l_suppkey AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
z AS (SELECT l.*, rc.r_name AS from_zone, rs.r_name AS to_zone, rc.r_regionkey AS a, rs.r_regionkey AS b FROM l JOIN customer ON c = c_custkey JOIN nation nc ON c_nationkey = nc.n_nationkey JOIN region rc ON nc.n_regionkey = rc.r_regionkey
  JOIN supplier ON s = s_suppkey JOIN nation ns ON s_nationkey = ns.n_nationkey JOIN region rs ON ns.n_regionkey = rs.r_regionkey)
SELECT from_zone, to_zone, count(*) AS n, min('c/' || c) AS first_src FROM z WHERE a <> b AND b <> (a + 1) % (SELECT count(*) FROM region) GROUP BY ALL""",
    "nearest_manifest": r"""WITH p AS (SELECT DISTINCT file AS path FROM files), o AS (SELECT DISTINCT regexp_extract(path, '^(/work/[^/]+(?:/packages/[^/]+)?)/', 1) AS dir FROM p),
a AS (SELECT path, array_to_string(list_slice(string_split(path, '/'), 1, n), '/') AS dir FROM (SELECT path, unnest(range(1, len(string_split(path, '/')))) AS n FROM p))
SELECT path, arg_max(dir, length(dir)) AS owner FROM a JOIN o USING (dir) GROUP BY path""",
    "private_type_leak": """WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS at, event_type, value FROM events),
j AS (SELECT u.user_id AS key, u.event_id AS id, s.event_id AS span, s.at AS lo FROM e u JOIN e s ON u.user_id = s.user_id AND u.event_type = 'error' AND s.event_type = 'view' AND s.at <= u.at AND u.at < s.at + floor(s.value * 60000000)::BIGINT)
SELECT key, id, span FROM j QUALIFY row_number() OVER (PARTITION BY key, id ORDER BY lo, span) = 1""",
    "cross_reference": f"""WITH RECURSIVE {_REACH}, {_DECLS}, {_ALL}, g AS (SELECT * FROM f WHERE NOT (kind = 'unused-files' AND file IN (SELECT k FROM o WHERE p = '2-HIGH')))
SELECT kind, file, coalesce(name, '') AS name FROM g WHERE NOT (kind IN ('unused-exports', 'unused-types') AND file IN (SELECT file FROM g WHERE kind = 'unused-files'))
AND NOT (kind = 'unused-exports' AND name IN (SELECT s_suppkey::VARCHAR FROM supplier WHERE s_acctbal < 0))""",
    "diagnostics_by_rule": f"""WITH RECURSIVE {_REACH}, {_DECLS}, {_ALL} SELECT rule, count(f.kind) AS n FROM (SELECT unnest(['unused-files', 'unused-exports', 'unused-types', 'unused-deps', 'circular-dependencies']) AS rule) LEFT JOIN f ON f.kind = rule GROUP BY rule""",
    "rollup_report": "WITH f AS (SELECT DISTINCT finding_id, recorded_at, severity, kind FROM findings_actual) SELECT coalesce(severity, '*') AS severity, coalesce(kind, '*') AS kind, count(*) AS n FROM f GROUP BY ROLLUP (severity, kind)",
}
