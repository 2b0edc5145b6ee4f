"""The rule catalogue over relations of code structure; every rule is a plan, nothing runs until a result is asked for.

Relations (other columns are ignored): files(file), decls(file, name, kind, exported, start_off, end_off, members, bases,
annotation, callee), usages(file, kind, name, off), edges(src, dst, kind, spec, resolvable, off; dst null outside the project),
entries(file), deps(project, section, name), zones(zone, ord, regex), allow(from_zone, to_zone). ``file`` may be of any type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.operators.graph import cycle_walk, reachable, strongly_connected

TYPE_BASES = ["TypedDict", "Protocol"]
TYPE_CALLEES = ["NewType", "TypeAliasType", "TypeVar", "ParamSpec", "TypeVarTuple"]


def resolved(edges: DataFrame) -> DataFrame:
    return edges.filter("resolvable and dst is not null")


def unused_files(files: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """Files that neither an entry nor the source of a dynamic import reaches; none if there is no entry."""
    present = entries.select("file").join(files.select("file"), "file", "left_semi")
    roots = present.select(F.col("file").alias("node")).union(edges.filter("kind = 'dynamic'").select("src"))
    found = reachable(resolved(edges).select("src", "dst"), roots)
    unused = files.select("file").join(found, F.col("file") == F.col("node"), "left_anti")
    return unused.join(present.limit(1).select(F.lit(1).alias("_any")), F.lit(True), "left_semi")


def importers(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(file) of all files that reach a target over at least one edge: the trace."""
    back = resolved(edges).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    first = back.join(targets.select(F.col("file").alias("src")), "src", "left_semi").select(F.col("dst").alias("node"))
    return reachable(back, first).select(F.col("node").alias("file"))


def _unimported(decls: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    imported = edges.filter("dst is not null").select(F.col("dst").alias("file")).distinct()
    return decls.filter("exported").join(imported, "file", "left_anti").join(entries.select("file"), "file", "left_anti")


def unused_exports(decls: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """Exported values of files that nothing imports; use is per file, not per name."""
    return _unimported(decls.filter(~F.col("kind").isin("type", "css-class")), edges, entries)


def type_like() -> Column:
    none = F.lit(False)
    return (
        (F.col("kind") == "type")
        | F.coalesce((F.col("kind") == "class") & F.arrays_overlap("bases", F.array(*map(F.lit, TYPE_BASES))), none)
        | F.coalesce(F.col("annotation") == "TypeAlias", none)
        | F.coalesce(F.col("callee").isin(*TYPE_CALLEES), none)
    )


def unused_types(decls: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """Exported types, and Python declarations that act as types, of files that nothing imports."""
    return _unimported(decls.filter(type_like()), edges, entries)


def unused_deps(deps: DataFrame, imported: DataFrame) -> DataFrame:
    """Declared packages that are not imported; type packages are exempt."""
    return deps.filter(~F.startswith(F.col("name"), F.lit("@types/"))).join(imported.select("project", "name"), ["project", "name"], "left_anti")


def unused_members(decls: DataFrame, usages: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    """(file, owner, member): members of exported declarations that neither their own file nor an importer uses, by name or as ``owner.member``."""
    members = decls.filter(F.col("exported") & (F.col("kind") == kind)).select("file", F.col("name").alias("owner"), F.explode("members").alias("member"))
    names = usages.filter(F.col("kind").isin("identifier", "member")).select(F.col("file").alias("user"), F.col("name"))
    own = names.select(F.col("user").alias("file"), "name")
    outside = names.join(edges.filter("dst is not null").select(F.col("src").alias("user"), F.col("dst").alias("file")).distinct(), "user").select("file", "name")
    used = own.union(outside).distinct()
    # one join on (file, name) covers both spellings
    left = members.join(used.select("file", F.col("name").alias("member")), ["file", "member"], "left_anti")
    full = used.select("file", F.col("name").alias("_full"))
    return left.withColumn("_full", F.concat_ws(".", "owner", "member")).join(full, ["file", "_full"], "left_anti").select("file", "owner", "member")


def circular_dependencies(edges: DataFrame) -> DataFrame:
    """(scc, size, cycle) of every set of files that import each other."""
    links = resolved(edges).select("src", "dst")
    components = strongly_connected(links)
    sizes = components.groupBy("scc").agg(F.count("*").alias("size"))
    return sizes.join(cycle_walk(links, components), "scc")


def zone_of(files: DataFrame, zones: DataFrame, path: str) -> DataFrame:
    """(file, zone): the first zone in order one of whose patterns matches. The few patterns become one expression, no join."""
    rows = [r for r in zones.orderBy("ord", "regex").limit(10_001).collect()]
    if len(rows) > 10_000:
        raise ValueError("too many zone patterns")
    zone = F.coalesce(*(F.when(F.col(path).rlike(r.regex), F.lit(r.zone)) for r in rows)) if rows else F.lit(None).cast("string")
    return files.select("file", zone.alias("zone"))


def boundary_violations(edges: DataFrame, file_zones: DataFrame, allow: DataFrame) -> DataFrame:
    """(src, dst, from_zone, to_zone) of resolved edges between different zones of which the first may not import the second."""
    a, b = file_zones.filter("zone is not null"), file_zones.filter("zone is not null")
    crossing = resolved(edges).select("src", "dst").join(a.select(F.col("file").alias("src"), F.col("zone").alias("from_zone")), "src").join(b.select(F.col("file").alias("dst"), F.col("zone").alias("to_zone")), "dst")
    return crossing.filter("from_zone <> to_zone").join(allow, ["from_zone", "to_zone"], "left_anti").select("src", "dst", "from_zone", "to_zone")


def import_hygiene(edges: DataFrame, declared: DataFrame) -> DataFrame:
    """(src, spec, rule): imports that resolve to nothing; a bare name that is not declared is unlisted, anything else unresolved. One scan gives both rules.

    edges also has project and package (null unless the import is bare)."""
    open_ = edges.filter("dst is null and not resolvable")
    known = declared.select("project", F.col("name").alias("package"), F.lit(True).alias("_declared")).distinct()
    rows = open_.join(known, ["project", "package"], "left")
    rule = F.when(F.col("package").isNotNull() & F.col("_declared").isNull(), "unlisted-dependencies").otherwise("unresolved-imports")
    return rows.select("src", "spec", rule.alias("rule"))


def duplicate_exports(decls: DataFrame) -> DataFrame:
    """(file, name, occurrences): names a file exports more than once, with their sorted offsets."""
    groups = decls.filter("exported and kind <> 'css-class'").groupBy("file", "name").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("start_off")).alias("occurrences"))
    return groups.filter("n > 1").drop("n")


def private_type_leak(decls: DataFrame, usages: DataFrame) -> DataFrame:
    """(file, name, symbol): uses of a type the file does not export, inside an exported declaration; the first declaration around each use."""
    private = decls.filter("not exported and kind = 'type'").select("file", "name").distinct()
    used = usages.filter(F.col("kind").isin("identifier", "member")).join(private, ["file", "name"]).select("file", "name", "off")
    public = decls.filter("exported and kind <> 'type'").select("file", F.col("name").alias("symbol"), "start_off", "end_off")
    inside = used.join(public, "file").filter("start_off <= off and off < end_off")
    return inside.groupBy("file", "name", "off").agg(F.min_by("symbol", F.struct("start_off", "end_off", "symbol")).alias("symbol")).select("file", "name", "symbol").distinct()


def over_threshold(functions: DataFrame, metric: str, threshold: int) -> DataFrame:
    return functions.filter(F.col(metric) > threshold)


def counts_by_rule(findings: DataFrame, rules: list[str]) -> DataFrame:
    """(rule, n) with zeros for enabled rules without a finding."""
    enabled = F.explode(F.array(*map(F.lit, rules))).alias("rule")
    found = findings.groupBy(F.col("kind").alias("rule")).agg(F.count("*").alias("n"))
    return findings.sparkSession.range(1).select(enabled).join(found, "rule", "left").select("rule", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


ORPHAN_HIDES = ["unused-exports", "unused-types", "unused-enum-members", "unused-class-members"]


def cross_reference(findings: DataFrame, always_used: Column | None = None, tooling: DataFrame | None = None, allowed_exports: DataFrame | None = None, allowed_members: DataFrame | None = None) -> DataFrame:
    """Findings without what another finding or a plugin explains. findings(kind, file, name).

    Unused files that plugins always use go first; then findings inside the unused files that remain; then tooling packages, allowed exports and allowed members."""
    out = findings
    if always_used is not None:
        out = out.filter(~((F.col("kind") == "unused-files") & F.coalesce(always_used, F.lit(False))))
    orphans = out.filter("kind = 'unused-files'").select("file").distinct().withColumn("_orphan", F.lit(True))
    out = out.join(orphans, "file", "left").filter(~(F.col("kind").isin(*ORPHAN_HIDES) & F.coalesce("_orphan", F.lit(False)))).drop("_orphan")
    for names, kinds in ((tooling, ["unused-deps", "unused-dev-deps", "unused-optional-deps"]), (allowed_exports, ["unused-exports"]), (allowed_members, ["unused-class-members"])):
        if names is not None:
            known = names.select("name").distinct().withColumn("_known", F.lit(True))
            out = out.join(known, "name", "left").filter(~(F.col("kind").isin(*kinds) & F.coalesce("_known", F.lit(False)))).drop("_known")
    return out


def ordered(findings: DataFrame) -> DataFrame:
    """The total output order: file, offset (none first), kind, then position within the rule."""
    return findings.orderBy("file", F.coalesce("off", F.lit(-1)), "kind", "name")


def nearest_ancestor(paths: DataFrame, owners: DataFrame) -> DataFrame:
    """(path, owner): of the directories in owners(dir) the deepest that contains each path. Ancestors are listed and joined by equality."""
    parts = F.split("path", "/")
    up = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/")))
    pairs = paths.select("path", up.alias("dir")).join(owners.select("dir").distinct(), "dir")
    return pairs.groupBy("path").agg(F.max_by("dir", F.length("dir")).alias("owner"))


def first_enclosing(points: DataFrame, spans: DataFrame, width: int) -> DataFrame:
    """(key, id, span): for each point (key, id, at) the first span (key, span, lo, hi) with lo <= at < hi, by (lo, span).

    Points and spans meet in bins of ``width``, so a key with many of both does not form a product."""
    bins = F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("bin")
    left = points.withColumn("bin", F.floor(F.col("at") / width))
    right = spans.filter("lo < hi").select("key", "span", "lo", "hi", bins)
    met = left.join(right, ["key", "bin"]).filter("lo <= at and at < hi")
    return met.groupBy("key", "id").agg(F.min(F.struct("lo", "span")).alias("m")).select("key", "id", F.col("m.span").alias("span"))


def row_rank(df: DataFrame, key: list[str], order: list[Column]) -> Column:
    return F.row_number().over(Window.partitionBy(*key).orderBy(*order))
