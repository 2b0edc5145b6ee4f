"""The analysis of code bases: files and manifests in, one table of findings out.

``Codebase`` takes files(project, root, file, content) and either deps(project, dir, ecosystem, section, name) or
manifests(project, root, dir, name, content), all of any size, and offers the relations between them and the findings of the rule catalogue as plans.
From manifests it also has entry points, path aliases and the packages of a workspace. Plugins are few and given as definitions.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.extract import exploded, file_metrics, inventory
from tessel.functions import scores
from tessel.functions.globs import is_glob, path_glob, zone_glob
from tessel.operators import clones, reexports, rules
from tessel.operators.resolve import dirname, fold, normal_name, package_of, python_base, python_candidates, resolve, script_candidates
from tessel.session import materialize
from tessel.sources import manifests
from tessel.sources.config import Config
from tessel.sources.packages import Plugin
from tessel.sources.tree import normal_name as plain_name

# fixed values: file names that start programs or are run by tools
JS = "{ts,tsx,js,jsx,mjs,cjs,mts,cts}"
ENTRY_GLOBS = [
    *(f"{p}{n}.{JS}" for n in ("index", "main", "cli", "server", "app") for p in ("", "src/")), f"bin/**/*.{JS}", f"src/bin/**/*.{JS}", f"scripts/**/*.{JS}", f"**/preload.{JS}", f"src/electron/main.{JS}",
    f"src/main/index.{JS}", f"src/renderer/index.{JS}", f"packages/*/src/index.{JS}", f"packages/*/index.{JS}", f"packages/*/src/main.{JS}", f"**/*.test.{JS}", f"**/*.spec.{JS}", f"**/__tests__/**/*.{JS}",
    f"**/__mocks__/**/*.{JS}", f"test/**/*.{JS}", f"tests/**/*.{JS}", f"*.config.{JS}", "**/__main__.py", "manage.py", "**/manage.py", "wsgi.py", "asgi.py", "**/wsgi.py", "**/asgi.py", "app.py", "main.py", "run.py", "src/main.py",
    "setup.py", "noxfile.py", "tasks.py", "conftest.py", "**/conftest.py", "**/test_*.py", "**/*_test.py", "test/**/*.py", "tests/**/*.py", "scripts/**/*.py",
]
ALIASES = {"~~/": "", "@@/": "", "~/": "", "@/": "", "#internal/": "internal/"}
NODE_BUILTINS = "assert async_hooks buffer child_process cluster console constants crypto dgram diagnostics_channel dns domain events fs http http2 https inspector module net os path perf_hooks process punycode querystring readline repl stream string_decoder sys timers tls trace_events tty url util v8 vm wasi worker_threads zlib".split()
# fixed values: words that are no names, so renaming keeps them
CLONE_KEYWORDS = {
    "py": "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda match nonlocal not or pass raise return try while with yield case type".split(),
    "ts": "function class let const var if else for while do switch case default break continue return try catch finally throw new delete typeof instanceof in of import export from as async await yield this super null undefined true false void interface type enum extends implements readonly public private protected static abstract override declare module namespace".split(),
}
RULES = [
    "boundary-violations", "circular-dependencies", "code-duplication", "cognitive-complexity", "complexity-hotspot", "duplicate-exports", "private-type-leak", "unlisted-dependencies", "unresolved-imports", "unused-class-members",
    "unused-deps", "unused-dev-deps", "unused-enum-members", "unused-exports", "unused-files", "unused-optional-deps", "unused-types",
]
HEALTH = {"cognitive-complexity", "complexity-hotspot"}
MODES = {"full": set(RULES), "dead-code-only": set(RULES) - HEALTH - {"code-duplication"}, "dupes-only": {"code-duplication"}, "health-only": HEALTH, "audit": set()}


def _atoms(names: set[str]) -> Column:
    """Which of the wanted names or prefixes (with a slash at the end) a dependency is."""
    hit = lambda n: F.startswith(F.col("name"), F.lit(n)) if n.endswith("/") else F.col("name").isin(n, plain_name(n))
    return F.array_compact(F.array(*(F.when(hit(n), F.lit(f"dep {n}")) for n in sorted(names)), F.lit(None).cast("string")))


class Codebase:
    def __init__(self, files: DataFrame, deps: DataFrame | None = None, config: Config | None = None, manifests_: DataFrame | None = None, plugins: list[Plugin] = ()):
        self.spark, self.config, self.plugins = files.sparkSession, config or Config(), list(plugins)
        self.registered: dict[str, Callable[[Codebase], DataFrame]] = {}
        known = files.filter("file is not null").dropDuplicates(["file"])
        self.facts = materialize(manifests.facts(manifests_), "facts") if manifests_ is not None else None
        none = self.spark.createDataFrame([], manifests.ROW)
        self.deps = deps if deps is not None else none if self.facts is None else manifests.dependencies(self.facts)
        self.sources = known.select("project", "root", "file", "content")
        rel = F.expr("substr(file, length(root) + 2)")
        self.files = known.select("project", "root", "file", rel.alias("rel_path"))

    @cached_property
    def inventory(self) -> DataFrame:
        """Extracted once, written once; all rules read it."""
        return materialize(inventory(self.sources), "inventory")

    def table(self, what: str) -> DataFrame:
        return exploded(self.inventory, what)

    @cached_property
    def decls(self) -> DataFrame:
        return self.table("decls")

    # ------------------------------------------------------------ graph

    @cached_property
    def edges(self) -> DataFrame:
        """edges(src, dst, kind, spec, resolvable, project, package, off): imports, package files and submodules."""
        roots = self.files.select("file", "root")
        imports = self.table("imports").join(roots, "file")
        kind = F.when(F.col("kind") == "reexport", "static").otherwise(F.col("kind")).alias("kind")
        rows = imports.select("project", F.col("file").alias("src"), "root", "lang", kind, F.col("source").alias("spec"), F.col("resolvable").alias("literal"), F.col("start_off").alias("off"), "names")
        py, ts = rows.filter("lang = 'py'"), rows.filter("lang = 'ts'")
        return materialize(self._script_edges(ts).unionByName(self._python_edges(py)).unionByName(self._package_edges()), "edges")

    def _finish(self, rows: DataFrame, package: Column, builtin: Column) -> DataFrame:
        resolvable = F.col("literal") & (F.col("dst").isNotNull() | F.coalesce(builtin, F.lit(False)))
        return rows.select("src", "dst", "kind", "spec", resolvable.alias("resolvable"), "project", package.alias("package"), "off")

    def _script_edges(self, rows: DataFrame) -> DataFrame:
        spec, start = F.col("spec"), F.lit(None).cast("string")
        for prefix, to in ALIASES.items():  # built-in aliases name the project root and do not fall through
            start = F.when(F.startswith(spec, F.lit(prefix)), F.concat("root", F.lit("/" + to), F.substr(spec, F.lit(len(prefix) + 1)))).otherwise(start)
        start = F.when(spec.rlike(r"^\.{1,2}(/|$)"), F.concat(dirname(F.col("src")), F.lit("/"), spec)).when(F.startswith(spec, F.lit("/")), spec).otherwise(start)
        rows = rows.withColumn("base", fold(start))
        # path aliases come first, then what the specifier says by itself, then packages of the project
        later = lambda cs, n: F.transform(cs, lambda c: F.struct((c["rank"] + n).cast("int").alias("rank"), c["path"].alias("path")))
        candidates = F.when(F.col("base").isNotNull(), later(script_candidates(F.col("base")), 100_000)).otherwise(F.array().cast("array<struct<rank:int,path:string>>"))
        if self.facts is not None:
            named, none = rows.filter(F.col("literal") & ~spec.rlike(r"^(\.{1,2}(/|$)|/)")), F.array().cast("array<string>")
            for name, bases in (("_alias", manifests.alias_bases(named, self.facts)), ("_package", manifests.package_bases(named, self.facts))):
                rows = rows.join(bases.withColumnRenamed("bases", name), ["src", "spec"], "left")
            candidates = F.concat(manifests.base_candidates(F.coalesce("_alias", none)), candidates, later(manifests.base_candidates(F.coalesce("_package", none)), 200_000))
        rows = rows.withColumn("_candidates", candidates)
        open_ = F.col("literal") & (F.size("_candidates") > 0)
        found = resolve(rows.filter(open_), self.files.select("file"), F.col("_candidates"))
        rest = rows.filter(~open_).withColumn("dst", F.lit(None).cast("string"))
        builtin = F.startswith(spec, F.lit("node:")) | F.split(spec, "/")[0].isin(*NODE_BUILTINS)
        alias = F.lit(False)
        for prefix in ALIASES:
            alias = alias | F.startswith(spec, F.lit(prefix))
        package = F.when(alias, spec).otherwise(package_of(spec))
        return self._finish(found.unionByName(rest), package, builtin)

    def _python_edges(self, rows: DataFrame) -> DataFrame:
        names = F.explode(F.concat(F.array(F.lit(None).cast("string")), F.transform("names", lambda n: n))).alias("name")
        many = rows.select("*", names)
        dot = F.when(F.endswith("spec", F.lit(".")), F.lit("")).otherwise(F.lit("."))
        many = many.withColumn("module", F.when(F.col("name").isNull(), F.col("spec")).otherwise(F.concat("spec", dot, "name")))
        here = python_base(F.col("src"), F.col("root"), F.col("module"))
        other = python_base(F.col("src"), F.concat("root", F.lit("/src")), F.col("module"))
        shift = lambda c: F.transform(python_candidates(c), lambda x: F.struct((x["rank"] + 10).alias("rank"), x["path"].alias("path")))
        many = many.withColumn("_here", here).withColumn("_other", other)
        found = resolve(many, self.files.select("file"), F.concat(python_candidates(F.col("_here")), shift(F.col("_other"))))
        found = found.filter(F.col("name").isNull() | F.col("dst").isNotNull())  # a name that is no submodule is no edge
        head = F.split("spec", r"\.")[0]
        builtin = head.isin(*sorted(sys.stdlib_module_names))
        package = F.when(~F.startswith("spec", F.lit(".")), normal_name(head))
        return self._finish(found, package, builtin & ~F.startswith(F.col("spec"), F.lit(".")))

    def _package_edges(self) -> DataFrame:
        """From each Python file to the package files of the directories above it, up to the first directory without one."""
        parts = F.split("rel_path", "/")
        up = F.posexplode(F.reverse(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.concat_ws("/", F.col("root"), F.slice(parts, 1, n))))).alias("steps", "dir")
        py = self.files.filter(F.col("file").rlike(r"\.pyi?$")).select("project", "file", up)
        inits = self.files.filter(F.endswith("file", F.lit("/__init__.py"))).select(dirname(F.col("file")).alias("dir"), F.col("file").alias("dst"))
        rows = py.join(inits, F.regexp_replace(py["dir"], "/$", "") == inits["dir"], "left").select("project", py["file"], "steps", "dst")
        gap = F.min(F.when(F.col("dst").isNull(), F.col("steps"))).over(rules.Window.partitionBy("file"))
        rows = rows.withColumn("gap", gap).filter("dst is not null and (gap is null or steps < gap) and dst <> file")
        return rows.select(F.col("file").alias("src"), "dst", F.lit("static").alias("kind"), F.lit("<package-init>").alias("spec"), F.lit(True).alias("resolvable"), "project", F.lit(None).cast("string").alias("package"), F.lit(0).alias("off"))

    @cached_property
    def entries(self) -> DataFrame:
        """Entry points: those of active plugins, and the configured ones, else the conventional names and what manifests name."""
        found = self._matching({p.name: p.entry_points for p in self.plugins}).select("project", "file")
        if self.config.entrypoints:
            globs = [path_glob(g) if is_glob(g) else path_glob(g.removeprefix("./")) for g in self.config.entrypoints]
            return found.union(self.files.filter(F.col("rel_path").rlike("|".join(globs))).select("project", "file")).distinct()
        usual = self.files.filter(F.col("rel_path").rlike("|".join(path_glob(g) for g in ENTRY_GLOBS))).select("project", "file")
        found = found.union(usual)
        return (found if self.facts is None else found.union(manifests.entry_files(self.facts, self.files))).distinct()

    # ------------------------------------------------------------ plugins

    @cached_property
    def active(self) -> DataFrame:
        """(project, plugin) of the plugins whose dependencies or files a project has. Definitions become one expression over what a project holds."""
        names, globs = set(), set()
        for p in self.plugins:
            a, b = p.needs()
            names, globs = names | a, globs | b
        held = lambda rows, atom: rows.groupBy("project").agg(F.collect_set(atom).alias("has"))
        by_name = held(self.deps.filter(F.col("name").isNotNull()).select("project", F.explode(_atoms(names)).alias("atom")), "atom")
        hit = F.explode(F.array_compact(F.array(*(F.when(F.col("rel_path").rlike(path_glob(g)), F.lit(f"file {g}")) for g in sorted(globs)), F.lit(None).cast("string")))).alias("atom")
        by_file = held(self.files.select("project", hit), "atom")
        both = by_name.union(by_file).groupBy("project").agg(F.flatten(F.collect_list("has")).alias("has"))
        on = F.array(*(F.when(p.condition(lambda atom: F.array_contains("has", atom)), F.lit(p.name)) for p in self.plugins), F.lit(None).cast("string"))
        return materialize(both.select("project", F.explode(F.array_compact(on)).alias("plugin")), "plugins")

    def _matching(self, globs: dict[str, list[str]]) -> DataFrame:
        """(project, file, plugin) of files that the patterns of an active plugin match."""
        globs = {name: g for name, g in globs.items() if g}
        if not globs:
            return self.files.select("project", "file", F.lit("").alias("plugin")).limit(0)
        hit = F.array_compact(F.array(*(F.when(F.col("rel_path").rlike("|".join(map(path_glob, g))), F.lit(name)) for name, g in sorted(globs.items()))))
        return self.files.select("project", "file", F.explode(hit).alias("plugin")).join(self.active, ["project", "plugin"])

    def _plugin_filtered(self, found: DataFrame) -> DataFrame:
        """Findings without what active plugins explain."""
        if not self.plugins:
            return found
        always = self._matching({p.name: p.always_used for p in self.plugins}).select("file").distinct().withColumn("_always", F.lit(True))
        found = found.join(always, "file", "left").filter(~((F.col("kind") == "unused-files") & F.coalesce("_always", F.lit(False)))).drop("_always")
        exports = None
        for p in self.plugins:
            for rule in p.used_exports:
                names = F.explode(F.array(*(F.lit(x) for x in rule.get("exports") or ()), F.lit(None).cast("string"))).alias("name")
                rows = self._matching({p.name: [rule["pattern"]]}).select("file", names).filter("name is not null")
                exports = rows if exports is None else exports.union(rows)
        if exports is not None:
            used = exports.distinct().withColumn("_used", F.lit(True))
            found = found.join(used, ["file", "name"], "left").filter(~((F.col("kind") == "unused-exports") & F.coalesce("_used", F.lit(False)))).drop("_used")
        per = {p.name: (p.tooling, p.used_members) for p in self.plugins}
        pairs = [(name, what, x) for name, lists in per.items() for what, xs in zip(("tool", "member"), lists) for x in xs]
        if pairs:
            table = self.spark.createDataFrame(pairs, "plugin string, what string, name string").join(self.active, "plugin").join(self.files.select("project").distinct(), "project")
            owner = self.files.select("project", "file").union(self.deps.select("project", F.col("dir").alias("file"))).distinct()
            known = owner.join(table, "project").select("file", "name", F.when(F.col("what") == "tool", F.lit("dep")).otherwise("member").alias("_what")).distinct()
            what = F.when(F.col("kind").isin("unused-deps", "unused-dev-deps", "unused-optional-deps"), "dep").when(F.col("kind") == "unused-class-members", "member")
            found = found.withColumn("_what", what).join(known.withColumn("_known", F.lit(True)), ["file", "name", "_what"], "left").filter("_known is null").drop("_known", "_what")
        return found.select("kind", "severity", "file", "off", "message", "name")

    # ------------------------------------------------------------ rules

    def _finding(self, rows: DataFrame, kind: str, message: Column, off: str | None = None, name: str | None = None, file: str = "file") -> DataFrame:
        return rows.select(F.lit(kind).alias("kind"), F.lit(self.config.rules.get(kind, "error")).alias("severity"), F.col(file).alias("file"), (F.col(off) if off else F.lit(None)).cast("int").alias("off"), F.concat(F.lit(f"{kind}: "), message).alias("message"), (F.col(name) if name else F.lit(None)).cast("string").alias("name"))

    def register(self, kind: str, rule: Callable[[Codebase], DataFrame]) -> None:
        """Add a rule of one's own: a function from the code base to (file, message), and off and name if it has them. It runs in the mode full, unless its severity is off."""
        if kind in RULES:
            raise ValueError(f"{kind} is a rule already")
        self.registered[kind] = rule

    def rule(self, kind: str) -> DataFrame:
        if kind in self.registered:
            rows = self.registered[kind](self)
            for column in ("off", "name"):
                if column not in rows.columns:
                    rows = rows.withColumn(column, F.lit(None).cast("string"))
            return self._finding(rows, kind, F.col("message"), "off", "name")
        c, decls, edges = self.config, self.decls, self.edges
        f = F.col
        if kind == "unused-files":
            return self._finding(rules.unused_files(self.files, edges, self.entries), kind, F.concat("file", F.lit(" is not reachable from any entry point")))
        if kind in ("unused-exports", "unused-types"):
            rows = (rules.unused_exports if kind == "unused-exports" else rules.unused_types)(decls, edges, self.entries)
            return self._finding(rows, kind, F.concat("name", F.lit(" in "), "file", F.lit(" has no consumers")), "start_off", "name")
        if kind in ("unused-deps", "unused-dev-deps", "unused-optional-deps"):
            if c.production and kind != "unused-deps":
                return self._finding(self.files.limit(0), kind, f("file"))
            declared = self.deps.filter(f("section") == kind.removeprefix("unused-")).select("project", "dir", "name")
            imported = edges.filter("dst is null and not resolvable and package is not null").select("project", f("package").alias("name")).distinct()
            return self._finding(rules.unused_deps(declared, imported), kind, F.concat(F.lit("package "), "name", F.lit(" declared but not imported")), None, "name", "dir")
        if kind in ("unused-enum-members", "unused-class-members"):
            what = kind.split("-")[1]
            rows = rules.unused_members(decls, self.table("usages"), edges, what)
            if what == "class":  # annotated fields, decorated and special methods are used by frameworks
                exempt = decls.select("file", f("name").alias("owner"), F.explode(F.array_union("decorated", "fields")).alias("member"))
                rows = rows.join(exempt, ["file", "owner", "member"], "left_anti").filter(~(f("file").rlike(r"\.pyi?$") & f("member").rlike("^__.*__$")))
            rows = rows.join(decls.filter(f("kind") == what).groupBy("file", f("name").alias("owner")).agg(F.min("start_off").alias("off")), ["file", "owner"])
            return self._finding(rows, kind, F.concat("owner", F.lit("."), "member", F.lit(" in "), "file", F.lit(" has no consumers")), "off", "member")
        if kind == "circular-dependencies":
            rows = rules.circular_dependencies(edges)
            return self._finding(rows, kind, F.concat(F.lit("cycle detected: "), F.array_join("cycle", " → ")), None, None, "scc")
        if kind == "boundary-violations":
            zones = [(z, n, zone_glob(g)) for n, (z, spec) in enumerate(c.zones.items()) for g in spec.get("pattern", [])]
            allow = [(z, t) for z, spec in c.zones.items() for t in spec.get("canImport", [])]
            zoned = rules.zone_of(self.files, self.spark.createDataFrame(zones, "zone string, ord int, regex string"), "rel_path")
            rows = rules.boundary_violations(edges, zoned, self.spark.createDataFrame(allow, "from_zone string, to_zone string"))
            return self._finding(rows, kind, F.concat("from_zone", F.lit(" may not import "), "to_zone"), None, None, "src")
        if kind in ("unresolved-imports", "unlisted-dependencies"):
            rows = rules.import_hygiene(edges, self.deps).filter(f("rule") == kind).distinct()
            text = F.concat(F.lit("cannot resolve "), "spec", F.lit(" from "), "src") if kind == "unresolved-imports" else F.concat("spec", F.lit(" is not declared in a manifest"))
            return self._finding(rows, kind, text, None, "spec", "src")
        if kind == "duplicate-exports":
            rows = rules.duplicate_exports(decls).withColumn("off", f("occurrences")[0])
            return self._finding(rows, kind, F.concat("name", F.lit(" declared "), F.size("occurrences"), F.lit(" times in "), "file"), "off", "name")
        if kind == "private-type-leak":
            rows = rules.private_type_leak(decls.filter("lang = 'ts'"), self.table("usages"))
            return self._finding(rows, kind, F.concat("name", F.lit(" leaks into public signature of "), "symbol", F.lit(" in "), "file"), None, "name")
        if kind in HEALTH:
            metric, threshold = ("cyclomatic", c.cyclomatic_threshold) if kind == "complexity-hotspot" else ("cognitive", c.cognitive_threshold)
            rows = rules.over_threshold(self.table("functions"), metric, threshold)
            return self._finding(rows, kind, F.concat("name", F.lit(f" has {metric} complexity "), metric, F.lit(f" (threshold {threshold})")), "start_off", "name")
        if kind == "code-duplication":
            found = self.clone_families()
            return self._finding(found, kind, F.concat(F.lit("type-"), "type", F.lit(" clone of "), "length", F.lit(" tokens in "), "members", F.lit(" places")), None, None)
        raise ValueError(kind)

    def clone_families(self) -> DataFrame:
        """Families of all clone types, merged."""
        toks = self.sources.filter("content is not null").select("file", clones.tokens(F.col("content"), F.col("file").rlike(r"\.pyi?$")).alias("toks"))
        return clones.find_clones(toks, self.config.min_tokens, CLONE_KEYWORDS)

    def enabled(self, mode: str) -> list[str]:
        return sorted(r for r in [*RULES, *self.registered] if (r in MODES[mode] or mode == "full") and self.config.rules.get(r, "error") != "off" and (r != "boundary-violations" or self.config.zones))

    def findings(self, mode: str = "full", always_used: Column | None = None, kinds: list[str] | None = None) -> DataFrame:
        """All findings of a mode (only those of some rules, with ``kinds``), without what other findings explain. Only rules that are on are ever built."""
        out = None
        for kind in [k for k in self.enabled(mode) if kinds is None or k in kinds]:
            rows = self.rule(kind)
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            return self._finding(self.files.limit(0), "none", F.col("file"))
        return rules.cross_reference(self._plugin_filtered(out), always_used)

    def counts(self, findings: DataFrame, mode: str = "full") -> DataFrame:
        return rules.counts_by_rule(findings, self.enabled(mode))

    # ------------------------------------------------------------ health and traces

    def health(self) -> DataFrame:
        m = file_metrics(self.inventory)
        return m.withColumn("score", scores.health(F.col("cyclomatic"), F.col("cognitive"), F.col("mi")))

    def project_scores(self) -> DataFrame:
        return self.health().groupBy("project").agg(F.coalesce(F.round(F.avg("score")), F.lit(100)).cast("int").alias("score"))

    def refactor_targets(self, k: int = 10) -> DataFrame:
        return self.health().orderBy("score", "file").limit(k)

    def trace(self, file: str) -> DataFrame:
        """(file) of everything that imports a file, directly or not."""
        return rules.importers(self.edges, self.spark.createDataFrame([(file,)], "file string"))

    def trace_export(self, name: str) -> DataFrame:
        """(file) of the importers of files that use a name, over importers that use it too."""
        return reexports.trace_export(self.edges, self.table("usages"), name)

    def package_roots(self) -> DataFrame:
        """(file, root) of every Python file: the directory from which it is imported, above the regular packages around it."""
        parts = F.split("rel_path", "/")
        up = F.posexplode(F.reverse(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.concat_ws("/", F.col("root"), F.slice(parts, 1, n))))).alias("steps", "dir")
        plain = F.regexp_replace("dir", "/$", "")
        py = self.files.filter(F.col("file").rlike(r"\.pyi?$")).select("file", up).select("file", "steps", plain.alias("dir"))
        inits = self.files.filter(F.endswith("file", F.lit("/__init__.py"))).select(dirname(F.col("file")).alias("dir"), F.lit(True).alias("regular")).distinct()
        rows = py.join(inits, "dir", "left")
        top = rows.groupBy("file").agg(F.min(F.when(F.col("regular").isNull(), F.struct("steps", "dir")))["dir"].alias("root"), F.max_by("dir", "steps").alias("last"))
        return top.select("file", F.coalesce("root", "last").alias("root"))

    def audit(self) -> dict[str, int]:
        return {"files": self.files.count(), "edges": self.edges.count()}
