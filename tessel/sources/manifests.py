"""Manifest files as relations: dependencies, entry targets, path aliases and packages, read where the text is.

manifests(project, root, dir, name, content) holds one row per manifest file; its text is parsed once, in tasks, into facts. Defined results: a
manifest that is null or malformed gives no fact; repeated rows give equal facts once."""

from __future__ import annotations

import configparser
import json
import posixpath
import re
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.operators.resolve import package_of, script_candidates, source_candidates
from tessel.sources.config import parse_jsonc
from tessel.sources.packages import exports_target, package_entries
from tessel.sources.tree import package_json, pyproject, requirements, setup_cfg, setup_py

FACTS = "project string, root string, dir string, kind string, name string, value string, list array<string>"
ROW = "project string, dir string, ecosystem string, section string, name string"


def _python_scripts(data: dict) -> list[str]:
    """Module paths of the scripts a pyproject declares."""
    project, poetry = data.get("project", {}), data.get("tool", {}).get("poetry", {})
    groups = [project.get("scripts"), project.get("gui-scripts"), poetry.get("scripts"), *(project.get("entry-points") or {}).values()]
    targets = [t for g in groups if isinstance(g, dict) for t in g.values() if isinstance(t, str)]
    return sorted({t.split(":")[0].split("[")[0].strip().replace(".", "/") for t in targets if t.strip()})


def _setup_scripts(text: str) -> list[str]:
    parser = configparser.ConfigParser()
    try:
        parser.read_string(text)
    except configparser.Error:
        return []
    lines = parser.get("options.entry_points", "console_scripts", fallback="").splitlines()
    return sorted({m[1].strip().replace(".", "/") for line in lines if (m := re.search(r"=\s*([\w.]+)", line))})


def facts_of(directory: str, name: str, text: str | None) -> list[tuple[str, str | None, str | None, list[str] | None]]:
    """(kind, name, value, list) facts of one manifest: ``dep`` (package, ecosystem/section), ``entry`` (null, path), ``script`` (null, module path), ``package`` (name, JSON of exports and main) and ``alias`` (pattern, null, targets)."""
    if text is None:
        return []
    text = text.removeprefix("﻿")
    out: list[tuple[str, str | None, str | None, list[str] | None]] = []
    deps: list[tuple[str, str, str]] = []
    if name == "package.json":
        deps = package_json(text)
        try:
            data = json.loads(text)
        except ValueError:
            return []
        if not isinstance(data, dict):
            return []
        out += [("entry", None, t, None) for t in package_entries(data)]
        if isinstance(data.get("name"), str):
            main = next((data[k] for k in ("source", "module", "main") if isinstance(data.get(k), str)), None)
            out.append(("package", data["name"], json.dumps({"exports": data.get("exports"), "main": main}), None))
    elif name == "pyproject.toml":
        deps = pyproject(text)
        try:
            out += [("script", None, t, None) for t in _python_scripts(tomllib.loads(text))]
        except tomllib.TOMLDecodeError:
            return []
    elif name == "setup.cfg":
        deps = setup_cfg(text)
        out += [("script", None, t, None) for t in _setup_scripts(text)]
    elif name == "setup.py":
        deps = setup_py(text)
    elif re.fullmatch(r"requirements[\w.-]*\.txt", name):
        deps = requirements(name, text)
    elif re.fullmatch(r"[tj]sconfig(\.[\w-]+)?\.json", name):
        try:
            options = parse_jsonc(text).get("compilerOptions") or {}
        except (ValueError, AttributeError):
            return []
        base = posixpath.normpath(posixpath.join(directory, options.get("baseUrl") or "."))
        for pattern, targets in (options.get("paths") or {}).items():
            if isinstance(targets, list) and pattern.count("*") <= 1:
                out.append(("alias", pattern, None, [posixpath.normpath(posixpath.join(base, t)) for t in targets if isinstance(t, str)]))
        if options.get("baseUrl"):
            out.append(("alias", "*", None, [base + "/*"]))
    return [("dep", n, f"{e}/{s}", None) for e, s, n in deps] + out


def facts(manifests: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, r, d, *f) for p, r, d, n, c in zip(*(batch[k] for k in ("project", "root", "dir", "name", "content"))) for f in facts_of(d, n, c)]
            yield pd.DataFrame(rows, columns=["project", "root", "dir", "kind", "name", "value", "list"])

    return manifests.select("project", "root", "dir", "name", "content").mapInPandas(run, FACTS).distinct()


def dependencies(found: DataFrame) -> DataFrame:
    """(project, dir, ecosystem, section, name)."""
    part = F.split("value", "/")
    return found.filter("kind = 'dep'").select("project", "dir", part[0].alias("ecosystem"), part[1].alias("section"), "name")


def _ranked(bases: Column, candidates) -> Column:
    """Candidates of every base, those of an earlier base before those of a later one."""
    return F.flatten(F.transform(bases, lambda b, i: F.transform(candidates(b), lambda c: F.struct((c["rank"] + i * 1000).cast("int").alias("rank"), c["path"].alias("path")))))


def _source_first(base: Column) -> Column:
    late = F.transform(script_candidates(base), lambda c: F.struct((c["rank"] + 500).alias("rank"), c["path"].alias("path")))
    return F.concat(source_candidates(base), late)


def entry_files(found: DataFrame, files: DataFrame) -> DataFrame:
    """(project, file) of the files that manifests name as their own; a built file means what it was built from."""
    scripts = found.filter("kind = 'entry'").select("project", F.concat("dir", F.lit("/"), F.regexp_replace("value", r"^(\./)+", "")).alias("base"))
    python = found.filter("kind = 'script'").select("project", F.explode(F.array(F.concat("dir", F.lit("/"), "value"), F.concat("dir", F.lit("/src/"), "value"))).alias("base"))
    ends = F.explode(F.array(*(F.concat("base", F.lit(x)) for x in (".py", "/__init__.py")))).alias("file")
    named = scripts.select("project", F.explode(F.transform(_source_first(F.col("base")), lambda c: c["path"])).alias("file")).union(python.select("project", ends))
    return named.distinct().join(files.select("project", "file"), ["project", "file"])


def alias_bases(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(src, spec, bases): what the path aliases nearest to a file make of a specifier; of several patterns the exact one, else the one with the longest literal part holds."""
    aliases = found.filter("kind = 'alias'").select("dir", F.col("name").alias("pattern"), F.col("list").alias("targets"))
    parts = F.split("src", "/")
    up = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("dir")
    asked = rows.select("src", "spec").distinct()
    near = asked.select("src").distinct().select("src", up).join(aliases.select("dir").distinct(), "dir").groupBy("src").agg(F.max_by("dir", F.length("dir")).alias("dir"))
    head, tail = F.substring_index("pattern", "*", 1), F.when(F.contains("pattern", F.lit("*")), F.substring_index("pattern", "*", -1))
    met = asked.join(near, "src").join(aliases, "dir").withColumn("head", head).withColumn("tail", tail)
    fits = F.when(F.col("tail").isNull(), F.col("spec") == F.col("pattern")).otherwise(F.startswith("spec", F.col("head")) & F.endswith("spec", F.col("tail")) & (F.length("spec") >= F.length("head") + F.length("tail")))
    star = F.when(F.col("tail").isNotNull(), F.substr("spec", F.length("head") + 1, F.length("spec") - F.length("head") - F.length("tail"))).otherwise("")
    best = met.filter(fits).withColumn("bases", F.transform("targets", lambda t: F.replace(t, F.lit("*"), star)))
    rank = F.struct(F.col("tail").isNull().cast("int"), F.length("pattern"), "pattern")
    return best.groupBy("src", "spec").agg(F.max_by("bases", rank).alias("bases"))


def package_bases(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(src, spec, bases): where a bare specifier leads in a package of the same project, by its exports, else its main file or the path below it."""
    packages = found.filter("kind = 'package' and not contains(dir, '/node_modules/')").select("project", "dir", F.col("name").alias("_package"), F.col("value").alias("meta"))
    asked = rows.select("project", "src", "spec", package_of(F.col("spec")).alias("_package")).distinct().join(packages, ["project", "_package"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bases = []
            for spec, package, directory, meta in zip(batch["spec"], batch["_package"], batch["dir"], batch["meta"]):
                data, sub = json.loads(meta), "." + spec[len(package) :]
                if data["exports"] is not None:
                    target = exports_target(data["exports"], sub)
                    found_ = [target] if target else []
                elif sub == ".":
                    found_ = ([data["main"]] if data["main"] else []) + ["src/index", "index"]
                else:
                    found_ = [sub]
                bases.append([posixpath.normpath(posixpath.join(directory, t)) for t in found_])
            yield pd.DataFrame({"src": batch["src"], "spec": batch["spec"], "bases": bases})

    return asked.select("src", "spec", "_package", "dir", "meta").mapInPandas(run, "src string, spec string, bases array<string>")


def base_candidates(bases: Column) -> Column:
    return _ranked(bases, _source_first)
