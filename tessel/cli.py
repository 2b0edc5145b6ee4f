"""Command line: python -m tessel.cli COMMAND ROOT [options]. Exit 0: nothing above the limit, 1: findings, 2: a wrong call."""

from __future__ import annotations

import argparse
import difflib
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessel.engine import RULES, Codebase
from tessel.sources import config, sinks
from tessel.sources.packages import load_plugins
from tessel.sources.tree import manifest_files, read_tree

MODES = {"analyze": "full", "dead-code": "dead-code-only", "dupes": "dupes-only", "health": "health-only", "audit": "audit", "trace": "audit"}
SINGLE = {
    "unused-files": ["unused-files"], "unused-exports": ["unused-exports"], "unused-types": ["unused-types"], "unused-deps": ["unused-deps", "unused-dev-deps", "unused-optional-deps"], "circular-deps": ["circular-dependencies"],
    "boundaries": ["boundary-violations"],
}
PRINTED = ("explain", "schema", "init")
COMMANDS = [*MODES, *SINGLE, *PRINTED]
EXPLAIN = {
    "boundary-violations": "A file of one zone imports a file of a zone its own may not import.", "circular-dependencies": "Files import each other in a circle; the walk shown goes to the least file not seen yet.",
    "code-duplication": "The same run of tokens stands in several places, as it is, up to renaming, or up to structure.", "cognitive-complexity": "A function is hard to follow: nesting, breaks of flow and mixed conditions add up.",
    "complexity-hotspot": "There are too many ways through a function.", "duplicate-exports": "A file exports one name more than once.", "private-type-leak": "An exported declaration shows a type the file does not export.",
    "unlisted-dependencies": "An imported package is in no manifest of the project.", "unresolved-imports": "An import leads to no file and names no package.", "unused-class-members": "Neither its own file nor an importer uses a member of an exported class.",
    "unused-deps": "A package in the manifest is imported nowhere.", "unused-dev-deps": "A development package in the manifest is imported nowhere.", "unused-enum-members": "Neither its own file nor an importer uses a member of an exported enum.",
    "unused-exports": "A file exports a value, but nothing imports the file and it is no entry.", "unused-files": "No entry point reaches the file.", "unused-optional-deps": "An optional package in the manifest is imported nowhere.", "unused-types": "A file exports a type, but nothing imports the file and it is no entry.",
}


def schema() -> dict:
    """The JSON schema of a configuration."""
    text, number = {"type": "string"}, {"type": "integer", "minimum": 1}
    texts = {"type": "array", "items": text}
    zone = {"type": "object", "properties": {"pattern": texts, "canImport": texts}, "required": ["pattern"]}
    return {
        "$schema": "https://json-schema.org/draft/2020-12/schema", "type": "object",
        "properties": {
            "extends": {"oneOf": [text, texts]}, "rules": {"type": "object", "propertyNames": {"enum": RULES}, "additionalProperties": {"enum": ["error", "warn", "off"]}}, "exclude": texts, "entrypoints": texts,
            "production": {"type": "boolean"}, "zones": {"type": "object", "additionalProperties": zone}, "health": {"type": "object", "properties": {"cyclomaticThreshold": number, "cognitiveThreshold": number}}, "dupes": {"type": "object", "properties": {"minTokens": number}},
        },
    }


def _printed(args: argparse.Namespace) -> int:
    """The commands that need no analysis; the argument of ``explain`` is a rule."""
    if args.command == "schema":
        print(json.dumps(schema(), indent=2))
    elif args.command == "explain":
        if args.root not in EXPLAIN:
            near = difflib.get_close_matches(args.root, EXPLAIN, 1)
            print(f"no such rule: {args.root}" + (f", did you mean {near[0]}?" if near else ""), file=sys.stderr)
            return 2
        print(f"{args.root}: {EXPLAIN[args.root]}")
    else:
        path = Path(args.root, "tessel.json")
        if not Path(args.root).is_dir() or path.exists():
            print(f"{path} exists already or its directory does not", file=sys.stderr)
            return 2
        path.write_text(json.dumps({"rules": {r: "error" for r in RULES}, "exclude": [], "entrypoints": []}, indent=2) + "\n", encoding="utf-8")
        print(path)
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessel", description=__doc__)
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("root", nargs="?", default=".", help="the directory; for explain a rule")
    p.add_argument("--config")
    p.add_argument("--plugins", help="a folder of plugin definitions in JSON")
    p.add_argument("--format", default="human", choices=["human", "markdown", *sinks.FORMATS])
    p.add_argument("--file", help="trace: the file whose importers are wanted")
    p.add_argument("--export", help="trace: the name whose users are wanted")
    p.add_argument("--ci", action="store_true", help="any finding fails, not errors alone")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command in PRINTED:
        return _printed(args)
    root = str(Path(args.root).resolve())
    if not Path(root).is_dir() or args.command == "trace" and not args.file and not args.export:
        print("a directory is needed, and for trace a --file or an --export", file=sys.stderr)
        return 2
    settings = config.Config.of(config.load(args.config) if args.config else {})
    spark = spark or SparkSession.builder.appName("tessel").getOrCreate()
    base = Codebase(read_tree(spark, {Path(root).name: root}, settings.exclude), None, settings, manifest_files(spark, {Path(root).name: root}), load_plugins(sorted(Path(args.plugins).glob("*.json"))) if args.plugins else [])
    if args.command == "audit":
        print(base.audit())
        return 0
    if args.command == "trace" and args.export:
        for r in base.trace_export(args.export).orderBy("file").collect():
            print(r.file)
        return 0
    if args.command == "trace":
        target = str(Path(root, args.file))
        if base.files.filter(F.col("file") == target).isEmpty():
            print(f"no such file: {args.file}", file=sys.stderr)
            return 2
        for r in base.trace(target).orderBy("file").collect():
            print(r.file)
        return 0
    found = base.findings(MODES.get(args.command, "full"), kinds=SINGLE.get(args.command))
    place = base.sources.select("file", "content")
    line = F.when(F.col("off").isNotNull(), F.size(F.split(F.substr(F.col("content"), F.lit(1), F.col("off")), "\n")))
    col = F.when(F.col("off").isNotNull(), F.length(F.substring_index(F.substr(F.col("content"), F.lit(1), F.col("off")), "\n", -1)))
    rows = found.join(place, "file", "left").select("kind", "severity", "file", "message", line.cast("int").alias("line"), col.cast("int").alias("col")).persist()
    print(sinks.human(rows) if args.format == "human" else sinks.markdown(rows) if args.format == "markdown" else sinks.render(rows, args.format))
    bad = rows if args.ci else rows.filter("severity = 'error'")
    return 0 if bad.isEmpty() else 1


if __name__ == "__main__":
    sys.exit(main())
