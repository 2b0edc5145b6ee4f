import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tessel.extract import extract
from tessel.extract.suppress import apply_suppressions, suppressions
from tessel.operators import offsets, reexports
from tessel.sources import packages


def names(found, what, key="name"):
    return [x[key] for x in found[what]]


def test_component_files():
    vue = extract("a.vue", "<template>\n <my-card :items=\"rows\" @go=\"open(x)\">{{ title.text }}</my-card><Other/>\n</template>\n<script setup>\nimport MyCard from './card'\nrun(1)\n</script>\n<style>.x { }</style>")
    assert names(vue, "imports", "source") == ["./card"] and vue["imports"][0]["line"] == 5
    assert {"MyCard", "Other", "rows", "open", "x", "title", "run"} <= set(names(vue, "usages"))
    svelte = extract("a.svelte", "<script>import C from './c'</script>\n{#if shown}<C on:go={act}/>{/if}\n<p>{label}</p>")
    assert names(svelte, "imports", "source") == ["./c"] and {"shown", "C", "label"} <= set(names(svelte, "usages"))
    astro = extract("a.astro", "---\nimport L from '../l.astro'\nconst t = 1\n---\n<L title={t}>{name}</L>")
    assert names(astro, "imports", "source") == ["../l.astro"] and names(astro, "decls") == ["t"] and {"L", "name"} <= set(names(astro, "usages"))
    mdx = extract("a.mdx", "import { Box } from './box'\n\n# T\n\n<Box>{value}</Box>\n\n```js\nimport x from 'no'\n```\n")
    assert names(mdx, "imports", "source") == ["./box"] and {"Box", "value"} <= set(names(mdx, "usages"))
    css = extract("a.css", "@import './base.css';\n/* .no {} */ .card, .card:hover .row { composes: wide from './grid.css'; content: '.fake'; }\n")
    assert names(css, "decls") == ["card", "row"] and names(css, "imports", "source") == ["./base.css", "./grid.css"] and names(css, "usages") == ["wide"]
    for ext in ("vue", "svelte", "astro", "mdx", "css"):
        for text in ("", "<", "---", "{{", "<script>", "@import", "```"):
            extract(f"a.{ext}", text)


def test_suppressions(spark):
    text = "// tessel-ignore-file unused-types\n// tessel-ignore-next-line unused-exprts, complexity-hotspot\nx\n# tessel-ignore-next-line\ny\n"
    df = spark.createDataFrame([("a.ts", text), ("b.ts", None)], "file string, content string")
    marks = suppressions(df, ["unused-exports", "unused-types", "complexity-hotspot"])
    assert sorted(((r.line, r.scope, r.rule, r.hint) for r in marks.collect()), key=str) == [(1, "file", "unused-types", None), (2, "next-line", "complexity-hotspot", None), (2, "next-line", "unused-exprts", "unused-exports"), (4, "next-line", None, None)]
    found = spark.createDataFrame([("a.ts", 3, "complexity-hotspot"), ("a.ts", 3, "unused-exports"), ("a.ts", 5, "unused-exports"), ("a.ts", 9, "unused-types"), ("b.ts", 3, "complexity-hotspot")], "file string, line int, kind string")
    assert sorted(tuple(r) for r in apply_suppressions(found, marks).collect()) == [("a.ts", 3, "unused-exports"), ("b.ts", 3, "complexity-hotspot")]


def test_line_map_and_istanbul(spark):
    text = "﻿ab\r\ncd\rß\nx"
    lines = offsets.LineMap(text)
    assert [lines.at(n) for n in (0, 1, 2, 5, 8, 10)] == [(1, 0), (1, 0), (1, 1), (2, 0), (3, 0), (4, 0)] and lines.at(99) == (4, 1)
    fns = [{"functionName": "", "isBlockCoverage": True, "ranges": [{"startOffset": 0, "endOffset": 11, "count": 2}, {"startOffset": 5, "endOffset": 7, "count": 0}]}, {"functionName": "g", "isBlockCoverage": False, "ranges": [{"startOffset": 8, "endOffset": 9, "count": 1}]}, {"functionName": "h", "ranges": []}]
    got = offsets.istanbul(fns, text)
    assert got["f"] == {"0": 2, "1": 1, "2": 0} and got["s"] == {"0": 0, "1": 1} and got["b"] == {"0": [0]} and got["fnMap"]["0"]["name"] == "(anonymous)"
    df = spark.createDataFrame([("a.ts", text, json.dumps(fns))], "file string, content string, functions string")
    assert json.loads(offsets.istanbul_table(df).collect()[0].report) == got


def test_edits(spark):
    text = "größe = 1\nb = 2\n"
    assert offsets.splice(text, [(0, 7, "size"), (12, 13, "c")]) == "size = 1\nc = 2\n"
    assert offsets.splice(text, [(0, 7, "x"), (3, 9, "y")]) is None and offsets.splice(text, [(0, 999, "")]) is None
    sources = spark.createDataFrame([("a", text), ("b", text), ("c", text), ("d", None)], "file string, content string")
    good = hashlib.sha256(text.encode()).hexdigest()
    edits = spark.createDataFrame([("a", 0, 7, "x", good), ("b", 0, 1, "x", "0"), ("c", 0, 99, "x", None), ("d", 0, 0, "x", None)], "file string, start int, end int, new_text string, hash string")
    got = {r.file: (r.status, r.content) for r in offsets.apply_edits(sources, edits).collect()}
    assert got == {"a": ("applied", "x = 1\nb = 2\n"), "b": ("drifted", text), "c": ("rejected", text)}


def test_reexports(spark):
    links = spark.createDataFrame([("index", "a"), ("index", "b"), ("a", "c"), ("c", "a"), ("b", "b")], "src string, dst string")
    decls = spark.createDataFrame([("c", "deep", True), ("b", "flat", True), ("b", "own", False)], "file string, name string, exported boolean")
    exported = reexports.exported_names(decls, links)
    assert {tuple(r) for r in exported.collect()} == {("c", "deep"), ("a", "deep"), ("index", "deep"), ("b", "flat"), ("index", "flat")}
    assert {tuple(r) for r in reexports.provenance(exported, decls, links).collect()} == {("a", "deep", "c"), ("index", "deep", "a"), ("index", "flat", "b")}
    assert {tuple(r) for r in reexports.reexport_cycles(links).collect()} == {("a", "a"), ("c", "a"), ("b", "b")}
    entries = spark.createDataFrame([("index",)], "file string")
    assert {tuple(r) for r in reexports.entry_targets(links, entries).collect()} == {("a", True), ("b", True), ("c", False)}
    stars = spark.createDataFrame([("index", 3, None), ("index", 4, "ns")], "src string, dst_id int, alias string")
    assert {r.symbol for r in reexports.star_symbols(stars).collect()} == {"__star_3__", "__star_4_as_ns__"}
    edges = spark.createDataFrame([("x", "y", True), ("y", "z", True), ("w", "x", True), ("z", None, False)], "src string, dst string, resolvable boolean")
    uses = spark.createDataFrame([("z", "n"), ("y", "n"), ("w", "n")], "file string, name string")
    assert [r.file for r in reexports.trace_export(edges, uses, "n").collect()] == ["y"]


def test_package_metadata(tmp_path):
    exports = {".": {"import": "./m.mjs", "default": "./m.js"}, "./f/*": "./src/f/*.js", "./f/x/*": ["bad", "./x/*.js"], "./no": None}
    assert packages.exports_target(exports) == "./m.mjs" and packages.exports_target(exports, "./f/a") == "./src/f/a.js" and packages.exports_target(exports, "./f/x/b") == "./x/b.js"
    assert packages.exports_target(exports, "./no") is None and packages.exports_target("./a.js") == "./a.js"
    assert packages.package_entries({"main": "./a.js", "bin": {"x": "bin/x.js"}, "exports": exports}) == ["a.js", "bin/x.js", "m.js", "m.mjs", "src/f/*.js", "x/*.js"]
    (tmp_path / "tsconfig.json").write_text('{ // c\n "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"], "@/lib/*": ["lib/*", "x/*"], "exact": ["e.ts"],}}}')
    a = packages.PathAliases.read(tmp_path / "tsconfig.json")
    assert a.candidates("@/lib/q") == [f"{tmp_path}/lib/q", f"{tmp_path}/x/q"] and a.candidates("exact") == [f"{tmp_path}/e.ts"] and a.candidates("no") == []
    assert packages.ancestors("/a/b/c.ts") == ["/a/b", "/a", "/"]
    (tmp_path / "package.json").write_text('{"workspaces": ["packages/*", "!packages/old"]}')
    for n in ("one", "old"):
        (tmp_path / "packages" / n).mkdir(parents=True)
        (tmp_path / "packages" / n / "package.json").write_text("{}")
    assert packages.workspaces(tmp_path) == ["packages/one"]
    (tmp_path / "pnpm-workspace.yaml").write_text("packages:\n  - 'packages/*'\nother: 1\n")
    assert packages.workspaces(tmp_path) == ["packages/old", "packages/one"]


def test_plugins(tmp_path):
    (tmp_path / "a.json").write_text('{"name": "a", "enablers": ["@x/"], "alwaysUsed": ["**/*.stories.ts"]}')
    (tmp_path / "b.json").write_text('{"name": "b", "detection": {"type": "all", "conditions": [{"type": "dependency", "package": "Py_Lib"}, {"type": "fileExists", "pattern": "**/*.py"}]}}')
    (tmp_path / "bad.json").write_text("[")
    a, b = packages.load_plugins(sorted(tmp_path.iterdir()))
    assert a.active({"@x/y"}, set(), []) and not a.active({"x"}, set(), [])
    assert b.active(set(), {"py-lib"}, ["src/a.py"]) and not b.active(set(), {"py-lib"}, ["a.ts"])
    with pytest.raises(ValueError):
        packages.Plugin.of({"enablers": []})


def test_files_of_many_functions_keep_all(spark):
    from tessel.extract import exploded, file_metrics, inventory

    text = "".join(f"def f{n}(a):\n    return a\n" for n in range(1500))
    rows = inventory(spark.createDataFrame([("p", "/w/p/a.py", text)], "project string, file string, content string"))
    assert exploded(rows, "functions").count() == 1500
    assert file_metrics(rows).collect()[0].cyclomatic == 1500
