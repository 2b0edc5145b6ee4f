import json

from pyspark.sql import functions as F

from tessel.engine import Codebase
from tessel.extract import extract
from tessel.functions.globs import path_glob, zone_glob
from tessel.sources import config, sinks, tree
from tessel.sources.config import Config

import re

import pytest

FILES = {
    "src/index.ts": "import { a } from './a.js'\nimport type { T } from '@/types'\nimport fs from 'node:fs'\nimport left from 'left-pad'\nimport { x } from 'unlisted/deep'\nmain(a)\n",
    "src/a.ts": "import { b } from './b'\nexport const a = 1\nexport enum Kind { On, Off }\nstart(Kind.On)\n",
    "src/b.ts": "import { a } from './a'\nexport function b(p) { if (p && q) { return 1 } else { for (const x of y) { go(x) } } }\n",
    "src/orphan.ts": "export const lost = 1\nexport type Gone = string\n",
    "types.ts": "export type T = string\n",
    "src/lazy.tsx": "import { c } from './missing'\nconst m = import('./page')\n",
    "src/page.tsx": "export const page = 1\nexport const page2 = 2\nexport function page2x() {}\nexport function dup() {}\nexport function dup() {}\n",
    "pkg/__init__.py": "",
    "pkg/one.py": "import os\nimport numpy\nfrom . import two\nfrom .three import K\nclass Own:\n    n: int = 1\n    def used(self): return self.used()\n    def idle(self): pass\n    def __repr__(self): return ''\n",
    "pkg/two.py": "x = (\n",
    "pkg/three.py": "class K:\n    pass\n",
    "main.py": "import pkg.one\n",
}


@pytest.fixture(scope="module")
def base(spark):
    files = tree.from_memory(spark, "p", "/w/p", FILES)
    deps = spark.createDataFrame([("p", "/w/p", "npm", "deps", "left-pad"), ("p", "/w/p", "npm", "deps", "never"), ("p", "/w/p", "npm", "dev-deps", "@types/x"), ("p", "/w/p", "pypi", "deps", "numpy")], "project string, dir string, ecosystem string, section string, name string")
    zones = {"web": {"pattern": ["src/**"], "canImport": []}, "root": {"pattern": ["*.ts"]}}
    return Codebase(files, deps, Config(zones=zones, cyclomatic_threshold=3, cognitive_threshold=3, min_tokens=12))


def names(base, kind):
    return sorted((r.file.removeprefix("/w/p/"), r["name"]) for r in base.rule(kind).collect())


def test_edges(base):
    got = {(r.src.removeprefix("/w/p/"), (r.dst or "").removeprefix("/w/p/"), r.kind, r.resolvable) for r in base.edges.collect()}
    assert {("src/index.ts", "src/a.ts", "static", True), ("src/index.ts", "types.ts", "type", True), ("src/index.ts", "", "static", True), ("src/a.ts", "src/b.ts", "static", True), ("src/lazy.tsx", "src/page.tsx", "dynamic", True), ("pkg/one.py", "pkg/two.py", "static", True), ("pkg/one.py", "pkg/three.py", "static", True), ("pkg/one.py", "pkg/__init__.py", "static", True), ("main.py", "pkg/one.py", "static", True)} <= got


def test_rules(base):
    assert names(base, "unused-files") == [("src/orphan.ts", None)]
    assert ("src/orphan.ts", "lost") in names(base, "unused-exports") and ("src/a.ts", "a") not in names(base, "unused-exports")
    assert names(base, "unused-types") == [("src/orphan.ts", "Gone")]
    assert [n for _, n in names(base, "unused-deps")] == ["never"] and names(base, "unused-dev-deps") == []
    assert names(base, "unlisted-dependencies") == [("src/index.ts", "unlisted/deep")]
    # a declared package that is not installed is unresolved, one that is not declared is unlisted
    assert names(base, "unresolved-imports") == [("pkg/one.py", "numpy"), ("src/index.ts", "left-pad"), ("src/lazy.tsx", "./missing")]
    assert names(base, "duplicate-exports") == [("src/page.tsx", "dup")]
    assert names(base, "unused-enum-members") == [("src/a.ts", "Off"), ("src/a.ts", "On")]
    assert names(base, "unused-class-members") == [("pkg/one.py", "idle")]
    assert [n for _, n in names(base, "complexity-hotspot")] == ["b"] and [n for _, n in names(base, "cognitive-complexity")] == ["b"]
    (cycle,) = base.rule("circular-dependencies").collect()
    assert cycle.message == "circular-dependencies: cycle detected: /w/p/src/a.ts → /w/p/src/b.ts → /w/p/src/a.ts"
    assert [(r.file, r.message) for r in base.rule("boundary-violations").collect()] == [("/w/p/src/index.ts", "boundary-violations: web may not import root")]


def test_findings_counts_and_reports(base):
    found = base.findings("dead-code-only")
    kinds = {(r.kind, r.file) for r in found.collect()}
    assert ("unused-files", "/w/p/src/orphan.ts") in kinds and ("unused-exports", "/w/p/src/orphan.ts") not in kinds
    counts = dict(base.counts(found, "dead-code-only").collect())
    assert counts["unused-files"] == 1 and counts["unused-dev-deps"] == 0 and set(counts) == set(base.enabled("dead-code-only"))
    rows = found.withColumn("line", F.lit(1)).withColumn("col", F.lit(0))
    assert len(json.loads(sinks.render(rows, "json"))["issues"]) == len(kinds) + found.count() - len(kinds)
    assert json.loads(sinks.render(rows, "sarif"))["version"] == "2.1.0" and json.loads(sinks.render(rows, "codeclimate"))[0]["type"] == "issue"


def test_health_and_trace(base):
    scores = {r.file.removeprefix("/w/p/"): r.score for r in base.health().collect()}
    assert scores["types.ts"] == 100 and scores["src/b.ts"] < 100
    assert base.project_scores().collect()[0].score > 50 and base.refactor_targets(2).count() == 2
    assert sorted(r.file.removeprefix("/w/p/") for r in base.trace("/w/p/src/b.ts").collect()) == ["src/a.ts", "src/b.ts", "src/index.ts"]
    assert base.audit()["files"] == len(FILES)


def test_clone_families_match_brute_force(spark):
    import random

    from tessel.operators import clones

    rng = random.Random(5)
    for case in range(3):
        docs = {f"d{n}": [rng.choice("ab") for _ in range(rng.randrange(0, 24))] for n in range(4)}
        df = spark.createDataFrame(list(docs.items()), "file string, toks array<string>")
        m = 3
        got = {(r.file, r.pos, r.members, r.length) for r in clones.families(clones.grams(df, m), m).collect()}
        groups = {}
        for f, t in docs.items():
            for p in range(len(t) - m + 1):
                groups.setdefault(tuple(t[p : p + m]), []).append((f, p))
        shared = {k: sorted(v) for k, v in groups.items() if len(v) > 1}
        nexts = {}
        for k, v in shared.items():
            after = {tuple(docs[f][p + 1 : p + 1 + m]) for f, p in v}
            (a,) = after if len(after) == 1 else (None,)
            if a in shared and all(p + 1 + m <= len(docs[f]) for f, p in v) and len(shared[a]) == len(v):
                nexts[k] = a
        begun = set(shared) - {a for k, a in nexts.items() if shared[a][0] == (shared[k][0][0], shared[k][0][1] + 1)}
        want = set()
        for k in begun:
            size, now = m, k
            while now in nexts and shared[nexts[now]][0] == (shared[now][0][0], shared[now][0][1] + 1):
                now = nexts[now]
                size += 1
            want.add((*shared[k][0], len(shared[k]), size))
        assert got == want, case


def test_code_duplication_finds_all_clone_types(spark):
    same = "export function f(a) { const b = a * 2; return b + a; }"
    ternary, branches = "function g(x, y) { return x > y ? x * 3 : y * 4; }", "function h(p, q) { if (p > q) return p * 3; return q * 4; }"
    texts = {"1a": same, "1b": same, "2a": same.replace("a", "z"), "4a": ternary, "4b": branches}
    files = spark.createDataFrame([("p", "/w", f"/w/{n}.ts", t) for n, t in texts.items()], "project string, root string, file string, content string")
    got = {(r.file, r.message) for r in Codebase(files, config=config.Config(min_tokens=20)).rule("code-duplication").collect()}
    assert got == {("/w/1a.ts", "code-duplication: type-1 clone of 20 tokens in 2 places"), ("/w/1a.ts", "code-duplication: type-2 clone of 20 tokens in 3 places"), ("/w/4a.ts", "code-duplication: type-4 clone of 25 tokens in 2 places")}


def test_extract_is_tolerant():
    for text in ("", "export", "import {", "class {", "function (", "const", "if (", "x = `${", "enum A {", "@", "export default", "interface", "type X ="):
        assert extract("a.ts", text)["failed"] is False
    assert extract("a.py", "def f(:")["failed"] and extract("a.py", None)["failed"] is False
    assert extract("a.ts", "const a = /[/'\"]/; f(`${b}`)\nexport { a } from './b'")["imports"][0]["kind"] == "reexport"


def test_globs():
    assert re.search(path_glob("**/*.{ts,tsx}"), "a/b/c.tsx") and re.search(path_glob("**/*.ts"), "c.ts") and not re.search(path_glob("src/*.ts"), "src/a/b.ts")
    assert re.search(zone_glob("src/**"), "src/a/b.ts") and not re.search(zone_glob("src/*.{ts}"), "src/a.ts") and re.search(path_glob("[!a]b"), "cb")


def test_config_and_manifests(tmp_path):
    (tmp_path / "base.json").write_text('{"rules": {"unused-files": "warn", "a": "off"}, /* c */ "zones": {"x": {"pattern": ["//"]}},}')
    (tmp_path / "c.json").write_text('{"extends": "base.json", "rules": {"a": "error"}}')
    data = config.load(tmp_path / "c.json")
    assert data["rules"] == {"unused-files": "warn", "a": "error"} and data["zones"]["x"]["pattern"] == ["//"]
    (tmp_path / "loop.json").write_text('{"extends": "loop.json"}')
    for bad in ("loop.json",):
        with pytest.raises(ValueError):
            config.load(tmp_path / bad)
    (tmp_path / "package.json").write_text('{"dependencies": {"a": "1"}, "devDependencies": {"b": "1"}}')
    (tmp_path / "requirements-dev.txt").write_text("# c\nPy_Test>=3\n-r x\n")
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "x.ts").write_text("")
    (tmp_path / "dist").mkdir()
    (tmp_path / "dist" / "y.ts").write_text("")
    assert {r[1:] for r in tree.read_manifests(str(tmp_path))} == {("npm", "deps", "a"), ("npm", "dev-deps", "b"), ("pypi", "dev-deps", "py-test")}
    assert [p.rsplit("/", 1)[1] for p in tree.discover(str(tmp_path))] == ["x.ts"]
    assert tree.pyproject('[project]\ndependencies = ["Foo_Bar[x]>=1"]\n[tool.poetry.group.dev.dependencies]\nbaz = "*"') == [("pypi", "deps", "foo-bar"), ("pypi", "dev-deps", "baz")]
    assert tree.package_json("{") == [] and tree.pyproject("=") == []
