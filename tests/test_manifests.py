import json

from pyspark.sql import functions as F

from tessel.engine import Codebase
from tessel.sources import manifests
from tessel.sources.packages import Plugin
from tessel.sources.tree import from_memory

FILES = {
    "src/index.ts": "import { a } from '@lib/a';\nimport { b } from '@acme/util';\nimport { c } from '@acme/util/deep/c';\nimport r from 'react';\nimport { x } from 'exact';\nimport { m } from '@lib/missing';\n",
    "src/lib/a.ts": "export const a = 1;\n",
    "src/one.ts": "export const x = 1;\n",
    "src/bin/tool.ts": "export const t = 1;\n",
    "src/app/page.tsx": "export default function Page() { return null }\nexport const meta = 1;\nexport const odd = 2;\n",
    "src/setup.ts": "export const s = 1;\n",
    "src/lost.ts": "export const l = 1;\n",
    "packages/util/src/index.ts": "export const b = 1;\n",
    "packages/util/src/deep/c.ts": "export const c = 1;\n",
    "pkg/run.py": "import os\n",
    "pkg/other.py": "x = 1\n",
}
MANIFESTS = {
    "package.json": json.dumps({"name": "root", "main": "./dist/index.js", "bin": {"t": "./dist/bin/tool.js"}, "dependencies": {"react": "1", "left": "1"}, "devDependencies": {"framework": "1", "framework-tool": "1"}}),
    "tsconfig.json": '{ // paths\n "compilerOptions": {"baseUrl": ".", "paths": {"@lib/*": ["./src/none/*", "./src/lib/*"], "exact": ["./src/one"], "ex*": ["./src/lost"]}} }',
    "packages/util/package.json": json.dumps({"name": "@acme/util", "exports": {".": {"import": "./dist/index.js"}, "./deep/*": "./dist/deep/*.js"}}),
    "pyproject.toml": '[project]\nname = "p"\ndependencies = ["Some_Lib>=1"]\n[project.scripts]\nrun = "pkg.run:main"\n',
    "broken/package.json": "{",
}


def project(spark, plugins=()):
    rows = [("app", "/w/app", "/w/app/" + p.rpartition("/")[0] if "/" in p else "/w/app", p.rpartition("/")[2], t) for p, t in MANIFESTS.items()]
    rows += [rows[0], ("app", "/w/app", "/w/app/null", "package.json", None)]
    return Codebase(from_memory(spark, "app", "/w/app", FILES), None, None, spark.createDataFrame(rows, "project string, root string, dir string, name string, content string"), plugins)


def test_specifiers_follow_aliases_and_workspace_packages(spark):
    got = {(r.spec, r.dst and r.dst.removeprefix("/w/app/"), r.resolvable) for r in project(spark).edges.filter("src like '%index.ts'").collect()}
    assert got == {
        ("@lib/a", "src/lib/a.ts", True), ("@acme/util", "packages/util/src/index.ts", True), ("@acme/util/deep/c", "packages/util/src/deep/c.ts", True), ("react", None, False), ("exact", "src/one.ts", True), ("@lib/missing", None, False),
    }


def test_manifests_name_entries_and_dependencies(spark):
    base = project(spark)
    names = {r.file.removeprefix("/w/app/") for r in base.entries.collect()}
    assert {"src/index.ts", "src/bin/tool.ts", "pkg/run.py", "packages/util/src/index.ts"} <= names and not names & {"src/lost.ts", "pkg/other.py", "src/app/page.tsx"}
    assert {(r.ecosystem, r.section, r["name"]) for r in base.deps.collect()} == {("npm", "deps", "react"), ("npm", "deps", "left"), ("npm", "dev-deps", "framework"), ("npm", "dev-deps", "framework-tool"), ("pypi", "deps", "some-lib")}


def test_active_plugins_add_entries_and_explain_findings(spark):
    on = Plugin.of({"name": "framework", "detection": {"type": "all", "conditions": [{"type": "dependency", "package": "framework"}, {"type": "fileExists", "pattern": "src/app/**"}]}, "entryPoints": [], "alwaysUsed": ["src/setup.ts"], "toolingDependencies": ["framework", "framework-tool"], "usedExports": [{"pattern": "src/lost.ts", "exports": ["l"]}]})
    off = Plugin.of({"name": "other", "enablers": ["absent", "gone/"], "entryPoints": ["src/lost.ts"], "alwaysUsed": ["**/*.ts"]})
    pages = Plugin.of({"name": "pages", "enablers": ["frame/", "framework"], "entryPoints": ["src/app/**/page.{ts,tsx}"]})
    base = project(spark, [on, off, pages])
    assert {r.plugin for r in base.active.collect()} == {"framework", "pages"}
    found = {(r.kind, r.file.removeprefix("/w/app/"), r["name"]) for r in base.findings("dead-code-only").collect()}
    files = {f for k, f, _ in found if k == "unused-files"}
    assert files == {"src/lost.ts", "pkg/other.py"}
    assert {n for k, _, n in found if k.endswith("deps")} == {"left", "some-lib"}
    plain = {(r.kind, r.file.removeprefix("/w/app/")) for r in project(spark).findings("dead-code-only").collect()}
    assert {f for k, f in plain if k == "unused-files"} == {"src/lost.ts", "pkg/other.py", "src/setup.ts", "src/app/page.tsx"}


def test_facts_of_malformed_manifests(spark):
    for name in ("package.json", "tsconfig.json", "pyproject.toml", "setup.cfg"):
        for text in (None, "", "{", "[1]", "= ="):
            assert manifests.facts_of("/w", name, text) == []
    empty = spark.createDataFrame([], "project string, root string, dir string, name string, content string")
    assert manifests.facts(empty).count() == 0
    assert manifests.facts_of("/w", "jsconfig.json", '{"compilerOptions": {"paths": {"a/*": ["b/*"]}}}') == [("alias", "a/*", None, ["/w/b/*"])]
