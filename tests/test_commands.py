import json

import pytest
from pyspark.sql import functions as F

from tessel import cli, runtime
from tessel.engine import RULES, Codebase
from tessel.extract.suppress import suppressions, unknown_once
from tessel.operators.resolve import canonical
from tessel.sources import tree


def test_printed_commands(capsys, tmp_path):
    assert cli.main(["explain", "unused-files"]) == 0 and "entry point" in capsys.readouterr().out
    assert cli.main(["explain", "unused-file"]) == 2 and "unused-files" in capsys.readouterr().err
    assert sorted(cli.EXPLAIN) == RULES
    assert cli.main(["schema"]) == 0 and set(json.loads(capsys.readouterr().out)["properties"]) >= {"rules", "zones", "extends"}
    assert cli.main(["init", str(tmp_path)]) == 0 and cli.main(["init", str(tmp_path)]) == 2
    assert list(json.loads((tmp_path / "tessel.json").read_text())["rules"]) == RULES


def test_single_rules_and_traces(spark, tmp_path, capsys):
    for p, t in {"src/index.ts": "import { a } from './a'\nrun(a)\n", "src/a.ts": "export const a = 1\n", "src/lost.ts": "export const lost = 1\n", ".github/x.ts": "export const g = 1\n", ".cache/y.ts": "", "src/w.vue": "<script>export default {}</script>"}.items():
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text(t)
    assert [p.removeprefix(str(tmp_path) + "/") for p in tree.discover(str(tmp_path))] == [".github/x.ts", "src/a.ts", "src/index.ts", "src/lost.ts", "src/w.vue"]
    assert cli.main(["unused-files", str(tmp_path), "--format", "compact"], spark) == 1
    out = capsys.readouterr().out
    assert "lost.ts" in out and "unused-exports" not in out
    assert cli.main(["circular-deps", str(tmp_path)], spark) == 0
    capsys.readouterr()
    assert cli.main(["trace", str(tmp_path), "--export", "a"], spark) == 0


def test_rules_of_ones_own(spark):
    base = Codebase(tree.from_memory(spark, "p", "/w/p", {"src/index.ts": "const x = 1\n", "src/todo.ts": "// TODO\n"}))
    base.register("no-todo", lambda b: b.sources.filter(F.contains("content", F.lit("TODO"))).select("file", F.lit("left to do").alias("message")))
    with pytest.raises(ValueError):
        base.register("unused-files", lambda b: b.files)
    got = {(r.kind, r.file, r.message) for r in base.findings(kinds=["no-todo"]).collect()}
    assert got == {("no-todo", "/w/p/src/todo.ts", "no-todo: left to do")} and "no-todo" in base.enabled("full") and "no-todo" not in base.enabled("audit")


def test_python_package_roots(spark):
    base = Codebase(tree.from_memory(spark, "p", "/w/p", {"lib/a/__init__.py": "", "lib/a/b/__init__.py": "", "lib/a/b/m.py": "", "lib/n.py": "", "top.py": "", "a.ts": ""}))
    got = {r.file.removeprefix("/w/p/"): r.root for r in base.package_roots().collect()}
    assert got == {"lib/a/__init__.py": "/w/p/lib", "lib/a/b/__init__.py": "/w/p/lib", "lib/a/b/m.py": "/w/p/lib", "lib/n.py": "/w/p/lib", "top.py": "/w/p"}


def test_small_ones(spark):
    paths = {"/a/./b/../c/": "/a/c", "C:\\x\\y\\": "c:/x/y", "a//b": "a/b", "/": "/"}
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", canonical(F.col("p")).alias("c")).collect()
    assert {r.p: r.c for r in rows} == paths
    text = "# tessel-ignore-file unused-fils\n# tessel-ignore-file unused-fils\n# tessel-ignore-next-line unused-files\n"
    marks = suppressions(spark.createDataFrame([("f.py", text)], "file string, content string"), RULES)
    assert [(r.rule, r.hint, r.line) for r in unknown_once(marks).collect()] == [("unused-fils", "unused-files", 1)]
    whole, lost = runtime.placed(spark.createDataFrame([("a", "f", 0, 5, 1), ("a", "g", None, 5, 1), ("a", "h", 1, None, 2)], "file string, fn string, start int, end int, hits int"))
    assert whole.count() == 1 and [(r.file, r.lost) for r in lost.collect()] == [("a", 2)]
