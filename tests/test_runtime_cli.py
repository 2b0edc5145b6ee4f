import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tessel import cli, runtime
from tessel.engine import Codebase
from tessel.operators import clones, coverage, resolve
from tessel.sources import tree

FILES = {"src/index.ts": "import { a } from './a'\nrun(a)\n", "src/a.ts": "export function a(p) { if (p && q) { return 1 } return 2 }\nexport function z() { return 0 }\n", "src/lost.ts": "export const lost = 1\n"}


def test_runtime_report(spark):
    dump = {"result": [{"url": f"file:///ci/app/{f}", "functions": [{"functionName": n, "ranges": [{"startOffset": 0, "endOffset": 9, "count": c}]} for n, c in fns]} for f, fns in {"src/index.ts": [("main", 5)], "src/a.ts": [("a", 90), ("z", 0), ("", 4)]}.items()]}
    rows = spark.createDataFrame(runtime.rows_of(runtime.validate(json.dumps(dump))) * 2, "file string, fn string, start int, end int, hits int")
    base = Codebase(tree.from_memory(spark, "p", "/w/p", FILES))
    moved = runtime.rebase_to(rows, base.files, "/w/p/src", "/ci/app/src")
    assert {r.file for r in runtime.rebase_to(rows, base.files, "/w/p/src").select("file").distinct().collect()} == {r.file for r in moved.select("file").distinct().collect()} == {"/w/p/src/index.ts", "/w/p/src/a.ts"}
    with pytest.raises(ValueError):
        runtime.rebase_to(rows, base.files, "/elsewhere")
    report = runtime.runtime_report(base, moved)
    assert [(r.fn, r.hits, r["rank"]) for r in report["hotPaths"].collect()] == [("a", 180, 0)]
    assert [r.fn for r in report["coldCode"].collect()] == ["z"] and [r.file for r in report["coverageMissing"].collect()] == ["/w/p/src/lost.ts"]
    assert [r.file for r in report["weightedRefactorTargets"].collect()] == ["/w/p/src/a.ts"]
    for bad in ("[", "{}", '{"result": [{}]}', '{"result": [{"url": "a", "functions": [{"functionName": "", "ranges": [{"startOffset": 1}]}]}]}'):
        with pytest.raises(ValueError):
            runtime.validate(bad)


def test_hot_paths(spark):
    rows = [("f", f"g{n:03d}", n % 7) for n in range(95)]
    df = spark.createDataFrame(rows, "file string, fn string, hits bigint")
    live = sorted((r for r in rows if r[2]), key=lambda r: (-r[2], r[0], r[1]))
    got = sorted((r["rank"], r.fn, r.n) for r in coverage.hot_paths(df).collect())
    assert got == [(k, r[1], len(live)) for k, r in enumerate(live[: -(-len(live) // 10)])]
    assert coverage.hot_paths(df.filter("hits = 3")).count() == 0 and coverage.hot_paths(df.limit(0)).count() == 0


def test_structural_clones(spark):
    kw = {"return", "if", "while", "for"}
    t = lambda s: s.split()
    assert clones.structural(t("return a > b ? x : y ;"), kw) == clones.structural(t("if ( a > b ) return x ; return y ;"), kw)
    assert clones.structural(t("{ i = 0 ; while ( i < n ) { f ( i ) ; i ++ ; } }"), kw) == clones.structural(t("{ for ( i = 0 ; i < n ; i ++ ) { f ( i ) ; } }"), kw)
    assert clones.structural(t("return a ;"), kw) == t("return IDENT ;")
    one, two = "p q r s t u v w x y".split(), "p q r s t u v w".split()
    df = spark.createDataFrame([("a", one), ("b", one), ("c", two)], "file string, toks array<string>")
    got = {(r.type, r.file, r.pos, r.members, r.length) for r in clones.find_clones(df, 4, [], (1,)).collect()}
    assert got == {(1, "a", 0, 3, 8), (1, "a", 5, 2, 5)}


def test_candidates(spark):
    df = spark.createDataFrame([("/p/dist/x.js", "/p", "num.py")], "base string, root string, module string")
    paths = lambda c: [x["path"] for x in sorted(df.select(c.alias("c")).first().c, key=lambda x: x["rank"])]
    assert paths(resolve.platform_candidates(F.lit("/p/v")))[:2] == ["/p/v.ios.ts", "/p/v.ios.tsx"] and "/p/v.ts" in paths(resolve.platform_candidates(F.lit("/p/v")))
    assert "/p/src/x.ts" in paths(resolve.source_candidates(F.col("base"))) and paths(resolve.source_candidates(F.lit("/p/src/x.js"))) == []
    assert "/p/.venv/lib/python3.13/site-packages/num/__init__.py" in paths(resolve.venv_candidates(F.col("root"), F.col("module"), ["3.13"]))


def test_cli(spark, tmp_path, capsys):
    for p, t in FILES.items():
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text(t)
    (tmp_path / "package.json").write_text('{"dependencies": {"left-pad": "1"}}')
    assert cli.main(["dead-code", str(tmp_path), "--format", "compact"], spark) == 1
    out = capsys.readouterr().out
    assert "lost.ts" in out and "unused-deps: package left-pad" in out
    (tmp_path / "c.json").write_text('{"rules": {"unused-files": "warn", "unused-deps": "off"}}')
    assert cli.main(["dead-code", str(tmp_path), "--config", str(tmp_path / "c.json")], spark) == 0
    assert ", 0 errors, " in capsys.readouterr().out
    assert cli.main(["trace", str(tmp_path), "--file", "src/a.ts"], spark) == 0 and capsys.readouterr().out.strip().endswith("src/index.ts")
    assert cli.main(["trace", str(tmp_path)], spark) == 2 and cli.main(["audit", str(tmp_path)], spark) == 0


def test_determinism_hash_of_many_findings(spark, tmp_path):
    from tessel.plans import text_reports

    n = 140_000  # the sums of so many pass 2^63
    place = F.struct(F.struct(F.lit(1).alias("line"), F.lit(0).alias("col")).alias("start_pos")).alias("loc")
    found = spark.range(n).select(F.concat(F.lit("f"), "id").alias("finding_id"), F.lit("k").alias("kind"), F.lit("error").alias("severity"), F.lit("a.ts").alias("file"), F.lit("m").alias("message"), place, F.when(F.col("id") < 3, "r2").otherwise("r1").alias("run_id"))
    found.write.parquet(f"{tmp_path}/findings_actual.parquet")
    spark.createDataFrame([("r1", "p"), ("r2", "few")], "run_id string, project string").write.parquet(f"{tmp_path}/runs.parquet")
    parts = [int(hashlib.md5(f"f{i}|k|a.ts|1".encode()).hexdigest()[:12], 16) for i in range(n)]
    assert sum(parts[3:]) >= 2**63
    wrapped = (sum(parts[3:]) + 2**63) % 2**64 - 2**63
    got = text_reports.determinism_hash(spark, str(tmp_path))
    assert dict(got.dtypes) == {"project": "string", "digest": "bigint", "n": "bigint"}
    assert {tuple(r) for r in got.collect()} == {("few", sum(parts[:3]), 3), ("p", wrapped, n - 3)}


def test_clone_anchors_lose_no_repeated_run(spark):
    import numpy as np

    rng, m = np.random.default_rng(5), 10
    stock = [f"t{k}" for k in rng.integers(0, 40, 120)]
    rows = []
    for n in range(60):
        toks = [f"t{k}" for k in rng.integers(0, 60, rng.integers(0, 60))]
        at, length = rng.integers(0, 100), rng.integers(m - 2, 21)
        rows.append((n, (toks + stock[at : at + length] if n % 3 else ["a", "b"] * 15 + toks) if n != 7 else None))
    files = spark.createDataFrame(rows, "file bigint, toks array<string>").repartition(3)
    whole = clones.grams(files, m).collect()
    times = {}
    for r in whole:
        times[r.key] = times.get(r.key, 0) + 1
    seen = clones.anchors(files, m).groupBy("anchor").agg(F.count("*").alias("times")).filter("times > 1").select("anchor")
    kept = {tuple(r) for r in clones.grams(files, m, clones.sieve_of(seen)).collect()}
    repeated = {tuple(r) for r in whole if times[r.key] > 1}
    assert repeated and repeated <= kept <= {tuple(r) for r in whole} and len(kept) < len(whole) / 2
