import json
import random

from pyspark.sql import functions as F

from tessel.operators import intervals, nested, reconcile


def brute(rows):
    out = {}
    for k, s, e in rows:
        if k is not None and s is not None and e is not None and s < e:
            out.setdefault(k, set()).update(range(s, e))
    periods, gaps = set(), set()
    for k, points in out.items():
        edges = sorted(points)
        start = prev = edges[0]
        for p in edges[1:]:
            if p != prev + 1:
                periods.add((k, start, prev + 1))
                gaps.add((k, prev + 1, p))
                start = p
            prev = p
        periods.add((k, start, prev + 1))
    return periods, gaps


def test_intervals_match_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(600):
        s = rng.randrange(0, 500)
        rows.append((rng.choice(["a", "a", "a", "b", "größe", None]), rng.choice([s, s, None]), s + rng.choice([-3, 0, 1, 2, 9, 60]), "x"))
    rows += rows[:50]
    df = spark.createDataFrame(rows, "path string, s int, e int, gap_start string")
    for block in (7, 64, 1 << 16):
        states = intervals.interval_states(df, F.col("path"), F.col("s"), F.col("e"), block=block)
        periods, gaps = brute([r[:3] for r in rows])
        assert {tuple(r) for r in intervals.interval_gaps(states).collect()} == gaps
        assert sorted(tuple(r) for r in intervals.interval_periods(states).collect()) == sorted(periods)


def test_intervals_wide_and_empty(spark):
    df = spark.createDataFrame([("a", -(2**61), 2**61), ("a", 2**61 + 5, 2**61 + 6), ("b", 3, 3)], "k string, s bigint, e bigint")
    states = intervals.interval_states(df, F.col("k"), F.col("s"), F.col("e"))
    assert [tuple(r) for r in intervals.interval_gaps(states).collect()] == [("a", 2**61, 2**61 + 5)]
    assert intervals.interval_gaps(intervals.interval_states(df.limit(0), F.col("k"), F.col("s"), F.col("e"))).count() == 0


def test_nested_cases(spark):
    deep = "[" * 50_000 + "]" * 50_000
    payloads = [
        (1, json.dumps({"result": [None, {"functions": [{"ranges": [{"startOffset": 1}, None, {}]}, {"ranges": []}, 5]}, {"functions": None}, {"functions": {"a": 1}}, 7]})),
        (1, json.dumps({"result": [None, {"functions": [{"ranges": [{"startOffset": 1}, None, {}]}, {"ranges": []}, 5]}, {"functions": None}, {"functions": {"a": 1}}, 7]})),
        (2, '{"result": [{}]} x'),
        (3, '{"result": [{'),
        (4, None),
        (5, "[1]"),
        (6, '{"result": NaN}'),
        (7, '{"x": ' + deep + ', "result": [{}]}'),
        (8, '{"result": [{}], "n": ' + "9" * 5000 + "}"),
        (9, ""),
        (10, '{"result": {}}'),
    ]
    df = spark.createDataFrame(payloads, "dump_id bigint, payload string")
    nodes = nested.node_table(df, F.col("dump_id"), F.col("payload"), ["result", "functions", "ranges"], {"startOffset": "bigint"})
    got = sorted(tuple(r) for r in nested.leaf_paths(nodes, 3, ["key", "record"]).drop("record").collect())
    assert got == [(1, 1, 0, 0), (1, 1, 0, 2), (1, 1, 1, -1), (1, 2, -1, -1), (1, 3, -1, -1), (7, 0, -1, -1), (8, 0, -1, -1)]


def test_labels_nest():
    record = {"a": [{"b": [{}, {}]}, {"b": [{}]}]}
    rows = list(nested.label(record, ["a", "b"]))
    for la, _, pa, qa, _ in rows:
        assert pa < qa
        assert sum(pb < pa and qa < qb for _, _, pb, qb, _ in rows) == la


def test_deep_parser_agrees():
    for text in ('{"a": [1, {"b": [], "c": {}}, "x", -1.5e3, true, null]}', "[]", "3", ' [ [ ] , {"k" : "v"} ] '):
        assert nested._parse_deep(text) == json.loads(text)
    for text in ("[1,]", '{"a" 1}', "[1] 2", "[", '{"a": 1', "{,}"):
        try:
            nested._parse_deep(text)
        except ValueError:
            continue
        raise AssertionError(text)


def test_mersenne_product():
    import numpy as np

    rng = random.Random(3)
    a = [rng.randrange(reconcile.P) for _ in range(500)] + [0, 1, reconcile.P - 1]
    b = [rng.randrange(reconcile.P) for _ in range(500)] + [reconcile.P - 1] * 3
    assert [int(v) for v in reconcile.mul(np.array(a, np.uint64), np.array(b, np.uint64))] == [x * y % reconcile.P for x, y in zip(a, b)]


def test_interpolation_recovers_sets():
    rng = random.Random(4)
    common = [rng.randrange(2**60) for _ in range(20)]
    for na, nb in ((0, 0), (3, 0), (0, 5), (7, 7), (8, 4), (12, 12)):
        only_a, only_b = [rng.randrange(2**60) for _ in range(na)], [rng.randrange(2**60) for _ in range(nb)]

        def at(xs, z):
            out = 1
            for x in xs:
                out = out * (z - x) % reconcile.P
            return out

        zs = reconcile.points(16 + reconcile.CHECKS)
        got = reconcile.interpolate(20 + na, 20 + nb, [at(common + only_a, z) for z in zs], [at(common + only_b, z) for z in zs])
        if na + nb > 16:
            assert got is None
        else:
            num, den = got
            assert len(num) == na + 1 and len(den) == nb + 1
            assert all(reconcile._value(num, x) == 0 for x in only_a) and all(reconcile._value(den, x) == 0 for x in only_b)


def test_differences_match_brute_force(spark):
    rng = random.Random(6)
    left = {i: (rng.choice(["a", None]), str(i)) for i in range(400)}
    right = {i: v for i, v in left.items() if i % 11}
    for i in range(0, 400, 3):  # some buckets differ almost entirely
        if i in right:
            right[i] = ("b", right[i][1])
    right.update({i: ("z", None) for i in range(1000, 1040)})
    frame = lambda x: spark.createDataFrame([(k, *v, "extra") for k, v in x.items()] + [(None, "q", "q", "q")], "id bigint, f string, g string, x string")
    got = {tuple(r) for r in reconcile.differences(frame(left), frame(right), "id", ["f", "g"]).collect()}
    want = set()
    for k in left.keys() | right.keys():
        if k not in right:
            want.add((k, "missing_in_right"))
        elif k not in left:
            want.add((k, "missing_in_left"))
        else:
            want |= {(k, n) for n, x, y in zip("fg", left[k], right[k]) if x != y}
    assert got == want
    empty = spark.createDataFrame([], "id bigint, f string, g string")
    assert reconcile.differences(empty, empty, "id", ["f", "g"]).count() == 0
    assert reconcile.differences(empty, frame({1: ("a", "b")}), "id", ["f", "g"]).collect() == [(1, "missing_in_left")]
