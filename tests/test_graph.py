import random

import pytest

from tessel.operators import graph


def closure(edges):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    out = {}
    for n in {x for e in edges for x in e}:
        seen, todo = set(), [n]
        while todo:
            for b in after.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        out[n] = seen
    return out


@pytest.mark.parametrize("local", [10**6, 0])
def test_graph_operators_match_closure(spark, local):
    rng = random.Random(local)
    edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(34)] + [(40, 40), (50, 51), (51, 50)]
    reach = closure(edges)
    df = spark.createDataFrame(edges + edges[:4] + [(None, 3), (4, None)], "src bigint, dst bigint")
    roots = spark.createDataFrame([(3,), (50,), (99,), (None,)], "node bigint")
    got = sorted(r[0] for r in graph.reachable(df, roots, local).collect())
    assert got == sorted({3, 50, 99} | reach.get(3, set()) | reach[50])
    want = {n: min(m for m in r if n in reach[m]) for n, r in reach.items() if n in r}
    assert {r.node: r.scc for r in graph.strongly_connected(df, local).collect()} == want
    both = closure(edges + [(b, a) for a, b in edges])
    assert {r.node: r.component for r in graph.connected_components(df, local).collect()} == {n: min(r | {n}) for n, r in both.items()}


def test_propagate_and_walk(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "x")]
    df = spark.createDataFrame(edges, "src string, dst string")
    facts = spark.createDataFrame([("a", 1), ("d", 2)], "node string, value int")
    for local in (10**6, -1):
        assert {tuple(r) for r in graph.propagate(df, facts, local).collect()} == {("a", 1), ("b", 1), ("c", 1), ("d", 1), ("d", 2)}
    walks = {r.scc: list(r.cycle) for r in graph.cycle_walk(df, graph.strongly_connected(df)).collect()}
    assert walks == {"a": ["a", "b", "c", "a"], "x": ["x", "x"]}


def test_empty_graphs(spark):
    df = spark.createDataFrame([], "src bigint, dst bigint")
    roots = spark.createDataFrame([(1,)], "node bigint")
    assert [r[0] for r in graph.reachable(df, roots).collect()] == [1]
    assert graph.strongly_connected(df).count() == 0 and graph.connected_components(df).count() == 0
    assert graph.reachable(df, roots, -1).count() == 1 and graph.strongly_connected(df, -1).count() == 0 and graph.connected_components(df, -1).count() == 0
