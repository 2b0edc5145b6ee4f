"""Reachability, strongly connected components, connected components and set propagation over edge tables (src, dst).

Each operator has two ways with equal results. Up to ``LOCAL_EDGES`` edges (counted, so the bound holds) one task runs a compact kernel
on arrays; beyond that, rounds of joins on shared storage run distributed, each round's result being written so that a lost executor costs
no earlier round. Repeated edges and self-loops are allowed; edges with a null end are ignored; nodes may be of any one type that
compares.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.session import materialize

LOCAL_EDGES = 500_000


def clean_edges(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").filter("src is not null and dst is not null").distinct()


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _csr(src: np.ndarray, dst: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(src, kind="stable")
    return np.searchsorted(src[order], np.arange(n + 1)), dst[order]


def _one_task(rows: DataFrame, kernel, schema: str) -> DataFrame:
    """Run a kernel over all rows, which the caller has counted, in a single task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if parts:
            yield kernel(pd.concat(parts, ignore_index=True))

    return rows.repartition(1).mapInPandas(run, schema)


# ---------------------------------------------------------------- reachability


def _reach_kernel(rows: pd.DataFrame) -> pd.DataFrame:
    is_root = rows["dst"].isna().to_numpy()
    codes, names = pd.factorize(pd.concat([rows["src"], rows["dst"][~is_root]], ignore_index=True))
    head, tail = codes[: len(rows)], codes[len(rows) :]
    at, to = _csr(head[~is_root], tail, len(names))
    seen = np.zeros(len(names), bool)
    frontier = np.unique(head[is_root])
    seen[frontier] = True
    while len(frontier):
        n = at[frontier + 1] - at[frontier]
        if not n.sum():
            break
        found = to[np.repeat(at[frontier] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
        frontier = np.unique(found[~seen[found]])
        seen[frontier] = True
    return pd.DataFrame({"node": names[seen]})


def reachable(edges: DataFrame, roots: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node) of everything that can be reached from the roots (node), the roots included."""
    edges = materialize(clean_edges(edges), "edges")
    roots = roots.select("node").filter("node is not null").distinct()
    kind = _kind(roots, "node")
    if edges.count() <= local_edges:
        marks = roots.select(F.col("node").alias("src"), F.lit(None).cast(kind).alias("dst"))
        # a reached node that is only a root stays: roots are rows of their own
        return _one_task(edges.union(marks), _reach_kernel, f"node {kind}")
    seen = materialize(roots, "seen")
    frontier = seen
    while not frontier.isEmpty():
        found = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = materialize(found.join(seen, "node", "left_anti"), "frontier")
        seen = seen.union(frontier)
    return seen


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


# ---------------------------------------------------------------- strongly connected components


def _scc_kernel(rows: pd.DataFrame) -> pd.DataFrame:
    codes, names = pd.factorize(pd.concat([rows["src"], rows["dst"]], ignore_index=True), sort=True)
    src, dst = codes[: len(rows)], codes[len(rows) :]
    n = len(names)
    at, to = _csr(src, dst, n)
    loop = np.zeros(n, bool)
    loop[src[src == dst]] = True
    bounds, nexts = at.tolist(), to.tolist()
    index, low, on, comp = [-1] * n, [0] * n, [False] * n, [-1] * n
    stack: list[int] = []
    clock = 0
    for root in range(n):
        if index[root] >= 0:
            continue
        work = [(root, bounds[root])]
        index[root] = low[root] = clock
        clock += 1
        stack.append(root)
        on[root] = True
        while work:
            v, i = work.pop()
            if i < bounds[v + 1]:
                work.append((v, i + 1))
                w = nexts[i]
                if index[w] < 0:
                    index[w] = low[w] = clock
                    clock += 1
                    stack.append(w)
                    on[w] = True
                    work.append((w, bounds[w]))
                elif on[w]:
                    low[v] = min(low[v], index[w])
                continue
            if low[v] == index[v]:
                members = []
                while True:
                    w = stack.pop()
                    on[w] = False
                    members.append(w)
                    if w == v:
                        break
                if len(members) > 1 or loop[v]:
                    first = min(members)
                    for w in members:
                        comp[w] = first
            if work:
                parent = work[-1][0]
                low[parent] = min(low[parent], low[v])
    comp_ = np.array(comp)
    keep = comp_ >= 0
    return pd.DataFrame({"node": names[keep], "scc": names[comp_[keep]]})


def strongly_connected(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, scc) of every node on a cycle; ``scc`` is the least node of its component. Single nodes count only with a self-loop."""
    edges = materialize(clean_edges(edges), "edges")
    kind = _kind(edges, "src")
    if edges.count() <= local_edges:
        return _one_task(edges, _scc_kernel, f"node {kind}, scc {kind}")
    loops = edges.filter("src = dst").select(F.col("src").alias("node"), F.col("src").alias("scc"))
    edges = edges.filter("src <> dst")
    done = []
    while True:
        # nodes without predecessor or successor are on no cycle
        while True:
            before = edges.count()
            heads, tails = edges.select("src").distinct(), edges.select("dst").distinct()
            edges = materialize(edges.join(tails.select(F.col("dst").alias("src")), "src", "left_semi").join(heads.select(F.col("src").alias("dst")), "dst", "left_semi").select("src", "dst"), "trim")
            if edges.count() == before:
                break
        if before == 0:
            break
        # forward: the least node that reaches each node
        color = materialize(edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct().withColumn("color", F.col("node")), "color")
        while True:
            offered = edges.join(color, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.min("color").alias("offer"))
            step = materialize(color.join(offered, "node", "left").select("node", F.least("color", "offer").alias("color"), (F.col("offer") < F.col("color")).alias("changed")), "color")
            color = step.select("node", "color")
            if step.filter("changed").isEmpty():
                break
        # backward within a colour: what reaches the colour's own node is its component
        inside = edges.join(color.select(F.col("node").alias("src"), F.col("color").alias("c1")), "src").join(color.select(F.col("node").alias("dst"), F.col("color").alias("c2")), "dst").filter("c1 = c2").select("src", "dst", F.col("c1").alias("scc"))
        inside = materialize(inside, "inside")
        seen = materialize(color.filter("node = color").select("node", F.col("color").alias("scc")), "scc")
        frontier = seen
        while not frontier.isEmpty():
            found = frontier.join(inside, (F.col("dst") == F.col("node")) & (inside["scc"] == frontier["scc"])).select(F.col("src").alias("node"), inside["scc"]).distinct()
            frontier = materialize(found.join(seen, ["node", "scc"], "left_anti"), "frontier")
            seen = seen.union(frontier)
        seen = materialize(seen, "found")
        sizes = seen.groupBy("scc").agg(F.count("*").alias("n")).filter("n > 1")
        done.append(seen.join(sizes, "scc").select("node", "scc"))
        gone = seen.select("node")
        edges = materialize(edges.join(gone.select(F.col("node").alias("src")), "src", "left_anti").join(gone.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"), "rest")
    out = loops
    for part in done:
        out = out.union(part)
    return out.groupBy("node").agg(F.min("scc").alias("scc"))


# ---------------------------------------------------------------- connected components


def _cc_kernel(rows: pd.DataFrame) -> pd.DataFrame:
    codes, names = pd.factorize(pd.concat([rows["src"], rows["dst"]], ignore_index=True), sort=True)
    a, b = codes[: len(rows)], codes[len(rows) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return pd.DataFrame({"node": names, "component": names[label]})


def connected_components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, component) for the nodes of undirected edges; ``component`` is the least node. Distributed: alternating large and small stars."""
    edges = materialize(clean_edges(edges), "edges")
    kind = _kind(edges, "src")
    if edges.count() <= local_edges:
        return _one_task(edges, _cc_kernel, f"node {kind}, component {kind}")
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    pairs = edges.filter("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    before = None
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).filter("u <> v")
        pairs = materialize(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    found = pairs.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(found, F.col("node") == F.col("u"), "left").select("node", F.coalesce("component", "node").alias("component"))


# ---------------------------------------------------------------- sets along edges


LOCAL_PAIRS = 20_000_000


def _propagate_kernel(rows: pd.DataFrame) -> pd.DataFrame:
    fact = rows["dst"].isna().to_numpy()
    codes, names = pd.factorize(pd.concat([rows["src"], rows["dst"][~fact]], ignore_index=True))
    head, tail = codes[: len(rows)], codes[len(rows) :]
    values, labels = pd.factorize(rows["value"][fact])
    at, to = _csr(head[~fact], tail, len(names))
    k = max(1, len(labels))
    seen = np.zeros(len(names) * k, bool)
    frontier = np.unique(head[fact].astype(np.int64) * k + values)
    seen[frontier] = True
    while len(frontier):
        node, value = frontier // k, frontier % k
        n = at[node + 1] - at[node]
        if not n.sum():
            break
        found = to[np.repeat(at[node] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())].astype(np.int64) * k + np.repeat(value, n)
        frontier = np.unique(found[~seen[found]])
        seen[frontier] = True
    pairs = np.flatnonzero(seen)
    return pd.DataFrame({"node": names[pairs // k], "value": np.asarray(labels)[pairs % k]})


def propagate(edges: DataFrame, facts: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, value): every value reaches all successors of its nodes. Only what is new in a round travels in the next one."""
    edges = materialize(clean_edges(edges), "edges")
    seen = materialize(facts.select("node", "value").filter("node is not null and value is not null").distinct(), "facts")
    n_edges = edges.count()
    counts = seen.agg(F.count("*").alias("rows"), F.countDistinct("value").alias("values")).first()
    if n_edges <= local_edges and counts.rows <= local_edges and (2 * n_edges + counts.rows) * counts["values"] <= LOCAL_PAIRS:
        kind, of = _kind(seen, "node"), _kind(seen, "value")
        rows = edges.select("src", "dst", F.lit(None).cast(of).alias("value")).union(seen.select("node", F.lit(None).cast(kind), "value"))
        return _one_task(rows, _propagate_kernel, f"node {kind}, value {of}")
    fresh = seen
    while not fresh.isEmpty():
        moved = fresh.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), "value").distinct()
        fresh = materialize(moved.join(seen, ["node", "value"], "left_anti"), "fresh")
        seen = seen.union(fresh)
    return seen


def cycle_walk(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(scc, cycle): from the least node of a component always to the least unvisited successor until there is none, then back to the start.

    The walk is sequential by definition; one task holds the inner edges of one component."""
    inner = components.select(F.col("node").alias("src"), "scc").join(clean_edges(edges), "src").join(components.select(F.col("node").alias("dst"), F.col("scc").alias("other")), "dst").filter("scc = other").select("scc", "src", "dst")
    kind = _kind(components, "scc")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        after: dict = {}
        for a, b in sorted(zip(pdf["src"], pdf["dst"])):
            after.setdefault(a, []).append(b)
        start = pdf["scc"].iloc[0]
        seen, out, now = {start}, [start], start
        while (step := next((b for b in after.get(now, ()) if b not in seen), None)) is not None:
            seen.add(step)
            out.append(step)
            now = step
        return pd.DataFrame({"scc": [start], "cycle": [[*out, start]]})

    return inner.groupBy("scc").applyInPandas(walk, f"scc {kind}, cycle array<{kind}>")
