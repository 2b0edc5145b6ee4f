import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tessel.llm import neardup, spans


def pairs_by_span(rows, span):
    grams = {}
    for f, x in rows:
        for i in range(len(x) - span + 1):
            grams.setdefault(x[i : i + span], set()).add(f)
    return {(a, b) for fs in grams.values() for a in fs for b in fs if a < b}


def random_text(rng, n, alphabet="abcdef \n"):
    return "".join(rng.choice(alphabet) for _ in range(n))


def test_spans_match_brute_force(spark):
    rng = random.Random(8)
    blocks = [random_text(rng, 240, "abcdefgh \nöß中\U0001f600") for _ in range(14)]
    rows = []
    for n in range(90):
        parts = [random_text(rng, rng.randrange(0, 200))]
        for _ in range(rng.randrange(0, 3)):
            b = rng.choice(blocks)
            size = rng.choice([150, 158, 159, 160, 161, 170, 240])
            at = rng.randrange(0, 240 - size + 1)
            parts += [b[at : at + size], random_text(rng, rng.randrange(0, 90))]
        rows.append((f"f{n:02d}", "".join(parts)))
    rows += [("copy1", rows[0][1] + "x" * 400), ("copy2", rows[0][1] + "x" * 400), ("é", "-" * 500), ("dash", "-" * 160), ("dash2", "-" * 159), ("empty", ""), (rows[3][0], rows[3][1])]
    df = spark.createDataFrame([(*r, "other") for r in rows] + [("null", None, "x"), (None, "y" * 300, "x")], "file string, content string, id string")
    want = pairs_by_span(rows, 160)
    for cap in (40, 2):
        found = spans.SharedSpans(df, F.col("file"), F.col("content"), cap=cap)
        assert {tuple(r) for r in found.pairs().collect()} == want
    shared = {r[0]: (r[1], r[2]) for r in found.shared().collect()}
    grams = {}
    for f, x in set(rows):
        for i in range(len(x) - 159):
            grams.setdefault(x[i : i + 160], set()).add(f)
    for f, x in set(rows):
        covered = set()
        for i in range(len(x) - 159):
            if len(grams[x[i : i + 160]]) > 1:
                covered.update(range(i, i + 160))
        assert shared[f] == (len(x), len(covered)), f


def test_licence_header_is_no_span(spark):
    rng = random.Random(9)
    header = random_text(rng, 155)
    rows = [(f"f{n:03d}", header + random_text(rng, 300)) for n in range(60)]
    rows.append(("g", header + rows[7][1][155:200] + random_text(rng, 100)))
    found = spans.SharedSpans(spark.createDataFrame(rows, "file string, content string"), F.col("file"), F.col("content"), cap=4)
    got = {tuple(r) for r in found.pairs().collect()}
    assert got == pairs_by_span(rows, 160) and ("f007", "g") in got


def test_spans_empty(spark):
    df = spark.createDataFrame([], "file string, content string")
    assert spans.SharedSpans(df, F.col("file"), F.col("content")).pairs().count() == 0


def near(rows, t, least):
    sets = {}
    for f, x in rows:
        w = neardup.WORD.findall(x or "")
        if len(w) >= least:
            sets[f] = set(zip(w, w[1:], w[2:]))
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(10)
    vocabulary = [f"w{n}" for n in range(300)] + ["größe", "中文", "Part", "part"]
    rows = []
    for k in range(20):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([29, 30, 60, 120]))]
        for v in range(rng.randrange(1, 5)):
            words = list(base)
            for _ in range(rng.randrange(0, len(base) // 7 + 1)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((f"f{k}-{v}", rng.choice([" ", ", ", "\r\n"]).join(words)))
    boiler = [rng.choice(vocabulary) for _ in range(40)]
    rows += [(f"b{n}", " ".join(boiler + [rng.choice(vocabulary) for _ in range(12)])) for n in range(40)]
    rows += [("same1", rows[0][1]), ("same2", rows[0][1].replace(" ", "  ")), (rows[5][0], rows[5][1]), ("empty", ""), ("null", None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "file string, content string, id int")
    for cap, big in ((64, 100_000), (3, 12)):
        found = neardup.NearDuplicates(df, F.col("file"), F.col("content"), cap=cap, big=big)
        got = {tuple(r) for r in found.pairs().collect()}
        want = near(rows, 0.6, 30)
        assert got <= want and len(want - got) <= len(want) // 200
    after = {}
    for a, b in got:
        after.setdefault(a, set()).add(b)
        after.setdefault(b, set()).add(a)
    groups = {r.file: (r.grp, r.links) for r in found.groups().collect()}
    assert groups.keys() == after.keys()
    for f, near_ in after.items():
        seen, todo = {f}, [f]
        while todo:
            for g in after[todo.pop()] - seen:
                seen.add(g)
                todo.append(g)
        assert groups[f] == (min(seen), len(near_))


def test_trie_matches_follow_the_definition():
    rng = np.random.default_rng(4)
    for cap in (2, 3, 6):
        # labels 3 to 6 of 300 rows of 12 nodes, few values each, so that nodes of all depths and sizes occur
        node, labels = rng.integers(0, 12, 300), rng.integers(0, 3, (300, 4)).astype(np.uint64)
        labels[:, 0] = 1
        tail = labels[:, 0] << np.uint64(48) | labels[:, 1] << np.uint64(32) | labels[:, 2] << np.uint64(16) | labels[:, 3]
        order = np.lexsort((tail, node))
        node, labels, tail = node[order], labels[order], tail[order]
        a, b, depth = neardup.trie_matches(node, tail, 3, cap)
        prefix = {d: [(int(n), *map(int, row[: d - 2])) for n, row in zip(node, labels)] for d in range(3, 7)}
        size = {d: Counter(p) for d, p in prefix.items()}
        want = [next((d for d in range(3, 7) if size[d][prefix[d][i]] <= cap), 7) for i in range(300)]
        assert depth.tolist() == want
        pairs = {(i, j) for i in range(300) for j in range(i + 1, 300) if want[i] < 7 and prefix[want[i]][i] == prefix[want[i]][j]}
        assert set(zip(a.tolist(), b.tolist())) == pairs and len(a) == len(pairs)


def test_texts_that_full_nodes_hide_are_found(spark):
    rng = random.Random(5)
    boiler = [f"b{n}" for n in range(60)]
    rows = [(f"f{n:03d}", " ".join(boiler + [f"x{n}_{k}" for k in range(14)])) for n in range(70)]
    rows += [(f"n{n}", " ".join([f"q{n // 2}_{k}" for k in range(80)] + [f"z{n}_{k}" for k in range(8)])) for n in range(20)]
    df = spark.createDataFrame(rows, "file string, content string")
    for cap, big in ((8, 9), (70, 80)):
        got = {tuple(r) for r in neardup.NearDuplicates(df, F.col("file"), F.col("content"), cap=cap, big=big).pairs().collect()}
        assert got == near(rows, 0.6, 30)


def test_near_duplicates_empty(spark):
    df = spark.createDataFrame([], "file string, content string")
    assert neardup.NearDuplicates(df, F.col("file"), F.col("content")).pairs().count() == 0


def test_depth_reaches_recall():
    assert neardup.depth_for(0.6) == 3 and neardup.depth_for(0.9) == 8 or neardup.depth_for(0.9) > 3
