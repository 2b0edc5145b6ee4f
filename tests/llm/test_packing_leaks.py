import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.llm import leaks, packing


def test_histogram_packs_are_whole():
    rng = random.Random(1)
    for capacity in (1, 7, 64, 512):
        for _ in range(30):
            histogram = Counter(min(capacity, 1 + int(rng.expovariate(3 / capacity))) for _ in range(rng.randrange(0, 400)))
            packs = packing.pack_histogram(dict(histogram), capacity)
            placed = Counter()
            for count, pack in packs:
                assert count > 0 and sum(k * n for k, n in pack.items()) <= capacity
                for k, n in pack.items():
                    placed[k] += n * count
            assert placed == histogram
            total = sum(k * n for k, n in histogram.items())
            fewest, used = -(-total // capacity), sum(count for count, _ in packs)
            assert used <= fewest * 1.25 + 2


def test_packing_places_every_item_once(spark):
    rng = random.Random(2)
    tokens = [0, 0, 0, 5, 10, 11, 20, 21, 35] + [rng.randrange(0, 30) for _ in range(400)] + [4] * 200
    df = spark.createDataFrame([(n, t) for n, t in enumerate(tokens)] + [(None, 3), (None, 3)], "id bigint, tokens bigint")
    old, packing._SALT_ROWS = packing._SALT_ROWS, 50  # several salts for one length
    try:
        rows = packing.pack(df, {"a": 10, "b": 1000}).collect()
    finally:
        packing._SALT_ROWS = old
    for profile, capacity in (("a", 10), ("b", 1000)):
        mine = [r for r in rows if r.profile == profile]
        room, pieces = Counter(), defaultdict(list)
        for r in mine:
            room[r.container] += r.tokens
            pieces[r.id].append((r.piece_ix, r.tokens))
        assert max(room.values()) <= capacity
        for n, t in enumerate(tokens):
            got = sorted(pieces[n])
            assert [p for p, _ in got] == list(range(len(got))) and sum(k for _, k in got) == t
            assert len(got) == max(1, -(-t // capacity))
        assert len(pieces[None]) == 2
        volume = sum(tokens) + 6
        assert len(room) <= -(-volume // capacity) * 1.1 + 1


def test_repeated_and_null_ids_above_the_capacity_have_containers_of_their_own(spark):
    counts = spark.createDataFrame([(1, 25), (1, 25), (None, 12), (None, 13)], "id bigint, tokens bigint")
    got = packing.pack(counts, {"a": 10, "b": 12})
    assert {tuple(r) for r in got.groupBy("profile").agg(F.sum("tokens")).collect()} == {("a", 75), ("b", 75)}
    rooms = got.groupBy("profile", "container").agg(F.sum("tokens").alias("t")).collect()
    assert all(r.t <= {"a": 10, "b": 12}[r.profile] for r in rooms)


def test_offsets_of_ranks_are_never_broadcast(spark):
    old, packing._SALT_ROWS = packing._SALT_ROWS, 10  # one offset for nearly every item
    try:
        got = packing.pack(spark.range(5000).selectExpr("id", "id % 97 as tokens"), {"a": 40, "b": 200})
    finally:
        packing._SALT_ROWS = old
    assert {tuple(r) for r in got.groupBy("profile").agg(F.sum("tokens")).collect()} == {(p, sum(n % 97 for n in range(5000))) for p in "ab"}
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_token_counts_and_edge_texts(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, "größe 中文\r\n" * 5000)], "doc_id bigint, text string")
    got = dict(packing.token_counts(df, F.col("doc_id"), F.col("text")).collect())
    assert got[1] == 2 and got[2] == 0 and got[3] == 0 and got[4] > 20_000
    assert packing.pack(packing.token_counts(df.limit(0), F.col("doc_id"), F.col("text")), {"a": 5}).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df.selectExpr("doc_id as id", "doc_id as tokens"), {"a": 0})


def brute_leaks(items, docs, least):
    grams = defaultdict(set)
    for i, t in items:
        w = [x.lower() for x in leaks.WORD.findall(t or "")]
        for k in range(len(w) - least + 1):
            grams[tuple(w[k : k + least])].add(i)
    out = set()
    for d, t in docs:
        w = [x.lower() for x in leaks.WORD.findall(t or "")]
        for k in range(len(w) - least + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + least]), ())}
    return out


def test_leaks_match_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["one", "Two", "drei", "größe", "İstanbul", "中文字", "x_y", "4"] + [f"w{n}" for n in range(40)]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    items = [(n, text(rng.randrange(0, 50))) for n in range(40)] + [(100, None), (101, ""), (None, text(30))]
    items += [(102, items[3][1].upper()), (3, items[3][1])]
    docs = []
    for n in range(120):
        parts = [text(rng.randrange(0, 30))]
        source = leaks.WORD.findall(rng.choice(items[:40])[1])
        if len(source) > 4:
            at = rng.randrange(len(source))
            parts += [" ".join(source[at : at + rng.randrange(3, 25)]), text(rng.randrange(0, 30))]
        docs.append((n, " ".join(parts)))
    docs += [(500, None), (501, ""), (None, items[0][1]), (7, docs[7][1])]
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id bigint, text string, doc_id int")
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    for group in (leaks.GROUP, 2):
        got = leaks.leaks(i, d, F.col("item_id"), F.col("text"), F.col("doc_id"), F.col("text"), 5, group)
        assert {(r.doc_id, r.item_id) for r in got.collect()} == brute_leaks([x for x in items if x[0] is not None], [x for x in docs if x[0] is not None], 5)
    assert leaks.leaks(i.limit(0), d, F.col("item_id"), F.col("text"), F.col("doc_id"), F.col("text")).count() == 0


def test_tiles_cover_reordered_passages():
    item = np.arange(1, 41, dtype=np.uint64)
    doc = np.concatenate([item[20:], [99], item[:20], [99], item[10:16]]).astype(np.uint64)
    seeds = [(d, i) for d in range(len(doc) - 4) for i in range(len(item) - 4) if (doc[d : d + 5] == item[i : i + 5]).all()]
    assert sorted(t[1:] for t in leaks.tile(doc, item, seeds, 5)) == [(0, 20), (20, 20)]


def test_periodic_texts_stay_small(spark):
    i = spark.createDataFrame([(1, "a " * 3000), (2, "b c " * 500)], "item_id bigint, text string")
    d = spark.createDataFrame([(1, "a " * 200_000), (2, "x " + "c b " * 50_000), (3, "a " * 14)], "doc_id bigint, text string")
    got = leaks.leaks(i, d, F.col("item_id"), F.col("text"), F.col("doc_id"), F.col("text"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(1, 1), (2, 2)}


def brute_tiles(doc, item, least):
    """Greedy string tiling over every diagonal, word by word."""
    doc, item, tiles = list(doc), list(item), []
    while True:
        best = None
        for d in range(len(doc)):
            for i in range(len(item)):
                n = 0
                while d + n < len(doc) and i + n < len(item) and doc[d + n] is not None and doc[d + n] == item[i + n]:
                    n += 1
                if n >= least and (best is None or (-n, d, i) < best):
                    best = (-n, d, i)
        if best is None:
            return tiles
        n, d, i = -best[0], best[1], best[2]
        tiles.append((d, i, n))
        doc[d : d + n] = item[i : i + n] = [None] * n


def test_tiles_of_repetitive_texts_equal_brute_force(spark):
    rng = random.Random(5)
    items, docs = [], []
    for n in range(12):
        letters = "ab" if n % 2 else "abc"
        items.append((n, " ".join(rng.choice(["a a a", "a b", *letters]) for _ in range(rng.randrange(4, 22)))))
        docs.append((n, " ".join(rng.choice(["a a a a", "a b", "z", *letters]) for _ in range(rng.randrange(4, 30)))))
    i, d = spark.createDataFrame(items, "item_id bigint, text string"), spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id): (r.tiles, r.longest, r.covered) for r in leaks.leaks(i, d, F.col("item_id"), F.col("text"), F.col("doc_id"), F.col("text"), 3).collect()}
    for dn, dt in docs:
        for n, it in items:
            t = brute_tiles(dt.split(), it.split(), 3)
            assert got.get((dn, n)) == ((len(t), max(x[2] for x in t), sum(x[2] for x in t)) if t else None)


def test_every_occurrence_of_a_repeated_run_counts(spark):
    passage = " ".join(f"p{n}" for n in range(6)) + " r1 r2 r3 r4 r5 r6 r7 r8 " + " ".join(f"q{n}" for n in range(6))
    items = [(1, "a " * 3000), (2, passage)]
    docs = [(1, "a " * 200_000), (2, " ".join(f"r1 r2 r3 r4 r5 r6 r7 r8 x{n}" for n in range(300)) + " " + passage)]
    i, d = spark.createDataFrame(items, "item_id bigint, text string"), spark.createDataFrame(docs, "doc_id bigint, text string")
    got = leaks.leaks(i, d, F.col("item_id"), F.col("text"), F.col("doc_id"), F.col("text"), 8).collect()
    assert {(r.doc_id, r.item_id, r.tiles, r.longest, r.covered) for r in got} == {(1, 1, 1, 3000, 3000), (2, 2, 1, 20, 20)}
