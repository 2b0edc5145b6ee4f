"""Candidate pairs from shared keys, without ever holding an unbounded group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_keys(rows: DataFrame) -> DataFrame:
    """(key, id, n) of distinct (key, id) rows whose key at least two ids have. The count combines map-side; only keys that are shared meet their rows again."""
    live = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    return rows.join(live, "key")


def _within(members: str) -> F.Column:
    tail = lambda x, i: F.transform(F.filter(members, lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))
    return F.flatten(F.transform(members, tail))


def small_pairs(live: DataFrame, cap: int) -> DataFrame:
    """(a, b), a < b: the pairs of every key that at most ``cap`` ids share."""
    groups = live.filter(F.col("n") <= cap).groupBy("key").agg(F.collect_set("id").alias("ids"))
    return groups.select(F.inline(_within("ids"))).distinct()


def block_pairs(live: DataFrame, cap: int) -> DataFrame:
    """The pairs of every key, however many ids share it: a large group is cut into blocks of about ``cap`` ids by digest, and every two blocks meet in a task of their own."""
    blocks = F.ceil(F.col("n") / F.lit(cap)).cast("int")
    own = live.select("key", "id", blocks.alias("nb"), F.pmod(F.xxhash64("id"), blocks).cast("int").alias("blk"))
    met = own.select("*", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other"))
    met = met.groupBy("key", F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi")).agg(F.collect_set(F.struct("blk", "id")).alias("m"))
    ids = lambda c: F.transform(F.filter("m", lambda x: x["blk"] == F.col(c)), lambda x: x["id"])
    both = met.select("lo", "hi", ids("lo").alias("ids"), ids("hi").alias("others"))
    across = F.flatten(F.transform("ids", lambda x: F.transform("others", lambda y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")))))
    return both.select(F.inline(F.when(F.col("lo") == F.col("hi"), _within("ids")).otherwise(across))).distinct()


def expand(pairs: DataFrame, members: DataFrame, name: str) -> DataFrame:
    """Distinct (``name``_a, ``name``_b) of pairs (a, b) of classes and, within each class, of its own members (id, name)."""
    left, right = members.select(F.col("id").alias("a"), F.col(name).alias("x")), members.select(F.col("id").alias("b"), F.col(name).alias("y"))
    across = pairs.join(left, "a").join(right, "b").select("x", "y")
    # only classes with copies: the others have no inner pair
    shared = members.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")
    inner = block_pairs(members.join(shared, "id").select(F.col("id").alias("key"), F.col(name).alias("id"), "n"), 256).select(F.col("a").alias("x"), F.col("b").alias("y"))
    return across.filter("x <> y").union(inner).select(F.least("x", "y").alias(f"{name}_a"), F.greatest("x", "y").alias(f"{name}_b")).distinct()
