"""Differences between two copies of a table by characteristic-polynomial set reconciliation.

Each row becomes an element of the field of integers modulo 2^61 - 1 (a digest of its key and compared values). Rows fall into
buckets by key digest, a bucket holding about ``BUCKET_ROWS`` rows whatever the table's size. Per bucket and side the characteristic
polynomial prod(z - x) is evaluated at a few agreed points; that is a mergeable product, so only (bucket, points) crosses the
network. The ratio of both sides' values is a rational function whose reduced numerator and denominator have as roots
just the elements that one side lacks. It is interpolated for a bound m on its degrees, and verified at further points; buckets
that fail are evaluated again with the bound doubled, until all are verified. Each side then tests its own elements in buckets that
differ as roots, and only the rows found are fetched and compared field by field.

Defined results: keys must be unique per side (deduplicate first, see ``latest``); null keys are ignored; null equals null only; an
empty side makes every row of the other one missing; columns other than key and fields are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.session import materialize

P = (1 << 61) - 1
BUCKET_ROWS = 64
FIRST_BOUND = 16
CHECKS = 2
_P, _29, _32 = np.uint64(P), np.uint64(29), np.uint64(32)
_LOW29, _LOW32, _61, _3 = np.uint64((1 << 29) - 1), np.uint64((1 << 32) - 1), np.uint64(61), np.uint64(3)


def mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2^61 - 1 on uint64 arrays of residues."""
    ah, al, bh, bl = a >> _32, a & _LOW32, b >> _32, b & _LOW32
    mid, low = ah * bl + al * bh, al * bl
    s = ((ah * bh) << _3) + (mid >> _29) + ((mid & _LOW29) << _32) + (low & _P) + (low >> _61)
    s = (s & _P) + (s >> _61)
    return np.where(s >= _P, s - _P, s)


def sub(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(a >= b, a - b, a + _P - b)


def points(n: int) -> list[int]:
    """Agreed evaluation points, from the top of the field, where digests (below 2^60) never lie."""
    return [P - 1 - k for k in range(n)]


def _products(group: np.ndarray, x: np.ndarray, m: int) -> np.ndarray:
    """prod(z - x) of each group (sorted group numbers) at m points: shape (groups, m)."""
    at = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    out = np.empty((len(at), m), np.uint64)
    place = np.arange(len(group)) - np.repeat(at, np.diff(np.r_[at, len(group)]))
    for k, z in enumerate(points(m)):
        value, pos, g = sub(np.full(len(x), z, np.uint64), x), place, group
        while len(value) > len(at):  # neighbours within a group multiply, halving the length each time
            left = pos % 2 == 0
            has = np.r_[left[:-1] & (pos[1:] > pos[:-1]) & (g[1:] == g[:-1]), False]
            product = value.copy()
            i = np.flatnonzero(has)
            product[i] = mul(value[i], value[i + 1])
            value, pos, g = product[left], pos[left] // 2, g[left]
        out[:, k] = value
    return out


def _sketch(m: int):
    """Per batch and bucket: the number of elements and the products at m points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, x = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint64)
            order = np.argsort(bucket, kind="stable")
            bucket, x = bucket[order], x[order]
            at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            yield _sketch_batch(bucket[at], np.diff(np.r_[at, len(bucket)]), _products(bucket, x, m))

    return run


def _sketch_batch(bucket: np.ndarray, n: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    flat = pa.array(value.astype(np.int64).ravel())
    offsets = pa.array(np.arange(0, value.size + 1, value.shape[1], dtype=np.int32))
    return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(offsets, flat)], names=["bucket", "n", "value"])


_SKETCH = "bucket bigint, n bigint, value array<bigint>"


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sketches sorted by bucket in, their products out."""
    carry: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if carry is not None:
            batch = pa.Table.from_batches([carry, batch]).combine_chunks().to_batches()[0]
        bucket, n = batch.column("bucket").to_numpy(zero_copy_only=False), batch.column("n").to_numpy(zero_copy_only=False)
        value = batch.column("value").flatten().to_numpy(zero_copy_only=False).astype(np.uint64).reshape(len(bucket), -1)
        at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        total, size = value[at].copy(), np.diff(np.r_[at, len(bucket)])
        for k in range(1, int(size.max())):
            i = np.flatnonzero(size > k)
            total[i] = mul(total[i], value[at[i] + k])
        merged = _sketch_batch(bucket[at], np.add.reduceat(n, at), total)
        carry = merged.slice(merged.num_rows - 1)
        if merged.num_rows > 1:
            yield merged.slice(0, merged.num_rows - 1)
    if carry is not None:
        yield carry


def solve(rows: list[list[int]]) -> list[int] | None:
    """One solution of the linear system (coefficients..., right side) over the field, free unknowns 0; None if there is none."""
    n = len(rows[0]) - 1
    pivots: list[int] = []
    r = 0
    for c in range(n):
        p = next((i for i in range(r, len(rows)) if rows[i][c]), None)
        if p is None:
            continue
        rows[r], rows[p] = rows[p], rows[r]
        inverse = pow(rows[r][c], P - 2, P)
        row = rows[r] = [v * inverse % P for v in rows[r]]
        for i in range(len(rows)):
            if i != r and (f := rows[i][c]):
                rows[i] = [(v - f * w) % P for v, w in zip(rows[i], row)]
        pivots.append(c)
        r += 1
    if any(row[n] for row in rows[r:]):
        return None
    out = [0] * n
    for i, c in enumerate(pivots):
        out[c] = rows[i][n]
    return out


def _trim(a: list[int]) -> list[int]:
    while a and not a[-1]:
        a.pop()
    return a


def _divide(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    a, q, inverse = a[:], [0] * max(0, len(a) - len(b) + 1), pow(b[-1], P - 2, P)
    for k in range(len(a) - len(b), -1, -1):
        q[k] = f = a[k + len(b) - 1] * inverse % P
        if f:
            for i, v in enumerate(b):
                a[k + i] = (a[k + i] - f * v) % P
    return q, _trim(a[: len(b) - 1])


def _value(a: list[int], z: int) -> int:
    out = 0
    for v in reversed(a):
        out = (out * z + v) % P
    return out


def interpolate(n_a: int, n_b: int, value_a: list[int], value_b: list[int]) -> tuple[list[int], list[int]] | None:
    """Reduced monic (numerator, denominator), lowest coefficient first, of the rational function value_a / value_b; None if it does not verify.

    The last CHECKS points verify; those before give the degree bound."""
    m, delta = len(value_a) - CHECKS, n_a - n_b
    if abs(delta) > m:
        return None
    high = (m + abs(delta)) // 2
    low = high - abs(delta)
    da, db = (high, low) if delta >= 0 else (low, high)
    zs = points(m + CHECKS)
    rows = []
    for z, a, b in zip(zs[: da + db], value_a, value_b):
        powers = [1]
        for _ in range(max(da, db)):
            powers.append(powers[-1] * z % P)
        # num(z) * b - den(z) * a = 0 with both monic
        rows.append([*(p * b % P for p in powers[:da]), *((-p * a) % P for p in powers[:db]), (powers[db] * a - powers[da] * b) % P])
    found = solve(rows) if rows else []
    if found is None:
        return None
    num, den = [*found[:da], 1], [*found[da:], 1]
    g, h = num, den
    while h:
        g, h = h, _divide(g, h)[1]
    if len(g) > 1:
        num, den = _divide(num, g)[0], _divide(den, g)[0]
    lead = pow(den[-1], P - 2, P)
    num, den = [v * lead % P for v in num], [v * lead % P for v in den]
    if num[-1] != 1 or any((_value(num, z) * b - _value(den, z) * a) % P for z, a, b in zip(zs, value_a, value_b)):
        return None
    return num, den


_DECODED = "bucket bigint, ok boolean, num array<bigint>, den array<bigint>"


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            size = len(r["va"] or r["vb"])
            a, b = r["va"] or [1] * size, r["vb"] or [1] * size
            if r["na"] == r["nb"] and a == b:
                continue  # verified equal at all points
            done = interpolate(r["na"] or 0, r["nb"] or 0, a, b)
            rows.append({"bucket": r["bucket"], "ok": done is not None, "num": done and done[0], "den": done and done[1]})
        schema = pa.schema([("bucket", pa.int64()), ("ok", pa.bool_()), ("num", pa.list_(pa.int64())), ("den", pa.list_(pa.int64()))])
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _sketches(elements: DataFrame, m: int) -> DataFrame:
    # keys are unique and bucketed by digest, so no bucket is hot: one combining shuffle is enough
    return elements.select("bucket", "x").mapInArrow(_sketch(m), _SKETCH).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_combine, _SKETCH)


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (x, poly, ...) whose x is a root of the polynomial."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x = batch.column("x").to_numpy(zero_copy_only=False).astype(np.uint64)
        poly = batch.column("poly")
        coefficients = poly.flatten().to_numpy(zero_copy_only=False).astype(np.uint64)
        size = poly.value_lengths().to_numpy(zero_copy_only=False)
        end = np.cumsum(size)
        acc = np.zeros(len(x), np.uint64)
        for k in range(int(size.max())):
            i = np.flatnonzero(size > k)
            acc[i] = mul(acc[i], x[i]) + coefficients[end[i] - 1 - k]
            acc[i] = np.where(acc[i] >= _P, acc[i] - _P, acc[i])
        yield batch.filter(pa.array(acc == 0)).select(["key"])


def latest(df: DataFrame, key: str, order: list[str], keep: list[str]) -> DataFrame:
    """Of each key the row that is last by ``order`` (nulls first); ties fall to the greater kept values. One map-side combined aggregation, no sort of a hot key."""
    best = F.max(F.struct(*(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), *keep)).alias("_best")
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, *(F.col(f"_best.{c}").alias(c) for c in keep))


def differences(left: DataFrame, right: DataFrame, key: str, fields: list[str], names: tuple[str, str] = ("missing_in_right", "missing_in_left")) -> DataFrame:
    """(key, field): ``names[0]`` for keys that only the left copy has, ``names[1]`` for the right; else one row per field whose values differ.

    Both copies hold each key at most once. Triggers jobs: it must know how many rounds are needed."""
    digest = lambda *cols: F.conv(F.substring(F.sha2(F.concat_ws("\x1f", *cols), 256), 1, 15), 16, 10).cast("bigint")  # noqa: E731  60 bits
    # a null is told from every text by its mark
    marked = [F.coalesce(F.concat(F.lit("v"), F.col(f"_f{i}").cast("string")), F.lit("n")) for i in range(len(fields))]
    # separators inside texts are escaped by their length
    parts = [F.concat(F.length(c).cast("string"), F.lit(":"), c) for c in marked]
    sides = []
    for df in (left, right):
        rows = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), *(F.col(f).alias(f"_f{i}") for i, f in enumerate(fields)))
        sides.append(materialize(rows.select("*", digest(F.col("key").cast("string"), *parts).alias("x"), F.xxhash64("key").alias("h")), "copy"))
    n_rows = max(s.count() for s in sides)
    buckets = max(1, n_rows // BUCKET_ROWS)
    left, right = (s.withColumn("bucket", F.pmod(F.col("h"), F.lit(buckets))) for s in sides)

    m, open_buckets, found = FIRST_BOUND, None, []
    while True:
        a, b = left, right
        if open_buckets is not None:
            a, b = (s.join(open_buckets, "bucket", "left_semi") for s in (left, right))
        both = _sketches(a, m + CHECKS).select("bucket", F.col("n").alias("na"), F.col("value").alias("va")).join(_sketches(b, m + CHECKS).select("bucket", F.col("n").alias("nb"), F.col("value").alias("vb")), "bucket", "full")
        # few small rows with much to compute: a fixed number of tasks, which adaptive execution does not merge
        spread = both.repartition(max(1, min(buckets, 4 * left.sparkSession.sparkContext.defaultParallelism)))
        decoded = materialize(spread.mapInArrow(_decode, _DECODED), f"round{m}")
        found.append(decoded.filter("ok"))
        open_buckets = decoded.filter("not ok").select("bucket")
        if open_buckets.isEmpty():
            break
        m *= 2
    polys = found[0]
    for more in found[1:]:
        polys = polys.unionByName(more)

    kind = left.schema["key"].dataType.simpleString()
    hits = []
    for rows, poly in ((left, "num"), (right, "den")):
        at = polys.filter(F.size(poly) > 1).select("bucket", F.col(poly).alias("poly"))
        hits.append(rows.select("key", "x", "bucket").join(at, "bucket").mapInArrow(_roots, f"key {kind}"))
    keys = materialize(hits[0].union(hits[1]).distinct(), "keys")
    one, two = (s.select("key", F.struct(*(f"_f{i}" for i in range(len(fields)))).alias(n)).join(keys, "key", "left_semi") for s, n in ((left, "l"), (right, "r")))
    each = [F.when(~F.col(f"l._f{i}").eqNullSafe(F.col(f"r._f{i}")), F.lit(f)) for i, f in enumerate(fields)]
    differ = F.when(F.col("r").isNull(), F.array(F.lit(names[0]))).when(F.col("l").isNull(), F.array(F.lit(names[1]))).otherwise(F.array_compact(F.array(*each)))
    return one.join(two, "key", "full").select(F.col("key").alias(key), F.explode(differ).alias("field"))


def strip_root(path: Column, root: Column) -> Column:
    """``path`` without a leading ``root`` and the slash after it."""
    prefix = F.concat(root, F.lit("/"))
    return F.when(F.startswith(path, prefix), F.substr(path, F.length(prefix) + 1)).otherwise(path)
