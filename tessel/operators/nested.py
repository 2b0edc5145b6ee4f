"""Nested JSON records as flat tables with parent keys, by interval labels.

A depth-first walk numbers every object of interest on the way down (``pre``) and on the way up (``post``). Each type becomes rows of
a node table; a node contains another one of the same record iff ``a.pre < b.pre and b.post < a.post``. Children find their
parents by that containment alone: in ``pre`` order, the last node of the parent's type before a child contains it or nothing does, so one
ordered pass joins all levels.

Defined results: a record that is null, is not one complete JSON text (truncated, trailing text, ``NaN``) or is no object gives
nothing. Array elements that are no objects are counted in the positions, but give no node. A level that is absent, null, or of
another type than array counts as empty. Repeated records give equal rows once. Missing fields are null; a field of another type than
declared is null in the typed column (numbers that are written as strings or fractions are not guessed). Nesting depth is not limited.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_WS = " \t\n\r"
_FLUSH = 20_000


class _Bad(ValueError):
    pass


def _constant(name: str) -> Any:
    raise _Bad(name)


def parse_json(text: str | None) -> Any:
    """The value of a complete JSON text, else ``_Bad`` or ``ValueError``."""
    if text is None:
        raise _Bad("null")
    try:
        return json.loads(text, parse_constant=_constant)
    except (_Bad, json.JSONDecodeError):
        raise
    except RecursionError:
        return _parse_deep(text)
    except ValueError:  # integers beyond the interpreter's digit limit are still JSON
        return json.loads(text, parse_constant=_constant, parse_int=float)


def _parse_deep(text: str) -> Any:
    """The same by an explicit stack, for texts nested deeper than the interpreter's own stack."""
    scan = json.JSONDecoder(parse_constant=_constant, parse_int=float).raw_decode
    holder: list[Any] = []
    stack: list[Any] = [holder]
    i, n, state = 0, len(text), "value"
    key: Any = None
    keys: list[Any] = []
    while True:
        while i < n and text[i] in _WS:
            i += 1
        top = stack[-1]
        if len(stack) == 1 and holder:
            if i < n:
                raise _Bad("trailing text")
            return holder[0]
        if i >= n:
            raise _Bad("truncated")
        c = text[i]
        if state == "after":
            if c == ",":
                i, state = i + 1, "key" if isinstance(top, dict) else "value"
            elif c == ("}" if isinstance(top, dict) else "]"):
                i += 1
                stack.pop()
                key = keys.pop()
            else:
                raise _Bad("no separator")
            continue
        if state in ("key", "first") and isinstance(top, dict):
            if c == "}" and state == "first":
                i += 1
                stack.pop()
                key, state = keys.pop(), "after"
                continue
            if c != '"':
                raise _Bad("no name")
            key, i = scan(text, i)
            while i < n and text[i] in _WS:
                i += 1
            if text[i : i + 1] != ":":
                raise _Bad("no colon")
            i, state = i + 1, "value"
            continue
        if state == "first" and c == "]":
            i += 1
            stack.pop()
            key, state = keys.pop(), "after"
            continue
        if c in "[{":
            value: Any = [] if c == "[" else {}
            i, after = i + 1, "first"
        else:
            value, i = scan(text, i)
            after = "after"
        if isinstance(top, dict):
            top[key] = value
        else:
            top.append(value)
        state = after
        if after == "first":
            keys.append(key)
            stack.append(value)


def label(record: Any, levels: list[str]) -> Iterator[tuple[int, int, int, int, dict]]:
    """(level, ix, pre, post, object) of each object on the path of arrays ``levels``; level 0 is the record. One clock gives both numbers."""
    clock = 0
    todo: list[tuple[int, int, Any, int]] = [(0, 0, record, -1)]
    while todo:
        level, ix, node, pre = todo.pop()
        clock += 1
        if pre >= 0:
            yield level, ix, pre, clock, node
            continue
        todo.append((level, ix, node, clock))
        below = node.get(levels[level]) if level < len(levels) else None
        if isinstance(below, list):
            todo.extend((level + 1, k, below[k], -1) for k in range(len(below) - 1, -1, -1) if isinstance(below[k], dict))


def _typed(value: Any, kind: str) -> Any:
    if kind == "string":
        return value if isinstance(value, str) else None
    if kind == "boolean":
        return value if isinstance(value, bool) else None
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return None
    if kind == "bigint":
        return int(value) if value == value and abs(value) < 2**63 and value == int(value) else None
    return float(value)


def node_table(df: DataFrame, key: Column, payload: Column, levels: list[str], fields: dict[str, str]) -> DataFrame:
    """Every labelled node: (key, record, level, ix, pre, post) and the declared ``fields`` (name -> string, bigint, boolean or double).

    ``levels`` names the array to descend into at each level. Equal (key, payload) rows are labelled once; ``record`` tells
    different payloads of one key apart."""
    names = list(fields)
    used = {"key", "record", "level", "ix", "pre", "post"}
    if clash := used & set(names):
        raise ValueError(f"fields may not be named {sorted(clash)}")

    columns = ["key", "record", "level", "ix", "pre", "post", *names]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for batch in batches:
            for k, digest, text in zip(batch["key"], batch["record"], batch["payload"]):
                try:
                    record = parse_json(text)
                except ValueError:
                    continue
                if isinstance(record, dict):
                    rows.extend((k, digest, level, ix, pre, post, *(_typed(node.get(f), fields[f]) for f in names)) for level, ix, pre, post, node in label(record, levels))
                if len(rows) > _FLUSH:
                    yield pd.DataFrame(rows, columns=columns, dtype=object)
                    rows = []
        if rows:
            yield pd.DataFrame(rows, columns=columns, dtype=object)

    schema = "key bigint, record string, level int, ix bigint, pre bigint, post bigint" + "".join(f", `{n}` {t}" for n, t in fields.items())
    rows = df.select(key.cast("bigint").alias("key"), payload.cast("string").alias("payload")).filter("payload is not null")
    # equal payloads of a key meet by digest; the text itself is no grouping key
    once = rows.groupBy("key", F.md5("payload").alias("record")).agg(F.first("payload").alias("payload"))
    return once.mapInPandas(run, schema)


def with_parents(nodes: DataFrame, depth: int, keys: list[str]) -> DataFrame:
    """Add to each node the position of its ancestors on level 1..depth: the containment join.

    Each level's last node before the row in ``pre`` order is its ancestor iff its interval contains the row's."""
    order = Window.partitionBy(*keys).orderBy("pre").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for level in range(1, depth + 1):
        last = F.last(F.when(F.col("level") == level, F.struct("ix", "pre", "post")), ignorenulls=True).over(order)
        nodes = nodes.withColumn(f"_a{level}", last)
    for level in range(1, depth + 1):
        a = F.col(f"_a{level}")
        nodes = nodes.withColumn(f"ix{level}", F.when((a["pre"] <= F.col("pre")) & (F.col("post") <= a["post"]), a["ix"])).drop(f"_a{level}")
    return nodes


def leaf_paths(nodes: DataFrame, depth: int, keys: list[str]) -> DataFrame:
    """One row per deepest object, and one for each object on a level above without any object below it; absent positions are -1.

    A node has nothing below it iff the next node in ``pre`` order is not inside it."""
    linked = with_parents(nodes, depth, keys)
    inside = F.lead("pre").over(Window.partitionBy(*keys).orderBy("pre")) < F.col("post")
    leaves = linked.withColumn("_below", F.coalesce(inside, F.lit(False))).filter("level > 0 and not _below").drop("_below")
    return leaves.select(*keys, *(F.coalesce(f"ix{n}", F.lit(-1)).cast("bigint").alias(f"ix{n}") for n in range(1, depth + 1)))
