"""Offsets and positions: line maps, coverage per statement and branch, and edits of texts."""

from __future__ import annotations

import bisect
import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class LineMap:
    """(line from 1, column from 0 in code points) of a character offset; ``\\n``, ``\\r\\n`` and ``\\r`` end lines, a leading byte-order mark takes no column."""

    def __init__(self, text: str):
        self.shift = 1 if text.startswith("﻿") else 0
        self.size = len(text)
        self.starts = [0]
        i = 0
        while i < len(text):
            if text[i] == "\r":
                i += 1 + (text[i + 1 : i + 2] == "\n")
                self.starts.append(i)
                continue
            if text[i] == "\n":
                self.starts.append(i + 1)
            i += 1

    def at(self, offset: int) -> tuple[int, int]:
        offset = max(0, min(offset, self.size))
        line = bisect.bisect_right(self.starts, offset)
        column = offset - self.starts[line - 1] - (self.shift if line == 1 else 0)
        return line, max(0, column)


def istanbul(functions: list[dict], source: str) -> dict:
    """Statement, function and branch maps of one script's functions (functionName, isBlockCoverage, ranges)."""
    lines = LineMap(source)

    def place(r: dict) -> dict:
        (a, b), (c, d) = lines.at(r["startOffset"]), lines.at(r["endOffset"])
        return {"start": {"line": a, "column": b}, "end": {"line": c, "column": d}}

    out: dict = {k: {} for k in ("statementMap", "s", "fnMap", "f", "branchMap", "b")}

    def statement(r: dict) -> None:
        key = str(len(out["s"]))
        out["statementMap"][key], out["s"][key] = place(r), r["count"]

    for n, fn in enumerate(functions):
        ranges = fn.get("ranges") or []
        loc = place(ranges[0]) if ranges else {"start": {"line": 1, "column": 0}, "end": {"line": 1, "column": 0}}
        out["fnMap"][str(n)] = {"name": fn.get("functionName") or "(anonymous)", "decl": {"start": loc["start"], "end": loc["start"]}, "loc": loc, "line": loc["start"]["line"]}
        out["f"][str(n)] = ranges[0]["count"] if ranges else 0
        if not ranges:
            continue
        if fn.get("isBlockCoverage") and len(ranges) > 1:
            key = str(len(out["b"]))
            out["branchMap"][key] = {"type": "branch", "loc": loc, "locations": [place(r) for r in ranges[1:]]}
            out["b"][key] = [r["count"] for r in ranges[1:]]
            for r in ranges[1:]:
                statement(r)
        else:
            statement(ranges[0])
    return out


def istanbul_table(scripts: DataFrame) -> DataFrame:
    """(file, report) of scripts(file, content, functions as JSON text of the functions array)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [json.dumps(istanbul(json.loads(f), c or "")) for f, c in zip(batch["functions"], batch["content"])]
            yield pd.DataFrame({"file": batch["file"], "report": rows})

    return scripts.select("file", "content", "functions").mapInPandas(run, "file string, report string")


def splice(text: str, edits: list[tuple[int, int, str]]) -> str | None:
    """The text after edits (start, end, new) in UTF-8 byte offsets, last first; None if one is out of bounds or two overlap."""
    data, last = text.encode(), None
    for start, end, new in sorted(edits, reverse=True):
        if not 0 <= start <= end <= len(data) or last is not None and end > last:
            return None
        data = data[:start] + new.encode() + data[end:]
        last = start
    return data.decode(errors="replace")


def apply_edits(sources: DataFrame, edits: DataFrame) -> DataFrame:
    """(file, content, status) of every file with edits(file, start, end, new_text, hash): ``applied``, ``drifted`` if the content is no longer what the hash (sha256, or null) says, ``rejected`` if the edits do not fit. Texts are new rows, nothing is changed in place."""
    grouped = edits.groupBy("file").agg(F.collect_list(F.struct("start", "end", "new_text")).alias("edits"), F.max("hash").alias("hash"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, content, todo, digest in zip(batch["file"], batch["content"], batch["edits"], batch["hash"]):
                if digest is not None and hashlib.sha256(content.encode()).hexdigest() != digest:
                    rows.append((file, content, "drifted"))
                    continue
                done = splice(content, [(e["start"], e["end"], e["new_text"]) for e in todo])
                rows.append((file, content if done is None else done, "rejected" if done is None else "applied"))
            yield pd.DataFrame(rows, columns=["file", "content", "status"])

    joined = sources.filter("content is not null").select("file", "content").join(grouped, "file")
    return joined.select("file", "content", "edits", "hash").mapInPandas(run, "file string, content string, status string")
