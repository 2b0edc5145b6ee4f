"""Inline suppressions, as an opt-in: ``// TOOL-ignore-next-line rule, rule`` and ``// TOOL-ignore-file``; ``#`` in Python. The catalogue does not apply them by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def suppressions(sources: DataFrame, rules: list[str], tool: str = "tessel") -> DataFrame:
    """(file, line, scope, rule, hint): one row per named rule, ``rule`` null for all rules; ``hint`` is the nearest known rule within two edits of an unknown one."""
    at = F.posexplode(F.split("content", "\n")).alias("ix", "text")
    mark = rf"(?://|#|/\*)\s*{tool}-ignore-(next-line|file)\b[ \t]*([\w,\- \t]*)"
    rows = sources.filter("content is not null").select("file", at).withColumn("scope", F.regexp_extract("text", mark, 1)).filter("scope <> ''")
    names = F.filter(F.transform(F.split(F.regexp_extract("text", mark, 2), "[,\\s]+"), lambda x: F.trim(x)), lambda x: x != "")
    rows = rows.select("file", (F.col("ix") + 1).alias("line"), "scope", F.explode_outer(names).alias("rule"))
    known = F.array(*map(F.lit, rules))
    near = F.element_at(F.array_sort(F.transform(known, lambda k: F.struct(F.levenshtein(F.col("rule"), k).alias("n"), k.alias("k")))), 1)
    return rows.withColumn("hint", F.when(~F.array_contains(known, F.col("rule")) & (near["n"] <= 2), near["k"]))


def unknown_once(marks: DataFrame) -> DataFrame:
    """(file, scope, rule, hint, line): each unknown rule of a file once for each scope, at its first line."""
    return marks.filter("hint is not null").groupBy("file", "scope", "rule", "hint").agg(F.min("line").alias("line"))


def apply_suppressions(findings: DataFrame, marks: DataFrame) -> DataFrame:
    """Findings(file, line, kind) that no suppression covers."""
    whole = marks.filter("scope = 'file'").select("file", F.col("rule").alias("_rule"))
    line = marks.filter("scope = 'next-line'").select("file", (F.col("line") + 1).alias("line"), F.col("rule").alias("_rule"))
    hit = lambda m: m["_rule"].isNull() | (m["_rule"] == findings["kind"])
    left = findings.join(whole, (findings["file"] == whole["file"]) & hit(whole), "left_anti")
    return left.join(line, (left["file"] == line["file"]) & (left["line"] == line["line"]) & (line["_rule"].isNull() | (line["_rule"] == left["kind"])), "left_anti")
