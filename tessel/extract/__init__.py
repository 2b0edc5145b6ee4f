"""Source text to relations: declarations, imports, uses and function metrics of each file."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.extract.components import HANDLERS
from tessel.extract.python_source import extract_python
from tessel.extract.script_source import extract_script

RANGE = "start_off int, end_off int, line int"
DECL = f"kind string, name string, exported boolean, {RANGE}, members array<string>, bases array<string>, annotation string, callee string, decorated array<string>, fields array<string>"
SCHEMA = f"""project string, file string, lang string, failed boolean, whole boolean,
decls array<struct<{', '.join(x.replace(' ', ': ', 1) for x in DECL.split(', '))}>>,
imports array<struct<kind: string, source: string, resolvable: boolean, start_off: int, end_off: int, line: int, names: array<string>>>,
usages array<struct<kind: string, name: string, off: int>>,
functions array<struct<name: string, cyclomatic: int, cognitive: int, mi: double, loc: int, start_off: int, end_off: int, line: int>>"""


def extract(file: str, content: str | None) -> dict:
    """The relations of one file; unreadable content is an empty file, content that does not parse is marked as failed and gives what can be read."""
    if content is None:
        return {"failed": False, "decls": [], "imports": [], "usages": [], "functions": []}
    handler = extract_python if file.endswith((".py", ".pyi")) else HANDLERS.get("." + file.rsplit(".", 1)[-1], extract_script)
    return handler(content.removeprefix("﻿"))


def inventory(files: DataFrame) -> DataFrame:
    """files(project, file, content) -> one nested row per file. The text goes no further than this stage."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for project, file, content in zip(batch["project"], batch["file"], batch["content"]):
                got = extract(file, content)
                rows.append({"project": project, "file": file, "lang": "py" if file.endswith((".py", ".pyi")) else "ts", "whole": not got["failed"], **got})
            yield pd.DataFrame(rows, columns=["project", "file", "lang", "failed", "whole", "decls", "imports", "usages", "functions"])

    return files.filter("file is not null").select("project", "file", "content").mapInPandas(run, SCHEMA)


def exploded(rows: DataFrame, what: str) -> DataFrame:
    """One of the tables decls, imports, usages and functions of an inventory."""
    return rows.select("project", "file", "lang", F.explode(what).alias("_x")).select("project", "file", "lang", "_x.*")


def file_metrics(rows: DataFrame) -> DataFrame:
    """(project, file, cyclomatic, cognitive, mi, loc): sums and the mean index per file; a file without functions has 0, 0, 100, 0."""
    f = exploded(rows, "functions").groupBy("project", "file").agg(F.sum("cyclomatic").alias("c"), F.sum("cognitive").alias("g"), F.round(F.avg("mi"), 6).alias("m"), F.sum("loc").alias("l"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return rows.select("project", "file").join(f, ["project", "file"], "left").select("project", "file", zero("c").alias("cyclomatic"), zero("g").alias("cognitive"), F.coalesce("m", F.lit(100.0)).alias("mi"), zero("l").alias("loc"))
