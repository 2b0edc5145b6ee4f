"""Report formats as columns over findings(kind, severity, file, line, col, message); a sink writes them as text and adds its envelope once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEEP_NULLS = {"ignoreNullFields": "false"}


def compact() -> Column:
    return F.concat_ws(":", "file", "line", "col", "severity", "kind", "message")


def fingerprint() -> Column:
    return F.sha1(F.concat_ws(":", "kind", "file", "line", "message"))


def json_row() -> Column:
    return F.to_json(F.struct("kind", "severity", "file", "line", F.col("col").alias("column"), "message"), KEEP_NULLS)


def codeclimate_row() -> Column:
    severity = F.when(F.col("severity") == "error", "major").otherwise("minor")
    place = F.struct(F.col("file").alias("path"), F.struct(F.coalesce("line", F.lit(1)).alias("begin")).alias("lines"))
    return F.to_json(F.struct(F.lit("issue").alias("type"), F.col("kind").alias("check_name"), F.col("message").alias("description"), fingerprint().alias("fingerprint"), severity.alias("severity"), place.alias("location")))


def sarif_result() -> Column:
    level = F.when(F.col("severity") == "warn", "warning").otherwise(F.col("severity"))
    # what has no place has no region, and without a file no location
    region = F.when(F.col("line").isNotNull(), F.struct(F.col("line").alias("startLine"), (F.col("col") + 1).alias("startColumn")))
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    places = F.filter(F.array(place), lambda p: p["physicalLocation"]["artifactLocation"]["uri"].isNotNull())
    return F.to_json(F.struct(F.col("kind").alias("ruleId"), level.alias("level"), F.struct(F.coalesce("message", F.lit("")).alias("text")).alias("message"), places.alias("locations")))


def markdown_table(findings: DataFrame) -> DataFrame:
    """(kind, line): a table row per rule with its findings and files."""
    counts = findings.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("file").alias("files"))
    return counts.select("kind", F.concat(F.lit("| "), "kind", F.lit(" | "), "n", F.lit(" | "), "files", F.lit(" |")).alias("line"))


FORMATS = {"compact": compact, "json": json_row, "codeclimate": codeclimate_row, "sarif": sarif_result}
ENVELOPES = {
    "json": ('{"issues":[', ",", "]}"), "codeclimate": ("[", ",", "]"), "compact": ("", "\n", ""),
    "sarif": ('{"version":"2.1.0","$schema":"https://json.schemastore.org/sarif-2.1.0.json","runs":[{"tool":{"driver":{"name":"tessel","rules":[]}},"results":[', ",", "]}]}"),
}


def write_rows(findings: DataFrame, kind: str, path: str) -> None:
    """Write one report row per finding as text files, in report order; the order is a property of this sink alone."""
    ordered = findings.orderBy("file", "line", "col", "kind", "message")
    ordered.select(FORMATS[kind]().alias("value")).write.mode("overwrite").text(path)


def render(findings: DataFrame, kind: str, most: int = 100_000) -> str:
    """The whole report as one string, for results of at most ``most`` findings."""
    rows = findings.orderBy("file", "line", "col", "kind", "message").select(FORMATS[kind]().alias("value")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} findings: use write_rows")
    head, between, tail = ENVELOPES[kind]
    return head + between.join(r.value for r in rows) + tail


def human(findings: DataFrame, colour: bool = False, most: int = 100_000) -> str:
    """Findings by file for a terminal, with totals; plain unless ``colour``."""
    rows = findings.orderBy("file", "line", "col", "kind", "message").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} findings: use write_rows")
    paint = (lambda s, c: f"\x1b[{c}m{s}\x1b[0m") if colour else (lambda s, c: s)
    out, last = [], None
    for r in rows:
        if r.file != last:
            out += [""] * bool(out) + [paint(r.file, 1)]
            last = r.file
        place = f"{r.line if r.line is not None else '-'}:{r['col'] if r['col'] is not None else '-'}"
        out.append(f"  {place:>8}  {paint(r.severity, 31 if r.severity == 'error' else 33)}  {r.message}")
    errors = sum(r.severity == "error" for r in rows)
    return "\n".join([*out, *[""] * bool(out), f"{len(rows)} findings, {errors} errors, {len({r.file for r in rows})} files"])


def markdown(findings: DataFrame) -> str:
    """A summary table of the rules; as long as there are rules."""
    lines = [r.line for r in markdown_table(findings).orderBy("kind").collect()]
    return "\n".join(["| rule | findings | files |", "|-|-|-|", *lines])
