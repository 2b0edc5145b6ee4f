"""Queries of the llm problems over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.llm.language import detect
from tessel.llm.leaks import leaks
from tessel.llm.neardup import NearDuplicates
from tessel.llm.packing import fill, pack, token_counts
from tessel.llm.spans import SharedSpans
from tessel.llm.syntax import check_syntax
from tessel.session import table


def _syntax(spark: SparkSession, d: str) -> DataFrame:
    return check_syntax(table(spark, d, "files"), F.col("file"), F.col("content"), F.col("project"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Files that do not parse."""
    return _syntax(spark, d).filter("not valid").select("file").distinct()


def p1_errors(spark: SparkSession, d: str) -> DataFrame:
    """Of each file that does not parse, where its first unrecoverable error is."""
    return _syntax(spark, d).filter("not valid").select("file", "ext", "line", "col")


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    """The share of files that do not parse, per project and language."""
    files = _syntax(spark, d).groupBy("grp", "file", "ext").agg(F.min("valid").alias("valid"))
    lang = F.when(F.col("ext").isin("py", "pyi"), "py").otherwise("ts").alias("lang")
    counts = files.groupBy(F.col("grp").alias("project"), lang).agg(F.count("*").alias("files"), F.count_if(~F.col("valid")).alias("invalid"))
    return counts.withColumn("share", F.round(F.col("invalid") / F.col("files"), 4))


def _spans(spark: SparkSession, d: str) -> SharedSpans:
    return SharedSpans(table(spark, d, "files"), F.col("file"), F.col("content"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of files that share a run of at least 160 characters."""
    return _spans(spark, d).pairs()


def p4_shared(spark: SparkSession, d: str) -> DataFrame:
    """Of each file how many of its characters lie in such a run."""
    return _spans(spark, d).shared()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of files at least 0.6 of whose three-word sequences are common."""
    return NearDuplicates(table(spark, d, "files"), F.col("file"), F.col("content")).pairs()


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """Of each file with a near-duplicate its group and its number of links."""
    return NearDuplicates(table(spark, d, "files"), F.col("file"), F.col("content")).groups()


def _profiles(spark: SparkSession, d: str) -> dict[str, int]:
    return {r.profile: r.capacity_tokens for r in table(spark, d, "pack_profiles").filter("profile is not null").distinct().limit(1001).collect()}


def _packing(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, int]]:
    profiles = _profiles(spark, d)
    return pack(token_counts(table(spark, d, "documents"), F.col("doc_id"), F.col("text")), profiles), profiles


def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    """A container for every document, or each piece of one above the capacity, for each profile."""
    return _packing(spark, d)[0].withColumnRenamed("id", "doc_id")


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers of each profile are, beside the least number of containers by volume."""
    return fill(*_packing(spark, d))


def p7_valid(spark: SparkSession, d: str) -> DataFrame:
    """Of each profile how many documents are packed, how many containers hold more than they may, and how many documents lack a piece before another."""
    packing, profiles = _packing(spark, d)
    capacity = F.create_map(*(F.lit(x) for p, c in profiles.items() for x in (p, c)))[F.col("profile")]
    rooms = packing.groupBy("profile", "container").agg(F.sum("tokens").alias("t")).groupBy("profile").agg(F.count_if(F.col("t") > capacity).alias("overfull"))
    pieces = packing.groupBy("profile", "id", "piece_ix").agg(F.count("*").alias("n"))
    before = F.lag("n").over(Window.partitionBy("profile", "id").orderBy("piece_ix"))
    last = F.lag("piece_ix").over(Window.partitionBy("profile", "id").orderBy("piece_ix"))
    gap = (F.col("piece_ix") > 0) & (F.coalesce(before < F.col("n"), F.lit(True)) | (F.coalesce(last, F.lit(-1)) != F.col("piece_ix") - 1))
    checked = pieces.withColumn("gap", gap).groupBy("profile").agg(F.sum(F.when(F.col("piece_ix") == 0, F.col("n")).otherwise(0)).alias("documents"), F.count_if("gap").alias("broken"))
    return checked.join(rooms, "profile").select("profile", "documents", "overfull", "broken")


def _leaks(spark: SparkSession, d: str, least: int) -> DataFrame:
    return leaks(table(spark, d, "eval_items"), table(spark, d, "documents"), F.col("item_id"), F.col("text"), F.col("doc_id"), F.col("text"), least)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Items and documents that share a run of at least 15 words."""
    return _leaks(spark, d, 15).select("item_id", "doc_id")


def p8_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Items of which at least half the words lie in tiles of 8 words or more of a document, in whatever order."""
    covered = _leaks(spark, d, 8).filter("2 * covered >= item_words")
    return covered.select("doc_id", "item_id", "tiles", "longest", F.round(F.col("covered") / F.col("item_words"), 4).alias("coverage"))


def _languages(spark: SparkSession, d: str) -> DataFrame:
    return detect(table(spark, d, "documents"), F.col("doc_id"), F.col("text"), F.col("lang"), table(spark, d, "lang_codes"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Languages of passages of at least two sentences that are not what the document's label says."""
    other = ~F.col("lang").eqNullSafe(F.col("label"))
    return _languages(spark, d).filter((F.col("sentences") >= 2) & other).select(F.col("id").alias("doc_id"), "lang").distinct()


def p9_segments(spark: SparkSession, d: str) -> DataFrame:
    """The language and a confidence of every segment."""
    return _languages(spark, d).filter("lang is not null").select(F.col("id").alias("doc_id"), "start", "end", "lang", "sentences", "confidence")


def p9_documents(spark: SparkSession, d: str) -> DataFrame:
    """Each document's main language by the letters of its segments, with their mean confidence; no language with confidence 0 where there is no sentence."""
    per = _languages(spark, d).groupBy("id", "label", "lang").agg(F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("confidence")).alias("wc"))
    ratio = lambda x, y: F.round(F.coalesce(F.try_divide(x, y), F.lit(0.0)), 4)
    best = per.groupBy("id", "label").agg(F.max(F.struct("w", "lang", "wc")).alias("b"), F.sum("w").alias("all"))
    return best.select(F.col("id").alias("doc_id"), "label", F.col("b.lang").alias("lang"), ratio("b.wc", "b.w").alias("confidence"), ratio("b.w", "all").alias("share"))


QUERIES = {"p1_found": p1_found, "p1_errors": p1_errors, "p1_rates": p1_rates, "p4_found": p4_found, "p4_shared": p4_shared, "p5_found": p5_found, "p5_groups": p5_groups, "p7_packing": p7_packing, "p7_fill": p7_fill, "p7_valid": p7_valid, "p8_found": p8_found, "p8_coverage": p8_coverage, "p9_found": p9_found, "p9_segments": p9_segments, "p9_documents": p9_documents}
_GRAMS = """f AS (SELECT DISTINCT file, content FROM files WHERE content IS NOT NULL),
p AS (SELECT file, i, md5(substr(content, i, 160)) AS k FROM (SELECT file, content, unnest(range(1, greatest(length(content) - 158, 1))) AS i FROM f)),
g AS (SELECT DISTINCT file, k FROM p)"""
_WORDS = r"'[\p{L}\p{N}_]+'"
_NEAR = f"""f AS (SELECT DISTINCT file, regexp_extract_all(content, {_WORDS}) AS w FROM files WHERE content IS NOT NULL),
s AS (SELECT DISTINCT file, array_to_string(list_slice(w, i, i + 2), ' ') AS k FROM (SELECT file, w, unnest(range(1, len(w) - 1)) AS i FROM f WHERE len(w) >= 30)), n AS (SELECT file, count(*) AS n FROM s GROUP BY file),
j AS (SELECT a.file AS file_a, b.file AS file_b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.file < b.file GROUP BY ALL),
p AS (SELECT file_a, file_b FROM j JOIN n x ON x.file = file_a JOIN n y ON y.file = file_b WHERE 10 * c >= 6 * (x.n + y.n - c))"""

ORACLES = {
    "p4_found": f"WITH {_GRAMS} SELECT DISTINCT a.file AS file_a, b.file AS file_b FROM g a JOIN g b ON a.k = b.k AND a.file < b.file",
    "p4_shared": f"""WITH {_GRAMS}, s AS (SELECT k FROM g GROUP BY k HAVING count(*) > 1),
c AS (SELECT file, i, lead(i) OVER (PARTITION BY file ORDER BY i) AS n FROM (SELECT DISTINCT p.file, p.i FROM p JOIN s USING (k))), t AS (SELECT file, sum(least(160, coalesce(n - i, 160)))::BIGINT AS shared FROM c GROUP BY file)
SELECT file, length(content) AS n_chars, coalesce(shared, 0) AS shared_chars FROM f LEFT JOIN t USING (file)""",
    "p5_found": f"WITH {_NEAR} SELECT file_a, file_b FROM p",
    "p5_groups": f"""WITH RECURSIVE {_NEAR}, e AS (SELECT file_a AS a, file_b AS b FROM p UNION ALL SELECT file_b, file_a FROM p), c(node, low) AS (SELECT a, least(a, min(b)) FROM e GROUP BY a UNION SELECT e.a, c.low FROM e JOIN c ON e.b = c.node WHERE c.low < e.a)
SELECT node AS file, min(low) AS grp, (SELECT count(*) FROM e WHERE e.a = c.node) AS links FROM c GROUP BY node""",
    "p7_valid": "SELECT profile, (SELECT count(*) FROM documents) AS documents, 0 AS overfull, 0 AS broken FROM pack_profiles",
    "p8_found": f"""WITH i AS (SELECT DISTINCT item_id, list_transform(regexp_extract_all(text, {_WORDS}), lambda x: lower(x)) AS w FROM eval_items WHERE text IS NOT NULL AND item_id IS NOT NULL),
d AS (SELECT DISTINCT doc_id, list_transform(regexp_extract_all(text, {_WORDS}), lambda x: lower(x)) AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
gi AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, n, n + 14), ' ') AS k FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 1))) AS n FROM i)),
gd AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, n, n + 14), ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 13, 1))) AS n FROM d))
SELECT DISTINCT item_id, doc_id FROM gi JOIN gd USING (k)""",
}
