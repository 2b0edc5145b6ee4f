"""Duplicate token sequences by grouping m-grams.

Positions with one m-gram form a group; that is just a run of adjacent suffixes whose common prefixes are all at least m, so no suffix array is
needed and only digests are shuffled. A group whose members all move on to one group of the same size is one step of a longer
clone: along the first occurrence these steps are consecutive positions, so the length of a family is a run length, found
with one window.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions.rolling import MULTIPLIER, mix, window_hash
from tessel.session import materialize

BIN = 256  # tokens
MOST_BITS = 1 << 27  # of the sieve, which goes through the driver

_QUOTED = r"""'[^'\\\n]*(?:\\[\s\S][^'\\\n]*)*'|"[^"\\\n]*(?:\\[\s\S][^"\\\n]*)*\""""
_PLAIN = r"[A-Za-z_$][\w$]*|\d[\w.]*|[^\s\w]"
SCRIPT_TOKEN = rf"//[^\n]*|/\*[\s\S]*?\*/|{_QUOTED}|`[^`\\]*(?:\\[\s\S][^`\\]*)*`|=>|[=!]==?|&&|\|\||\?\?|\?\.|{_PLAIN}"
PYTHON_TOKEN = rf"""#[^\n]*|\'{{3}}[\s\S]*?\'{{3}}|"{{3}}[\s\S]*?"{{3}}|{_QUOTED}|->|:=|[=!<>]=|\*\*|//|{_PLAIN}"""
SCRIPT_COMMENT, PYTHON_COMMENT = r"^(//|/\*)", r"^#"


def tokens(content: Column, python: Column) -> Column:
    """Names, numbers, operators and whole strings of a source text; comments and white space are left out."""
    of = lambda token, comment: F.filter(F.regexp_extract_all(content, F.lit(token), F.lit(0)), lambda t: ~t.rlike(comment))
    return F.when(python, of(PYTHON_TOKEN, PYTHON_COMMENT)).otherwise(of(SCRIPT_TOKEN, SCRIPT_COMMENT))


def normalised(toks: Column, keywords: list[str]) -> Column:
    """Every identifier that is no keyword becomes one token: clones up to renaming."""
    return F.transform(toks, lambda t: F.when(t.rlike(r"^[A-Za-z_$]") & ~t.isin(*keywords), F.lit("IDENT")).otherwise(t))


def _digests(lists: pa.Array, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lists of tokens: a digest of each token, which lists have an m-gram, how many each has, and where its tokens begin. A token is digested once per batch."""
    sizes = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False)
    kept = np.flatnonzero(sizes >= m)
    coded = lists.flatten().dictionary_encode()
    known = np.array([xxhash.xxh3_64_intdigest(t) if t is not None else 0 for t in coded.dictionary.to_pylist()], np.uint64)
    digest = known[coded.indices.fill_null(0).to_numpy(zero_copy_only=False)] if len(kept) else known[:0]
    return digest, kept, sizes[kept] - m + 1, np.cumsum(np.r_[0, sizes])[:-1][kept]


def _anchors(digest: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """For every run of m tokens the place of its anchor, and the digests at all places: the first of the least digests of the shorter runs inside it.

    Equal runs have their anchors at the same distance, so a run whose anchor's digest is nowhere else is nowhere else."""
    short = (4 * m + 4) // 5
    value = mix(window_hash(mix(digest), short))
    best, width, wanted = np.arange(len(value)), 1, m - short + 1
    least = lambda x, y: np.where(value[y] < value[x], y, x)
    while 2 * width <= wanted:
        best, width = least(best[:-width], best[width:]), 2 * width
    rest = wanted - width
    return least(best[: len(best) - rest], best[rest:]), value


def _slot(value: np.ndarray, sieve: np.ndarray) -> np.ndarray:
    """Which values are in the sieve, by their leading digits."""
    slot = value >> np.uint64(64 - (64 * len(sieve)).bit_length() + 1)
    return (sieve[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def grams(files: DataFrame, m: int, sieve: np.ndarray | None = None) -> DataFrame:
    """(file, pos, key) of every m-gram, with a sieve of those whose anchor passes it; files(file, toks). The key is two rolling digests of 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest, kept, n, starts = _digests(batch.column(1), m)
            if not len(kept):
                continue
            first, second = window_hash(mix(digest), m).view(np.int64), window_hash(mix(digest + MULTIPLIER), m).view(np.int64)
            row = np.repeat(np.arange(len(kept)), n)
            pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = pos + starts[row]
            if sieve is not None:
                place, value = _anchors(digest, m)
                chosen = _slot(value, sieve)[place[at]]
                row, pos, at = row[chosen], pos[chosen], at[chosen]
            key = pa.StructArray.from_arrays([pa.array(first[at]), pa.array(second[at])], names=["a", "b"])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept[row])), pa.array(pos.astype(np.int32)), key], names=["file", "pos", "key"])

    kind = files.schema["file"].dataType.simpleString()
    return files.select("file", "toks").mapInArrow(run, f"file {kind}, pos int, key struct<a: bigint, b: bigint>")


def anchors(files: DataFrame, m: int) -> DataFrame:
    """(file, anchor) of the anchors of all m-grams, each place once; files(file, toks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest, kept, n, starts = _digests(batch.column(1), m)
            if not len(kept):
                continue
            row = np.repeat(np.arange(len(kept)), n)
            place, value = _anchors(digest, m)
            place = place[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + starts[row]]
            new = np.r_[True, (place[1:] != place[:-1]) | (row[1:] != row[:-1])]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept[row[new]])), pa.array(value[place[new]].view(np.int64))], names=["file", "anchor"])

    kind = files.schema["file"].dataType.simpleString()
    return files.select("file", "toks").mapInArrow(run, f"file {kind}, anchor bigint")


def sieve_of(found: DataFrame) -> np.ndarray:
    """The anchors of found(anchor) as bits at their leading digits, in 64-bit words; ``MOST_BITS`` bits at most, however many there are."""
    found = materialize(found, "repeated")
    bits = min(MOST_BITS, max(1 << 16, 1 << (16 * found.count() - 1).bit_length()))
    slot = F.shiftrightunsigned("anchor", 64 - bits.bit_length() + 1).alias("slot")
    words = found.select(slot).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("mask")).toArrow()
    out = np.zeros(bits >> 6, np.uint64)
    out[words.column("word").to_numpy()] = words.column("mask").to_numpy().view(np.uint64)
    return out


def families(positions: DataFrame, m: int) -> DataFrame:
    """(file, pos, members, length): each family by its first occurrence, how many it has, and its length in tokens. Overlapping occurrences are still in."""
    shared = positions.join(positions.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1"), "key")
    # where a position's group moves on to: one sort by file, and least and greatest in place of distinct counts, so each row is shuffled by file and by key once
    order = Window.partitionBy("file").orderBy("pos")
    ahead = lambda c: F.when(F.lead("pos").over(order) == F.col("pos") + 1, F.lead(c).over(order))
    moved = shared.select("file", "pos", "key", "members", ahead("key").alias("after"), ahead("members").alias("after_members"))
    same = (F.min("after.a") == F.max("after.a")) & (F.min("after.b") == F.max("after.b"))
    one = F.when((F.count("after") == F.count("*")) & same & (F.max("after_members") == F.max("members")), True).otherwise(False)
    groups = moved.groupBy("key").agg(F.max("members").alias("members"), F.min(F.struct("file", "pos")).alias("at"), one.alias("goes_on"))
    rows = groups.select("at.file", "at.pos", "members", "goes_on")
    # runs of consecutive first occurrences that go on; a run begins where nothing came on to it
    came = (F.lag("pos").over(order) == F.col("pos") - 1) & F.lag("goes_on").over(order) & (F.lag("members").over(order) == F.col("members"))
    rows = rows.withColumn("begins", ~F.coalesce(came, F.lit(False)))
    rows = rows.withColumn("run", F.sum(F.col("begins").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.groupBy("file", "run").agg(F.min("pos").alias("pos"), F.min("members").alias("members"), (F.count("*") + (m - 1)).alias("length")).select("file", "pos", "members", "length")


def occurrences(positions: DataFrame, found: DataFrame, m: int) -> DataFrame:
    """(family_file, family_pos, length, file, pos) of the occurrences that do not overlap an earlier one of the family in their file; families keep two or more."""
    first = positions.join(found.select("file", "pos", "length"), ["file", "pos"]).select("key", F.col("file").alias("family_file"), F.col("pos").alias("family_pos"), "length")
    rows = positions.join(first, "key").groupBy("family_file", "family_pos", "length", "file").agg(F.sort_array(F.collect_list("pos")).alias("at"))
    none = F.array().cast("array<int>")
    keep = F.aggregate("at", none, lambda acc, p: F.when((F.size(acc) == 0) | (p >= F.element_at(acc, -1) + F.col("length")), F.array_append(acc, p)).otherwise(acc))
    rows = rows.select("family_file", "family_pos", "length", "file", F.explode(keep).alias("pos"))
    n = F.count("*").over(Window.partitionBy("family_file", "family_pos", "length"))
    return rows.withColumn("_n", n).filter("_n > 1").drop("_n")


def subsumed(spans: DataFrame, width: int, ranked: bool = False) -> DataFrame:
    """(id) of families every occurrence of which lies inside an occurrence of one other, longer family; spans(id, length, file, lo, hi).

    Spans meet in bins of ``width``, in which the inner one begins; so far apart spans of one file form no pairs. ranked: or inside one of as long a
    family of a lower ``rank``, a further column."""
    rank = ["rank"] if ranked else []
    bins = F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))).alias("bin")
    a, b = spans.withColumn("bin", F.floor(F.col("lo") / width)), spans.select(F.col("id").alias("by"), F.col("length").alias("by_length"), "file", F.col("lo").alias("by_lo"), F.col("hi").alias("by_hi"), bins, *(F.col(r).alias("by_rank") for r in rank))
    longer = "(length < by_length or length = by_length and by_rank < rank)" if ranked else "length < by_length"
    inside = a.join(b, ["file", "bin"]).filter(f"id <> by and {longer} and by_lo <= lo and hi <= by_hi")
    covered = inside.groupBy("id", "by").agg(F.count_distinct("file", "lo").alias("n"))
    total = spans.groupBy("id").agg(F.count_distinct("file", "lo").alias("total"))
    return covered.join(total, "id").filter("n = total").select("id").distinct()


# ---------------------------------------------------------------- clones up to structure

_IDENT = re.compile(r"[A-Za-z_]\w*")


def _closing(toks: list[str], i: int, opens: str, closes: str) -> int:
    depth = 0
    for k in range(i, len(toks)):
        depth += (toks[k] == opens) - (toks[k] == closes)
        if depth == 0:
            return k
    return -1


def _top(toks: list[str], i: int, end: int, wanted: str) -> int:
    """The first ``wanted`` at the bracket depth of ``i``; -1 if a statement ends before it."""
    depth = 0
    for k in range(i, end):
        if depth == 0 and toks[k] == wanted:
            return k
        depth += (toks[k] in "([{") - (toks[k] in ")]}")
        if depth < 0 or depth == 0 and toks[k] == ";" and wanted != ";":
            return -1
    return -1


def _returns(toks: list[str], at: list[int]) -> tuple[list[str], list[int]]:
    """``return c ? a : b;`` as two conditional returns; new tokens are at the ``return``."""
    out, where, i = [], [], 0
    while i < len(toks):
        if toks[i] == "return":
            q = _top(toks, i + 1, len(toks), "?")
            c = _top(toks, q + 1, len(toks), ":") if q > 0 else -1
            e = _top(toks, c + 1, len(toks), ";") if c > 0 else -1
            if e > 0:
                r = at[i]
                out += ["if", "(", *toks[i + 1 : q], ")", "return", *toks[q + 1 : c], ";", "return", *toks[c + 1 : e], ";"]
                where += [r, r, *at[i + 1 : q], r, r, *at[q + 1 : c], r, r, *at[c + 1 : e], r]
                i = e + 1
                continue
        out.append(toks[i])
        where.append(at[i])
        i += 1
    return out, where


def _loops(toks: list[str], at: list[int]) -> tuple[list[str], list[int]]:
    """A counted ``while`` as a ``for``; new tokens are at the first of the initial statement."""
    out, where, i = [], [], 0
    while i < len(toks):
        if toks[i] == "while" and i + 1 < len(toks) and toks[i + 1] == "(" and out and out[-1] == ";":
            t = _closing(toks, i + 1, "(", ")")
            b = _closing(toks, t + 1, "{", "}") if t > 0 and t + 1 < len(toks) and toks[t + 1] == "{" else -1
            if b > 0 and toks[b - 1] == ";":
                cut = max((k for k in range(t + 2, b - 1) if toks[k] in (";", "}")), default=t + 1)
                start = max((k for k in range(len(out) - 1) if out[k] in (";", "{", "}")), default=-1)
                init, step = out[start + 1 : -1], toks[cut + 1 : b - 1]
                if init and step:
                    init_at, r = where[start + 1 : -1], where[start + 1]
                    del out[start + 1 :], where[start + 1 :]
                    out += ["for", "(", *init, ";", *toks[i + 2 : t], ";", *step, ")", "{", *toks[t + 2 : cut + 1], "}"]
                    where += [r, r, *init_at, r, *at[i + 2 : t], r, *at[cut + 1 : b - 1], r, r, *at[t + 2 : cut + 1], r]
                    i = b + 1
                    continue
        out.append(toks[i])
        where.append(at[i])
        i += 1
    return out, where


def rewritten(toks: list[str], keywords: set[str]) -> tuple[list[str], list[int]]:
    """Tokens after two rewrites and renaming, first the returns, then the loops, and the token of the text that each stands at."""
    out, where = _loops(*_returns(toks, list(range(len(toks)))))
    return ["IDENT" if _IDENT.fullmatch(t) and t not in keywords else t for t in out], where


def structural(toks: list[str], keywords: set[str]) -> list[str]:
    """Tokens after two rewrites and renaming: ``return c ? a : b;`` as two conditional returns, a counted ``while`` as a ``for``."""
    return rewritten(toks, keywords)[0]


def structural_tokens(files: DataFrame, keywords: list[str] | dict[str, list[str]]) -> DataFrame:
    """(n, file, toks, at) with rewritten tokens; at: where they stand in the text, null if nothing was rewritten. The rewrites need a stack, so they run in Arrow batches."""

    def run(batches):
        for batch in batches:
            rows = [rewritten(list(t), set(_kept(f, keywords))) if t is not None else (None, None) for f, t in zip(batch["file"], batch["toks"])]
            same = [at is None or at == list(range(len(t))) for (_, at), t in zip(rows, batch["toks"])]
            yield batch[["n", "file"]].assign(toks=[t for t, _ in rows], at=[None if s else at for (_, at), s in zip(rows, same)])

    return files.select("n", "file", "toks").mapInPandas(run, "n bigint, file string, toks array<string>, at array<int>")


def _kept(file: str, keywords: list[str] | dict[str, list[str]]) -> list[str]:
    return keywords if isinstance(keywords, list) else keywords["py" if file.endswith(".py") else "ts"]


def find_clones(files: DataFrame, m: int, keywords: list[str] | dict[str, list[str]], types: tuple[int, ...] = (1, 2, 4)) -> DataFrame:
    """(type, file, pos, members, length) of the families of all types, without those that a longer family, or as long a one of a lower type, covers entirely.

    files(file, toks); keywords: one list, or one each for "py" and "ts". members counts the occurrences that do not overlap. Positions count the tokens of
    the text; length those that are compared, of type 4 after the rewrites. Type 3 is type 2 under another name, so type 2 covers it always."""
    if isinstance(keywords, list):
        renamed = normalised(F.col("toks"), keywords)
    else:
        renamed = F.when(F.endswith("file", F.lit(".py")), normalised(F.col("toks"), keywords["py"])).otherwise(normalised(F.col("toks"), keywords["ts"]))
    # rows of positions carry a number, not the name of their file: eight times that of the file, and the type; so all types go one way
    files = materialize(files.select(F.monotonically_increasing_id().alias("n"), "file", "toks"), "numbered")
    moved = None
    if 4 in types:
        moved = materialize(structural_tokens(files, keywords).filter("at is not null").select("n", "at"), "rewritten")
        # type 2 renames names with a dollar, type 4 does not; without such names and without a rewrite its families are those of type 2
        dollars = files.filter(F.exists("toks", lambda t: t.rlike(r"^(\$|[A-Za-z_]\w*\$)")))
        if 2 in types and moved.isEmpty() and dollars.isEmpty():
            types = tuple(t for t in types if t != 4)
    structural = materialize(structural_tokens(files, keywords).select("n", "toks"), "structural") if 4 in types else None

    # (file, toks) of all types; those that need no table of their own come from one pass
    every = files.select(F.inline(F.array(*(F.struct((F.col("n") * 8 + t).alias("file"), (renamed if t == 2 else F.col("toks")).alias("toks")) for t in types if t != 4)))) if set(types) - {4} else None
    if structural is not None:
        own = structural.select((F.col("n") * 8 + 4).alias("file"), "toks")
        every = own if every is None else every.unionByName(own)
    # a run can only be repeated if its anchor is. The sieve only saves the others the shuffle; what repeats is decided by the keys
    kind = F.col("file").bitwiseAND(7)
    seen = anchors(every, m).groupBy(F.col("anchor").bitwiseXOR(kind).alias("anchor")).agg(F.count("*").alias("times"))
    rows = grams(every, m, sieve_of(seen.filter("times > 1").select("anchor"))).withColumn("key", F.struct(F.col("key.a").bitwiseXOR(kind).alias("a"), F.col("key.b").alias("b")))
    positions = materialize(rows, "grams")
    occ = occurrences(positions, families(positions, m), m)
    occ = occ.select(F.col("file").bitwiseAND(7).cast("int").alias("rank"), F.concat_ws("/", "family_file", "family_pos").alias("id"), "length", F.floor(F.col("file") / 8).alias("n"), F.col("pos").alias("lo"), (F.col("pos") + F.col("length") - 1).alias("hi"))
    if 4 in types:
        places = moved.select("n", F.lit(4).alias("rank"), F.posexplode("at").alias("k", "at"))
        for end in ("lo", "hi"):
            occ = occ.join(places.select("n", "rank", F.col("k").alias(end), "at"), ["n", "rank", end], "left").withColumn(end, F.coalesce("at", end)).drop("at")
    occ = occ.select("rank", "id", "length", "n", "lo", (F.col("hi") + 1).alias("hi"))
    spans = materialize(occ.join(files.select("n", "file").hint("merge"), "n").drop("n"), "clones")
    found = spans.groupBy("id").agg(F.first("rank").alias("type"), F.min(F.struct("file", "lo")).alias("b"), F.count("*").alias("members"), F.first("length").alias("length"))
    return found.join(subsumed(spans, BIN, True), "id", "left_anti").select("type", "b.file", F.col("b.lo").alias("pos"), "members", "length")
