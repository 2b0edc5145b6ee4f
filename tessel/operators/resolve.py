"""Module resolution as a ranked candidate join: every path an import may mean is listed with its priority, joined to the files that exist, and the best one kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the order in which extensions are tried
EXTENSIONS = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts", ".d.ts", ".json"]
SCRIPT_FALLBACK = {".js": [".ts", ".tsx", ".d.ts"], ".jsx": [".tsx"], ".mjs": [".mts"], ".cjs": [".cts"]}
INDEX = ["/index.ts", "/index.tsx", "/index.d.ts", "/index.js", "/index.jsx"]
PYTHON = [".py", "/__init__.py", ".pyi"]


def fold(path: Column) -> Column:
    """``path`` without ``.`` and ``..`` segments."""
    step = lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(x.isin("", "."), acc).otherwise(F.array_append(acc, x))
    folded = F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")
    return F.when(F.startswith(path, F.lit("/")), F.concat(F.lit("/"), folded)).otherwise(folded)


def canonical(path: Column) -> Column:
    """One spelling of a path: forward slashes, a small drive letter, no ``.``, ``..`` or trailing slash."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    drive = F.regexp_extract(plain, r"^([A-Za-z]):/", 1)
    return F.when(drive != "", F.concat(F.lower(drive), F.lit(":/"), fold(F.substr(plain, F.lit(4))))).otherwise(fold(plain))


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def script_candidates(base: Column) -> Column:
    """array<struct<rank, path>> of what a relative script import of the folded ``base`` may mean."""
    out = [F.struct(F.lit(n).alias("rank"), F.concat(base, F.lit(x)).alias("path")) for n, x in enumerate(EXTENSIONS)]
    n = len(EXTENSIONS)
    for ext, others in SCRIPT_FALLBACK.items():
        stem = F.when(F.endswith(base, F.lit(ext)), F.substr(base, F.lit(1), F.length(base) - len(ext)))
        for other in others:
            out.append(F.struct(F.lit(n).alias("rank"), F.concat(stem, F.lit(other)).alias("path")))
            n += 1
    out += [F.struct(F.lit(n + k).alias("rank"), F.concat(base, F.lit(x)).alias("path")) for k, x in enumerate(INDEX)]
    return F.filter(F.array(*out), lambda c: c["path"].isNotNull())


def python_candidates(base: Column) -> Column:
    return F.array(*(F.struct(F.lit(n).alias("rank"), F.concat(base, F.lit(x)).alias("path")) for n, x in enumerate(PYTHON)))


def python_base(file: Column, root: Column, module: Column) -> Column:
    """Folded path of a Python module name: leading dots climb from the file, an absolute name starts at the root."""
    dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    tail = F.replace(F.regexp_replace(module, r"^\.+", ""), F.lit("."), F.lit("/"))
    climb = F.repeat(F.lit("/.."), F.greatest(dots - 1, F.lit(0)))
    start = F.when(dots > 0, F.concat(dirname(file), climb)).otherwise(root)
    return fold(F.concat(start, F.lit("/"), tail))


def resolve(imports: DataFrame, files: DataFrame, candidates: Column) -> DataFrame:
    """imports plus ``dst``, the existing file of the best candidate, null if there is none. Equal candidate lists are resolved once."""
    wanted = imports.select(F.xxhash64(candidates).alias("_c"), candidates.alias("cand")).dropDuplicates(["_c"])
    listed = wanted.select("_c", F.inline("cand").alias("rank", "path"))
    best = listed.join(files.select(F.col("file").alias("path")).distinct(), "path").groupBy("_c").agg(F.min_by("path", "rank").alias("dst"))
    return imports.withColumn("_c", F.xxhash64(candidates)).join(best, "_c", "left").drop("_c")


def package_of(spec: Column) -> Column:
    """The package a bare specifier names; null for relative, absolute and URL-like ones."""
    bare = ~spec.rlike(r"^(\.|/|#|[A-Za-z][A-Za-z0-9+.\-]*:)")
    return F.when(bare & (spec != ""), F.regexp_extract(spec, r"^(@[^/]+/[^/]+|[^@/][^/]*)", 1))


def normal_name(name: Column) -> Column:
    """A Python distribution name without extras and version, in its normal form."""
    return F.lower(F.regexp_replace(F.regexp_extract(F.trim(name), r"^([A-Za-z0-9][A-Za-z0-9._\-]*)", 1), r"[-_.]+", "-"))

# fixed values: platform suffixes that go before the plain file, and where built code has its source
PLATFORMS = ["ios", "android", "native"]
BUILT = ["dist", "build", "out", "lib", "esm", "cjs"]
VENVS = [".venv", "venv", "env", ".env"]


def platform_candidates(base: Column, platforms: list[str] = PLATFORMS) -> Column:
    """Candidates with platform suffixes first, then the plain ones."""
    n = len(platforms) * (len(EXTENSIONS) - 1)
    first = [F.struct(F.lit(i * (len(EXTENSIONS) - 1) + k).alias("rank"), F.concat(base, F.lit(f".{p}{x}")).alias("path")) for i, p in enumerate(platforms) for k, x in enumerate(EXTENSIONS[1:])]
    rest = F.transform(script_candidates(base), lambda c: F.struct((c["rank"] + n).alias("rank"), c["path"].alias("path")))
    return F.concat(F.array(*first), rest)


def source_candidates(base: Column) -> Column:
    """For a path in a directory of built code, what it was built from in ``src``; empty for other paths."""
    built = "/(?:" + "|".join(BUILT) + ")/"
    moved = F.regexp_replace(base, built, "/src/")
    stem = F.regexp_replace(moved, r"\.(?:d\.ts|[cm]?jsx?)$", "")
    return F.when(base.rlike(built), script_candidates(stem)).otherwise(F.filter(script_candidates(base), lambda _: F.lit(False)))


def venv_candidates(root: Column, module: Column, versions: list[str]) -> Column:
    """Where an installed Python package lies in a virtual environment below the root."""
    head = F.split(module, r"\.")[0]
    dirs = [f"/{v}/lib/python{x}/site-packages/" for v in VENVS for x in versions] + [f"/{v}/Lib/site-packages/" for v in VENVS]
    ends = ["/__init__.py", ".py"]
    return F.array(*(F.struct(F.lit(n * len(ends) + k).alias("rank"), F.concat(root, F.lit(d), head, F.lit(e)).alias("path")) for n, d in enumerate(dirs) for k, e in enumerate(ends)))
