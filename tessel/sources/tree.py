"""Source trees and their manifests as tables."""

from __future__ import annotations

import configparser
import json
import os
import re
import subprocess
import tomllib
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tessel.functions.globs import is_glob, path_glob

# fixed values: what counts as a source file, and which directories are never entered
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts", ".py", ".pyi", ".vue", ".svelte", ".astro", ".mdx", ".css", ".scss")
HIDDEN = {".storybook", ".vitepress", ".well-known", ".changeset", ".github"}  # dot directories that are entered all the same
SKIPPED = {"node_modules", "dist", "build", "coverage", ".git", ".turbo", ".venv", "venv", "__pycache__", ".tox", ".pytest_cache", ".mypy_cache", ".ruff_cache"}
SECTIONS = {"dependencies": "deps", "devDependencies": "dev-deps", "optionalDependencies": "optional-deps", "peerDependencies": "peer-deps"}


def discover(root: str, exclude: list[str] = ()) -> list[str]:
    """Sorted paths of the source files below ``root``; dot entries but those of ``HIDDEN`` and tool directories are not entered, exclude globs hold for relative paths."""
    banned = re.compile("|".join(path_glob(g) for g in exclude if is_glob(g)) or r"(?!)")
    out = []
    for at, dirs, names in os.walk(root):
        dirs[:] = sorted(d for d in dirs if d not in SKIPPED and (not d.startswith(".") or d in HIDDEN))
        for n in names:
            path = f"{at.replace(os.sep, '/')}/{n}"
            if n.endswith(EXTENSIONS) and not n.startswith(".") and not banned.search(os.path.relpath(path, root).replace(os.sep, "/")):
                out.append(path)
    return sorted(out)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = []
        for path in batch["file"]:
            try:
                texts.append(Path(path).read_bytes().decode("utf-8", "replace"))
            except OSError:
                texts.append(None)
        yield batch.assign(content=texts)


def read_tree(spark: SparkSession, roots: dict[str, str], exclude: list[str] = ()) -> DataFrame:
    """files(project, root, file, content) of {project: root}. The driver lists, executors read (the tree is on storage they share); an unreadable file has null content."""
    rows = [(p, root.rstrip("/"), f) for p, root in sorted(roots.items()) for f in discover(root.rstrip("/"), exclude)]
    paths = spark.createDataFrame(rows, "project string, root string, file string")
    return paths.repartition(max(1, min(len(rows) // 200, 10_000))).mapInPandas(_read, "project string, root string, file string, content string")


def from_memory(spark: SparkSession, project: str, root: str, texts: dict[str, str | None]) -> DataFrame:
    return spark.createDataFrame([(project, root, f"{root}/{p}", t) for p, t in texts.items()], "project string, root string, file string, content string")


# ---------------------------------------------------------------- manifests


def normal_name(name: str) -> str:
    m = re.match(r"[A-Za-z0-9][A-Za-z0-9._-]*", name.strip())
    return re.sub(r"[-_.]+", "-", m[0]).lower() if m else ""


def package_json(text: str) -> list[tuple[str, str, str]]:
    """(ecosystem, section, name) rows; nothing for a malformed manifest."""
    try:
        data = json.loads(text)
    except ValueError:
        return []
    if not isinstance(data, dict):
        return []
    return [("npm", short, name) for key, short in SECTIONS.items() if isinstance(data.get(key), dict) for name in data[key]]


def pyproject(text: str) -> list[tuple[str, str, str]]:
    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return []
    project, poetry = data.get("project", {}), data.get("tool", {}).get("poetry", {})
    out = [("pypi", "deps", n) for n in project.get("dependencies", [])]
    out += [("pypi", "optional-deps", n) for group in project.get("optional-dependencies", {}).values() for n in group]
    out += [("pypi", "dev-deps", n) for group in data.get("dependency-groups", {}).values() for n in group if isinstance(n, str)]
    out += [("pypi", "optional-deps" if isinstance(v, dict) and v.get("optional") else "deps", n) for n, v in poetry.get("dependencies", {}).items() if n.lower() != "python"]
    out += [("pypi", "dev-deps", n) for n in poetry.get("dev-dependencies", {})]
    out += [("pypi", "dev-deps", n) for group in poetry.get("group", {}).values() for n in group.get("dependencies", {})]
    return [(e, s, normal_name(n)) for e, s, n in out if normal_name(n)]


def setup_cfg(text: str) -> list[tuple[str, str, str]]:
    parser = configparser.ConfigParser()
    try:
        parser.read_string(text)
    except configparser.Error:
        return []
    out = [("deps", n) for n in parser.get("options", "install_requires", fallback="").splitlines()]
    if parser.has_section("options.extras_require"):
        out += [("optional-deps", n) for _, v in parser.items("options.extras_require") for n in v.splitlines()]
    return [("pypi", s, normal_name(n)) for s, n in out if normal_name(n)]


def setup_py(text: str) -> list[tuple[str, str, str]]:
    m = re.search(r"install_requires\s*=\s*\[([^\]]*)\]", text)
    return [("pypi", "deps", normal_name(n)) for n in re.findall(r"['\"]([^'\"]+)['\"]", m[1] if m else "")]


def requirements(name: str, text: str) -> list[tuple[str, str, str]]:
    section = "dev-deps" if re.search(r"dev|test", name) else "deps"
    return [("pypi", section, normal_name(line)) for line in text.splitlines() if line.strip() and line.strip()[0] not in "#-" and normal_name(line)]


def read_manifests(root: str) -> list[tuple[str, str, str, str]]:
    """(dir, ecosystem, section, name) of every manifest below a root. Of Python's, the first that exists holds: pyproject, setup.cfg, setup.py, requirements."""
    out = []
    for at, dirs, names in os.walk(root):
        dirs[:] = sorted(d for d in dirs if d not in SKIPPED and not d.startswith("."))
        text = lambda n, at=at: Path(at, n).read_text(encoding="utf-8", errors="replace")
        here = at.replace(os.sep, "/")
        if "package.json" in names:
            out += [(here, *r) for r in package_json(text("package.json"))]
        for name, parse in (("pyproject.toml", pyproject), ("setup.cfg", setup_cfg), ("setup.py", setup_py)):
            if name in names and (rows := parse(text(name))):
                out += [(here, *r) for r in rows]
                break
        else:
            for name in sorted(n for n in names if re.fullmatch(r"requirements[\w.-]*\.txt", n)):
                out += [(here, *r) for r in requirements(name, text(name))]
    return out


MANIFESTS = re.compile(r"package\.json|pyproject\.toml|setup\.cfg|setup\.py|requirements[\w.-]*\.txt|[tj]sconfig(\.[\w-]+)?\.json")


def manifest_files(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """manifests(project, root, dir, name, content) of {project: root}; of Python's manifests in one directory the first that exists stands: pyproject, setup.cfg, setup.py, requirements."""
    rows = []
    for project, root in sorted(roots.items()):
        for at, dirs, names in os.walk(root.rstrip("/")):
            dirs[:] = sorted(d for d in dirs if d not in SKIPPED and not d.startswith("."))
            here = at.replace(os.sep, "/")
            python = next((n for n in ("pyproject.toml", "setup.cfg", "setup.py") if n in names), None)
            for n in sorted(n for n in names if MANIFESTS.fullmatch(n)):
                if n in ("setup.cfg", "setup.py") and n != python or n.endswith(".txt") and python:
                    continue
                rows.append((project, root.rstrip("/"), here, n, f"{here}/{n}"))
    paths = spark.createDataFrame(rows, "project string, root string, dir string, name string, file string")
    return paths.repartition(max(1, min(len(rows) // 200, 10_000))).mapInPandas(_read, "project string, root string, dir string, name string, file string, content string")


def manifest_table(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    rows = [(p, *r) for p, root in sorted(roots.items()) for r in read_manifests(root.rstrip("/"))]
    return spark.createDataFrame(rows, "project string, dir string, ecosystem string, section string, name string")


def changed_since(root: str, ref: str) -> list[str]:
    """Sorted absolute paths that differ from ``ref``, are staged, or are modified in the working tree."""
    if not re.fullmatch(r"[\w./~^@{}-]+", ref) or ref.startswith("-"):
        raise ValueError(f"not a revision: {ref}")
    found: set[str] = set()
    for args in ([f"{ref}...HEAD"], ["--cached"], []):
        done = subprocess.run(["git", "diff", "--name-only", *args], cwd=root, capture_output=True, text=True, timeout=60, check=True)
        found |= {os.path.join(root, p) for p in done.stdout.splitlines() if p}
    return sorted(found)
