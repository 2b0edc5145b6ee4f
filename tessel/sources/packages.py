"""Package metadata on the driver: exports maps, path aliases, workspaces, plugins."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

from pyspark.sql import functions as F

from tessel.functions.globs import path_glob
from tessel.sources.config import parse_jsonc
from tessel.sources.tree import normal_name

CONDITIONS = ("node", "import", "require", "default")


def _target(value, conditions: tuple[str, ...], star: str) -> str | None:
    """The first target of an exports value that holds; objects go by condition in their own order, arrays by place."""
    if isinstance(value, str):
        return value.replace("*", star) if value.startswith("./") else None
    if isinstance(value, list):
        return next((t for v in value if (t := _target(v, conditions, star))), None)
    if isinstance(value, dict):
        for key, inner in value.items():
            if key == "default" or key in conditions:
                if t := _target(inner, conditions, star):
                    return t
    return None


def exports_target(exports, subpath: str = ".", conditions: tuple[str, ...] = CONDITIONS) -> str | None:
    """What ``subpath`` (``.`` or ``./x``) means in an exports field; patterns compete by their longest literal part."""
    if not isinstance(exports, dict) or not any(k.startswith(".") for k in exports):
        return _target(exports, conditions, "") if subpath == "." else None
    if subpath in exports and "*" not in subpath:
        return _target(exports[subpath], conditions, "")
    best = None
    for key in exports:
        if key.count("*") == 1:
            head, tail = key.split("*")
            if subpath.startswith(head) and subpath.endswith(tail) and len(subpath) >= len(head) + len(tail):
                rank = (len(head), len(tail))
                if best is None or rank > best[0]:
                    best = (rank, key, subpath[len(head) : len(subpath) - len(tail)])
    return _target(exports[best[1]], conditions, best[2]) if best else None


def package_entries(manifest: dict) -> list[str]:
    """Files a package.json names as its own: main, module, bin and all exports."""
    out = [manifest[k] for k in ("main", "module", "types", "browser") if isinstance(manifest.get(k), str)]
    bins = manifest.get("bin")
    out += [bins] if isinstance(bins, str) else list(bins.values()) if isinstance(bins, dict) else []
    todo = [manifest.get("exports")]
    while todo:
        v = todo.pop()
        if isinstance(v, str) and v.startswith("./"):
            out.append(v)
        elif isinstance(v, (dict, list)):
            todo.extend(v.values() if isinstance(v, dict) else v)
    return sorted({x.removeprefix("./") for x in out if isinstance(x, str)})


@dataclass
class PathAliases:
    """``paths`` of the nearest tsconfig: the pattern with the longest literal part wins, then its targets in order."""

    base: str
    paths: dict[str, list[str]]

    @classmethod
    def read(cls, path: str | Path) -> PathAliases:
        options = parse_jsonc(Path(path).read_text(encoding="utf-8")).get("compilerOptions", {})
        return cls(str((Path(path).parent / options.get("baseUrl", ".")).resolve()), options.get("paths", {}))

    def candidates(self, spec: str) -> list[str]:
        best = None
        for pattern, targets in self.paths.items():
            head, star, tail = pattern.partition("*")
            if spec == pattern if not star else spec.startswith(head) and spec.endswith(tail) and len(spec) >= len(head) + len(tail):
                rank = len(head) + len(tail) + (0 if star else 1_000_000)
                if best is None or rank > best[0]:
                    best = (rank, targets, spec[len(head) : len(spec) - len(tail)] if star else "")
        return [f"{self.base}/{t.replace('*', best[2]).removeprefix('./')}" for t in best[1]] if best else []


def ancestors(path: str, most: int = 64) -> list[str]:
    """Directories above a path, nearest first: where node_modules and manifests are looked for."""
    parts = path.split("/")[:-1]
    return ["/".join(parts[:n]) or "/" for n in range(len(parts), 0, -1)][:most]


def workspace_globs(root: str | Path) -> list[str]:
    """The package patterns of a monorepo: pnpm's list first, else the workspaces of package.json."""
    root = Path(root)
    pnpm = root / "pnpm-workspace.yaml"
    if pnpm.exists():
        lines, out = pnpm.read_text(encoding="utf-8").splitlines(), []
        inside = False
        for line in lines:
            if re.match(r"packages\s*:", line):
                inside = True
            elif inside and (m := re.match(r"\s*-\s*['\"]?([^'\"#]+)", line)):
                out.append(m[1].strip())
            elif line.strip() and not line.startswith((" ", "-", "#")):
                inside = False
        return out
    try:
        spaces = json.loads((root / "package.json").read_text(encoding="utf-8")).get("workspaces", [])
    except (OSError, ValueError, AttributeError):
        return []
    return list(spaces.get("packages", []) if isinstance(spaces, dict) else spaces)


def workspaces(root: str | Path) -> list[str]:
    """Sorted directories with a package.json that the patterns match; patterns with ``!`` take away."""
    root = Path(root)
    globs = workspace_globs(root)
    yes = [re.compile(path_glob(g.rstrip("/"))) for g in globs if not g.startswith("!")]
    no = [re.compile(path_glob(g[1:].rstrip("/"))) for g in globs if g.startswith("!")]
    dirs = [p.parent.relative_to(root).as_posix() for p in root.rglob("package.json") if "node_modules" not in p.parts]
    return sorted(d for d in dirs if d != "." and any(r.search(d) for r in yes) and not any(r.search(d) for r in no))


# ---------------------------------------------------------------- plugins


@dataclass
class Plugin:
    name: str
    detection: dict | None = None
    enablers: list[str] = field(default_factory=list)
    entry_points: list[str] = field(default_factory=list)
    always_used: list[str] = field(default_factory=list)
    tooling: list[str] = field(default_factory=list)
    used_exports: list[dict] = field(default_factory=list)
    used_members: list[str] = field(default_factory=list)
    used_decorators: list[str] = field(default_factory=list)
    manager: str = "npm"

    @classmethod
    def of(cls, data: dict) -> Plugin:
        """A definition; anything but a named object is an error."""
        if not isinstance(data, dict) or not isinstance(data.get("name"), str) or not data["name"]:
            raise ValueError("a plugin needs a name")
        lists = {a: list(data.get(b) or []) for a, b in (("enablers", "enablers"), ("entry_points", "entryPoints"), ("always_used", "alwaysUsed"), ("tooling", "toolingDependencies"), ("used_exports", "usedExports"), ("used_decorators", "usedDecorators"))}
        return cls(data["name"], data.get("detection"), used_members=[m for m in data.get("usedClassMembers") or [] if isinstance(m, str)], manager=data.get("packageManager") or "npm", **lists)

    def needs(self) -> tuple[set[str], set[str]]:
        """The dependency names and file patterns that decide whether the plugin is active."""
        if self.detection is None:
            return set(self.enablers), set()
        names, globs, todo = set(), set(), [self.detection]
        while todo:
            rule = todo.pop()
            if rule.get("type") == "dependency":
                names.add(rule["package"])
            elif rule.get("type") == "fileExists":
                globs.add(rule["pattern"])
            todo += rule.get("conditions", [])
        return names, globs

    def condition(self, has):
        """The same decision as an expression; ``has`` makes one of an atom."""
        if self.detection is None:
            return _any([has(f"dep {e}") for e in self.enablers])
        return _expression(self.detection, has)

    def active(self, npm: set[str], python: set[str], files: list[str]) -> bool:
        """By its detection if it has one, else if a dependency enables it; a name that ends with a slash is a prefix."""
        if self.detection is not None:
            return detected(self.detection, npm, python, files)
        for e in self.enablers:
            if self.manager in ("auto", "npm") and (any(n.startswith(e) for n in npm) if e.endswith("/") else e in npm):
                return True
            if self.manager in ("auto", "pip", "poetry", "uv") and normal_name(e) in python:
                return True
        return False


def _any(conditions: list):
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def _expression(rule: dict, has):
    kind = rule.get("type")
    if kind == "dependency":
        return has(f"dep {rule['package']}")
    if kind == "fileExists":
        return has(f"file {rule['pattern']}")
    if kind in ("all", "any"):
        inner = [_expression(r, has) for r in rule.get("conditions", [])]
        return _any(inner) if kind == "any" else ~_any([~x for x in inner])
    raise ValueError(f"unknown detection {kind}")


def detected(rule: dict, npm: set[str], python: set[str], files: list[str]) -> bool:
    kind = rule.get("type")
    if kind == "dependency":
        return rule["package"] in npm or normal_name(rule["package"]) in python
    if kind == "fileExists":
        pattern = re.compile(path_glob(rule["pattern"]))
        return any(pattern.search(f) for f in files)
    if kind in ("all", "any"):
        return (all if kind == "all" else any)(detected(r, npm, python, files) for r in rule.get("conditions", []))
    raise ValueError(f"unknown detection {kind}")


def load_plugins(paths: list[str | Path]) -> list[Plugin]:
    """Definitions by name; malformed ones are skipped, of two with one name the later holds."""
    out: dict[str, Plugin] = {}
    for path in paths:
        try:
            plugin = Plugin.of(json.loads(Path(path).read_text(encoding="utf-8")))
        except (OSError, ValueError):
            continue
        out[plugin.name] = plugin
    return [out[n] for n in sorted(out)]
