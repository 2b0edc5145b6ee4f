"""Configuration files: JSON with comments or TOML, with chains of ``extends`` inside the project."""

from __future__ import annotations

import json
import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

MOST_EXTENDS = 10
_COMMENT = re.compile(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*[\s\S]*?\*/')
_FORBIDDEN = {"__proto__", "constructor", "prototype"}


def parse_jsonc(text: str) -> dict:
    """JSON with comments and trailing commas; comment marks inside strings stay."""
    text = _COMMENT.sub(lambda m: m[1] or " ", text.removeprefix("﻿"))
    return json.loads(re.sub(r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', lambda m: m[1] or "", text))


def merge(base: dict, over: dict) -> dict:
    """Deep merge; objects merge, everything else is replaced."""
    out = dict(base)
    for k, v in over.items():
        if k in _FORBIDDEN:
            continue
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load(path: str | Path, root: str | Path | None = None, _chain: tuple[Path, ...] = ()) -> dict:
    """A configuration with everything it extends; remote and outside files are refused, cycles and long chains are errors."""
    path = Path(path).resolve()
    root = Path(root).resolve() if root else path.parent
    if path in _chain or len(_chain) >= MOST_EXTENDS:
        raise ValueError(f"extends chain of {path} is a cycle or longer than {MOST_EXTENDS}")
    if not path.is_relative_to(root):
        raise ValueError(f"{path} lies outside of {root}")
    text = path.read_text(encoding="utf-8")
    data = tomllib.loads(text) if path.suffix == ".toml" else parse_jsonc(text)
    parents = data.pop("extends", [])
    out: dict = {}
    for parent in [parents] if isinstance(parents, str) else parents:
        if "://" in parent:
            raise ValueError(f"{parent}: remote configurations are not loaded")
        out = merge(out, load(path.parent / parent, root, (*_chain, path)))
    return merge(out, data)


@dataclass
class Config:
    """What the analysis reads of a configuration; unknown keys are kept aside, as in permissive mode."""

    rules: dict[str, str] = field(default_factory=dict)
    exclude: list[str] = field(default_factory=list)
    entrypoints: list[str] = field(default_factory=list)
    production: bool = False
    zones: dict[str, dict] = field(default_factory=dict)
    cyclomatic_threshold: int = 10
    cognitive_threshold: int = 15
    min_tokens: int = 50

    @classmethod
    def of(cls, data: dict) -> Config:
        health, dupes = data.get("health") or {}, data.get("dupes") or {}
        return cls(
            rules=dict(data.get("rules") or {}), exclude=list(data.get("exclude") or []), entrypoints=list(data.get("entrypoints") or []), production=bool(data.get("production")), zones=dict(data.get("zones") or {}),
            cyclomatic_threshold=int(health.get("cyclomaticThreshold", 10)), cognitive_threshold=int(health.get("cognitiveThreshold", 15)), min_tokens=int(dupes.get("minTokens", 50)),
        )
