"""The two glob dialects as anchored regular expressions (driver-side)."""

from __future__ import annotations

import re


def path_glob(glob: str) -> str:
    """``**/`` any directories, ``*`` within a segment, ``?`` one character, ``{a,b}`` alternatives, ``[...]`` classes."""
    out, i = [], 0
    depth = 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
            continue
        if glob.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        close = glob.find("]", i + 1)
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and close > 0:
            body = glob[i + 1 : close]
            out.append(f"[{'^' + body[1:] if body[:1] == '!' else body}]")
            i = close + 1
            continue
        elif c == "{" and "}" in glob[i:]:
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        else:
            out.append(re.escape(c))
        i += 1
    return f"^{''.join(out)}$"


def zone_glob(glob: str) -> str:
    """The zone dialect: ``**`` anything, ``*`` within a segment, ``?`` one character; braces are literal."""
    out = []
    for part in re.split(r"(\*\*|\*|\?)", glob):
        out.append({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part)))
    return f"^{''.join(out)}$"


def is_glob(text: str) -> bool:
    return any(c in text for c in "*?[{")
