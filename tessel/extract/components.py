"""Inventories of component files and style sheets: Vue, Svelte, Astro, MDX, CSS.

Everything but the scripts is blanked out, so offsets stay, and the script scan does the rest; the markup adds uses of components and of names in expressions."""

from __future__ import annotations

import re

from tessel.extract.script_source import extract_script

_BLOCK = re.compile(r"<(script|style|template)\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>([\s\S]*?)</\1\s*>", re.I)
_TAG = re.compile(r"<([A-Za-z][\w.-]*)((?:[^>\"'{]|\"[^\"]*\"|'[^']*'|\{[^{}]*\})*)/?>")
_MUSTACHE = re.compile(r"\{\{([\s\S]*?)\}\}")
_BRACES = re.compile(r"\{([#/:@]?)\s*(?:(?:if|each|await|key|html|else if|else|then|catch)(?![\w$]))?([^{}]*)\}")
_BOUND = re.compile(r"(?:^|\s)(?:[:@#]|v-)[\w:.\-\[\]]*=(?:\"([^\"]*)\"|'([^']*)')")
_NAME = re.compile(r"(?<![\w$.])([A-Za-z_$][\w$]*)\s*(\??\.)?(?!\s*:[^:])")
_STRINGS = re.compile(r"'[^']*'|\"[^\"]*\"|`[^`]*`")
_RESERVED = set("true false null undefined this typeof instanceof in of new void if else each as await then catch return const let var function key html".split())
_COMMENT = re.compile(r"/\*[\s\S]*?\*/")
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'|url\([^)]*\)")


def blank(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with everything outside of the spans blank, line breaks kept."""
    out, last = [], 0
    for a, b in sorted(spans):
        out += [re.sub(r"[^\n]", " ", text[last:a]), text[a:b]]
        last = b
    return "".join(out) + re.sub(r"[^\n]", " ", text[last:])


def blocks(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, attributes, start, end) of the top-level script, style and template blocks."""
    return [(m[1].lower(), m[2], m.start(3), m.end(3)) for m in _BLOCK.finditer(text)]


def pascal(tag: str) -> str:
    return "".join(p[:1].upper() + p[1:] for p in tag.split("-"))


def _names(code: str, base: int, out: list[dict]) -> None:
    code = _STRINGS.sub(lambda m: " " * len(m[0]), code)
    for m in _NAME.finditer(code):
        if m[1] not in _RESERVED:
            out.append({"kind": "member" if m[2] else "identifier", "name": m[1], "off": base + m.start(1)})


def _tags(text: str, base: int, out: list[dict]) -> None:
    for m in _TAG.finditer(text):
        head = m[1].split(".")[0]
        if head[0].isupper() or "-" in head:
            out.append({"kind": "jsx", "name": pascal(head) if "-" in head else head, "off": base + m.start(1)})


def _with(script: dict, usages: list[dict]) -> dict:
    script["usages"] = sorted(script["usages"] + usages, key=lambda u: (u["off"], u["name"]))
    return script


def extract_vue(text: str) -> dict:
    found, usages = blocks(text), []
    for kind, _, a, b in found:
        if kind == "template":
            part = text[a:b]
            _tags(part, a, usages)
            for m in _MUSTACHE.finditer(part):
                _names(m[1], a + m.start(1), usages)
            for m in _TAG.finditer(part):
                for v in _BOUND.finditer(m[2]):
                    k = 1 if v[1] is not None else 2
                    _names(v[k], a + m.start(2) + v.start(k), usages)
    return _with(extract_script(blank(text, [(a, b) for k, _, a, b in found if k == "script"])), usages)


def extract_svelte(text: str) -> dict:
    found, usages = blocks(text), []
    markup = text
    for _, _, a, b in found:
        markup = markup[:a] + re.sub(r"[^\n]", " ", markup[a:b]) + markup[b:]
    _tags(markup, 0, usages)
    for m in _BRACES.finditer(markup):
        if m[1] != "/":
            _names(m[2], m.start(2), usages)
    return _with(extract_script(blank(text, [(a, b) for k, _, a, b in found if k == "script"])), usages)


def extract_astro(text: str) -> dict:
    front = re.match(r"\s*---[^\n]*\n([\s\S]*?)\n---", text)
    spans = [(front.start(1), front.end(1))] if front else []
    rest = (front.end() if front else 0)
    markup, usages = blank(text, [(rest, len(text))]), []
    spans += [(a, b) for k, _, a, b in blocks(text) if k == "script" and a >= rest]
    _tags(markup, 0, usages)
    for m in _BRACES.finditer(markup):
        _names(m[2], m.start(2), usages)
    return _with(extract_script(blank(text, spans)), usages)


def extract_mdx(text: str) -> dict:
    spans, usages, at = [], [], 0
    fence = None
    statement = False
    for line in text.splitlines(keepends=True):
        mark = re.match(r"\s*(```+|~~~+)", line)
        if mark and (fence is None or mark[1].startswith(fence)):
            fence = None if fence else mark[1]
        elif fence is None:
            statement = statement and bool(line.strip()) or bool(re.match(r"(import|export)\b", line))
            if statement:
                spans.append((at, at + len(line)))
            else:
                clean = re.sub(r"`[^`\n]*`", lambda m: " " * len(m[0]), line)
                _tags(clean, at, usages)
                for m in _BRACES.finditer(clean):
                    _names(m[2], at + m.start(2), usages)
        at += len(line)
    return _with(extract_script(blank(text, spans)), usages)


def extract_css(text: str) -> dict:
    """Class names as declarations, imported sheets and composed modules as imports, composed names as uses."""
    keep = lambda m: " " * len(m[0])
    clean = _COMMENT.sub(keep, text)
    decls, imports, usages = [], [], []
    line = lambda off: text.count("\n", 0, off) + 1

    def add(source: str, m: re.Match) -> None:
        imports.append({"kind": "static", "source": source, "resolvable": True, "start_off": m.start(), "end_off": m.end(), "line": line(m.start()), "names": []})

    for m in re.finditer(r"@import\s+(?:url\(\s*)?['\"]?([^'\")\s;]+)['\"]?\)?[^;]*;?", clean):
        add(m[1], m)
    for m in re.finditer(r"composes\s*:\s*([^;}]+)", clean):
        origin = re.search(r"\bfrom\s+(?:['\"]([^'\"]+)['\"]|global)\s*$", m[1].strip())
        if origin and origin[1]:
            add(origin[1], m)
        for name in re.finditer(r"[A-Za-z_][\w-]*", m[1].split(" from ")[0]):
            usages.append({"kind": "css-class", "name": name[0], "off": m.start(1) + name.start()})
    body = re.sub(r"composes\s*:[^;}]+|@import[^;]*;?", keep, clean)
    body = _QUOTED.sub(keep, body)
    seen = set()
    for m in re.finditer(r"\.(-?[A-Za-z_][\w-]*)(?=[^;{}]*\{)", body):
        if m[1] not in seen:
            seen.add(m[1])
            decls.append({"kind": "css-class", "name": m[1], "exported": True, "start_off": m.start(), "end_off": m.end(), "line": line(m.start()), "members": [], "bases": [], "annotation": None, "callee": None, "decorated": [], "fields": []})
    return {"failed": False, "decls": decls, "imports": imports, "usages": usages, "functions": []}


HANDLERS = {".vue": extract_vue, ".svelte": extract_svelte, ".astro": extract_astro, ".mdx": extract_mdx, ".css": extract_css, ".scss": extract_css}
