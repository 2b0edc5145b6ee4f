"""Shallow inventories of TypeScript and JavaScript by a token scan: declarations, imports, uses in expression statements, function metrics.

Variable initialisers, returned values and class bodies are not searched for uses, as the catalogue's rules expect. Offsets are in characters."""

from __future__ import annotations

import bisect
import re

from tessel.extract.metrics import maintainability, nonblank

_TOKEN = re.compile(
    r"(?P<skip>[ \t\r\f\v  ]+|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<line>\n)|(?P<word>[A-Za-z_$\u0080-\U0010ffff][\w$]*)|(?P<text>'(?:[^'\\\n]|\\[\s\S])*'?|\"(?:[^\"\\\n]|\\[\s\S])*\"?)"
    r"|(?P<template>`(?:[^`\\]|\\[\s\S])*`?)|(?P<number>\d[\w.]*)|(?P<punct>=>|\.\.\.|\?\.|\?\?=?|&&=?|\|\|=?|[=!]==?|[<>]=?|\+\+|--|[-+*/%&|^]=?|[\s\S])"
)
_REGEX = re.compile(r"/(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*")
_BEFORE_REGEX = set("(,=:[!&|?{};+-*%~^<>") | {"=>", "&&", "||", "??", "==", "===", "!=", "!==", "return", "typeof", "case"}
_BRANCH = {"if", "for", "while", "case", "catch", "&&", "||", "??"}
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
_WORDS = set("break case catch class const continue debugger default delete do else enum export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with yield let await async null true false of".split())
_CONTINUES = {".", "?.", "(", "[", ",", "=", "=>", "+", "-", "*", "/", "%", "&&", "||", "??", "?", ":", "&", "|", "^", "==", "===", "!=", "!==", "<", ">", "<=", ">=", "+=", "-=", "*=", "/=", "in", "instanceof", "as"}


class _Scan:
    def __init__(self, text: str):
        self.text = text
        self.kinds, self.words, self.at, self.ends, self.fresh = [], [], [], [], []
        pos, n, fresh, last = 0, len(text), False, ""
        while pos < n:
            m = _TOKEN.match(text, pos)
            kind = m.lastgroup
            if kind == "skip":
                fresh = fresh or "\n" in m[0]
            elif kind == "line":
                fresh = True
            else:
                if m[0][0] == "/" and kind == "punct" and (last in _BEFORE_REGEX or not last):
                    m = _REGEX.match(text, pos) or m
                    kind = "regex" if len(m[0]) > 2 else kind
                last = m[0]
                self.kinds.append(kind)
                self.words.append(last)
                self.at.append(pos)
                self.ends.append(m.end())
                self.fresh.append(fresh)
                fresh = False
            pos = m.end()
        # partner of every bracket; unclosed ones end with the file
        size = len(self.words)
        self.match = [size] * size
        stack: list[int] = []
        closed = 0
        for i, (w, k) in enumerate(zip(self.words, self.kinds)):
            if k != "punct":
                continue
            if w in _OPEN:
                stack.append(i)
            elif w in _CLOSE:
                closed += 1
                if stack and _OPEN[self.words[stack[-1]]] == w:
                    self.match[stack.pop()] = i
                    closed -= 1
        self.balanced = not stack and not closed
        self.size = size
        self.newlines = [m.start() for m in re.finditer("\n", text)]
        self.decls, self.imports, self.usages, self.functions = [], [], [], []

    def word(self, i: int) -> str:
        return self.words[i] if i < self.size else ""

    def close(self, i: int) -> int:
        """Index after the partner of the bracket at ``i``."""
        return min(self.match[i], self.size - 1) + 1

    def line(self, offset: int) -> int:
        return bisect.bisect_left(self.newlines, offset) + 1

    def span(self, i: int, j: int) -> dict:
        start = self.at[i]
        return {"start_off": start, "end_off": self.ends[min(j, self.size) - 1], "line": self.line(start)}

    def until(self, i: int, stops: set[str]) -> int:
        """The next of ``stops`` outside brackets, or where a new statement begins on a new line."""
        first = i
        while i < self.size:
            w = self.words[i]
            if self.kinds[i] == "punct" and (w in stops or w == "}" or w == ")" or w == "]"):
                return i
            if i > first and self.fresh[i] and w not in _CONTINUES and self.words[i - 1] not in _CONTINUES and self.kinds[i] != "template":
                return i
            i = self.close(i) if self.kinds[i] == "punct" and w in _OPEN else i + 1
        return i

    def declare(self, kind: str, name: str, exported: bool, i: int, j: int, members: list[str] | None = None) -> None:
        self.decls.append({"kind": kind, "name": name, "exported": exported, **self.span(i, j), "members": members or [], "bases": [], "annotation": None, "callee": None, "decorated": [], "fields": []})

    def add_import(self, kind: str, source: str, resolvable: bool, i: int, j: int) -> None:
        self.imports.append({"kind": kind, "source": source, "resolvable": resolvable, **self.span(i, j), "names": []})

    # ------------------------------------------------------------ statements

    def block(self, i: int, end: int) -> None:
        while i < end:
            j = self.statement(i, end)
            i = j if j > i else i + 1

    def statement(self, i: int, end: int) -> int:
        w = self.words[i]
        if w == "import" and self.word(i + 1) not in ("(", "."):
            return self.static_import(i)
        if w == "export":
            return self.export(i, end)
        return self.declaration(i, i, False, end) or self.plain(i, end)

    def static_import(self, i: int) -> int:
        j = i + 1
        while j < self.size and self.kinds[j] != "text" and not (self.fresh[j] and self.word(j) in _WORDS and self.word(j) not in ("default", "as")):
            j += 1
        if j >= self.size or self.kinds[j] != "text" or self.word(j - 1) != "from" and j != i + 1:
            return j
        if len(self.words[j]) < 3 or self.words[j][-1] != self.words[j][0]:
            return j + 1  # a string that never ends names no module
        types = self.word(i + 1) == "type" and self.word(i + 2) not in ("from", ",") and self.kinds[i + 2] != "text"
        if not types and self.word(i + 1) == "{":
            inner = self.words[i + 2 : self.match[i + 1]]
            named = [x for x in " ".join(inner).split(",") if x.strip()]
            types = bool(named) and all(x.split()[0] == "type" and len(x.split()) > 1 for x in named)
        k = j + 1 + (self.word(j + 1) == ";")
        self.add_import("type" if types else "static", self.words[j][1:-1], True, i, k)
        return k

    def export(self, i: int, end: int) -> int:
        j = i + 1
        if self.word(j) == "type" and self.word(j + 1) in ("{", "*"):
            j += 1
        if self.word(j) in ("{", "*"):
            k = self.close(j) if self.word(j) == "{" else j + 1
            if self.word(k) == "as":
                k += 2
            if self.word(k) == "from" and k + 1 < self.size and self.kinds[k + 1] == "text":
                e = k + 2 + (self.word(k + 2) == ";")
                self.add_import("reexport", self.words[k + 1][1:-1], True, i, e)
                return e
            return k + (self.word(k) == ";")
        if self.word(j) == "default":
            j += 1
        return self.declaration(j, j, True, end) or self.plain(j, end)

    def declaration(self, i: int, start: int, exported: bool, end: int) -> int:
        """The index after a declaration at ``i``; 0 if there is none."""
        w, follow = self.word(i), self.word(i + 1)
        named = i + 1 < self.size and self.kinds[i + 1] == "word" and follow not in _WORDS
        if w in ("declare", "abstract") and follow in ("class", "function", "const", "let", "var", "enum", "interface", "type", "namespace", "module", "abstract"):
            return self.declaration(i + 1, start, exported, end)
        if w == "@":
            j = i + 1
            while self.word(j + 1) == ".":
                j += 2
            self.usages.append({"kind": "decorator", "name": self.word(j), "off": self.at[i]})
            j += 1
            if self.word(j) == "(":
                j = self.close(j)
            return j
        if w == "async" and follow == "function":
            return self.function(i + 1, start, exported)
        if w == "function":
            return self.function(i, start, exported)
        if w == "class":
            j = i + 1
            while j < self.size and self.words[j] != "{":
                j = self.close(j) if self.words[j] in "([" else j + 1
            k = self.close(j) if j < self.size else j
            if named:
                self.declare("class", follow, exported, start, k, self.class_members(j, k, follow))
            return k
        if w in ("const", "let", "var") and not (w == "const" and follow == "enum"):
            return self.variables(i, exported)
        if w == "enum" or w == "const" and follow == "enum":
            j = i + 1 + (w == "const")
            k = self.close(j + 1) if self.word(j + 1) == "{" else j + 1
            inner, depth = [], True
            for x in range(j + 2, k - 1):
                if depth and self.kinds[x] in ("word", "text"):
                    inner.append(self.words[x].strip("'\""))
                depth = self.words[x] == ","
            self.declare("enum", self.word(j), exported, start, k, inner)
            return k
        if w == "interface" and named:
            j = i + 2
            while j < self.size and self.words[j] != "{":
                j += 1
            k = self.close(j) if j < self.size else j
            self.declare("type", follow, exported, start, k)
            return k
        if w == "type" and named and self.word(i + 2) in ("=", "<"):
            k = self.until(i + 2, {";"})
            k += self.word(k) == ";"
            self.declare("type", follow, exported, start, k)
            return k
        return 0

    def function(self, i: int, start: int, exported: bool) -> int:
        j = i + 1 + (self.word(i + 1) == "*")
        name = self.words[j] if j < self.size and self.kinds[j] == "word" else ""
        while j < self.size and self.words[j] != "(":
            j += 1
        j = self.close(j) if j < self.size else j
        while j < self.size and self.words[j] not in ("{", ";") and not (self.fresh[j] and self.words[j - 1] not in _CONTINUES and self.words[j] not in _CONTINUES):
            if self.words[j] == "(" or self.words[j] == "[":
                j = self.close(j)
            elif self.words[j] == ":" and self.word(j + 1) == "{":
                j = self.close(j + 1)
            else:
                j += 1
        if self.word(j) != "{":
            if name:
                self.declare("function", name, exported, start, j)
            return j + (self.word(j) == ";")
        k = self.close(j)
        if name:
            self.declare("function", name, exported, start, k)
            self.measure(name, start, j, k)
        self.block(j + 1, k - 1)
        return k

    def class_members(self, j: int, k: int, owner: str) -> list[str]:
        out, i = [], j + 1
        while i < k - 1:
            first = i
            while self.word(i) == "@":
                i += 2
                if self.word(i) == "(":
                    i = self.close(i)
            while self.word(i) in ("static", "async", "get", "set", "readonly", "public", "private", "protected", "abstract", "override", "declare", "accessor", "*", "#") and self.word(i + 1) not in ("(", "=", ";", ":", "?", "!"):
                i += 1
            name = self.word(i) if i < k - 1 and self.kinds[i] in ("word", "text") else ""
            if name and (self.word(i + 1) in ("(", "=", ";", ":", "?", "!", "<", "}") or i + 1 >= k - 1 or self.fresh[i + 1]):
                out.append(name.strip("'\""))
            while i < k - 1 and self.words[i] != ";" and not (i > first and self.fresh[i] and self.words[i] not in _CONTINUES and self.words[i - 1] not in _CONTINUES):
                brace = self.words[i] == "{"
                i = self.close(i) if self.words[i] in _OPEN and self.kinds[i] == "punct" else i + 1
                if brace and self.word(i) not in _CONTINUES:
                    break
            i += self.word(i) == ";"
            i = max(i, first + 1)
            if name and any(self.words[x] == "(" for x in range(first, min(i, k - 1))) and self.words[i - 1] == "}":
                # methods count as functions without branches
                span = self.span(first, i)
                loc = nonblank(self.text[span["start_off"] : span["end_off"]])
                self.functions.append({"name": f"{owner}.{name}", "cyclomatic": 1, "cognitive": 0, "mi": maintainability(len({*self.words[first:i]}), 1, loc), "loc": loc, **span})
        return out

    def variables(self, i: int, exported: bool) -> int:
        j = i + 1
        while j < self.size:
            k = self.until(j, {",", ";"})
            if self.kinds[j] == "word":
                self.declare("variable", self.words[j], exported, j, k)
            elif self.words[j] in "{[":
                for x in range(j + 1, min(self.match[j], self.size)):
                    if self.kinds[x] == "word" and self.word(x + 1) in (",", "}", "]", "="):
                        self.declare("variable", self.words[x], exported, x, x + 1)
            if self.word(k) != ",":
                return k + (self.word(k) == ";")
            j = k + 1
        return j

    def plain(self, i: int, end: int) -> int:
        if i >= self.size:
            return i
        w = self.words[i]
        if w == "{":
            k = self.close(i)
            self.block(i + 1, k - 1)
            return k
        if w in ("if", "for", "while", "switch", "catch", "with"):
            j = i + 1 + (self.word(i + 1) == "await")
            if self.word(j) == "(":
                k = self.close(j)
                if w != "for" and w != "catch":
                    self.expression(j + 1, k - 1)
                return k
            return j
        if w in ("else", "try", "finally", "do"):
            return i + 1
        if w in ("return", "throw", "break", "continue", "debugger"):
            k = self.until(i + 1, {";"}) if not (i + 1 < self.size and self.fresh[i + 1]) else i + 1
            self.nested(i + 1, k)
            return k + (self.word(k) == ";")
        if w == "case" or w == "default" and self.word(i + 1) == ":":
            while i < end and self.words[i] != ":":
                i = self.close(i) if self.words[i] in _OPEN else i + 1
            return i + 1
        if w == ";":
            return i + 1
        k = self.until(i, {";"})
        self.expression(i, min(k, end))
        return k + (self.word(k) == ";")

    def nested(self, i: int, k: int) -> None:
        """Dynamic imports and markup are found in returned values too."""
        for x in range(i, min(k, self.size)):
            if self.words[x] == "<" and x + 1 < self.size and self.kinds[x + 1] == "word" and self.words[x + 1][0].isupper() and self.word(x - 1) in ("(", "return", "?", ":", "&&", ">", "}"):
                self.usages.append({"kind": "jsx", "name": self.words[x + 1], "off": self.at[x]})

    def expression(self, i: int, k: int) -> None:
        for x in range(i, min(k, self.size)):
            if self.kinds[x] == "template":
                continue
            if self.kinds[x] != "word":
                continue
            w, before, after = self.words[x], self.word(x - 1) if x else "", self.word(x + 1)
            if w == "import" and after == "(":
                self.dynamic(x)
                continue
            if w in _WORDS or before in (".", "?."):
                continue
            if after == ":" and before in ("{", ","):
                continue
            if before == "<" and after in (">", "/") or before == "</":
                self.usages.append({"kind": "jsx", "name": w, "off": self.at[x]})
                continue
            self.usages.append({"kind": "member" if after in (".", "?.") else "identifier", "name": w, "off": self.at[x]})

    def dynamic(self, x: int) -> None:
        k = self.close(x + 1)
        inside = range(x + 2, k - 1)
        first = x + 2
        if len(inside) and self.kinds[first] == "text" and len(inside) == 1:
            self.add_import("dynamic", self.words[first][1:-1], True, x, k)
        elif len(inside) and self.kinds[first] == "template" and len(inside) == 1:
            body = self.words[first][1:-1]
            self.add_import("dynamic", body.split("${")[0], "${" not in body, x, k)
        else:
            self.add_import("dynamic", "", False, x, k)

    # ------------------------------------------------------------ metrics

    def measure(self, name: str, start: int, j: int, k: int) -> None:
        span = self.span(start, k)
        cyc = 1
        for x in range(j, k):
            w = self.words[x]
            if w in _BRANCH and self.word(x - 1) != "." or w == "?" and self.word(x + 1) not in (":", ")", ",", "="):
                cyc += 1
        loc = nonblank(self.text[span["start_off"] : span["end_off"]])
        self.functions.append({"name": name, "cyclomatic": cyc, "cognitive": self.cognitive(name, j, k), "mi": maintainability(len({*self.words[j:k]}), cyc, loc), "loc": loc, **span})

    def cognitive(self, name: str, j: int, k: int) -> int:
        """One per structure and its depth, one per else and per change of logical operator, one per call of itself."""
        total, depth, logical = 0, 0, ""
        control, braces = False, []
        for x in range(j + 1, k - 1):
            w = self.words[x]
            before = self.word(x - 1)
            if w in ("if", "for", "while", "switch", "catch") and before != ".":
                total += 1 if w == "if" and before == "else" else 1 + depth
                control = True
            elif w == "else" and self.word(x + 1) != "if":
                total += 1
                control = True
            elif w == "?" and self.word(x + 1) not in (":", ")", ",", "="):
                total += 1 + depth
            elif w in ("&&", "||", "??"):
                total += w != logical
                logical = w
                continue
            elif w == name and self.word(x + 1) == "(":
                total += 1
            elif w == "{" and self.kinds[x] == "punct":
                braces.append(control)
                depth += control
                control = False
            elif w == "}" and braces:
                depth -= braces.pop()
            if w in (";", "{", "}", "(", ",") or self.fresh[x]:
                logical = "" if w not in ("(",) else logical
        return total


def extract_script(text: str) -> dict:
    """The inventory; not ``whole`` if a bracket has no partner, so that a declaration may end in the wrong place."""
    scan = _Scan(text)
    try:
        scan.block(0, scan.size)
    except RecursionError:  # nested deeper than the interpreter's stack
        return {"failed": True, "decls": [], "imports": [], "usages": [], "functions": []}
    for x in range(scan.size - 1):  # dynamic imports and asset urls anywhere
        if scan.words[x] == "import" and scan.words[x + 1] == "(" and not any(i["start_off"] == scan.at[x] for i in scan.imports):
            scan.dynamic(x)
        elif scan.words[x] == "URL" and scan.word(x - 1) == "new" and scan.words[x + 1] == "(" and "".join(scan.words[x + 3 : x + 9]) == ",import.meta.url)" and scan.kinds[x + 2] == "text":
            scan.add_import("asset", scan.words[x + 2][1:-1], True, x - 1, x + 9)
    key = lambda d: (d["start_off"], d.get("name") or d.get("source") or "")
    return {"failed": False, "whole": scan.balanced, "decls": sorted(scan.decls, key=key), "imports": sorted(scan.imports, key=key), "usages": sorted(scan.usages, key=lambda u: (u["off"], u["name"])), "functions": sorted(scan.functions, key=lambda f: f["start_off"])}
