"""Source text as token codes for the recognisers, line by line.

Each lexer gives a list of lines, a line being the codes of its tokens and, for messages, where it starts. The script lexer first takes one
regular expression over the whole file; where that meets what needs context (markup, nested templates) or the parse fails, an exact
scanner with a mode stack decides.
"""

from __future__ import annotations

import re
import unicodedata

ERROR = "\x02"

# ---------------------------------------------------------------- scripts

_IDENT = r"(?:[A-Za-z_$\u0080-\U0010ffff]|\\u\{?[0-9A-Fa-f]+\}?)(?:[\w$‌‍]|\\u\{?[0-9A-Fa-f]+\}?)*"
_NUMBER = r"(?:0[xX][0-9A-Fa-f_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:(?:[1-9][\d_]*|0(?![\d_]))(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?n?)(?![\w$])"
_STRING = r"'(?:[^'\\\r\n]|\\(?:\r\n|[\s\S]))*'|\"(?:[^\"\\\r\n]|\\(?:\r\n|[\s\S]))*\""
_REGEX = r"/(?![*/])(?:[^\\/\[\r\n]|\\[^\r\n]|\[(?:[^\]\\\r\n]|\\[^\r\n])*\])+/[A-Za-z]*"
_COMMENT = r"//[^\r\n  ]*|/\*[\s\S]*?\*/"
_SPACE = r"[ \t\f\v ﻿  -   　]+"
_PUNCT = r">>>=|\.\.\.|\*\*=|<<=|>>=|===|!==|&&=|\|\|=|\?\?=|=>|\?\.(?!\d)|\*\*|\+\+|--|<<|<=|>=|==|!=|&&|\|\||\?\?|\+=|-=|\*=|/=|%=|&=|\|=|\^=|[{}()\[\];,<>+\-*/%&|^!~?:=.@]"
_ASSIGN = {"+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "**=", "<<=", ">>=", ">>>=", "&&=", "||=", "??="}
_BINARY = {"%", "<<", "<=", ">=", "==", "!=", "===", "!==", "^"}
_LOGICAL = {"&&", "||"}
# after these a slash begins a regular expression, and a less-than sign markup
_OPENS = {"(", ",", "=", ":", "[", "!", "&", "|", "?", "{", ";", "+", "-", "*", "%", "~", "^", "<", "=>", "&&", "||", "??", "==", "===", "!=", "!==", "<=", ">=", "...", "**", "<<", *_ASSIGN}
_OPEN_WORDS = {"return", "typeof", "case", "delete", "void", "in", "of", "instanceof", "new", "await", "yield", "else", "do", "throw", "default", "extends"}
_BREAKS = {"return", "break", "continue", "throw"}
# before a line break these are plain names
_JOINED = ("async", "type", "declare", "namespace", "module", "abstract")
_SIMPLE_TEMPLATE = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{[^{}`'\"/\r\n]*\})*`"
_FAST = re.compile(
    rf"{_SPACE}|((?:\r\n|[\r\n  ])(?:[ \t\r\n]*)|{_COMMENT}|(?:[(,=:\[!&|?{{;]|\b(?:return|typeof|case)\b)[ \t]*(?:{_REGEX})|{_IDENT}|{_STRING}|{_NUMBER}|{_SIMPLE_TEMPLATE}|{_PUNCT}|#{_IDENT}|[\s\S])"
)
_SLOW = re.compile(
    rf"(?P<space>{_SPACE})|(?P<line>\r\n|[\r\n  ])|(?P<comment>{_COMMENT})|(?P<ident>{_IDENT})|(?P<string>{_STRING})|(?P<number>{_NUMBER})|(?P<private>#{_IDENT})|(?P<punct>{_PUNCT})|(?P<other>[\s\S])"
)
_SLOW_REGEX = re.compile(_REGEX)
_TEMPLATE_PART = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{)")
_MARKUP_NAME = re.compile(r"[A-Za-z_$\u0080-\U0010ffff][\w$\-.:\u0080-\U0010ffff]*")
_MARKUP_STRING = re.compile(r"'[^']*'|\"[^\"]*\"")
_MARKUP_SPACE = re.compile(rf"(?:[\s﻿]|{_COMMENT})+")
_MARKUP_TEXT = re.compile(r"[^{}<>]*")
_GENERIC = re.compile(r"<\s*(?:const\s+)?[A-Za-z_$][\w$]*\s*(?:,|=(?!=)|extends\b(?!\s*[=>/]))")
_HASHBANG = re.compile(r"#![^\r\n]*")


class ScriptLexer:
    NEWLINE = "\x01"

    def __init__(self, terminals: dict[str, str], markup: bool, types: bool):
        t = terminals
        self.t, self.markup, self.types = t, markup, types
        code = dict(t)
        for name in ("ID", "STR", "NUM", "REGEX", "PRIVATE", "TEMPLATE", "TEMPLATE_HEAD", "TEMPLATE_MIDDLE", "TEMPLATE_TAIL", "SEMI_AUTO", "ASSIGN", "BINARY", "LOGICAL", "UNARY", "UPDATE", "UPDATE_FIRST", "JNAME", "JSTR"):
            code.pop(name, None)
        for name in [n for n in code if n != "J" and "J" in n and not n.isalpha()]:
            code.pop(name)
        code |= {p: t["ASSIGN"] for p in _ASSIGN} | {p: t["BINARY"] for p in _BINARY} | {p: t["LOGICAL"] for p in _LOGICAL} | {"~": t["UNARY"], "++": t["UPDATE"], "--": t["UPDATE"]}
        self.code = code
        self.id = t["ID"]
        start = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_$\\"
        self.first = {c: self.id for c in start} | {c: t["NUM"] for c in "0123456789"}
        self.known: dict[str, str] = {}

    def _odd(self, token: str) -> str:
        """The codes of a token that its first character does not tell."""
        c, t = token[0], self.t
        if c in "\r\n  ":
            return self.NEWLINE
        if c == "/" and len(token) > 1 and token[1] in "/*":
            return self.NEWLINE if token[1] == "*" and re.search(r"[\r\n  ]", token) else ""
        if c in "'\"":
            return t["STR"] if len(token) > 1 else ERROR
        if c == "`":
            if len(token) == 1:
                return ERROR
            if "${" not in token:
                return t["TEMPLATE"]
            parts = re.findall(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*\$\{([^{}`'\"/\r\n]*)\}", token[1:])
            inner = ["".join(self._codes(p)) for p in parts]
            return t["TEMPLATE_HEAD"] + t["TEMPLATE_MIDDLE"].join(inner) + t["TEMPLATE_TAIL"]
        if c == "#" and len(token) > 1:
            return t["PRIVATE"]
        if c == "." and len(token) > 1 and token[1].isdigit():
            return t["NUM"]
        if token[-1] == "/" or "/" in token:  # an opening token and a regular expression
            head = re.match(r"[A-Za-z]+|[^\w\s]", token)[0]
            if head != token and head in self.code:
                return self.code[head] + t["REGEX"]
        return self.id if c > "\x7f" and re.fullmatch(_IDENT, token) else ERROR

    def _codes(self, text: str) -> list[str]:
        code, first, odd = self.code.get, self.first.get, self._odd
        return [(code(x) or (first(x[0]) if x[0] not in "rtc" or "/" not in x else None) or odd(x)) if x else "" for x in _FAST.findall(text)]

    def quick(self, text: str) -> list[str] | None:
        """Lines of codes, or None where the exact scanner has to read."""
        if self.markup and ("</" in text or "/>" in text):
            return None
        text = "".join(self._codes(text))
        newline = self.NEWLINE
        t = self.t
        for word in _BREAKS:  # a line break ends these statements
            if t[word] + newline in text:
                text = text.replace(t[word] + newline, t[word] + t["SEMI_AUTO"] + newline)
        for word in _JOINED:
            if word in t and t[word] + newline in text:
                text = text.replace(t[word] + newline, self.id + newline)
        if newline + t["UPDATE"] in text:
            text = text.replace(newline + t["UPDATE"], newline + t["UPDATE_FIRST"])
        lines = text.split(newline)
        return [lines[0], *(newline + x for x in lines[1:] if x)]

    def exact(self, text: str) -> tuple[list[str], list[list[int]]]:
        """Lines of codes and the offset of each code. What is no token ends the list with an error code."""
        t, code, newline = self.t, self.code.get, self.NEWLINE
        out: list[str] = []
        at: list[int] = []
        modes: list[str | tuple] = []  # "{" in code, "`" in a substitution, ("tag", name) and so on in markup
        pos, n, last, opens, fresh = 0, len(text), "", True, False
        hashbang = _HASHBANG.match(text)
        if hashbang:
            pos = hashbang.end()

        def put(codes: str, where: int) -> None:
            nonlocal fresh
            if fresh:
                out.append(newline)
                at.append(where)
                fresh = False
            for c in codes:
                out.append(c)
                at.append(where)

        def fail(where: int) -> None:
            put(ERROR, where)

        match, tag = _SLOW.match, None
        while pos < n:
            mode = modes[-1] if modes else None
            if mode.__class__ is list:  # markup: [phase, tag names]
                stop = self._markup(text, pos, mode, modes, put)
                if stop < 0:
                    fail(pos)
                    break
                pos = stop
                if not modes or modes[-1].__class__ is not list:
                    # the element or an expression in it begins or ends
                    last, opens = ("}", False) if not modes or modes[-1].__class__ is not tuple else ("{", True)
                continue
            m = match(text, pos)
            kind, token, start = m.lastgroup, m[0], pos
            pos = m.end()
            if kind == "space":
                continue
            if kind == "line" or kind == "comment":
                if kind == "line" or token[1] == "*" and re.search(r"[\r\n  ]", token):
                    if last in _BREAKS:
                        put(t["SEMI_AUTO"], start)
                        last = ";"
                    elif last in _JOINED and out and out[-1] == code(last):
                        out[-1] = self.id
                    fresh = True
                continue
            if kind == "ident":
                put(code(token) or self.id, start)
                opens, last = token in _OPEN_WORDS and last != ".", token if last != "." else "x"
                continue
            if kind == "string" or kind == "number" or kind == "private":
                put(t["STR" if kind == "string" else "NUM" if kind == "number" else "PRIVATE"], start)
                opens, last = False, "x"
                continue
            if token == "`":
                part = _TEMPLATE_PART.match(text, pos)
                if not part:
                    fail(start)
                    break
                pos = part.end()
                if part[1] == "`":
                    put(t["TEMPLATE"], start)
                    opens, last = False, "x"
                else:
                    put(t["TEMPLATE_HEAD"], start)
                    modes.append("`")
                    opens, last = True, "{"
                continue
            if kind == "other":
                fail(start)
                break
            if (token == "/" or token == "/=") and (opens or last == "}" and fresh):
                m = _SLOW_REGEX.match(text, start)
                if m:
                    pos = m.end()
                    put(t["REGEX"], start)
                    opens, last = False, "x"
                    continue
            if token == "<" and self.markup and opens and (_MARKUP_NAME.match(text, pos) or re.match(r"\s*>", text[pos:])) and not (self.types and _GENERIC.match(text, start)):
                put(t["<J"], start)
                modes.append(["tag", []])
                continue
            if token == "}" and mode == "`":
                part = _TEMPLATE_PART.match(text, pos)
                if not part:
                    fail(start)
                    break
                pos = part.end()
                if part[1] == "`":
                    put(t["TEMPLATE_TAIL"], start)
                    modes.pop()
                    opens, last = False, "x"
                else:
                    put(t["TEMPLATE_MIDDLE"], start)
                    opens, last = True, "{"
                continue
            if token == "}" and mode.__class__ is tuple:
                put(t["J}"], start)
                modes.pop()
                continue
            if token == "{":
                modes.append("{")
            elif token == "}" and mode == "{":
                modes.pop()
            if token in ("++", "--") and fresh:
                put(t["UPDATE_FIRST"], start)
            else:
                put(code(token) or ERROR, start)
            opens, last = token in _OPENS, token
        else:
            if modes:
                fail(n)
        lines, offsets = [[]], [[]]
        for c, where in zip(out, at):
            if c == newline:
                lines.append([])
                offsets.append([])
            lines[-1].append(c)
            offsets[-1].append(where)
        return ["".join(x) for x in lines], offsets

    def _markup(self, text: str, pos: int, mode: list, modes: list, put) -> int:
        """One token of markup; the new position, or -1."""
        t, phase = self.t, mode[0]
        names = mode[1]
        if phase == "children":
            m = _MARKUP_TEXT.match(text, pos)
            pos = m.end()
            if pos >= len(text) or text[pos] in ">}":
                return -1
            if text[pos] == "{":
                put(t["J{"], pos)
                modes.append(("J",))
                return pos + 1
            close = re.compile(r"<\s*/").match(text, pos)
            if close:
                put(t["</J"], pos)
                mode[0] = "close"
                return close.end()
            put(t["<J"], pos)
            mode[0] = "tag"
            return pos + 1
        space = _MARKUP_SPACE.match(text, pos)
        if space:
            pos = space.end()
            if pos >= len(text):
                return -1
        if phase == "tag":  # the name after <
            m = _MARKUP_NAME.match(text, pos)
            names.append(m[0] if m else "")
            mode[0] = "attributes"
            if m:
                put(t["JNAME"], pos)
                return m.end()
            return pos if text[pos] == ">" else -1
        if phase == "close":
            m = _MARKUP_NAME.match(text, pos)
            if (m[0] if m else "") != names[-1]:
                return -1
            if m:
                put(t["JNAME"], pos)
                pos = m.end()
            space = _MARKUP_SPACE.match(text, pos)
            pos = space.end() if space else pos
            if text[pos : pos + 1] != ">":
                return -1
            put(t["J>"], pos)
            names.pop()
            self._ended(mode, modes)
            return pos + 1
        c = text[pos]
        if c == ">":
            put(t["J>"], pos)
            mode[0] = "children"
            return pos + 1
        if text.startswith("/>", pos):
            put(t["/J>"], pos)
            names.pop()
            self._ended(mode, modes)
            return pos + 2
        if c == "=":
            put(t["J="], pos)
            return pos + 1
        if c == "{":
            put(t["J{"], pos)
            modes.append(("J",))
            return pos + 1
        m = _MARKUP_STRING.match(text, pos)
        if m:
            put(t["JSTR"], pos)
            return m.end()
        m = _MARKUP_NAME.match(text, pos)
        if m:
            put(t["JNAME"], pos)
            return m.end()
        return -1

    @staticmethod
    def _ended(mode: list, modes: list) -> None:
        if mode[1]:
            mode[0] = "children"
        else:
            modes.pop()


# ---------------------------------------------------------------- Python

_PY_PREFIX = r"(?:[rRuUbB]|[bB][rR]|[rR][bB])?"
_PY_STRING = (
    rf"{_PY_PREFIX}(?:'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''|\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'(?!'')(?:[^'\\\n]|\\[\s\S])*'|\"(?!\"\")(?:[^\"\\\n]|\\[\s\S])*\")"
)
_PY_NUMBER = r"(?:0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.?)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)(?!\w)"
_PY_NAME = r"[A-Za-z_\u0080-\U0010ffff][\w\u0080-\U0010ffff]*"
_PY_PUNCT = r"\*\*=|//=|>>=|<<=|\.\.\.|->|:=|\*\*|//|>>|<<|<=|>=|==|!=|\+=|-=|\*=|/=|%=|@=|&=|\|=|\^=|[()\[\]{},:;.=+\-*/%@&|^~<>!]"
_PY_SIMPLE_FORMAT = (
    r"[fF](?:\"(?!\"\")(?:[^\"\\\n{}]|\\[^N\n]|\{\{|\}\}|\{(?:[a-z]\w*_\w*)\})*\"|'(?!'')(?:[^'\\\n{}]|\\[^N\n]|\{\{|\}\}|\{(?:[a-z]\w*_\w*)\})*')"
)
_PY_FORMAT = r"(?:[fF][rR]?|[rR][fF])(?:'''|\"\"\"|'|\")"
# a line end with the blank and comment lines after it, and the indentation of the next line
_PY_LINE = r"(?:[ \t\f]*(?:#[^\n]*)?\n)+[ \t\f]*(?:#[^\n]*)?"
_PY_FAST = re.compile(rf"[ \t\f]+|\\\n|({_PY_LINE}|#[^\n]*|{_PY_STRING}|{_PY_SIMPLE_FORMAT}|{_PY_FORMAT}|{_PY_NAME}|{_PY_NUMBER}|{_PY_PUNCT}|[\s\S])")
# the interpreter's own limits of nested formatted strings, and of fields nested in format specifications
_PY_STRINGS, _PY_FIELDS = 149, 3
_PY_COMPARE = {"<", ">", "<=", ">=", "==", "!="}
_PY_OPERATOR = {"//", "%", "<<", ">>", "&", "^"}
_PY_AUGMENTED = {"+=", "-=", "*=", "/=", "//=", "%=", "@=", "&=", "|=", "^=", ">>=", "<<=", "**="}
_BRACKET = {"(": ")", "[": "]", "{": "}"}


# escapes that promise digits have them
_PY_BYTES = re.compile(r"(?:[^\\]|\\x[0-9a-fA-F]{2}|\\[^x])*", re.S)
_PY_ESCAPE = re.compile(r"\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U(?:000[0-9a-fA-F]|0010)[0-9a-fA-F]{4}|N\{([^}]*)\}|[^xuUN])", re.S)


def _escapes_hold(text: str) -> bool:
    """Whether every escape of a string is complete and names a character."""
    pos = text.find("\\")
    while pos >= 0:
        m = _PY_ESCAPE.match(text, pos)
        if not m:
            return False
        if m[1] is not None:
            try:
                unicodedata.lookup(m[1])
            except KeyError:
                return False
        pos = text.find("\\", m.end())
    return True


class PythonLexer:
    def __init__(self, terminals: dict[str, str]):
        t = self.t = terminals
        self.code = {k: v for k, v in t.items() if k not in ("NAME", "NUMBER", "STRING", "BYTES", "FSTART", "FEND", "NEWLINE", "INDENT", "DEDENT", "COMPARE", "OPERATOR", "AUGMENTED")}
        self.code |= {p: t["COMPARE"] for p in _PY_COMPARE} | {p: t["OPERATOR"] for p in _PY_OPERATOR} | {p: t["AUGMENTED"] for p in _PY_AUGMENTED}
        start = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_"
        self.first = {c: t["NAME"] for c in start}
        # string prefixes are settled by the last character
        self.quoted = "'\""

    def _field(self, text: str, pos: int, out: list[str], quote: str, spec: int, depth: int) -> int:
        """The codes of one replacement field after its brace; the position after it, or -1."""
        t, need = self.t, []
        out.append(t["{"])
        while pos < len(text):
            m = _PY_FAST.match(text, pos)
            token = m[1]
            if token is None:
                pos = m.end()
                continue
            if token[0] in " \t\f\n#":
                pos = m.end()
                continue
            if not need and token == "}":
                out.append(t["}"])
                return pos + 1
            if not need and token == "!":
                out.append(t["!"])
                pos += 1
                continue
            if not need and token[0] == ":":
                out.append(t[":"])
                pos = self._literal(text, pos + 1, out, quote, spec + 1, depth)
                if pos < 0:
                    return -1
                out.append(t["}"])
                return pos + 1
            if not need and token == "=":
                out.append(t["="])
                pos += 1
                continue
            if token in _BRACKET:
                need.append(_BRACKET[token])
            elif token in ")]}":
                if not need or need.pop() != token:
                    return -1
            pos = self._token(text, m, out, depth)
            if pos < 0:
                return -1
        return -1

    def _literal(self, text: str, pos: int, out: list[str], quote: str, spec: int, depth: int, raw: bool = False) -> int:
        """The literal parts of a formatted string up to its quotes (or, of a format specification, up to its brace). spec, depth: levels of specifications and strings."""
        if depth > _PY_STRINGS:
            return -1
        n, size = len(text), len(quote)
        while pos < n:
            c = text[pos]
            if spec and c == "}":
                return pos
            if text.startswith(quote, pos):
                return -1 if spec else pos + size
            if c == "\\":
                if raw:
                    pos += 1 if text[pos + 1 : pos + 2] in ("{", "}") else 2
                elif text[pos + 1 : pos + 2] in ("{", "}"):
                    pos += 1
                else:
                    m = _PY_ESCAPE.match(text, pos)
                    if not m or not _escapes_hold(m[0]):
                        return -1
                    pos = m.end()
            elif c == "{" and not (not spec and text.startswith("{{", pos)):
                pos = self._field(text, pos + 1, out, quote, spec, depth) if spec < _PY_FIELDS else -1
                if pos < 0:
                    return -1
            elif c == "{":
                pos += 2
            elif c == "}":
                if not text.startswith("}}", pos):
                    return -1
                pos += 2
            elif c == "\n" and size == 1:
                return -1
            else:
                pos += 1
        return -1

    def _token(self, text: str, m: re.Match, out: list[str], depth: int) -> int:
        """Append the codes of one token; the position after it, or -1."""
        token, t = m[1], self.t
        found = self.code.get(token)
        if found:
            out.append(found)
        elif token[-1] in self.quoted:
            if re.fullmatch(_PY_FORMAT, token):
                out.append(t["FSTART"])
                quote = re.search(r"'+|\"+", token)[0]
                pos = self._literal(text, m.end(), out, quote, 0, depth + 1, "r" in token.lower())
                if pos < 0:
                    return -1
                out.append(t["FEND"])
                return pos
            if len(token) < 2 or token.lower() in ("r'", 'r"', "b'", 'b"', "u'", 'u"'):
                return -1
            prefix = token[: min(token.find(q) for q in self.quoted if q in token)].lower()
            if "b" in prefix:
                if not token.isascii() or "\\" in token and "r" not in prefix and not _PY_BYTES.fullmatch(token, len(prefix)):
                    return -1
                out.append(t["BYTES"])
                return m.end()
            if "\\" in token and "r" not in prefix and not _escapes_hold(token):
                return -1
            out.append(t["STRING"])
        elif token[0] in self.first or token[0] > "\x7f":
            if not token.isidentifier():
                return -1
            out.append(t["NAME"])
        elif token[0].isdigit() or token[0] == "." and len(token) > 1:
            if len(token) > 1 and token[0] == "0" and token.replace("_", "").isdigit() and token.replace("_", "").strip("0"):
                return -1
            out.append(t["NUMBER"])
        else:
            return -1
        return m.end()

    def exact(self, text: str) -> tuple[list[str], list[int]]:
        """Logical lines of codes, each with the offset where it starts. What is no token or layout ends the list with an error code."""
        if "\r" in text:
            text = text.replace("\r\n", "\n").replace("\r", "\n")
        t, code, first = self.t, self.code.get, self.first
        newline, indent, dedent, name, string = t["NEWLINE"], t["INDENT"], t["DEDENT"], t["NAME"], t["STRING"]
        lead = re.compile(r"(?:[ \t\f]*(?:#[^\n]*)?\n)*[ \t\f]*(?:#[^\n]*$)?").match(text)
        pos, n = lead.end(), len(text)
        lines: list[str] = []
        starts: list[int] = []
        stack, others, need = [0], [0], []  # columns with tabs of eight and of one: their order must agree
        now: list[str] = []
        if pos < n and self._width(lead[0].rsplit("\n", 1)[-1]) != 0:
            return [ERROR], [pos]
        start = pos
        match = _PY_FAST.match
        put = now.append
        while pos < n:
            m = match(text, pos)
            token = m[1]
            if token is None:
                pos = m.end()
                continue
            found = code(token)
            if found:
                put(found)
                pos = m.end()
                if token in _BRACKET:
                    need.append(_BRACKET[token])
                elif token in ")]}":
                    if not need or need.pop() != token:
                        lines.append("".join(now) + ERROR)
                        starts.append(start)
                        return lines, starts
                continue
            c = token[0]
            if c in first and token[-1] not in "'\"":
                put(name)
                pos = m.end()
                continue
            if c == "#" and "\n" not in token:
                pos = m.end()
                continue
            if c in " \t\f\n#":
                pos = m.end()
                if need:
                    continue
                put(newline)
                lines.append("".join(now))
                starts.append(start)
                now = []
                put = now.append
                start = pos
                if pos >= n:
                    break
                margin = token[token.rfind("\n") + 1 :]
                if "#" in margin:
                    continue
                width, other = self._width(margin), len(margin.rsplit("\f", 1)[-1])
                if width > stack[-1] and other > others[-1]:
                    stack.append(width)
                    others.append(other)
                    put(indent)
                else:
                    while width < stack[-1]:
                        stack.pop()
                        others.pop()
                        put(dedent)
                    if width != stack[-1] or other != others[-1]:
                        lines.append(ERROR)
                        starts.append(start)
                        return lines, starts
                continue
            pos = self._token(text, m, now, 0)
            if pos < 0:
                lines.append("".join(now) + ERROR)
                starts.append(start)
                return lines, starts
        if need:
            lines.append("".join(now) + ERROR)
            starts.append(start)
            return lines, starts
        if any(x != dedent and x != indent for x in now):
            lines.append("".join(now) + newline)
            starts.append(start)
            now = []
        rest = "".join(x for x in now if x == dedent) + dedent * (len(stack) - 1)
        if rest:
            lines.append(rest)
            starts.append(n)
        return lines, starts

    @staticmethod
    def _width(margin: str) -> int:
        """Column of the first token; tabs go to the next multiple of eight, a form feed begins again."""
        if "\t" not in margin and "\f" not in margin:
            return len(margin)
        return len(margin.rsplit("\f", 1)[-1].expandtabs(8))
