"""Python inventories by the interpreter's own syntax tree. A file that does not parse has an empty inventory, not a partial one."""

from __future__ import annotations

import ast
import re
import warnings

from tessel.extract.metrics import maintainability, nonblank

_WORD = re.compile(r"[A-Za-z_]\w*|\d+|[^\s\w]+")
_LOOPS = (ast.For, ast.AsyncFor, ast.While)
_FUNCS = (ast.FunctionDef, ast.AsyncFunctionDef)


class _Places:
    """Character offsets of syntax nodes, whose columns count UTF-8 bytes."""

    def __init__(self, text: str):
        self.lines = text.splitlines(keepends=True)
        self.starts = [0]
        for line in self.lines:
            self.starts.append(self.starts[-1] + len(line))
        self.ascii = text.isascii()

    def at(self, line: int, column: int) -> int:
        if not self.ascii and line <= len(self.lines):
            column = len(self.lines[line - 1].encode()[:column].decode(errors="ignore"))
        return self.starts[min(line - 1, len(self.starts) - 1)] + column

    def of(self, node: ast.AST) -> dict:
        return {"start_off": self.at(node.lineno, node.col_offset), "end_off": self.at(node.end_lineno, node.end_col_offset), "line": node.lineno}


def _dotted(node: ast.AST) -> str:
    if isinstance(node, ast.Call):
        node = node.func
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else ""


def _head(node: ast.AST | None) -> str | None:
    if isinstance(node, ast.Subscript):
        node = node.value
    if isinstance(node, ast.Attribute):
        return node.attr
    return node.id if isinstance(node, ast.Name) else None


def _callee(node: ast.AST | None) -> str | None:
    return _head(node.func) if isinstance(node, ast.Call) else None


def _exports(tree: ast.Module) -> set[str] | None:
    """Names of the last literal ``__all__``; None where there is none."""
    found = None
    for node in tree.body:
        targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, ast.AnnAssign) else []
        if any(isinstance(t, ast.Name) and t.id == "__all__" for t in targets) and isinstance(node.value, (ast.List, ast.Tuple)):
            found = {e.value for e in node.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)}
    return found


class _Walk(ast.NodeVisitor):
    """Imports and uses in source order, names bound by parameters, loops and walrus left out within their function."""

    def __init__(self, places: _Places):
        self.places, self.imports, self.usages, self.bound, self.typing = places, [], [], [set()], False

    def _use(self, kind: str, name: str, node: ast.AST) -> None:
        if name and not any(name in frame for frame in self.bound):
            self.usages.append({"kind": kind, "name": name, "off": self.places.at(node.lineno, node.col_offset)})

    def _import(self, node, source: str, names: list[str]) -> None:
        place = self.places.of(node)
        self.imports.append({"kind": "type" if self.typing else "static", "source": source, "resolvable": True, **place, "names": names})

    def visit_Import(self, node):
        for alias in node.names:
            self._import(node, alias.name, [])

    def visit_ImportFrom(self, node):
        self._import(node, "." * node.level + (node.module or ""), [a.name for a in node.names if a.name != "*"])

    def visit_If(self, node):
        self.visit(node.test)
        before, self.typing = self.typing, self.typing or _dotted(node.test) in ("TYPE_CHECKING", "typing.TYPE_CHECKING")
        for x in node.body:
            self.visit(x)
        self.typing = before
        for x in node.orelse:
            self.visit(x)

    def _function(self, node):
        for d in node.decorator_list:
            name = _dotted(d)
            if name:
                self.usages.append({"kind": "decorator", "name": name, "off": self.places.at(d.lineno, d.col_offset)})
            if isinstance(d, ast.Call):
                for x in (*d.args, *(k.value for k in d.keywords)):
                    self.visit(x)
        a = node.args
        params = [*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg))]
        for x in (*a.defaults, *filter(None, a.kw_defaults), *filter(None, (p.annotation for p in params)), *filter(None, (node.returns,))):
            self.visit(x)
        self.bound.append({p.arg for p in params})
        for x in node.body:
            self.visit(x)
        self.bound.pop()

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def visit_Lambda(self, node):
        a = node.args
        for x in (*a.defaults, *filter(None, a.kw_defaults)):
            self.visit(x)
        self.bound.append({p.arg for p in [*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg))]})
        self.visit(node.body)
        self.bound.pop()

    def visit_ClassDef(self, node):
        for d in node.decorator_list:
            name = _dotted(d)
            if name:
                self.usages.append({"kind": "decorator", "name": name, "off": self.places.at(d.lineno, d.col_offset)})
        for x in (*node.bases, *(k.value for k in node.keywords), *node.body):
            self.visit(x)

    def visit_For(self, node):
        self.bound[-1] |= {n.id for n in ast.walk(node.target) if isinstance(n, ast.Name)}
        self.generic_visit(node)

    visit_AsyncFor = visit_For

    def visit_NamedExpr(self, node):
        self.bound[-1].add(node.target.id)
        self.visit(node.value)

    def visit_Attribute(self, node):
        base = node
        while isinstance(base, ast.Attribute):
            base = base.value
        if isinstance(base, ast.Name):
            self._use("member", base.id, node)
        else:
            self.visit(base)
        self._use("member", node.attr, node)

    def visit_Name(self, node):
        if isinstance(node.ctx, ast.Load):
            self._use("identifier", node.id, node)


def _cyclomatic(node: ast.AST) -> int:
    n = 1
    for x in ast.walk(node):
        if isinstance(x, (ast.If, *_LOOPS, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.match_case, ast.Assert, ast.Lambda, ast.IfExp)):
            n += 1
        elif isinstance(x, ast.BoolOp):
            n += len(x.values) - 1
        elif isinstance(x, ast.comprehension):
            n += 1 + len(x.ifs)
    return n


def _cognitive(body: list[ast.stmt], name: str, depth: int) -> int:
    n = 0
    for x in body:
        n += _cognitive_of(x, name, depth)
    return n


def _expressions(x: ast.AST, name: str, depth: int) -> int:
    n = 0
    for e in ast.walk(x):
        if isinstance(e, ast.BoolOp):
            n += 1
        elif isinstance(e, ast.IfExp):
            n += 1 + depth
        elif isinstance(e, ast.Call) and isinstance(e.func, ast.Name) and e.func.id == name:
            n += 1
    return n


def _cognitive_of(x: ast.stmt, name: str, depth: int) -> int:
    if isinstance(x, ast.If):
        n = 1 + depth + _expressions(x.test, name, depth) + _cognitive(x.body, name, depth + 1)
        rest = x.orelse
        while len(rest) == 1 and isinstance(rest[0], ast.If) and rest[0].col_offset == x.col_offset:
            n += 1 + _expressions(rest[0].test, name, depth) + _cognitive(rest[0].body, name, depth + 1)
            rest = rest[0].orelse
        return n + (1 + _cognitive(rest, name, depth + 1) if rest else 0)
    if isinstance(x, _LOOPS):
        head = x.test if isinstance(x, ast.While) else x.iter
        return 1 + depth + _expressions(head, name, depth) + _cognitive(x.body, name, depth + 1) + (1 + _cognitive(x.orelse, name, depth + 1) if x.orelse else 0)
    if isinstance(x, ast.Try) or x.__class__.__name__ == "TryStar":
        n = _cognitive(x.body, name, depth) + _cognitive(x.orelse, name, depth) + _cognitive(x.finalbody, name, depth)
        return n + sum(1 + depth + _cognitive(h.body, name, depth + 1) for h in x.handlers)
    if isinstance(x, ast.Match):
        return 1 + depth + sum(_cognitive(c.body, name, depth + 1) for c in x.cases)
    if isinstance(x, (ast.With, ast.AsyncWith)):
        return _cognitive(x.body, name, depth)
    if isinstance(x, (*_FUNCS, ast.ClassDef)):
        return _cognitive(x.body, name, depth + 1)
    return _expressions(x, name, depth)


_UNREADABLE = (SyntaxError, ValueError, RecursionError, MemoryError)
_TOP = re.compile(r"(?!else\b|elif\b|except\b|finally\b)[^\s#)\]}]")
_AHEAD = 8


def _reads(text: str) -> int | None:
    """None if the text can be read, else how many of its lines lie before the error."""
    try:
        _read(text)
    except SyntaxError as e:
        return max(0, (e.lineno or 1) - 1)
    except _UNREADABLE:
        return 0
    return None


def repaired(text: str) -> str:
    """The text with what cannot be read of the module's statements blanked; all offsets stay.

    Of a statement that ends in the middle, up to ``_AHEAD`` of the lines that look like the next ones are tried as its rest; of one that is
    broken, the lines before the error are kept if they can be read."""
    lines = text.split("\n")
    starts = [n for n, line in enumerate(lines) if _TOP.match(line)] + [len(lines)]
    k = 0
    while k < len(starts) - 1:
        end = next((j for j in range(k + 1, min(k + 1 + _AHEAD, len(starts))) if _reads("\n".join(lines[starts[k] : starts[j]])) is None), None)
        if end is None:
            end, last = k + 1, starts[k + 1]
            while last > starts[k] and (good := _reads("\n".join(lines[starts[k] : last]))) is not None:
                last = min(last - 1, starts[k] + good)
            for n in range(last, starts[end]):
                lines[n] = " " * len(lines[n].rstrip("\r")) + "\r" * lines[n].endswith("\r")
        k = end
    return "\n".join(lines)


def _read(text: str) -> dict:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(text)
    places = _Places(text)
    decls = _declarations(tree, places)
    walk = _Walk(places)
    walk.visit(tree)
    functions = [_metrics(x, text, places) for x in ast.walk(tree) if isinstance(x, _FUNCS)]
    decls.sort(key=lambda d: (d["start_off"], d["name"]))
    functions.sort(key=lambda f: f["start_off"])
    return {"decls": decls, "imports": walk.imports, "usages": walk.usages, "functions": functions}


def extract_python(text: str) -> dict:
    """The inventory; of a module that does not parse, or is nested too deeply, that of its readable statements."""
    try:
        return {"failed": False, **_read(text)}
    except _UNREADABLE:
        try:
            return {"failed": True, **_read(repaired(text))}
        except _UNREADABLE:
            return {"failed": True, "decls": [], "imports": [], "usages": [], "functions": []}


def _metrics(node, text: str, places: _Places) -> dict:
    place = places.of(node)
    source = text[place["start_off"] : place["end_off"]]
    cyc, loc = _cyclomatic(node), nonblank(source)
    return {"name": node.name, "cyclomatic": cyc, "cognitive": _cognitive(node.body, node.name, 0), "mi": maintainability(len(set(_WORD.findall(source))), cyc, loc), "loc": loc, **place}


def _declarations(tree: ast.Module, places: _Places) -> list[dict]:
    listed, out = _exports(tree), []

    def add(kind: str, name: str, node, **more) -> None:
        exported = name in listed if listed is not None else not name.startswith("_")
        out.append({"kind": kind, "name": name, "exported": exported, **places.of(node), "members": [], "bases": [], "annotation": None, "callee": None, "decorated": [], "fields": [], **more})

    for node in tree.body:
        if isinstance(node, _FUNCS):
            add("function", node.name, node)
        elif isinstance(node, ast.ClassDef):
            members, fields, decorated = [], [], []
            for x in node.body:
                if isinstance(x, _FUNCS):
                    members.append(x.name)
                    if any(_dotted(d) for d in x.decorator_list):
                        decorated.append(x.name)
                elif isinstance(x, ast.Assign):
                    members += [t.id for t in x.targets if isinstance(t, ast.Name)]
                elif isinstance(x, ast.AnnAssign) and isinstance(x.target, ast.Name):
                    members.append(x.target.id)
                    fields.append(x.target.id)
            add("class", node.name, node, members=members, bases=[h for b in node.bases if (h := _head(b))], decorated=decorated, fields=fields)
        elif isinstance(node, ast.Assign):
            for t in node.targets:
                if isinstance(t, ast.Name) and t.id != "__all__":
                    add("variable", t.id, node, callee=_callee(node.value))
        elif isinstance(node, ast.AnnAssign) and isinstance(node.target, ast.Name):
            add("variable", node.target.id, node, annotation=_head(node.annotation), callee=_callee(node.value))
    return out
