import ast
import pathlib
import pickle
import sysconfig
import zlib

import pytest
from pyspark.sql import functions as F

from tessel.llm import syntax
from tessel.llm.glr import Recognizer, compile_grammar


@pytest.fixture(scope="module")
def parser():
    return syntax.Parser(pickle.loads(zlib.decompress(syntax.packed_tables())))


VALID = {
    "ts": [
        "",
        "﻿const a = 1\r\nlet b = a\r\n",
        "export const f = async <T extends object, U = string>(x: T, ...rest: U[]): Promise<Map<string, U[]>> => { await g(x); return new Map<string, U[]>() }",
        "type A = { readonly [K in keyof B as `get${K}`]?: B[K] } | ((x: number) => x is string) | typeof import('x') | [a: string, b?: number, ...c: string[]]",
        "abstract class C<T> extends D<T> implements E, F { private readonly x?: number = 1; static { go() } constructor(public a: string, b = 2) { super() } get y(): number { return this.#z } #z = 3; abstract m(): void }",
        "const x = a ? (b) : c => d\nconst r = /[/'\"`]+/gi.test(s) ? a / b / c : `x${`y${z}`}`",
        "declare module 'm' { export function f(x: string): void; const y: number }\ndeclare global { interface Window { a: 1 } }",
        "label: for (const [a, { b = 1, ...c }] of d) { if (a) continue label\n else break }",
        "enum E { A, B = 1 << 2, 'c' = 3 }\nexport default interface X { (a: string): void; new (b: number): X; get z(): number }",
        "const o = { async *gen() {}, get a() { return 1 }, set a(v) {}, [k]: 1, b, 'c': 2, ...d, if: 3, async: 4 } satisfies O",
        "let v = <Foo>bar\nx!.y!.z\nfunction f(this: Foo, a?: string): asserts a is string;\nfunction f(a) {}",
        "/*\n<<<<<<< a\n=======\n>>>>>>> b\n*/ const t = `\n<<<<<<< a\n=======\n`",
        "import type { A } from 'a'\nimport { type B, default as C } from \"b\" with { type: 'json' }\nexport * as ns from './x'\nexport type { A }",
        "i\n++j\nreturn_ = async\ntype = 3\nof(get, set)",
        "@dec() class A { @prop x = 1; @m() f() {} }",
        "if (a < b && c > d) e(f < g, h > i)",
        "do x++; while (x < 5) y()",
        "do\nx();\nwhile (a)\nwhile (b) c()",
    ],
    "tsx": ["const a = <div className='x' {...p} on={() => <b>{y} text's <></></b>}>{/* c */}</div>", "const f = <T,>(x: T) => <A.B<string> x={1}/>".replace("<string>", ""), "return_ = (\n <p>a &amp; b {x < y ? <i/> : null}</p>\n)"],
    "js": ["export async function* f({ a, b: [c] } = {}, ...d) { for await (const x of y) yield* x }", "const x = a?.b?.[c]?.(d) ?? e ** 2; x ||= 1", "class A { static async *[Symbol.iterator]() {} static x = 1; 'y' = 2; #p; has(o) { return #p in o } }", "#!/usr/bin/env node\nawait import('x'); import.meta.url", "throw new Error(`a ${b} c`)"],
    "jsx": ["export default () => <ul>{xs.map((x) => <li key={x}>{x}</li>)}</ul>", "const a = b < c, d = e > f"],
    "py": ["x = 1  # c\n\n\tif_ = 2\n".replace("\tif_", "if_"), "def f(a, /, b=1, *c: int, d, **e) -> int: return lambda x, *y: x\n", "match x:\n    case {'a': [1, *_], **r} | P(q=2) if z: pass\n", "with (open(a) as b, c as d): pass\n", "f'{x!r:>{w}} {{}} {y=} {d['k']}' rf'\\d{z}' '\\N{BULLET}' f'\\N{BULLET}'\n", "try:\n  pass\nexcept* (A, B) as e:\n  pass\n", "class A[T: int, *U](B, metaclass=C):\n\n    # c\n    type X = int\n\n# end", "a, *b = c = yield_ = [*d, e := 3]\nprint(*a, **b, c=1)\nasync def g():\n\tasync with a as (b, c): await d\n", "x = (1 if a else\n  # c\n 2)\\\n + 3", "match = case = type = 1\nmatch[0] = type\n", "if x:\n  y\n# c\n  z\n"],
}
INVALID = {
    "ts": ["export const = 9;", "<<<<<<< HEAD\nconst a = 1\n=======\n>>>>>>> b", "function f() {", "const a = 'x", "const a = <div>x</div>", '{\n  "a": 1,\n  "b": 2\n}', "const a", "x = /* never closed", "const t = `a ${b", "import x as y", "let a = 1 let b = 2", "def f(x):\n    return 1", "f(1, 2", "Some prose about `a` and b.", "if (a) { } }", "type A = { a: string", "for (const x of) {}", "a => { b } }", "interface X { a: }"],
    "tsx": ["const a = <div>x</span>", "const a = <div>", "const a = <div a=>x</div>", "const a = <div>x</div", "const a = <p>}</p>"],
    "js": ["function f(a: string) {}", "interface A {}", "const a = <div/>", "let a = b as const", "type A = string", "const { a } ;"],
    "jsx": ["const f = (x: number) => <a/>", "<a></b>"],
    "py": ["def f(:\n", "if x:\npass\n", "  x = 1\n", "x = 'a\n", "f(a=1, b)\n", "x + 1 = 2\n", "if x:\n    a\n  b\n", "x = (1,\n", "print 'a'\n", "<<<<<<< HEAD\n", "x = 1z\n", "f'{x'\n", "a = 01\n", "def f(a=1, b): pass\n", "try:\n  pass\n", "x = $\n", "(]\n", "const a = 1;\nexport { a };\n", "with a as b\n"],
}


EARLY_ERRORS = [
    "return 1", "if (a) { return }", "class A { static { return } }", "{ return }", "for (;;) return", "switch (a) { case 1: return }", "try { return } catch { }", "label: return", "a ?? b || c", "a && b ?? c", "a || b ?? c", "a ?? b && c",
    "-1 ** 2", "typeof a ** 2", "!a ** 2", "+a ** b", "void 0 ** 2", "delete a.b ** 2", "({a = 1})", "({a, b = 2}, 1)", "f({a = 1})", "[{a = 1}].b", "1 = x", "f() = 1", "f() += 2", "this = 1", "a + b = c", "'a' = b", "`a` = b", "[1, 2]++",
    "++f()", "f()--", "--1", "1++", "a?.b = 1", "a?.[0]++", "new.target = 1", "(a, b) = c", "for (f() of y) {}", "for (1 in y) {}", "for (a + b of c) {}", "import {a as default} from 'x'", "import {if} from 'x'",
    "import {a as 'b'} from 'x'", "import default from 'x'", "x = 010", "x = 00", "x = 09.5", "x = 0_1", "a => b = c = 1 => 2", "[a, f()] += b", "({a: 1} += b)", "import {a, class} from 'x'",
]
NO_ERRORS = [
    "function f() { if (a) { return 1 } }", "(a ?? b) || c", "a || b && c", "2 ** -1", "(-1) ** 2", "({a = 1} = b)", "[a, b] = [b, a]", "[a.b, c[0], ...d] = e", "({ a: b.c, d: [e] = [], ...f } = g)", "for ({a, b = 2} of c) {}",
    "for (a.b in c) {}", "(a) = 1", "a.b.c += 1", "++a.b; a[0]--", "const f = ({a = 1}) => a", "const g = async ([a, b = {}]) => { return a }", "x = y = z", "a = b ?? c ?? d", "class A { m() { return 1 } static { go() } get x() { return 2 } }",
    "const o = { m() { return 1 }, get a() { return 2 }, b: () => { return 3 } }", "function g() { switch (x) { case 1: return 1; default: for (;;) { try { return } catch { return } finally { while (1) return } } } }",
    "x = 0.5 + 0n + 0x1f + 1_000 + 0", "import.meta.x = 1", "await a ** 2", "a ** b ** c", "import {default as a, if as b, 'c' as d} from 'x'", "export {a as default, b as if}", "f(...[a, b]).c = 1", "[[a], {b}] = c", "`${a}`.b = 1",
]


def test_early_errors_that_the_grammar_tells(parser):
    for ext in ("js", "ts", "jsx", "tsx", "mjs", "mts"):
        for text in EARLY_ERRORS:
            assert parser.first_error(ext, text) is not None, (ext, text)
        for text in NO_ERRORS:
            assert parser.first_error(ext, text) is None, (ext, text)
    for text in ["(a as any) = 1", "a! = 1", "(a as any).b = 2", "(<any>a).b = 2", "a! += 1", "x = a as T ?? b", "for (const [k, v] of (a as any)) {}", "namespace A { export const x = 1 }"]:
        assert parser.first_error("ts", text) is None, text


@pytest.mark.filterwarnings("ignore::SyntaxWarning")
def test_python_tokens_agree_with_the_interpreter(parser):
    texts = [
        "if a:\n\tb\n        c\n", "if a:\n        b\n\tc\n", "if a:\n  if b:\n\tc\n", "if a:\n\tif b:\n\t    c\n\td\n", "b'é'\n", "rb'é'\n", r"'\N{bad'", r"'\N'", r"'\N{nope}'", r"'\N{BULLET}'", r"'\x1'", r"'\u12'", r"'\U00110000'", r"'\U0010ffff'",
        r"b'\x1'", r"b'\u12' b'\N'", r"r'\x' rb'\x'", r"r'\x' '\x41'", "'a' b'b'", "b'a' f'b'", r"f'\x1'", r"f'\N{BULLET} {a}'", r"f'\N{nope} {a}'", r"rf'\N{a}'", r"f'\d {a}'", "'\\\n'", "f'\\\n{x}'", r"f'\{6}'", r"f'\N'",
        "match x:\n  case b'a': pass\n  case {b'a': 1}: pass\n", "x = 0777", "x = 1_", "x = 0b12", "x = 1__0",
    ]
    for text in texts:
        try:
            ast.parse(text)
            right = True
        except SyntaxError:
            right = False
        assert (parser.first_error("py", text) is None) == (parser.first_error("pyi", text) is None) == right, text


@pytest.mark.parametrize("ext", list(VALID))
def test_valid_sources(parser, ext):
    for text in VALID[ext]:
        assert parser.first_error(ext, text) is None, text
    if ext == "py":
        for text in VALID[ext]:
            ast.parse(text)


@pytest.mark.parametrize("ext", list(INVALID))
def test_invalid_sources(parser, ext):
    for text in INVALID[ext]:
        assert parser.first_error(ext, text) is not None, text


def test_place_of_the_first_error(parser):
    assert parser.first_error("ts", "const a = 1;\nexport const = 9;\n") == (2, 13)
    assert parser.first_error("py", "a = 1\nb = = 2\n")[0] == 2


def test_python_agrees_with_the_interpreter(parser):
    """Whole modules of the standard library, and each cut at several places."""
    files = sorted(pathlib.Path(sysconfig.get_paths()["stdlib"]).glob("*.py"))[::6]
    for path in files:
        text = path.read_text(encoding="utf-8")
        for part in (text, *(text[: len(text) * k // 5] for k in range(1, 5))):
            try:
                ast.parse(part)
                valid = True
            except SyntaxError:
                valid = False
            assert (parser.first_error("py", part) is None) == valid, (path, len(part))


def test_both_script_scanners_agree(parser):
    for ext in ("ts", "js"):
        for text in VALID[ext] + INVALID[ext]:
            quick = parser.lexers[ext].quick(text)
            if quick is not None and parser.recognizers[ext].run(quick) is None:
                assert parser.recognizers[ext].run(parser.lexers[ext].exact(text.removeprefix("﻿"))[0]) is None, text


def test_recognizer_takes_ambiguous_grammars():
    table = compile_grammar("s: s s | 'a' | 'b'? 'c'\n")
    r = Recognizer(table)
    code = lambda x: "".join(table.terminals[c] for c in x)
    for text, ok in (("a", 1), ("aaaaaaa", 1), ("bcac", 1), ("b", 0), ("", 0), ("abb", 0)):
        assert (r.run([code(text)]) is None) == bool(ok), text


def test_nesting_is_not_limited(parser):
    assert parser.first_error("ts", "x = " + "(" * 20_000 + "1" + ")" * 20_000) is None
    assert parser.first_error("py", "x = " + "[" * 20_000 + "]" * 19_999) is not None


def test_operator(spark):
    rows = [("/w/a.ts", "p", "const a = 1"), ("/w/a.ts", "p", "const a = 1"), ("/w/b.py", "p", "x = = 1"), ("/w/c.py", None, ""), ("/w/d.py", "p", None), ("/w/e.md", "p", "# x"), (None, "p", "x")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "file string, project string, content string, ext int")
    got = sorted(tuple(r) for r in syntax.check_syntax(df, F.col("file"), F.col("content"), F.col("project")).select("file", "grp", "valid").collect())
    assert got == [("/w/a.ts", "p", True), ("/w/b.py", "p", False), ("/w/c.py", None, True)]
    assert syntax.check_syntax(df.limit(0), F.col("file"), F.col("content"), F.col("project")).count() == 0


def test_nested_formatted_strings_as_deep_as_the_interpreter(parser):
    strings = lambda k: "x = " + "f'{" * k + "1" + "}'" * k + "\n"
    fields = lambda k: "x = f'" + "{1:" * (k - 1) + "{1}" + "}" * (k - 1) + "'\n"
    for text in [*map(strings, (6, 7, 20, 149, 150)), *map(fields, (1, 2, 3, 4, 5)), "x = f'{1:{1:{1:x}}}'\n", "x = f'{1:{f\"{1:{1:{1}}}\"}}'\n"]:
        try:
            ast.parse(text)
            right = True
        except SyntaxError:
            right = False
        assert (parser.first_error("py", text) is None) == right, text
