"""Source files that do not parse (p1).

Grammars bundled with this package become LR tables on the driver; tasks run a generalised LR recogniser over the whole token stream of each file and
report the first token that no reading of the grammar takes. The extension names the language: ``.py`` and ``.pyi`` a Python 3.13 module, ``.ts``, ``.mts`` and ``.cts``
TypeScript, ``.tsx`` TypeScript with markup, ``.js`` and ``.mjs`` JavaScript, ``.jsx`` JavaScript with markup; modules all of them. What no grammar of
tokens says (names declared twice, jumps out of no loop) is not judged.

Defined results: null content gives no row; empty content, white space and comments alone are valid; a leading byte-order mark is not part of the
content; other extensions are not judged; repeated rows are reported once per (file, content). Very long files are read whole.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.llm.glr import Recognizer, compile_grammar
from tessel.llm.lexers import PythonLexer, ScriptLexer

GRAMMARS = Path(__file__).parent / "grammars"
# extension -> grammar, features, markup, types
LANGUAGES = {
    "py": ("python.txt", (), False, False),
    "ts": ("script.txt", ("ts", "cast"), False, True),
    "tsx": ("script.txt", ("ts", "jsx"), True, True),
    "js": ("script.txt", ("js",), False, False),
    "jsx": ("script.txt", ("jsx",), True, False),
}
LANGUAGES |= {"pyi": LANGUAGES["py"], "mts": LANGUAGES["ts"], "cts": LANGUAGES["ts"], "mjs": LANGUAGES["js"]}


@cache
def packed_tables() -> bytes:
    """The tables of all languages, compiled once per driver."""
    compiled = {(g, f): compile_grammar((GRAMMARS / g).read_text(), set(f)) for g, f, _, _ in LANGUAGES.values()}
    return zlib.compress(pickle.dumps({ext: compiled[g, f] for ext, (g, f, _, _) in LANGUAGES.items()}), 6)


class Parser:
    """Syntax checks of one worker; what was learnt about lines of tokens is kept between files."""

    def __init__(self, tables: dict):
        self.lexers, self.recognizers = {}, {}
        for ext, (grammar, _, markup, types) in LANGUAGES.items():
            t = tables[ext].terminals
            if grammar == "python.txt":
                self.lexers[ext] = PythonLexer(t)
                self.recognizers[ext] = Recognizer(tables[ext])
            else:
                self.lexers[ext] = ScriptLexer(t, markup, types)
                self.recognizers[ext] = Recognizer(tables[ext], ScriptLexer.NEWLINE, t["SEMI_AUTO"], t["}"])

    def first_error(self, ext: str, text: str) -> tuple[int, int] | None:
        """(line, column) of the first token that does not fit, from 1 and 0; None for a valid file."""
        text = text.removeprefix("﻿")
        lexer, recognizer = self.lexers[ext], self.recognizers[ext]
        if isinstance(lexer, PythonLexer):
            if "\0" in text:
                return _place(text, text.index("\0"))
            lines, starts = lexer.exact(text)
            error = recognizer.run(lines)
            if error is None:
                return None
            return _place(text.replace("\r\n", "\n").replace("\r", "\n"), starts[error[0]] if error[0] < len(starts) else len(text))
        quick = lexer.quick(text)
        if quick is not None and recognizer.run(quick) is None:
            return None
        lines, offsets = lexer.exact(text)
        error = recognizer.run(lines)
        if error is None:
            return None
        line, token = error
        return _place(text, offsets[line][token] if line < len(offsets) and token < len(offsets[line]) else len(text))


def _place(text: str, offset: int) -> tuple[int, int]:
    before = text[:offset]
    return before.count("\n") + 1, offset - (before.rfind("\n") + 1)


_PARSERS: dict[int, Parser] = {}


def _check(packed: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = zlib.crc32(packed)
        parser = _PARSERS.get(key)
        if parser is None:
            parser = _PARSERS[key] = Parser(pickle.loads(zlib.decompress(packed)))
        for batch in batches:
            found = [parser.first_error(ext, text) for ext, text in zip(batch.column("ext").to_pylist(), batch.column("text").to_pylist())]
            line, column = ([f and f[k] for f in found] for k in (0, 1))
            kept = [batch.column(c) for c in batch.schema.names if c != "text"]
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([f is None for f in found]), pa.array(line, pa.int32()), pa.array(column, pa.int32())], names=[*names, "valid", "line", "col"])

    return run


def check_syntax(df: DataFrame, file: Column, text: Column, group: Column) -> DataFrame:
    """(file, grp, ext, valid, line, col) of every distinct (file, group, content) in a known language."""
    rows = df.select(file.cast("string").alias("file"), group.cast("string").alias("grp"), F.regexp_extract(F.lower(file), r"\.(\w+)$", 1).alias("ext"), text.alias("text"))
    rows = rows.filter(F.col("text").isNotNull() & F.col("ext").isin(*LANGUAGES))
    return rows.mapInArrow(_check(packed_tables()), "file string, grp string, ext string, valid boolean, line int, col int").distinct()
