"""Languages of documents and of their segments by a byte convolutional network (p9).

A text is read sentence by sentence: code, log lines, headings, inline code, identifiers and quoted terms are taken out, what is left is lower-cased. Indented
lines are code unless they go on with a paragraph or list; the cells of a table are read one by one. The UTF-8 bytes of each sentence fill fixed-length windows; the network (byte embedding, convolutions of several widths, maximum over time,
softmax; plain numpy) gives each window a distribution, a sentence gets the mean of its windows' log-probabilities. Along the text a most
probable path with a price per change of language makes segments. A sentence of few letters says little: its log-probabilities weigh
less, and it counts as a sentence of its segment only if it looks like its language by itself.

The network is trained on the labelled rows themselves: documents with a usable label, chosen by digest, about ``SAMPLE_DOCS``, of each language in
proportion to its documents but ``SAMPLE_LEAST`` at least if it has them, at most ``SAMPLE_SENTENCES`` sentences of each. Labels are partly wrong, so a sentence counts for
the label most of its copies have, and after a first round sentences the network is sure to be mislabelled are left out. Every sentence is also
shown without accents. Everything else reads all documents.

Defined results: null and empty texts, and texts with no sentence, have no segment but one row without language, with no sentence and confidence 0; a label that names
no language says nothing; without any usable label in the table there is no network, and every row is such a row; repeated rows give their rows again, ``distinct`` is up to the query. Input columns other than id, text and label are not read.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_DOCS = 4000
SAMPLE_LEAST = 50
SAMPLE_SENTENCES = 24
WINDOW = 64
EMBEDDING = 12
WIDTHS = (2, 3, 4, 5)
FILTERS = 24
STEPS = 800
CHANGE = 2.5
FLOOR = -9.0
FULL_WEIGHT = 48
_KEPT = 150_000
MAX_LANGUAGES = 1000

_FENCE = re.compile(r"^[ \t]*(```+|~~~+)[^\n]*\n(?:[\s\S]*?^[ \t]*\1[^\n]*$|[\s\S]*\Z)", re.M)
_LINE = re.compile(r"[^\r\n]+")
_SKIPPED = re.compile(r"\s*(?:#{1,6}\s|[=*_-]{3,}\s*$|(?:[A-Z]+|\[[^\]]*\])?[ \t]*\d{4}-\d\d-\d\d|\S+:\d+:\d+|\$ |at \S+\(|\|?(?:\s*:?-+:?\s*\|)+)")
_INDENTED = re.compile(r"(?: {4}|\t)\s*\S")
_LIST = re.compile(r"\s*(?:>\s*)*(?:[-*+]|\d+[.)])\s")
_CELL = re.compile(r"(?:`[^`]*`|[^|`]|`)+")
_MARK = re.compile(r"[ \t]*(?:>[ \t]*)*(?:[-*+][ \t]+|\d+[.)][ \t]+)?(?:\[[ xX]\][ \t]*)?")
_SENTENCE = re.compile(r"(?:`[^`]*`|[^`.!?…。！？]+|(?<=\b[^\W\d_])\.|[.!?…]+(?![\s\"'”»)\]*_]|$)|`)+(?:[.!?…。！？]+[\"'”»)\]*_]*|$)")
_MARKS = "_/\\0123456789@#<>=|{}[]()*~$%^+"
_OTHER = "[" + "".join(re.escape(chr(c)) for c in range(33, 127) if chr(c) not in _MARKS) + "]"
# inline code, quoted terms, and tokens that no prose has; a token is tried from its first character only
_NOISE = re.compile(
    r"`[^`]*`?|\(?[“\"«„][^“”\"«»„]{0,40}[”\"»“]\)?|(?<![!-~])" + _OTHER + "*[" + re.escape(_MARKS) + r"][!-~]*"
    r"|(?<![A-Za-z])(?:[A-Za-z]*[a-z][A-Z][!-~]*|[A-Za-z]+(?:-[A-Za-z]+)+\b|[A-Za-z]+\.[A-Za-z]+\b)"
)
_SPACES = re.compile(r"[\W\d_]+")
_WIDE = re.compile(r"[぀-ヿ㐀-鿿가-힯]")


def _prose(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the lines, and cells of table rows, that may be prose."""
    listed = coded = False
    end = 0
    for line in _LINE.finditer(text):
        raw, base = line[0], line.start()
        if not raw.strip():
            continue
        apart = end == 0 or text.count("\n", end, base) > 1 or text.count("\r", end, base) > 1
        end = line.end()
        if _LIST.match(raw) and not coded:
            listed = True
        elif apart and raw[0] not in " \t":
            listed = False
        coded = not listed and _INDENTED.match(raw) is not None and (apart or coded)
        if coded or _SKIPPED.match(raw):
            continue
        if raw.lstrip()[0] == "|":
            yield from ((base + cell.start(), base + cell.end()) for cell in _CELL.finditer(raw))
        else:
            yield base + _MARK.match(raw).end(), end


def sentences(text: str) -> list[tuple[int, int, str]]:
    """(start, end, cleaned) of every sentence of prose."""
    if "```" in text or "~~~" in text:
        text = _FENCE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    out = []
    for start, end in _prose(text):
        for m in _SENTENCE.finditer(text, start, end):
            clean = _SPACES.sub(" ", _NOISE.sub(" ", m[0])).strip().lower()
            if len(clean) >= 4 or len(clean) >= 2 and _WIDE.search(clean):
                out.append((m.start(), m.end(), clean))
    return out


def firm(clean: str) -> bool:
    """Whether a sentence is long enough to be judged by itself."""
    return len(clean) >= 12 and clean.count(" ") >= 2 or len(clean) >= 4 and len(_WIDE.findall(clean)) >= 4


def plain(clean: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", clean) if not unicodedata.combining(c))


def windows(cleans: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of each window, number of its sentence); the windows cover the sentence, the last one of a long sentence ends with it."""
    rows, owner = [], []
    for n, clean in enumerate(cleans):
        data = f" {clean} ".encode()
        for s in range(0, len(data), WINDOW):
            s = min(s, max(0, len(data) - WINDOW))
            rows.append(data[s : s + WINDOW].ljust(WINDOW, b"\0"))
            owner.append(n)
    return np.frombuffer(b"".join(rows), np.uint8).reshape(-1, WINDOW), np.array(owner)


class Network:
    """Embedding, one convolution per width, ReLU, maximum over time, softmax."""

    def __init__(self, classes: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        f = np.float32
        self.p = {"e": rng.normal(0, 0.5, (256, EMBEDDING)).astype(f)}
        self.p["e"][0] = 0
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, (2 / (w * EMBEDDING)) ** 0.5, (w * EMBEDDING, FILTERS)).astype(f)
            self.p[f"b{w}"] = np.zeros(FILTERS, f)
        self.p["o"] = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), classes)).astype(f)
        self.p["c"] = np.zeros(classes, f)

    def forward(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        p, n = self.p, len(x)
        emb = p["e"][x]
        pooled = []
        for w in WIDTHS:
            view = np.lib.stride_tricks.as_strided(emb, (n, WINDOW - w + 1, w * EMBEDDING), (emb.strides[0], emb.strides[1], emb.strides[2]))
            flat = np.ascontiguousarray(view).reshape(-1, w * EMBEDDING)
            out = (flat @ p[f"w{w}"]).reshape(n, WINDOW - w + 1, FILTERS)
            if keep is not None:
                keep[w] = (flat, out.argmax(1))
            pooled.append(np.maximum(out.max(1) + p[f"b{w}"], 0))
        h = np.concatenate(pooled, 1)
        z = h @ p["o"] + p["c"]
        z -= z.max(1, keepdims=True)
        z -= np.log(np.exp(z).sum(1, keepdims=True))
        if keep is not None:
            keep["h"] = h
        return z

    def gradients(self, x: np.ndarray, y: np.ndarray, smooth: float) -> dict[str, np.ndarray]:
        p, keep, n = self.p, {}, len(x)
        z = self.forward(x, keep)
        d = np.exp(z)
        target = np.full_like(d, smooth / d.shape[1])
        target[np.arange(n), y] += 1 - smooth
        d = (d - target) / n
        g = {"o": keep["h"].T @ d, "c": d.sum(0), "e": np.zeros_like(p["e"])}
        dh = (d @ p["o"].T) * (keep["h"] > 0)
        for k, w in enumerate(WIDTHS):
            flat, best = keep[w]
            dw = dh[:, k * FILTERS : (k + 1) * FILTERS]
            rows = np.arange(n)[:, None] * (WINDOW - w + 1) + best
            patches = flat[rows]  # only the maximum passes a gradient
            g[f"w{w}"] = np.einsum("nfi,nf->if", patches, dw, optimize=True)
            g[f"b{w}"] = dw.sum(0)
            back = dw[:, :, None] * p[f"w{w}"].T[None]
            for j in range(w):
                np.add.at(g["e"], x[np.arange(n)[:, None], best + j].ravel(), back[:, :, j * EMBEDDING : (j + 1) * EMBEDDING].reshape(-1, EMBEDDING))
        g["e"][0] = 0
        return g

    def train(self, x: np.ndarray, y: np.ndarray, steps: int, seed: int, batch: int = 128, rate: float = 3e-3) -> None:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(a) for k, a in self.p.items()}
        for t in range(1, steps + 1):
            i = rng.integers(0, len(x), batch)
            slope = rate * min(1, 4 * (1 - t / (steps + 1)))
            for k, g in self.gradients(x[i], y[i], 0.05).items():
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                self.p[k] -= slope * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)

    def scores(self, cleans: list[str]) -> np.ndarray:
        """Log-probabilities of each sentence, bounded below so that one window cannot outweigh a text."""
        x, owner = windows(cleans)
        z = np.concatenate([self.forward(x[i : i + 512]) for i in range(0, len(x), 512)])
        out = np.zeros((len(cleans), z.shape[1]), np.float32)
        np.add.at(out, owner, z)
        out = np.maximum(out / np.bincount(owner, minlength=len(cleans))[:, None], FLOOR)
        weak = [n for n, c in enumerate(cleans) if not firm(c)]
        out[weak] *= np.array([min(1, len(cleans[n].encode()) / FULL_WEIGHT) for n in weak], np.float32)[:, None]
        return out


def fit(texts: Iterator[tuple[str, str]], steps: int = STEPS) -> tuple[list[str], Network] | None:
    """Languages and network from (language, text) rows with partly wrong labels."""
    votes: dict[str, Counter] = defaultdict(Counter)
    for lang, text in texts:
        for clean in [c for _, _, c in sentences(text) if firm(c)][:SAMPLE_SENTENCES]:
            votes[clean][lang] += 1
    langs = sorted({lang for v in votes.values() for lang in v})
    if not langs:
        return None
    number = {lang: k for k, lang in enumerate(langs)}
    cleans = sorted(votes)
    best = [max(votes[c].items(), key=lambda v: (v[1], v[0]))[0] for c in cleans]
    y = np.array([number[b] for b in best])
    sure = np.array([votes[c][b] > 0.6 * sum(votes[c].values()) for c, b in zip(cleans, best)])
    if not sure.any():
        sure[:] = True
    net = Network(len(langs))
    keep = sure
    for round_, n in ((1, steps // 2), (2, steps)):
        chosen = np.flatnonzero(keep)
        shown = [cleans[i] for i in chosen] + [plain(cleans[i]) for i in chosen]
        x, owner = windows(shown)
        label = np.r_[y[chosen], y[chosen]][owner]
        # rare languages are shown more often, by the square root, and frequent sentences, by the logarithm
        counts = np.bincount(label, minlength=len(langs))
        often = np.log2([sum(votes[cleans[i]].values()) for i in chosen]).astype(int) + 1
        repeat = np.maximum(1, np.sqrt(counts.max() / np.maximum(counts, 1))).astype(int)[label] * np.r_[often, often][owner]
        net = Network(len(langs), seed=round_)
        net.train(np.repeat(x, repeat, 0), np.repeat(label, repeat), n, seed=round_)
        if round_ == 1:
            z = net.scores(cleans)
            keep = sure & (z[np.arange(len(y)), y] > z.max(1) - 2)
            if not keep.any():
                keep = sure
    return langs, net


def path(scores: np.ndarray, change: float = CHANGE) -> np.ndarray:
    """The most probable language of each sentence when every change costs ``change``."""
    n, k = scores.shape
    best, back = scores[0].copy(), np.zeros((n, k), np.int64)
    for i in range(1, n):
        top = int(best.argmax())
        stay = best >= best[top] - change
        back[i] = np.where(stay, np.arange(k), top)
        best = np.where(stay, best, best[top] - change) + scores[i]
    out = np.empty(n, np.int64)
    out[-1] = best.argmax()
    for i in range(n - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def segments(found: list[tuple[int, int, str]], scores: np.ndarray) -> list[tuple[int, int, int, int, float, float]]:
    """(start, end, language, sentences, confidence, weight) of each stretch of one language."""
    single = scores.argmax(1)
    # one language throughout costs no change, so there is nothing to weigh
    at = single if (single == single[0]).all() else path(scores)
    edges = np.flatnonzero(np.r_[True, at[1:] != at[:-1], True])
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        mean = scores[a:b].mean(0)
        p = np.exp(mean - mean.max())
        counted = sum(single[i] == at[i] or firm(found[i][2]) for i in range(a, b))
        out.append((found[a][0], found[b - 1][1], int(at[a]), counted, float(p[at[a]] / p.sum()), float(sum(len(found[i][2]) for i in range(a, b)))))
    return out


_SEGMENTS = "id bigint, label string, start bigint, end bigint, lang string, sentences int, confidence double, weight double"
_SCORES: dict[bytes, dict[str, np.ndarray]] = {}


def _detect(langs: list[str], net: Network, key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _SCORES.setdefault(key, {})
        for batch in batches:
            for s in range(0, batch.num_rows, 512):
                part = batch.slice(s, 512)
                docs = [sentences(t) if t else [] for t in part.column("text").to_pylist()]
                if len(known) > _KEPT:
                    known.clear()
                fresh = list(dict.fromkeys(c for found in docs for _, _, c in found if c not in known))
                if fresh:
                    known.update(zip(fresh, net.scores(fresh)))
                rows = []
                for key_, label, found in zip(part.column("id").to_pylist(), part.column("label").to_pylist(), docs):
                    if not found:
                        rows.append((key_, label, None, None, None, 0, 0.0, 0.0))
                    else:
                        rows.extend((key_, label, a, b, langs[k], n, round(p, 4), w) for a, b, k, n, p, w in segments(found, np.stack([known[c] for _, _, c in found])))
                columns = list(zip(*rows)) if rows else [[]] * 8
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["id", "label", "start", "end", "lang", "sentences", "confidence", "weight"])

    return run


def label_language(label: Column, codes: list[tuple[str, str, str]]) -> Column:
    """The two-letter code a label names by code or English name, whatever its case and region; null if it names none."""
    names = {n.strip().lower(): two for two, three, name in codes for n in (two, three, name) if n and two}
    if not names:
        return F.lit(None).cast("string")
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.try_element_at(table, F.lower(F.trim(F.split(label, "[-_]")[0])))


def _train(steps: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fit(((lang, text) for b in batches for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist())), steps)
        if model is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    return run


def detect(df: DataFrame, key: Column, text: Column, label: Column, codes: DataFrame, sample_docs: int = SAMPLE_DOCS, steps: int = STEPS) -> DataFrame:
    """(id, label, start, end, lang, sentences, confidence, weight) of every segment; ``codes`` has (lang, alpha3, lang_name)."""
    named = [tuple(r) for r in codes.select("lang", "alpha3", "lang_name").filter("lang is not null").distinct().limit(MAX_LANGUAGES + 1).collect()]
    if len(named) > MAX_LANGUAGES:
        raise ValueError("too many languages")
    rows = df.select(key.cast("bigint").alias("id"), text.alias("text"), label_language(label, named).alias("label"))
    usable = rows.filter("label is not null and length(text) > 40")
    digest = F.xxhash64("id").bitwiseAND((1 << 62) - 1)
    counts = {r.label: r.n for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}  # one row a language of ``codes``
    each = {label: max(SAMPLE_LEAST, round(sample_docs * n / sum(counts.values()))) for label, n in counts.items()}
    by_label = lambda d: F.try_element_at(F.create_map(*(F.lit(x) for pair in d.items() for x in pair)), F.col("label"))
    if not counts:
        sample = usable
    else:
        # about twice the sample passes these bounds at any size, so the final choice moves no more than that
        chosen = usable.filter(digest <= by_label({label: int(min(1.0, 2 * each[label] / n) * ((1 << 62) - 1)) for label, n in counts.items()}))
        place = F.row_number().over(Window.partitionBy("label").orderBy(digest, "id", "text"))
        sample = chosen.withColumn("place", place).filter(F.col("place") <= by_label(each))
    # one task trains, away from the driver; only the weights come back
    (model,) = sample.select("label", "text").repartition(1).mapInArrow(_train(steps), "model binary").collect() or [None]
    if model is None:
        return rows.selectExpr("id", "label", "cast(null as bigint) start", "cast(null as bigint) end", "cast(null as string) lang", "0 sentences", "0.0D confidence", "0.0D weight")
    langs, net = pickle.loads(model.model)
    digest = net.p["o"].tobytes()[:64]
    return rows.select("id", "text", "label").mapInArrow(_detect(langs, net, digest), _SEGMENTS)
