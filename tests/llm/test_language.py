import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.llm import language

WORDS = {
    "en": "the every file module with which this report keeps should would there because while never after before again their other nobody thing where might been does have".split(),
    "de": "der jede datei wird nicht damit dieser bericht sollte weil während niemals nachdem wieder andere niemand etwas wo könnte gewesen haben über für schließlich größe".split(),
    "ru": "каждый файл модуль который этот отчёт должен потому пока никогда после перед снова другой никто вещь где может был иметь через для".split(),
}


def prose(rng, lang, n):
    return " ".join(" ".join(rng.choice(WORDS[lang]) for _ in range(rng.randrange(7, 14))).capitalize() + rng.choice([".", "!", "?"]) for _ in range(n))


def test_sentences_leave_code_out():
    text = "# Heading about things\n\nThe first `a.b? c` sentence is here. And the second one follows, e.g. 4.12 of it!\n- A list item with several words\n\n```py\nthis is not prose at all. no.\n```\nsrc/a.ts:3:4:error:unused: this is a log line\n请把清单读取器移到模块图里。不应该知道细节。"
    found = language.sentences(text)
    assert [c for _, _, c in found][:3] == ["the first sentence is here", "and the second one follows of it", "a list item with several words"]
    assert len(found) == 5
    assert all(text[a:b].strip() for a, b, _ in found)
    assert language.sentences("") == [] and language.sentences("```\nnever closed, so all code. Really.") == []


def test_path_prefers_few_changes():
    s = np.log(np.array([[0.9, 0.1], [0.4, 0.6], [0.9, 0.1], [0.01, 0.99], [0.01, 0.99]]))
    assert language.path(s).tolist() == [0, 0, 0, 1, 1]


def test_gradient_is_right():
    rng = np.random.default_rng(0)
    net = language.Network(3, seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = rng.integers(1, 256, (5, language.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 0, 1])
    loss = lambda: -(net.forward(x)[np.arange(5), y]).mean()
    g = net.gradients(x, y, 0.0)
    for name, at in (("o", (3, 1)), ("c", (2,)), ("w3", (5, 4)), ("b2", (3,)), ("e", (int(x[0, 9]), 2))):
        old, step = net.p[name][at], 1e-6
        net.p[name][at] = old + step
        high = loss()
        net.p[name][at] = old - step
        low = loss()
        net.p[name][at] = old
        assert abs((high - low) / (2 * step) - g[name][at]) < 1e-5, name


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    rows = []
    for _ in range(240):
        lang = rng.choice(["en", "en", "de", "ru"])
        label = lang if rng.random() > 0.12 else rng.choice(["en", "de", "ru"])  # wrong labels
        rows.append((label, prose(rng, lang, 6)))
    return language.fit(iter(rows), steps=150)


def test_held_out_accuracy(model):
    langs, net = model
    rng = random.Random(2)
    texts = [(lang, prose(rng, lang, 1)) for _ in range(100) for lang in WORDS]
    cleans = [language.sentences(t)[0][2] for _, t in texts]
    for shown in (cleans, [language.plain(c) for c in cleans]):
        right = sum(langs[k] == lang for k, (lang, _) in zip(net.scores(shown).argmax(1), texts))
        assert right >= 0.98 * len(texts)


def test_mixed_document(model):
    langs, net = model
    rng = random.Random(3)
    text = prose(rng, "en", 4) + "\n\n" + prose(rng, "de", 2) + " " + prose(rng, "en", 3)
    found = language.sentences(text)
    got = language.segments(found, net.scores([c for _, _, c in found]))
    assert [(langs[s[2]], s[3]) for s in got] == [("en", 4), ("de", 2), ("en", 3)]
    assert all(0 < s[4] <= 1 for s in got)


def test_operator_and_labels(spark):
    rng = random.Random(4)
    codes = spark.createDataFrame([("en", "eng", "English"), ("de", "deu", "German"), ("ru", "rus", "Russian"), (None, None, None)], "lang string, alpha3 string, lang_name string")
    rows = [(n, prose(rng, lang, 6), label) for n, (lang, label) in enumerate([("en", "en_US"), ("de", "DEU"), ("ru", "Russian"), ("en", "eng")] * 30)]
    rows += [(900, prose(rng, "de", 3), "en"), (901, prose(rng, "ru", 3), "unknown"), (902, "", "en"), (903, None, "en"), (904, "```\ncode\n```", None), (None, prose(rng, "en", 3), None), (905, prose(rng, "en", 4000), "en")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, lang string, label string")
    got = language.detect(df, F.col("doc_id"), F.col("text"), F.col("lang"), codes, steps=120).filter("sentences >= 2").select("id", "label", "lang").distinct().collect()
    by = {r.id: (r.label, r.lang) for r in got if r.id is None or r.id >= 900}
    assert by == {900: ("en", "de"), 901: (None, "ru"), None: (None, "en"), 905: ("en", "en")}
    assert all(r.label == r.lang for r in got if r.id is not None and r.id < 900)
    assert language.detect(df.limit(0), F.col("doc_id"), F.col("text"), F.col("lang"), codes).count() == 0


def test_windows_cover_every_byte():
    for size in (1, 62, 63, 70, 94, 95, 126, 127, 158, 300):
        clean = "".join(chr(33 + n % 90) for n in range(size))
        x, owner = language.windows(["ab cd", clean])
        data, at = f" {clean} ".encode(), 0
        for row in x[owner == 1]:
            piece = row.tobytes().rstrip(b"\0")
            found = data.find(piece, max(0, at - language.WINDOW))
            assert 0 <= found <= at
            at = found + len(piece)
        assert at == len(data), size
