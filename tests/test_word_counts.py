"""Bulk counts of words against the words that Spark finds."""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tracehold.operators import features, word_counts as module

TEXTS = [
    "",
    "a bb a_b bb\n\tÉté-été l'été à ÀÀ ǅǆ ΟΔΟΣ",
    None,
    "x" * 5000 + " " + "x" * 5000 + " y1 ١٢ 漢字 𝒜𝒷 ²³ ábc é‍b cc",
    "Ᲊᲊ later \U0001df25\U0001df26letters ࡰࡱab zz \x00nul\x00",
    "--- !!",
    "one two Two TWO",
]


def test_words_are_those_of_spark(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, t string")
    want, texts = Counter(), Counter()
    for row in df.select(features.words(features.text_of(["t"])).alias("w")).collect():
        want.update(row.w)
        texts.update(set(row.w))
    found = {r.term: (r.total, r.df) for r in features.vocabulary(df, ["t"], 1000).collect()}
    assert found == {w: (n, texts[w]) for w, n in want.items()}
    top = [r.term for r in features.vocabulary(df, ["t"], 3).orderBy(F.desc("total"), "term").collect()]
    assert top == sorted(want, key=lambda w: (-want[w], w))[:3]
    lowered = [r[0] for r in df.select(F.lower(features.text_of(["t"]))).collect()]
    terms = sorted(want)
    counts = module.TermCounts(module.letter_runs(spark), terms)(pa.array(lowered))
    rows = df.select("id", features.words(features.text_of(["t"])).alias("w")).orderBy("id").collect()
    assert [dict(zip(terms, c)) for c in counts.tolist()] == [{t: r.w.count(t) for t in terms} for r in rows]
    empty = df.where("id < 0")
    assert features.vocabulary(empty, ["t"]).collect() == []
    assert module.TermCounts(module.letter_runs(spark), [])(pa.array(lowered)).shape == (len(TEXTS), 0)


def test_pieces_and_windows(spark, monkeypatch):
    """Texts beyond a piece and words beyond a window are whole."""
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdé"), rng.integers(1, 30))) for _ in range(40)]
    texts = [" ".join(rng.choice(words, rng.integers(0, 30))) for _ in range(70)] + ["e" * 900 + " " + "e" * 901]
    runs = module.letter_runs(spark)
    whole = module.Splitter(runs).words("\n".join(texts))
    monkeypatch.setattr(module, "PIECE", 50)
    monkeypatch.setattr(module, "WINDOW", 16)
    named, rows = [], []
    for first, n, joined, row, start, end, bits in module.Splitter(runs).pieces(pa.array(texts)):
        assert [joined[a:b] for a, b in zip(start, end)] == [w for t in texts[first : first + n] for w in t.split() if len(w) > 1]
        named += bits.tolist()
        rows += (row + first).tolist()
    assert rows == [i for i, t in enumerate(texts) for w in t.split() if len(w) > 1]
    assert named == whole[2].tolist()
    assert len(set(named)) == len({w for t in texts for w in t.split() if len(w) > 1})


def test_order_by_word():
    rng = np.random.default_rng(3)
    named = rng.choice(rng.integers(0, 1 << 63, 50).astype(np.uint64) * np.uint64(2), 1000)
    assert (module._by_word(named) == np.argsort(named, kind="stable")).all()
    alike = rng.choice(np.array([8, 9, 1 << 60, 10], np.uint64), 100)
    order = module._by_word(alike)
    assert (alike[order] == np.sort(alike)).all() and all((np.diff(order[alike[order] == v]) > 0).all() for v in set(alike))
