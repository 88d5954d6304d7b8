"""Phrase counts and scores against plain loops."""

import random
import re
from collections import Counter as Count

import numpy as np
import pytest

from tracehold.llm.collocations import BITS, Trie, collocations, count_phrases, pair_table, set_bits


def plain_counts(rows):
    counts = Count()
    for text, lang in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    counts["und" if lang is None else lang, tuple(words[i : i + k])] += 1
    return counts


def plain(rows, least, top, absorb=50):
    f = plain_counts(rows)
    out = []
    for lang in {g for g, _ in f}:
        n = sum(c for (g, w), c in f.items() if g == lang and len(w) == 1)
        candidates = {w: c for (g, w), c in f.items() if g == lang and len(w) > 1 and c >= least}
        scored = []
        for w, a in candidates.items():
            if any(w in (x[:2], x[1:]) and 100 * c >= absorb * a for x, c in candidates.items() if len(x) == 3 and len(w) == 2):
                continue
            cuts = [(1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
            score, _, l, r = min(cuts)
            scored.append((-score, -a, " ".join(w).encode(), l, r))
        for rank, (s, a, w, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, w.decode(), -a, l, r, n, -s))
    return sorted(out)


def random_rows(seed, n=120):
    draw = random.Random(seed)
    vocabulary = ["the", "The", "of", "a", "x", "y", "zé", "ß", "中文", "b\x00", "q\x85r", "\U0001f600", "in", "on"]
    weights = [9, 3, 8, 6, 4, 4, 3, 2, 2, 1, 1, 1, 5, 5]
    rows = []
    for _ in range(n):
        words = draw.choices(vocabulary, weights, k=draw.randint(0, 60))
        rows.append(("".join(w + draw.choice([" ", " ", " ", "\t ", ", ", ".", "\n"]) for w in words), draw.choice(["en", "de", None, "", "e\nn"])))
    return rows + rows[:7] + [(None, "en"), ("", "fr"), (" \n ", None)]


LIMITS = [{}, {"entries": 40, "numbered": 12, "burst": 3}, {"entries": 3, "numbered": 4, "burst": 1}]


@pytest.mark.parametrize("limits", LIMITS, ids=["whole", "spilling", "smallest"])
def test_against_loops(spark, limits):
    rows = random_rows(len(limits))
    docs = spark.createDataFrame([(t, g, 1, "p") for t, g in rows], "text string, lang string, n int, phrase string")
    got = sorted(tuple(r) for r in collocations(docs, min_count=3, top=30, **limits).collect())
    assert got == plain(rows, 3, 30)
    counted, totals = count_phrases(docs, min_count=3, **limits)
    found = {(r.lang, tuple(r.phrase.split(" "))): r.n for r in counted.collect()}
    assert found == {k: c for k, c in plain_counts(rows).items() if c >= 3}
    assert all(r.total > 0 for r in totals.collect())


def test_hot_phrase_long_text_and_nothing(spark):
    rows = [("of the " * 40_000, "en")] + [("of the " * 50, "en")] * 300 + [("of the end", "en")] * 12
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert sorted(tuple(r) for r in collocations(docs, entries=50, burst=2).collect()) == plain(rows, 10, 2000)
    assert collocations(docs.limit(0)).count() == 0


def test_stretches_of_words(spark, monkeypatch):
    """Numbered a few words at a time, in tasks of this process."""
    import pyarrow as pa

    from tracehold.llm import collocations as module

    rows = [r for r in random_rows(9) if r[1] is not None]
    batch = pa.RecordBatch.from_pydict({"lang": [g for _, g in rows], "text": pa.array([t for t, _ in rows], pa.string())})
    want = plain_counts(rows)

    class Whole:
        value = np.full(1 << 10, 255, np.uint8)

    for size in (1, 2, 3, 7, 1 << 20):
        monkeypatch.setattr(module, "WORDS", size)
        got = Count()
        for table in (None, Whole):
            for out in module._count(table, 50, 20, 4)(iter([batch])):
                for r in out.to_pylist():
                    assert r["words"] == len(r["phrase"].split(" "))
                    got[r["lang"], tuple(r["phrase"].split(" "))] += r["n"]
        assert got == want


def test_trie_counts_and_spills_in_order():
    draw = np.random.default_rng(1)
    trie, want, got = Trie(burst=5), Count(), Count()
    for _ in range(60):
        keys = (draw.integers(1, 9, 80) << 2 * BITS) | (draw.integers(0, 9, 80) << BITS) | draw.integers(0, 9, 80)
        keys, n = np.unique(keys, return_counts=True)
        trie.add(keys, n)
        want.update(dict(zip(keys.tolist(), n.tolist())))
        assert trie.entries == len(trie.run()[0])
        if trie.entries > 300:
            for run, counts in trie.spill(150):
                assert (np.diff(run) > 0).all()
                got.update(dict(zip(run.tolist(), counts.tolist())))
            assert trie.entries <= 150
    assert any(isinstance(p, Trie) for p in trie.parts)
    for run, counts in trie.spill(0):
        got.update(dict(zip(run.tolist(), counts.tolist())))
    assert got == want and trie.entries == 0


def test_table_never_denies_a_pair(spark):
    from tracehold.llm.collocations import _word_hashes, lang_hash, pair_hash
    from tracehold.llm.words import SPACE, words
    import pyarrow as pa

    pairs = [("en", f"w{i} x{i % 7}") for i in range(500)]
    table = pair_table(spark.createDataFrame(pairs, "lang string, phrase string"))
    for lang, expected in (("en", 1.0), ("de", 0.0)):
        hits = []
        for _, phrase in pairs:
            w = next(words(pa.array([phrase]), SPACE))
            hits += set_bits(table, pair_hash(_word_hashes(w, lang_hash([lang]))[1])).tolist()
        assert abs(np.mean(hits) - expected) < 0.1
