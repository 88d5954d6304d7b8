"""Near duplicates, repeated passages, vectors and contamination against plain loops."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tracehold.llm.decontaminate import decontaminate
from tracehold.llm.metric_join import similar_vectors
from tracehold.llm.near_duplicates import common_counts, near_duplicates
from tracehold.llm.substrings import node_names, remove_repeats
from tracehold.operators.graph import components

SCHEMA = "doc_id long, text string, node string, key string, d string, h string"


def table(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", None, "y", "z") for i, t in rows], SCHEMA)


def reachable(n, linked):
    root = list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in linked:
        root[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(n)]


def corpus(seed=5, n=60):
    """Prose of few words, with exact and near copies, shared passages, periodic and odd texts."""
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["The", "the", "é", "x,"]
    texts = [" ".join(draw.choices(vocabulary, k=draw.randint(1, 220))) for _ in range(n)]
    passage = " ".join(draw.choices(vocabulary, k=75))
    for i in range(0, n, 4):
        words = texts[i].split()
        for _ in range(draw.randint(0, max(1, len(words) // 12))):
            words[draw.randrange(len(words))] = draw.choice(vocabulary)
        texts.append("  ".join(words))
    texts += [texts[3], texts[3].upper(), passage, texts[5] + "\n" + passage, passage + " " + texts[7], "tail " + passage[20:]]
    texts += ["same " * 130, "same " * 90, "a b " * 70, None, "", " \t ", "one", "ONE", "one two", "a" * 3000]
    rows = [(3 * i, t) for i, t in enumerate(texts)]
    rows += [rows[10], (rows[11][0], texts[12]), (None, texts[13]), (None, "only without an id here")]
    draw.shuffle(rows)
    return rows


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


@pytest.mark.parametrize("size,family,block", [(2, 20_000, 256), (5, 20_000, 256), (2, 20_000, 3), (2, 2, 3), (5, 0, 256)])
def test_near_duplicates(spark, monkeypatch, size, family, block):
    monkeypatch.setattr("tracehold.llm.near_duplicates.BLOCK", block)
    rows = corpus()
    sets = [shingles(t, size) for _, t in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    top = reachable(len(rows), linked)
    want = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if top[j] == top[i] and rows[j][0] is not None]
        component = min(ids) if ids else None
        want.append((doc, len(sets[i]), component, doc is not None and doc == component))
    got = [tuple(r) for r in near_duplicates(table(spark, rows), words_per_shingle=size, family_size=family).collect()]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_near_duplicates_of_few_words(spark):
    """Pairs that share 4 of 5 or 8 of 10 shingles, each pair by itself."""
    rows = []
    for k in range(2000):
        words = [f"p{k}w{i}" for i in range(5 if k % 2 else 10)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[: len(words) * 4 // 5]))]
    got = {r.doc_id: r.component_id for r in near_duplicates(table(spark, rows), words_per_shingle=1).collect()}
    assert [d for d, c in got.items() if c != d - d % 2] == []


def test_intersections():
    draw = np.random.default_rng(5)
    sets = [np.unique(draw.integers(0, 300, n).astype(np.uint64)) for n in (0, 1, 5, 80, 200, 250)]
    got = common_counts(sets[:3], sets)
    assert got.tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets[:3]]


def test_near_duplicates_in_a_chain(spark):
    """Neighbours link, others do not: no hub links them all."""
    words = [f"v{i}" for i in range(400)]
    rows = [(100 - k, " ".join(words[6 * k : 6 * k + 100])) for k in range(40)]
    got = {tuple(r)[2:] for r in near_duplicates(table(spark, rows), words_per_shingle=2).collect()}
    assert {c for c, _ in got} == {61} and (61, True) in got


def test_no_rows(spark):
    empty = table(spark, [])
    assert near_duplicates(empty).count() == 0
    assert remove_repeats(empty).count() == 0
    assert decontaminate(empty, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0
    assert similar_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components(spark):
    draw = random.Random(8)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)] + [(500, i) for i in range(501, 560)]
    top = reachable(600, edges)
    df = spark.createDataFrame([*edges, (None, 3), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {i: top[i] for i in {x for e in edges if e[0] != e[1] for x in e}}


def brute_repeats(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    order = [1 << 62 if d is None else d for d, _ in rows]
    first = {}
    for d, w in zip(order, words):
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            first[g] = min(first.get(g, d), d)
    out = []
    for (doc, _), d, w in zip(rows, order, words):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("subtree", [4096, 2, 0])
def test_repeats(spark, subtree):
    rows = corpus()
    got = remove_repeats(table(spark, rows), subtree=subtree)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted([tuple(r)[:4] for r in got.collect()], key=key) == sorted(brute_repeats(rows, 50), key=key)
    for r in got.collect():
        assert r.n_removed == sum(s.end - s.start for s in r.spans)


def test_repeats_of_short_windows(spark):
    draw = random.Random(9)
    rows = [(i, " ".join(draw.choices("ab", k=draw.randint(0, 30)))) for i in range(25)]
    got = [tuple(r)[:4] for r in remove_repeats(table(spark, rows), window=6, prefix=3, subtree=5).collect()]
    assert sorted(got) == sorted(brute_repeats(rows, 6))


def test_node_names_are_exact():
    draw = np.random.default_rng(3)
    flat = draw.integers(0, 2, 300).astype(np.uint64)
    for depth in (1, 2, 3, 7, 50):
        names = node_names(flat, depth)
        spelled = [tuple(flat[i : i + depth].tolist()) for i in range(len(flat) - depth + 1)]
        assert len(names) == len(spelled) and len(set(zip(names.tolist(), spelled))) == len(set(spelled)) == len(set(names.tolist()))
    assert len(node_names(flat[:3], 5)) == 0


def brute_hits(docs, items, size):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: pattern.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = {}
    for name, text in items:
        w = split(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add("" if name is None else str(name))
    out = []
    for doc, text in docs:
        w, found = split(text), set()
        hit = [False] * len(w)
        for n in {len(g) for g in windows}:
            for i in range(len(w) - n + 1):
                if names := windows.get(tuple(w[i : i + n])):
                    found |= names
                    hit[i : i + n] = [True] * n
        out.append((doc, len(w), sum(hit), sorted(found), sum(hit) > 0))
    return out


@pytest.mark.parametrize("slice_bytes", [16 << 20, 400])
def test_decontaminate(spark, slice_bytes):
    rows = corpus(seed=6)
    draw = random.Random(2)
    items = [(i, " ".join((t or "").split()[5 : 5 + draw.choice([3, 9, 10, 11, 40])])) for i, t in rows[:25]]
    items += [(77, None), (78, ""), (79, "..!"), (None, "w1 w2"), (80, items[0][1]), (items[1][0], "w3"), (90, "THE é")]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    out = decontaminate(table(spark, rows), benchmark, slice_bytes=slice_bytes).collect()
    want = brute_hits(rows, items, 10)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in out], key=key) == sorted(want, key=key)
    for r in out:
        assert r.items_sha256 == hashlib.sha256(",".join(r["items"]).encode()).hexdigest()
    texts = {r.doc_id: r.clean_text for r in out}
    assert texts[next(d for d, t in rows if t is None)] is None


def test_clean_text(spark):
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    out = decontaminate(table(spark, [(1, "É, One  TWO-three; four one two"), (2, "nothing")]), items, keep=["doc_id", "node"]).orderBy("doc_id").collect()
    assert [r.clean_text for r in out] == ["É, ; four one two", "nothing"] and out[0].node == "x"
    none = decontaminate(table(spark, [(1, "one two three")]), items.limit(0)).collect()
    assert [(r.n_hit, r["items"], r.contaminated, r.clean_text) for r in none] == [(0, [], False, "one two three")]


def vectors(seed=1, n=240):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(6, 8))
    rows = []
    for i in range(n):
        v = centres[i % 6] + draw.normal(size=8) * draw.choice([0.05, 0.3, 1.0])
        rows.append([2 * i, [float(np.float32(x)) for x in v], int(i % 7 > 3)])
    rows += [[900, rows[0][1], rows[0][2]], [901, [3 * x for x in rows[0][1]], rows[0][2]], [902, rows[0][1], None], [902, rows[0][1], rows[0][2]]]
    rows += [[903, None, 1], [904, [], 1], [905, [0.0] * 8, 1], [906, [None] + [1.0] * 7, 1], [907, [float("nan")] + [1.0] * 7, 1], [908, [float("inf")] + [1.0] * 7, 1]]
    rows += [[909, [1.0] * 5, 1], [910, [1.0] * 5, 1], [911, [1e-30] * 8, 0], [912, [2e-30] * 8, 0], [None, rows[4][1], rows[4][2]], [914, [-0.0, 1.0], 0], [915, [0.0, 1.0], 0]]
    return rows


@pytest.mark.parametrize("cell,block", [(1024, 1024), (12, 1024), (12, 7), (3, 3), (10**9, 16)])
def test_similar_vectors(spark, cell, block):
    rows = vectors()
    whole = []
    for _, v, label in rows:
        ok = label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        a = np.array(v) if ok else None
        whole.append(a / np.linalg.norm(a) if ok else None)
    same = lambda i, j: whole[i] is not None and whole[j] is not None and rows[i][2] == rows[j][2] and len(whole[i]) == len(whole[j])
    linked = [(i, j) for i in range(len(rows)) for j in range(len(rows)) if i != j and same(i, j) and whole[i] @ whole[j] >= 0.93]
    top = reachable(len(rows), linked)
    want = []
    for i, (vec, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if top[j] == top[i] and rows[j][0] is not None]
        component = min(ids) if ids else None
        want.append((vec, sum(a == i for a, _ in linked), component, vec is not None and vec == component))
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, node string")
    got = [tuple(r) for r in similar_vectors(df, cell=cell, block=block).collect()]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("ids", ["own", "null", "one"])
def test_rows_without_ids_meet_only_themselves(spark, ids):
    """3,000 rows in pairs of near copies: the texts joined to nodes are as many with null ids as with own ones."""
    from tracehold.llm import near_duplicates as module

    words = lambda i: " ".join(f"t{i}w{k}" for k in range(30))
    rows = [({"own": i, "null": None, "one": 7}[ids], words(i // 2) + (" more" if i % 2 else ""), "x") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    handed_on, seen = module._texts_of_nodes, spark.sparkContext.accumulator(0)

    def counted(size):
        inner = handed_on(size)

        def texts(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield from inner(iter([batch]))

        return texts

    module._texts_of_nodes = counted
    try:
        assert module.keep_one_row(docs).count() == 1500
    finally:
        module._texts_of_nodes = handed_on
    assert seen.value == 3000


def test_window_index_is_small_and_whole():
    from tracehold.llm.decontaminate import WindowIndex
    from tracehold.llm.words import NOT_ALNUM, words

    draw = random.Random(6)
    texts = [" ".join("".join(draw.choices("abcdefgh", k=draw.randint(2, 9))) for _ in range(draw.choice([0, 1, 3, 10, 200]))) for _ in range(800)]
    index = WindowIndex([f"i{k}" for k in range(len(texts))], pa.array([*texts[:-1], None]), 10)
    assert index.nbytes() < 5 * sum(map(len, texts))
    text = " x ".join(texts[:60]) + " " + texts[7] * 2
    w = next(words(pa.array([text]), NOT_ALNUM))
    spelled = [x.decode() for x in w.bytes(0, len(w.start))]
    want = set()
    for k, item in enumerate(texts[:-1]):
        own = item.split()
        n = min(10, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        want |= {(i, n, f"i{k}") for i in range(len(spelled) - n + 1) if tuple(spelled[i : i + n]) in windows}
    assert {(i, n, x) for i, n, items in index.search(w) for x in items} == want
