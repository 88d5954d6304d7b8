"""Clustering with text fields against plain DBSCAN."""

import re

import numpy as np
import pyarrow as pa
import pytest

from test_learning import plain_dbscan
from tracehold.operators import models, text_density as module


def plain_features(texts, size=100):
    """TF-IDF rows of length one over the most frequent words."""
    bags = [re.findall(r"[^\W]{2,}", (t or "").lower()) for t in texts]
    total = {}
    for bag in bags:
        for word in bag:
            total[word] = total.get(word, 0) + 1
    words = sorted(total, key=lambda w: (-total[w], w))[:size]
    rows = np.array([[bag.count(w) for w in words] for bag in bags], dtype=float).reshape(len(texts), len(words))
    rows *= np.log((1 + len(texts)) / (1 + (rows > 0).sum(axis=0))) + 1
    norm = np.sqrt((rows**2).sum(axis=1, keepdims=True))
    return rows / np.where(norm > 0, norm, 1)


def made_up(seed, n):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(140)]
    likely = 1 / np.arange(1, len(words) + 1)
    base = [list(rng.choice(words, 8, p=likely / likely.sum())) for _ in range(12)]
    texts = []
    for i in range(n):
        text = list(base[rng.integers(len(base))])
        for _ in range(rng.integers(0, 3)):
            text[rng.integers(len(text))] = str(rng.choice(words))
        texts.append(" ".join(text))
    texts[3], texts[4], texts[5], texts[6] = "", None, "zz", texts[7] + " the end" * 3000
    values = [None if i % 17 == 0 else float(round(v, 1)) for i, v in enumerate(rng.normal(0, 1, n))]
    return texts, values, [None if i % 11 == 0 else str(k) for i, k in enumerate(rng.choice(["a", "b", "c"], n))]


def standard(values):
    x = np.array([np.nan if v is None else v for v in values])
    x = np.where(np.isnan(x), np.nanmean(x), x)
    return (x - x.mean()) / x.std()


@pytest.mark.parametrize("slice_points,eps,minimum,fields", [(1024, 0.5, 4, ""), (7, 0.8, 3, "n"), (7, 0.9, 4, "nc"), (1024, 1.3, 6, "nc")])
def test_clusters_with_text(spark, monkeypatch, slice_points, eps, minimum, fields):
    monkeypatch.setattr(module, "SLICE", slice_points)
    monkeypatch.setattr(module, "HEAVY", 2)
    texts, values, kinds = made_up(5, 160)
    x = plain_features(texts)
    extra = np.zeros((len(texts), len(texts)))
    if "n" in fields:
        x = np.hstack([x, standard(values)[:, None]])
    if "c" in fields:
        level = np.array(["" if k in (None, "a") else k for k in kinds])
        base = (level[:, None] == "") | (level[None, :] == "")
        extra = np.where(level[:, None] != level[None, :], np.where(base, 1.0, 2.0), 0.0)
    want = plain_dbscan(x, eps, minimum, extra)
    df = spark.createDataFrame(list(zip(range(len(texts)), texts, values, kinds)), "id long, t string, v double, k string")
    numeric, cats = ["v"] if "n" in fields else None, ["k"] if "c" in fields else None
    run = models.text_density(df, "id", numeric, cats, ["t"], eps, minimum)
    assert len(set(want)) > 2 or eps >= 1
    assert [r.cluster for r in run.clusters().orderBy("id").collect()] == list(want)
    assert sorted(r.id for r in run.noise().collect()) == list(np.flatnonzero(want < 0))
    near = (((x[:, None] - x[None]) ** 2).sum(-1) + extra <= eps * eps).sum(1)
    assert [r.close for r in run.neighbours().orderBy("id").collect()] == list(near)


def test_no_rows_and_no_words(spark):
    schema = "id long, t string, xs int, cats int"
    empty = spark.createDataFrame([], schema)
    assert models.cluster_events(empty, "id", text=["t"]).collect() == []
    df = spark.createDataFrame([(i, None if i % 2 else "!", 1, 2) for i in range(6)], schema)
    assert {r.cluster for r in models.cluster_events(df, "id", text=["t"]).collect()} == {0}


def block_table(rng, n, dims, second):
    """Points of two slices in order, of kinds that follow each other; the rest of what a block holds."""
    texts = rng.random((n, dims)) * (rng.random((n, dims)) < 0.5)
    length = np.sqrt((texts**2).sum(axis=1, keepdims=True))
    texts = texts / np.where(length > 0, length, 1)
    xs, kinds = rng.normal(0, 0.3, (n, 1)), np.sort(rng.choice(["a", "b", "c"], n))
    columns = {
        "pair": pa.array(np.full(n, second)),
        "spot": pa.array(np.arange(n)),
        "w": pa.array(rng.integers(1, 4, n)),
        "text": pa.array(list(texts)),
        "xs": pa.array(list(xs)),
        "cats": pa.array([[k] for k in kinds]),
        "kind": pa.array(kinds),
    }
    apart = ((texts[:, None] - texts[None]) ** 2).sum(-1) + ((xs[:, None] - xs[None]) ** 2).sum(-1)
    return pa.table(columns), np.where(kinds[:, None] != kinds[None], 9.0, apart)


@pytest.mark.parametrize("second", [0, 1])
def test_each_pair_of_points_meets_once(monkeypatch, second):
    """Points share many terms and cells, but are compared in one place only; far tiles not at all."""
    monkeypatch.setattr(module, "TILE", 8)
    size = 100 if second else 200
    table, apart = block_table(np.random.default_rng(3), 150, 6, second)
    block = module.Block(table, 0.6, size)
    tiles = len(block.tiles)
    assert len(set(block.pairs)) == len(block.pairs) < (tiles * (tiles + 1) // 2 if not second else 13 * 7)
    near = apart <= 0.36
    np.fill_diagonal(near, False)
    if second:
        near[:100, :100] = near[100:, 100:] = False
    assert list(block.close()) == list(near @ table["w"].to_numpy())
    core = block.close() + table["w"].to_numpy() >= 4
    part, edge, at = block.links(core, np.arange(150))
    want = near & core[:, None] & core[None, :] | np.eye(150, dtype=bool)
    for _ in range(8):
        want = want @ want
    assert [list(part == p) for p in part[core]] == [list(w & core) for w in want[core]]
    touched = {(e, c) for e, c in zip(*np.nonzero(near)) if not core[e] and core[c]}
    assert {(int(e), int(a)) for e, a in zip(edge, at)} == {(int(e), int(part[c])) for e, c in touched}


def test_blocks_over_batches():
    batch = pa.table({"pair": [1, 1, 2, 2, 2, 5]}).to_batches(max_chunksize=4) + pa.table({"pair": [5, 7]}).to_batches()
    assert [t["pair"].to_pylist() for t in module.blocks_of(batch)] == [[1, 1], [2, 2, 2], [5, 5], [7]]
    assert list(module.blocks_of([])) == []


def test_outliers_without_links(spark, monkeypatch):
    """Counts and outliers come from one pass over the pairs; texts are kept as packed counts, not as rows of weights."""
    written, write = [], module.stage
    monkeypatch.setattr(module, "stage", lambda df, label="stage": written.append(label) or write(df, label))
    texts, values, _ = made_up(5, 120)
    df = spark.createDataFrame(list(zip(range(len(texts)), texts, values)), "id long, t string, v double")
    run = models.text_density(df, "id", ["v"], None, ["t"], 0.5, 4)
    x = np.hstack([plain_features(texts), standard(values)[:, None]])
    want = plain_dbscan(x, 0.5, 4, np.zeros((len(x), len(x))))
    assert sorted(r.id for r in run.noise().collect()) == list(np.flatnonzero(want < 0))
    assert len(run.neighbours().collect()) == len(texts)
    assert "links" not in written and dict(run.spots.dtypes)["text"] == "binary"
    assert [r.cluster for r in run.clusters().orderBy("id").collect()] == list(want) and "links" in written


def test_few_neighbours_are_listed(monkeypatch):
    """All others within eps of a point that they do not make a core point, and counts, as in double precision."""
    monkeypatch.setattr(module, "TILE", 8)
    table, apart = block_table(np.random.default_rng(7), 120, 6, 0)
    w = table["w"].to_numpy()
    near = apart <= 0.36
    np.fill_diagonal(near, False)
    found = module.Block(table, 0.6, 200, minimum=9).counted().to_pylist()
    assert [(r["spot"], r["close"]) for r in found] == [(i, n) for i, n in enumerate((near @ w).tolist()) if n]
    few = [r["spot"] for r in found if r["beside"]]
    assert few == [i for i in range(120) if 0 < (near @ w)[i] < 9 - w[i]] and len(few) < len(found)
    assert all(sorted(r["beside"]) == list(np.flatnonzero(near[r["spot"]])) for r in found if r["beside"])


def test_pairs_at_the_very_distance():
    """Single precision leaves pairs near the limit to double precision, also far from zero."""
    xs = 1000 + np.arange(64) * 0.25
    columns = {
        "pair": pa.array(np.zeros(64, np.int64)),
        "spot": pa.array(np.arange(64)),
        "w": pa.array(np.full(64, 1 << 40)),
        "text": pa.array([[1.0, 0.0] if i % 2 else [0.0, 0.0] for i in range(64)]),
        "xs": pa.array([[x] for x in xs]),
        "cats": pa.array([["a"]] * 64),
        "kind": pa.array(["a"] * 64),
    }
    close = module.Block(pa.table(columns), 0.5, 64).close()
    assert close.tolist() == [(1 << 40) * ((i > 1) + (i < 62)) for i in range(64)]
    assert (module.Block(pa.table(columns), np.nextafter(0.5, 0), 64).close() == 0).all()


def test_packed_counts():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 3, (40, 13)) * rng.integers(0, 2, (40, 1))
    counts[3, 5], counts[4, 0], counts[5, 12] = 255, 256, 1 << 40
    rows = pa.array(module.packed(counts), pa.binary())
    assert (module.unpacked(rows, 13) == counts).all() and (module.unpacked(rows.slice(3, 9), 13) == counts[3:12]).all()
    assert module.unpacked(pa.array(module.packed(np.zeros((2, 0), np.int64)), pa.binary()), 0).shape == (2, 0)
    assert len(set(rows.to_pylist())) == len(np.unique(counts, axis=0)) and max(map(len, rows.to_pylist())) < 40 + 8 * 13
