"""The pipeline's stages against what their operators say and plain loops."""

import random
import re

import pytest

import corpus_pipeline
from test_llm_duplicates import brute_hits, reachable, shingles
from test_llm_filters import graded, naive_spans
from tracehold.session import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Prose and junk with copies, contamination, personal data and odd rows."""
    path = str(tmp_path_factory.mktemp("corpus"))
    rows, labels = graded(400, seed=8)
    draw = random.Random(1)
    docs = [(i, t) for i, t, _ in rows]
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    docs += [(1000 + i, docs[4 * i + 1][1]) for i in range(20)] + [(2000 + i, f"{docs[4 * i + 2][1]} {item}") for i in range(9)]
    docs += [(3000 + i, f"{docs[4 * i + 3][1]} mail me{i}@host.org now 10.1.2.{i}") for i in range(9)]
    docs += [(4000, None), (4001, ""), (None, "no id"), (1, docs[1][1])]
    draw.shuffle(docs)
    table = [(d, t, "en", None, None if t is None else len(t)) for d, t in docs]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    outs = [docs]
    for name, function in corpus_pipeline.STAGES:
        outs.append(stage(function(spark, outs[-1], folder), name))
    rows = [[(r.doc_id, r.text) for r in out.collect()] for out in outs[:-1]]
    assert all(out.columns == COLUMNS for out in outs[:-1])
    assert docs.schema.simpleString() == outs[4].schema.simpleString()
    # Clean prose stays, most junk goes.
    kept = {d for d, _ in rows[1]}
    assert len([i for i in range(400) if i % 4 and i in kept]) >= 290 and len([i for i in range(0, 400, 4) if i in kept]) <= 10
    # One row of each group of near duplicates stays.
    sets = [shingles(t, 5) for _, t in rows[1]]
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    top = reachable(len(sets), linked)
    groups = {}
    for (d, _), t in zip(rows[1], top):
        groups.setdefault(t, []).append(d)
    want = {min(x for x in g if x is not None) if any(x is not None for x in g) else None for g in groups.values()}
    assert {d for d, _ in rows[2]} == want
    # Contaminated documents go.
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    bad = {d for d, _, _, _, hit in brute_hits(rows[2], items, 10) if hit}
    assert bad and {d for d, _ in rows[3]} == {d for d, _ in rows[2]} - bad
    # Personal data is gone, other texts are as they were.
    before = dict(rows[3])
    assert {d for d, _ in rows[4]} == set(before)
    for d, t in rows[4]:
        assert not naive_spans(t or "")
        if not naive_spans(before[d] or ""):
            assert t == before[d]
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in outs[4].collect())
    assert {r.doc_id for r in outs[5].collect()} == set(before)
    result = corpus_pipeline.run(spark, folder)
    key = lambda r: str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32))
    assert sorted(map(key, result.collect())) == sorted(map(key, outs[5].collect()))


def test_one_row_of_each_group(spark):
    """Repeated rows, ids that texts share, null ids beside ids and alone: rows are counted, not ids."""
    from tracehold.llm.stages import keep_one_of_each_group

    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcde")
    rows = [(1, a), (1, a), (1, a + " end"), (None, a), (7, a)]
    rows += [(None, b), (None, b), (None, b + " end"), (None, c), (2, d), (2, e), (3, e)]
    rows += [(4, None), (4, None), (None, None), (5, ""), (1, ""), (None, " ")]
    table = [(i, t, "en", s, 0) for s, (i, t) in zip("zyxwvutsrqponmlkji", rows)]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars int")
    got = [(r.doc_id, r.text, r.source) for r in keep_one_of_each_group(spark, docs, "").collect()]
    texts = lambda x: [(i, s) for i, t, s in got if (t or "").startswith(x + "0")]
    assert [i for i, _ in texts("a")] == [1] and [i for i, _ in texts("b")] == [None] and [i for i, _ in texts("c")] == [None]
    assert [i for i, _ in texts("d")] == [2] and [i for i, _ in texts("e")] == [2]
    assert texts("a")[0][1] in "yx" and texts("b")[0][1] in "ts"
    empty = [(i, t) for i, t, _ in got if not (t or "").strip()]
    assert sorted(map(str, empty)) == sorted(map(str, rows[-6:])) and len(got) == 11


def test_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, folder), name)
        assert docs.count() == 0, name


def test_numbers_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in names if re.match(r"op\d+_", n)} == set(range(1, 14))
    assert "pipeline" in names and "alert_pipeline" in names
