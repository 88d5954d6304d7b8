"""The prefix trie against a plain one, and sums over subtrees against a walk."""

import hashlib
import random
import zlib

import pytest

from tracehold.llm.prefix_trie import prefix_trie, subtree_sums


def digest(role, text):
    return hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()


def plain(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn is not None, turn or 0, digest(role, text), role or "", text or ""))
    turns = {c: [x[3:] for x in sorted(t)] for c, t in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(c % 100 if c >= 0 else -(-c % 100))
        built[c] = tuple(turns.get(base, [])[:h] + own[h:])
    members, ends = {}, {}
    for c, t in built.items():
        for d in range(len(t) + 1):
            members.setdefault(t[:d], []).append(c)
        ends.setdefault(t, []).append(c)
    children = {}
    for t in members:
        if t:
            children.setdefault(t[:-1], []).append(t)
    sums = {}
    for t in sorted(members, key=len, reverse=True):
        below = [sums[x] for x in children.get(t, [])]
        own = (len(members[t]) - 1) * len(t[-1][1]) if t else 0
        sums[t] = (sum(x[0] for x in below) if below else 1, own + sum(x[1] for x in below))
    out = []
    for t, m in members.items():
        listed = ",".join(map(str, sorted(ends.get(t, []))))
        parent = min(members[t[:-1]]) if t else None
        out.append((min(m), len(t), parent, len(m), len(children.get(t, [])), *sums[t], hashlib.sha256(listed.encode()).hexdigest()))
    return sorted(out, key=str)


def random_rows(seed, convs=90, top=500, deep=14):
    draw = random.Random(seed)
    rows = []
    for c in draw.sample(range(-120, top), convs):
        for turn in range(draw.randint(1, deep)):
            text = draw.choice(["hi", "hi", "hello you", "é\U0001f600", "", None])
            rows.append((c, draw.choice([turn, turn, turn, turn, None, 3]), draw.choice(["user", "bot", None]), text))
    rows += rows[:20] + [(None, 1, "user", "nobody's"), (None, None, None, None)]
    draw.shuffle(rows)
    return rows


def table(spark, rows):
    schema = "conv_id long, turn int, role string, text string, c string, d string, nid string, said string, number int"
    return spark.createDataFrame([(*r, "x", "y", "z", "w", 1) for r in rows], schema)


@pytest.mark.parametrize("height,chunk", [(8, 1024), (2, 3), (3, 1)])
def test_against_a_plain_trie(spark, height, chunk):
    rows = random_rows(height)
    got = sorted((tuple(r) for r in prefix_trie(table(spark, rows), height=height, chunk=chunk).collect()), key=str)
    assert got == plain(rows)


def test_long_and_copied_conversations(spark):
    """One conversation of many turns, many copies of one, ids that start alike, very long texts."""
    rows = [(7, i, "user", f"turn {i % 5}") for i in range(400)] + [(10_007, i, "user", f"turn {i % 5}") for i in range(300)]
    rows += [(c, i, "user", "same") for c in range(200, 5200) for i in range(2)] + [(9_000_000_000_000, 0, "bot", "word " * 100_000)]
    got = sorted((tuple(r) for r in prefix_trie(table(spark, rows)).collect()), key=str)
    assert got == plain(rows)


def test_nothing(spark):
    assert prefix_trie(table(spark, [])).count() == 0
    assert prefix_trie(table(spark, [(None, 1, "user", "x")])).count() == 0


def test_sums_of_a_chain(spark):
    """Depth 300 in bands of two: totals of bands of bands."""
    paths = spark.createDataFrame([(1, d, 1) for d in range(300)] + [(2, d, 1 if d < 150 else 2) for d in range(200)], "c long, d long, nid long")
    values = paths.where("c = nid").selectExpr("nid", "d", "d + 1 as x")
    got = {(r.nid, r.d): r.x for r in subtree_sums(paths, values, ["x"], height=2).collect()}
    tail = lambda a, b: sum(range(a + 1, b + 1))
    want = {(1, d): tail(d, 300) + (tail(150, 200) if d < 150 else 0) for d in range(300)} | {(2, d): tail(d, 200) for d in range(150, 200)}
    assert got == want
