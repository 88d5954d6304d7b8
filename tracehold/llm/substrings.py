"""Repeated passages by prefix-partitioned suffix trees over words.

Every suffix that starts a window of ``WINDOW`` words belongs to one subtree: that
of the word prefix of ``PREFIX`` words with the smallest hash inside the window, so
equal windows are always in one subtree and neighbouring suffixes share theirs.

1. Prefixes are counted.  A prefix found in one document only has a subtree
   without repeats and is dropped before any text moves.
2. Suffixes of the other prefixes are sent to their subtree with the words that the
   windows reach, once per run of neighbouring suffixes.
3. A prefix of more than ``SUBTREE`` runs does not fit a task.  Its suffixes are split by
   their whole window, the longest prefix that matters, and only counted.
4. In a task the nodes of the subtrees are named level by level, each depth from two
   names of half the depth.  A node of depth ``WINDOW`` with suffixes of several
   documents is a repeat; its smallest document keeps it, the others mark it.

Documents with equal words are one document with their smallest id before that.

Cases: null texts and texts shorter than a window lose nothing; rows that share an id
are never smaller than each other; a null id is larger than any other; repeated rows
each get a result; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracehold.llm.words import SPACE, U64, Words, full_windows, mix, window_hashes, words
from tracehold.session import stage

WINDOW, PREFIX = 50, 16
#: Runs of suffixes in one subtree, and in one round of naming.
SUBTREE, ROUND = 4096, 2048
LAST = (1 << 63) - 1


def _joined(w: Words, a: int, b: int, keep: np.ndarray | None = None) -> bytes:
    spelled = w.bytes(a, b)
    return b" ".join(spelled if keep is None else [x for x, k in zip(spelled, keep.tolist()) if k])


def prefixes(w: Words, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, the full windows' starts, each one's prefix position and its prefix hash."""
    hashes = w.hashes()
    starts = np.flatnonzero(full_windows(w.offset, window, len(hashes)))
    if not len(starts):
        return hashes, starts, starts, np.zeros(0, U64)
    heads = window_hashes(hashes, prefix)
    inside = np.lib.stride_tricks.sliding_window_view(heads, window - prefix + 1)
    least = inside.argmin(1)[starts] + starts
    return hashes, starts, least, heads[least]


def _scan(window: int, prefix: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, prints, heads = [], [], []
            for w in words(batch.column(1), SPACE):
                _, starts, _, head = prefixes(w, window, prefix)
                cut = np.searchsorted(starts, w.offset).tolist()
                bound = w.offset.tolist()
                for k in range(w.n):
                    a, b = bound[k], bound[k + 1]
                    n_words.append(b - a)
                    prints.append(hashlib.sha256(_joined(w, a, b)).hexdigest())
                    heads.append(np.unique(head[cut[k] : cut[k + 1]]).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n_words, pa.int64()), pa.array(prints, pa.string()), pa.array(heads, pa.list_(pa.int64()))],
                ["d", "mark", "n_words", "print", "heads"],
            )

    return scan


def _runs(window: int, prefix: int, hot: bool):
    """Runs of suffixes with one prefix: their words, or for hot prefixes the names of their windows."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("heads")
            node, d = batch.column("node").to_pylist(), batch.column("d").to_pylist()
            out: dict[str, list] = {"h": [], "node": [], "d": [], "starts": [], "run": [], "k1": [], "k2": []}
            for w in words(batch.column("text"), SPACE):
                hashes, starts, least, head = prefixes(w, window, prefix)
                if not len(starts):
                    continue
                if hot:
                    one, two = window_hashes(hashes, window), window_hashes(mix(hashes + U64(1)), window)
                cut = np.searchsorted(starts, w.offset).tolist()
                for k in range(w.n):
                    s = slice(cut[k], cut[k + 1])
                    mine = np.isin(head[s], wanted[w.first + k].values.to_numpy().view(U64))
                    own_start, own_least, own_head = starts[s][mine], least[s][mine], head[s][mine]
                    if not len(own_start):
                        continue
                    base, row = int(w.offset[k]), w.first + k
                    seen: dict[bytes, list[int]] = {}
                    if hot:
                        for p, x, y in zip(own_start.tolist(), one[own_start].tolist(), two[own_start].tolist()):
                            seen.setdefault((x, y), []).append(p - base)
                        for (x, y), at in seen.items():
                            for c, v in zip(out.values(), (None, node[row], d[row], at, None, x, y)):
                                c.append(v)
                        continue
                    # Neighbouring windows with one prefix position are a run.
                    new = np.flatnonzero((np.diff(own_least, prepend=-1) != 0) | (np.diff(own_start, prepend=-2) != 1))
                    ends = np.append(new[1:], len(own_start)) - 1
                    for a, b in zip(new.tolist(), ends.tolist()):
                        p, q = int(own_start[a]), int(own_start[b]) + window
                        seen.setdefault(own_head[a].tobytes() + hashes[p:q].tobytes(), []).append(p - base)
                    for run, at in seen.items():
                        h = int.from_bytes(run[:8], "little", signed=True)
                        for c, v in zip(out.values(), (h, node[row], d[row], at, run[8:], None, None)):
                            c.append(v)
            if hot:
                k1, k2 = (pa.array(np.array(out[c], U64).view(np.int64)) for c in ("k1", "k2"))
                yield pa.RecordBatch.from_arrays([k1, k2, *_named(out)], ["k1", "k2", "node", "d", "starts"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(out["h"], pa.int64()), *_named(out), pa.array(out["run"], pa.binary())], ["h", "node", "d", "starts", "run"])

    return runs


def _named(out: dict) -> list[pa.Array]:
    return [pa.array(out["node"], pa.int64()), pa.array(out["d"], pa.int64()), pa.array(out["starts"], pa.list_(pa.int32()))]


def node_names(flat: np.ndarray, depth: int) -> np.ndarray:
    """The name of each position's node at ``depth`` words: equal names, equal words. Longer than the rest of ``flat``: none."""

    def named(values: np.ndarray) -> np.ndarray:
        return np.unique(values, return_inverse=True)[1].astype(np.int64)

    names, reach = named(flat), 1
    while reach < depth:
        step = min(reach, depth - reach)
        n = len(names) - step
        if n <= 0:
            return names[:0]
        names = named(names[:n] * (int(names.max()) + 1) + names[step : step + n])
        reach += step
    return names


def repeats(runs: list[np.ndarray], docs: np.ndarray, window: int) -> list[np.ndarray]:
    """For each run the windows, counted from its first, that a smaller document has too."""
    sizes = np.array([len(r) for r in runs])
    names = node_names(np.concatenate(runs), window)
    first = np.cumsum(sizes) - sizes
    count = sizes - window + 1
    owner = np.repeat(np.arange(len(runs)), count)
    offset = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    names = names[first[owner] + offset]
    least = np.full(int(names.max()) + 1 if len(names) else 0, LAST, np.int64)
    np.minimum.at(least, names, docs[owner])
    marked = least[names] < docs[owner]
    cut = np.searchsorted(owner[marked], np.arange(len(runs) + 1))
    return np.split(offset[marked], cut[1:-1])


def _subtrees(window: int):
    """Whole subtrees of a sorted partition, some at a time."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        found = repeats([np.frombuffer(r[4], U64) for r in rows], np.array([r[2] for r in rows], np.int64), window)
        marks = [(r[1], (np.array(r[3], np.int64)[:, None] + m).ravel()) for r, m in zip(rows, found) if len(m)]
        return pa.RecordBatch.from_arrays([pa.array([n for n, _ in marks], pa.int64()), pa.array([m for _, m in marks], pa.list_(pa.int64()))], ["node", "marks"])

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if len(rows) >= ROUND and row[0] != rows[-1][0]:
                    yield solve(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield solve(rows)

    return subtrees


def _removal(window: int):
    def removal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept, spans = [], [], []
            for w in words(batch.column("text"), SPACE):
                bound = w.offset.tolist()
                for k in range(w.n):
                    a, b = bound[k], bound[k + 1]
                    marks = np.unique(batch.column("marks")[w.first + k].values.to_numpy())
                    cover = np.zeros(b - a + 1, np.int32)
                    cover[marks] += 1
                    cover[marks + window] -= 1
                    gone = np.cumsum(cover[:-1]) > 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).tolist()
                    removed.append(int(gone.sum()))
                    kept.append(_joined(w, a, b, ~gone))
                    spans.append([{"start": x, "end": y} for x, y in zip(edge[::2], edge[1::2])])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("node"),
                    pa.array(removed, pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                ],
                ["node", "n_removed", "kept_sha256", "spans"],
            )

    return removal


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, prefix: int = PREFIX, subtree: int = SUBTREE) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` and ``spans``.

    ``spans`` are the removed word positions [start, end): words inside a window whose
    words also start in a document with a smaller id.  The digest is of the kept words
    joined by one space.
    """
    order = F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST))
    # The text's hash tells rows of one id, or of none, apart.
    texts = docs.select(order.alias("d"), F.col(text).alias("text"), F.xxhash64(text).alias("mark"))
    rows = stage(texts.mapInArrow(_scan(window, prefix), "d long, mark long, n_words long, print string, heads array<long>"), "scan")
    # Equal word sequences: the smallest id stands for all.
    nodes = rows.where(F.size("heads") > 0).groupBy("print").agg(F.min(F.struct("d", "mark", "heads")).alias("r"))
    nodes = stage(nodes.select(F.monotonically_increasing_id().alias("node"), "print", "r.d", "r.mark", "r.heads"), "nodes")
    heads = nodes.select("node", "d", F.explode("heads").alias("h"))
    counts = heads.groupBy("h").agg(F.min("d").alias("low"), F.max("d").alias("high"), F.count("*").alias("n")).where("low < high").select("h", "n")
    wanted = heads.join(counts, "h").groupBy("node").agg(
        F.collect_list(F.when(F.col("n") <= subtree, F.col("h"))).alias("heads"),
        F.collect_list(F.when(F.col("n") > subtree, F.col("h"))).alias("hot"),
    )
    asked = nodes.select("node", "d", "mark", "print").join(wanted, "node")
    found = texts.join(asked, ["d", "mark"]).mapInArrow(_same_print, "node long, d long, print string, text string, heads array<long>, hot array<long>")
    found = stage(found.dropDuplicates(["node"]), "texts")

    runs = found.where("size(heads) > 0").select("node", "d", "text", "heads").mapInArrow(
        _runs(window, prefix, False), "h long, node long, d long, starts array<int>, run binary"
    )
    marks = runs.repartition("h").sortWithinPartitions("h").mapInArrow(_subtrees(window), "node long, marks array<long>")
    split = stage(
        found.where("size(hot) > 0").select("node", "d", "text", F.col("hot").alias("heads")).mapInArrow(
            _runs(window, prefix, True), "k1 long, k2 long, node long, d long, starts array<int>"
        ),
        "windows",
    )
    least = split.groupBy("k1", "k2").agg(F.min("d").alias("low"))
    more = split.join(least, ["k1", "k2"]).where("low < d").select("node", F.col("starts").cast("array<long>").alias("marks"))
    marks = marks.union(more).groupBy("node").agg(F.flatten(F.collect_list("marks")).alias("marks"))
    done = found.select("node", "print", "text").join(marks, "node")
    done = done.select("node", "text", "marks").mapInArrow(
        _removal(window), "node long, n_removed long, kept_sha256 string, spans array<struct<start:int,end:int>>"
    )
    least = nodes.select(F.col("print").alias("p"), "node", F.col("d").alias("low")).join(done, "node", "left").drop("node")
    out = rows.drop("heads", "mark").join(least, F.col("print") == F.col("p"), "left")
    copy = F.col("low") < F.col("d")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    return out.select(
        F.when(F.col("d") != LAST, F.col("d")).alias("doc_id"),
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "print")).alias("kept_sha256"),
        F.when(copy, whole).otherwise(F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>"))).alias("spans"),
    )


def _same_print(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows may share an id: keep those whose words are the node's."""
    for batch in batches:
        prints, keep = batch.column("print").to_pylist(), []
        for w in words(batch.column("text"), SPACE):
            bound = w.offset.tolist()
            keep += [hashlib.sha256(_joined(w, bound[k], bound[k + 1])).hexdigest() == prints[w.first + k] for k in range(w.n)]
        yield batch.select(["node", "d", "print", "text", "heads", "hot"]).filter(pa.array(keep, pa.bool_()))
