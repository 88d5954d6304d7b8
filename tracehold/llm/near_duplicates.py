"""Near duplicates by HyperMinHash sketches, exact confirmation and components.

1. A text's shingle set is hashed once (64 bits).  Texts with equal sets are one node.
2. A sketch has ``BANDS * ROWS`` registers.  A shingle falls into one register; the
   register keeps its smallest value, as the number of leading zeros and ten
   mantissa bits behind the first one bit (16 bits in all).
3. An empty register repeats the one in use that comes first in an order of its own, then
   each band of registers is a key.  Nodes that share keys, directly or through others,
   are a family.
4. Families are joined inside tasks, block by block of at most about ``BLOCK`` nodes, small
   families many to a task.  The Jaccard index estimated from the registers, less the
   agreements that chance explains, drops pairs further below the threshold than
   ``SIGMAS`` standard errors; all others are confirmed on their full sets.  A task gives
   a spanning forest of its links, never pairs.  A family of more than ``FAMILY`` nodes
   is not joined as a whole but by each of its keys.
5. The links' components are the result.

A pair at similarity 0.8 shares no band with a probability below 1e-6, expected from
the registers of simulated pairs: 4e-7 for 4 of 5 shingles, 5e-8 for 8 of 10, 4e-8 for 36
of 45.  Pairs that share one are lost only by an estimate ``SIGMAS`` errors off.  Nothing
is capped.

Cases: null texts and texts without words have no shingles, link with nothing and
are their own component; repeated rows and rows with a null id are nodes like
others, a component without any id has a null one; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracehold.llm.metric_join import forest
from tracehold.llm.words import SPACE, U64, mix, window_hashes, words
from tracehold.operators.graph import components
from tracehold.session import stage

BANDS, ROWS = 48, 5
REGISTERS = BANDS * ROWS
MANTISSA = 10
SIGMAS = 6
#: Places of the bands' registers, one band after the other.
SPREAD = np.random.default_rng(1).permutation(REGISTERS)
#: A row per register: the rank of each register as its filling, itself first.
RANK = np.random.default_rng(2).random((REGISTERS, REGISTERS)).argsort(1).argsort(1).astype(np.int16)
RANK[np.diag_indices(REGISTERS)] = -1
#: Nodes of a block, and of the largest family that is joined as a whole.
BLOCK, FAMILY = 256, 20_000
#: Pairs estimated at once, columns of an incidence matrix, pairs that are few enough to be compared one by one.
PAIRS, COLUMNS, FEW = 8192, 8192, 500


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle."""
    for w in words(texts, SPACE, lower=True):
        hashes, bound = w.hashes(), w.offset.tolist()
        wide = window_hashes(hashes, size)
        for a, b in zip(bound[:-1], bound[1:]):
            if b - a >= size:
                yield np.unique(wide[a : b - size + 1])
            else:
                yield window_hashes(hashes[a:b], b - a) if b > a else np.zeros(0, U64)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Registers of a sorted set; 0 is an empty register."""
    out = np.zeros(REGISTERS, np.uint16)
    # The high half chooses the register in rising order, so its smallest value comes first.
    wide = (shingles >> U64(32)) * U64(REGISTERS)
    register = (wide >> U64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(register, prepend=-1))
    value = (wide[first] << U64(32)) | (shingles[first] & U64(0xFFFFFFFF))
    length = np.frexp(value.astype(np.float64))[1].clip(1, 64)  # 64 less the leading zeros
    zeros = 64 - length
    mantissa = (value << np.minimum(zeros + 1, 63).astype(U64)) >> U64(64 - MANTISSA)
    out[register[first]] = ((np.minimum(zeros, 62) + 1) << MANTISSA).astype(np.uint16) | mantissa.astype(np.uint16)
    return out


def filled(registers: np.ndarray) -> np.ndarray:
    """Rows of registers whose empty ones repeat one in use, each by its own order; no row is all empty.

    The orders are independent, so one differing shingle of a small set does not change
    the same stretch of registers, and all bands, at once.
    """
    out = registers.copy()
    for row in out:
        used = np.flatnonzero(row)
        if len(used) < len(row):
            empty = np.flatnonzero(row == 0)
            row[empty] = row[used[RANK[np.ix_(empty, used)].argmin(1)]]
    return out


def band_keys(registers: np.ndarray) -> np.ndarray:
    """The keys of the bands, a row per row of registers."""
    bands = filled(registers)[:, SPREAD].reshape(len(registers), BANDS, ROWS).astype(U64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U64), bands.shape[:2])
    for r in range(ROWS):
        key = mix(key * U64(0x9E3779B97F4A7C15) + bands[:, :, r] + U64(1))
    return key


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of rows of registers, without chance agreements, and their standard errors."""
    used = ((a > 0) | (b > 0)).sum(1)
    same = ((a == b) & (a > 0)).sum(1)
    x, y = n_a / REGISTERS, n_b / REGISTERS
    zeros = np.arange(0, 50)[:, None]
    low = 2.0 ** (-zeros - 1)
    # Two independent minima share a cell of a level: rates times cell width, over the level.
    chance = (x * y / (x + y) * low / (1 << MANTISSA) * (np.exp(-(x + y) * low) - np.exp(-2 * (x + y) * low))).sum(0)
    chance = chance / (1 - np.exp(-(x + y)))
    raw = same / np.maximum(used, 1)
    return (raw - chance) / (1 - chance), np.sqrt(0.25 / np.maximum(used, 1))


def _sketches(size: int):
    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, prints, registers = [], [], []
            for s in shingle_sets(batch.column(1), size):
                n.append(len(s))
                prints.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                registers.append(sketch(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(registers, pa.binary())],
                ["doc_id", "mark", "n_shingles", "print", "registers"],
            )

    return sketches


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        registers = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        node = batch.column("node").to_numpy()
        yield pa.RecordBatch.from_pydict({"key": band_keys(registers).ravel().view(np.int64), "node": np.repeat(node, BANDS)})


def _texts_of_nodes(size: int):
    """Rows whose set is the node's: several rows may share an id."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column("print").to_pylist()
            sets = shingle_sets(batch.column("text"), size)
            keep = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() == p for s, p in zip(sets, prints)]
            yield batch.select(["node", "registers", "text"]).filter(pa.array(keep, pa.bool_()))

    return texts


def common_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of sets of ``a`` with sets of ``b``, by products of incidence matrices."""
    sizes = np.array([len(s) for s in [*a, *b]])
    _, token, times = np.unique(np.concatenate([*a, *b]), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    wanted = np.flatnonzero(times > 1)
    place = np.full(len(times), -1)
    place[wanted] = np.arange(len(wanted))
    token = place[token]
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    out = np.zeros((len(a), len(b)), np.float32)
    for low in range(0, len(wanted), COLUMNS):
        cut = slice(*np.searchsorted(token, [low, low + COLUMNS]))
        part = np.zeros((len(sizes), min(COLUMNS, len(wanted) - low)), np.float32)
        part[owner[cut], token[cut] - low] = 1
        out += part[: len(a)] @ part[len(a) :].T
    return out.astype(np.int64)


def _links(a: list[np.ndarray], b: list[np.ndarray], ra: np.ndarray, rb: np.ndarray, possible: np.ndarray, percent: int) -> np.ndarray:
    """Which of the possible pairs link."""
    na, nb = np.array([len(s) for s in a]), np.array([len(s) for s in b])
    # The smaller set must have at least that share of the larger one.
    possible = possible & (100 * np.minimum.outer(na, nb) >= percent * np.maximum.outer(na, nb))
    x, y = np.nonzero(possible)
    likely = np.zeros(possible.shape, bool)
    for cut in range(0, len(x), PAIRS):
        i, j = x[cut : cut + PAIRS], y[cut : cut + PAIRS]
        jaccard, error = estimate(ra[i], rb[j], na[i].astype(float), nb[j].astype(float))
        likely[i, j] = jaccard >= percent / 100 - SIGMAS * error
    rows, columns = np.flatnonzero(likely.any(1)), np.flatnonzero(likely.any(0))
    linked = np.zeros(possible.shape, bool)
    if len(rows):
        both = np.zeros(possible.shape, np.int64)
        if likely.sum() < FEW:
            for i, j in zip(*np.nonzero(likely)):
                both[i, j] = len(np.intersect1d(a[i], b[j], assume_unique=True))
        else:
            both[np.ix_(rows, columns)] = common_counts([a[i] for i in rows], [b[j] for j in columns])
        linked = likely & (100 * both >= percent * (np.add.outer(na, nb) - both))
    return linked


def _join(size: int, percent: int):
    def join(task: pa.Table) -> pa.Table:
        left = np.array(task["left"].to_pylist(), bool)
        own = left.all() and task["i"][0].as_py() == task["j"][0].as_py()
        rows_a, rows_b = np.flatnonzero(left), np.flatnonzero(left if own else ~left)
        node, family = task["node"].to_numpy(), task["family"].to_numpy()
        out = pa.table({"node": pa.array([], pa.int64()), "to": pa.array([], pa.int64())})
        if len(rows_a) and len(rows_b):
            sets = list(shingle_sets(task["text"], size))
            registers = np.frombuffer(b"".join(task["registers"].to_pylist()), np.uint16).reshape(-1, REGISTERS)
            possible = family[rows_a][:, None] == family[rows_b][None, :]
            if own:
                possible &= np.triu(np.ones(possible.shape, bool), 1)
            linked = _links([sets[r] for r in rows_a], [sets[r] for r in rows_b], registers[rows_a], registers[rows_b], possible, percent)
            to_a, to_b = forest(linked | linked.T if own else linked, node[rows_a], node[rows_b])
            ends, to = np.concatenate([node[rows_a], node[rows_b]]), np.concatenate([to_a, to_b])
            keep = ends != to
            out = pa.table({"node": ends[keep], "to": to[keep]})
        return out

    return join


def _family_links(groups: DataFrame, candidates: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (node, to) that span what links inside the groups (family, node)."""
    sizes = groups.groupBy("family").agg(F.count("*").alias("size"))
    counts = sizes.agg(F.coalesce(F.sum(F.when(F.col("size") <= BLOCK, F.col("size"))), F.lit(0))).first()
    packs = max(1, -(-int(counts[0]) // BLOCK))
    placed = groups.join(sizes, "family").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    placed = placed.withColumn("at", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # Small families share a task; a large one has a task for each two of its blocks.
    small = F.col("blocks") == 1
    task = F.when(small, F.pmod(F.xxhash64("family"), F.lit(packs))).otherwise(F.col("family")).alias("task")
    fields = [task, small.alias("small"), "family", "node"]
    at, last = F.col("at"), F.col("blocks") - 1
    after = F.explode(F.when(at <= last, F.sequence(at, last)).otherwise(F.array().cast("array<int>")))
    before = F.explode(F.when(at > 0, F.sequence(F.lit(0), at - 1)).otherwise(F.array().cast("array<int>")))
    rows = placed.select(*fields, F.lit(True).alias("left"), at.alias("i"), after.alias("j"))
    rows = rows.union(placed.select(*fields, F.lit(False).alias("left"), before.alias("i"), at.alias("j")))
    rows = rows.join(candidates, "node")
    return stage(rows.groupBy("small", "task", "i", "j").applyInArrow(_join(size, percent), "node long, to long"), "links")


def _components(docs: DataFrame, size: int, percent: int, doc_id: str, text: str, family_size: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, mark, n_shingles, print) of ``docs``, ``mark`` the text's ``xxhash64``, and nodes (print, doc_id, c) with their component ``c``."""
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    marked = texts.withColumn("mark", F.xxhash64("text"))
    rows = marked.mapInArrow(_sketches(size), "doc_id long, mark long, n_shingles long, print binary, registers binary")
    rows = stage(rows, "sketches")
    nodes = rows.where("print is not null").groupBy("print").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "mark", "n_shingles", "registers")).alias("r"))
    nodes = stage(
        nodes.select(F.monotonically_increasing_id().alias("node"), "print", "r.doc_id", "r.mark", F.col("r.n_shingles").alias("n"), "r.registers"), "nodes"
    )
    keys = nodes.select("node", "registers").mapInArrow(_keys, "key long, node long")
    hubs = keys.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("size")).where("size > 1").select("key", "hub")
    shared = stage(keys.join(hubs, "key"), "bands")
    family = stage(components(shared.select("hub", "node")).toDF("node", "family"), "families")
    wanted = nodes.join(family.select("node"), "node").select("node", F.col("doc_id").alias("d"), F.col("mark").alias("m"), "print", "registers")
    # By the text's hash too, since many rows may share an id, or have none.
    found = marked.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m"))).select("node", "print", "registers", "text")
    candidates = found.mapInArrow(_texts_of_nodes(size), "node long, registers binary, text string").dropDuplicates(["node"])
    candidates = stage(candidates, "candidates")

    huge = family.groupBy("family").agg(F.count("*").alias("size")).where(F.col("size") > family_size).select("family")
    whole = family.join(huge, "family", "left_anti").select("family", "node")
    split = shared.join(family.join(huge, "family").select("node"), "node").select(F.xxhash64("key", F.lit("key")).alias("family"), "node")
    group = components(_family_links(stage(whole.union(split), "groups"), candidates, size, percent))
    whole = nodes.select("node", "print", "doc_id").join(group, "node", "left").withColumn("c", F.coalesce("component", "node"))
    return rows, whole.select("print", "doc_id", "c")


def near_duplicates(
    docs: DataFrame,
    words_per_shingle: int = 5,
    percent: int = 80,
    doc_id: str = "doc_id",
    text: str = "text",
    family_size: int = FAMILY,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id`` and ``kept``.

    Texts link when 100 * intersection >= ``percent`` * union of their sets of word shingles.
    """
    rows, whole = _components(docs, words_per_shingle, percent, doc_id, text, family_size)
    least = whole.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    found = whole.join(least, "c").select(F.col("print").alias("p"), "component_id")
    out = rows.select("doc_id", "n_shingles", "print").join(found, F.col("print") == F.col("p"), "left")
    component = F.when(F.col("print").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    )


def keep_one_row(
    docs: DataFrame,
    words_per_shingle: int = 5,
    percent: int = 80,
    doc_id: str = "doc_id",
    text: str = "text",
    family_size: int = FAMILY,
) -> DataFrame:
    """Exactly one row of ``docs`` per component: least id (null last), then least ``xxhash64`` of the text, then least row.

    Rows without shingles are their own component, so all of them stay.  Columns must have an order.
    """
    rows, whole = _components(docs, words_per_shingle, percent, doc_id, text, family_size)
    nodes = whole.select(F.col("print").alias("p"), "c")
    keys = rows.join(nodes, F.col("print") == F.col("p")).groupBy("c", "doc_id", "mark").agg(F.count("*").alias("copies"))
    least = keys.groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "mark", "copies")).alias("k"))
    kept = least.select(F.col("k.doc_id").alias("__doc"), F.col("k.mark").alias("__mark"), F.col("k.copies").alias("__copies"))
    none = rows.where("print is null").select("doc_id", "mark", F.lit(1).cast("long")).distinct()
    same = docs[doc_id].cast("long").eqNullSafe(F.col("__doc")) & (F.xxhash64(docs[text]) == F.col("__mark"))
    found = stage(docs.join(stage(kept.union(none), "kept"), same), "survivors")
    # Few rows repeat both id and text; only they are gathered.
    again = found.where("__copies > 1").groupBy("__doc", "__mark").agg(F.min(F.struct(*docs.columns)).alias("r"))
    return found.where("__copies = 1").select(*docs.columns).union(again.select("r.*"))
