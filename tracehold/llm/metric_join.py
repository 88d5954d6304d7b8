"""Exact range join of embeddings by cosine, as a metric join of unit vectors.

On unit vectors a cosine of at least ``c`` is a distance of at most
``sqrt(2 - 2c)``.  Vectors of one label go to the cell of their nearest pivot.  By the
triangle inequality a vector may have a partner in another cell only if it is at most
twice that distance further from its pivot than from its own, and not further than the
cell's radius plus the distance; there it is a visitor.  So every vector finds all its
partners in its home cell, and cells are joined independently.

A cell is dealt to blocks of about ``BLOCK`` vectors and joined block by block, which
bounds a task whatever the size of a cell.  A task gives counts of partners and a
spanning forest of its links, never pairs.  Equal vectors are one vector with a weight.

Pivots are the only thing broadcast: a hash sample of one in ``CELL`` vectors, less
often where that would exceed ``PIVOT_VALUES`` numbers.

Cases: vectors that are null, empty, zero or hold null or non-finite values, and those
with a null label, link with nothing; vectors of different length do not link; repeated
rows are copies; a null id gives way to any other in its component; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracehold.operators.graph import components
from tracehold.session import stage

CELL, BLOCK = 1024, 1024
PIVOT_VALUES = 1 << 21
#: Room for rounding in distances; candidates are confirmed by their cosine.
SLACK = 1e-6


def unit(raw: list[bytes]) -> np.ndarray:
    """Rows of equal length as unit vectors."""
    v = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints, raws, groups = [], [], []
        for label, values in zip(batch.column("label").to_pylist(), batch.column("embedding")):
            v = None
            if label is not None and values.is_valid and len(values) and not values.values.null_count:
                v = values.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # no negative zero
            if v is None or not np.isfinite(v).all() or not v.any():
                prints.append(None), raws.append(None), groups.append(None)
                continue
            group = f"{len(v)}:{label}"
            raws.append(v.tobytes())
            prints.append(hashlib.blake2b(group.encode() + b"\0" + raws[-1], digest_size=16).digest())
            groups.append(group)
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), pa.array(prints, pa.binary()), pa.array(groups, pa.string()), pa.array(raws, pa.binary())],
            ["vec_id", "print", "grp", "vec"],
        )


def _cells(pivots, reach: float):
    """Home and possible visits of each vector."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {g: (np.array(ids, np.int64), unit(raw)) for g, (ids, raw) in pivots.value.items()}
        for batch in batches:
            groups = np.array(batch.column("grp").to_pylist(), object)
            raws = batch.column("vec").to_pylist()
            for g in dict.fromkeys(groups.tolist()):
                rows = np.flatnonzero(groups == g)
                x = unit([raws[r] for r in rows])
                ids, p = table.get(g, (np.array([-1], np.int64), x[:1]))
                far = np.sqrt(np.maximum(2 - 2 * (x @ p.T), 0))
                if g not in table:
                    far[:] = 0  # a label without a pivot is one cell
                home = far.argmin(1)
                own = far[np.arange(len(rows)), home]
                a, c = np.nonzero(far - own[:, None] <= 2 * reach + SLACK)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("node").take(pa.array(rows[a])),
                        batch.column("grp").take(pa.array(rows[a])),
                        pa.array(ids[c]),
                        pa.array(c == home[a]),
                        pa.array(far[a, c]),
                    ],
                    ["node", "grp", "cell", "home", "far"],
                )

    return cells


def link_blocks(a: np.ndarray, b: np.ndarray, least: float, same: bool) -> np.ndarray:
    """Which rows of ``a`` link with which of ``b``; ``same``: both are one block, where nothing links itself."""
    linked = a @ b.T >= least
    if same:
        np.fill_diagonal(linked, False)
    return linked


def forest(linked: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of both sides the smallest node its links reach."""
    none = np.iinfo(np.int64).max
    la, lb = a.copy(), b.copy()
    while True:
        na = np.minimum(la, np.where(linked, lb, none).min(1, initial=none))
        nb = np.minimum(lb, np.where(linked.T, na, none).min(1, initial=none))
        if (na == la).all() and (nb == lb).all():
            return la, lb
        la, lb = na, nb


def _join(least: float):
    def join(task: pa.Table) -> pa.Table:
        left = np.array(task["left"].to_pylist(), bool)
        node, weight = task["node"].to_numpy(), task["weight"].to_numpy()
        raws = task["vec"].to_pylist()
        same = task["kind"][0].as_py() == "own"
        rows_a, rows_b = np.flatnonzero(left), np.flatnonzero(left if same else ~left)
        out = {"node": [], "n": [], "to": []}
        if len(rows_a) and len(rows_b):
            a, b = unit([raws[r] for r in rows_a]), unit([raws[r] for r in rows_b])
            linked = link_blocks(a, b, least, same)
            to_a, to_b = forest(linked, node[rows_a], node[rows_b])
            n_a, n_b = linked @ weight[rows_b], linked.T @ weight[rows_a]
            # A visitor's own partners are counted where it is at home.
            visit = task["kind"][0].as_py() == "visit"
            sides = [(rows_a, n_a, to_a)] if same else [(rows_a, n_a, to_a), (rows_b, n_b * 0 if visit else n_b, to_b)]
            for rows, n, to in sides:
                keep = (n > 0) | (to != node[rows])
                out["node"].append(node[rows][keep]), out["n"].append(n[keep]), out["to"].append(to[keep])
        arrays = [np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for v in out.values()]
        return pa.table(dict(zip(out, arrays)))

    return join


def similar_vectors(
    vectors: DataFrame,
    least: float = 0.93,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    cell: int = CELL,
    block: int = BLOCK,
) -> DataFrame:
    """One row per row of ``vectors``: ``vec_id``, ``n_links``, ``component_id`` and ``kept``.

    Vectors of one label link when their cosine is at least ``least``.
    """
    spark = vectors.sparkSession
    reach = float(np.sqrt(2 - 2 * least))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(embedding).alias("embedding"))
    rows = stage(rows.mapInArrow(_read, "vec_id long, print binary, grp string, vec binary"), "vectors")
    nodes = rows.where("print is not null").groupBy("print").agg(F.min("vec_id").alias("low"), F.count("*").alias("weight"), F.min(F.struct("grp", "vec")).alias("v"))
    nodes = stage(nodes.select(F.monotonically_increasing_id().alias("node"), "print", "low", "weight", "v.grp", "v.vec"), "nodes")

    size = nodes.agg(F.count("*"), F.max(F.octet_length("vec"))).first()
    share = min(1 / cell, PIVOT_VALUES / max(1, size[0] * (size[1] or 8) // 8))
    chosen = nodes.where(F.pmod(F.xxhash64("print"), F.lit(1 << 30)) < int(share * (1 << 30))).select("node", "grp", "vec")
    pivots: dict[str, tuple[list, list]] = {}
    for r in chosen.toLocalIterator():
        ids, raw = pivots.setdefault(r.grp, ([], []))
        ids.append(r.node), raw.append(bytes(r.vec))
    placed = nodes.select("node", "grp", "vec").mapInArrow(
        _cells(spark.sparkContext.broadcast(pivots), reach), "node long, grp string, cell long, home boolean, far double"
    )
    placed = stage(placed, "cells")
    key = ["grp", "cell"]
    radius = placed.where("home").groupBy(*key).agg(F.max("far").alias("radius"), F.count("*").alias("homes"))
    placed = placed.join(radius, key).where(F.col("home") | (F.col("far") <= F.col("radius") + reach + SLACK))
    visits = placed.where("not home").groupBy(*key).agg(F.count("*").alias("visits"))
    spot = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    homes = placed.where("home").withColumn("blocks", F.ceil(F.col("homes") / block)).withColumn("at", spot)
    homes = homes.join(visits, key, "left").withColumn("others", F.coalesce(F.ceil(F.col("visits") / block), F.lit(0)))
    guests = placed.where("not home").join(visits, key).withColumn("blocks", F.ceil(F.col("visits") / block)).withColumn("at", spot)

    def tasks(df: DataFrame, kind: str, left: bool, i, j) -> DataFrame:
        return df.select("node", *key, F.lit(kind).alias("kind"), F.lit(left).alias("left"), i.alias("i"), j.alias("j"))

    def upto(first, count):
        """``first`` .. ``count - 1``, one row each."""
        return F.explode(F.when(first < count, F.sequence(first.cast("int"), (count - 1).cast("int"))).otherwise(F.array().cast("array<int>")))

    at, zero = F.col("at"), F.lit(0)
    work = (
        tasks(homes, "own", True, at, at)
        .union(tasks(homes, "home", True, at, upto(at + 1, F.col("blocks"))))
        .union(tasks(homes, "home", False, upto(zero, at), at))
        .union(tasks(homes, "visit", True, at, upto(zero, F.col("others"))))
        .union(tasks(guests, "visit", False, upto(zero, F.ceil(F.col("homes") / block)), at))
    )
    work = work.join(nodes.select("node", "weight", "vec"), "node")
    found = work.groupBy(*key, "kind", "i", "j").applyInArrow(_join(least), "node long, n long, to long")
    found = stage(found, "found")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    groups = components(found.where("node <> to").select("node", "to"))
    whole = nodes.select("node", "print", "low", "weight").join(counts, "node", "left").join(groups, "node", "left")
    whole = whole.withColumn("component", F.coalesce("component", "node"))
    least_id = whole.groupBy("component").agg(F.min("low").alias("component_id"))
    whole = whole.join(least_id, "component").select(
        F.col("print").alias("p"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"
    )
    out = rows.select("vec_id", "print").join(whole, F.col("print") == F.col("p"), "left")
    component = F.when(F.col("print").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    )
