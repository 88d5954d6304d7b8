"""Sum-of-squares packing of documents into sequences of a fixed number of tokens.

A document longer than a sequence is cut from its end into full pieces; the
first piece holds the rest.  Full pieces are sequences of their own.  All other
pieces are dealt to groups of about ``GROUP_DOCS``, each large enough to be
packed with almost no loss and small enough for one task.  A group places its
pieces from long to short.  A piece goes where the sum of squared counts of
open sequences per residual gap becomes smallest; of a gap's count only what
exceeds the pieces of that very size still to come is counted, since those
will close them.  ``OPEN_TOKENS`` tokens left open weigh as much as one square, which
decides between places of almost the same sum; ties take the smallest gap.  Both
departures from the plain sum of squares (``excess=False``) are there because the
fewest sequences are asked for: see the README for what each rule needs.

Cases: null and empty texts hold the end id alone; repeated rows and null ids
are packed like others; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracehold.llm.tokens import ID, encoder, tokenizer_file
from tracehold.session import stage

GROUP_DOCS = 32_768
OPEN_TOKENS = 16
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pack(sizes: np.ndarray, capacity: int, excess: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each size, below ``capacity`` all, given from long to short.

    Without ``excess`` the plain sum of squared counts of open sequences per gap decides.
    """
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, np.int64)
    coming = np.bincount(sizes, minlength=capacity + 1).astype(np.int64) * excess
    never, left = np.inf, np.arange(capacity + 1) / OPEN_TOKENS * excess
    sequence, offset, used = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0
    for k, size in enumerate(sizes.tolist()):
        coming[size] -= excess
        spare = count - coming
        # Change of the squared excess where a gap's count goes up or down by one.
        up = np.where(spare >= 0, 2 * spare + 1, 0)
        down = np.where(spare > 0, 1 - 2 * spare, 0)
        up[0] = down[capacity] = 0
        cost = down[size:] + up[: capacity + 1 - size] + left[: capacity + 1 - size]
        closed = count[size:] == 0
        closed[-1] = False
        cost[closed] = never
        gap = size + int(cost.argmin())
        if gap == capacity:
            sequence[k], used = used, used + 1
        else:
            sequence[k] = open_bins[gap].pop()
            count[gap] -= 1
        offset[k] = capacity - gap
        if gap > size:
            open_bins[gap - size].append(int(sequence[k]))
            count[gap - size] += 1
    return sequence, offset


def _pieces(path: str, end_id: int, capacity: int, with_ids: bool):
    end = np.array([end_id], ID).tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            for name, raw in zip(batch.column(0).to_pylist(), encoder(path).encode_all(batch.column(1))):
                raw += end
                n = len(raw) // ID.itemsize
                cut = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cut[:-1], cut[1:])):
                    ids = raw[a * ID.itemsize : b * ID.itemsize]
                    for column, value in zip(rows.values(), (name, k, a, b - a, zlib.crc32(ids), ids)):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            arrays = {c: pa.array(v, t) for (c, v), t in zip(rows.items(), kinds) if with_ids or c != "ids"}
            yield pa.RecordBatch.from_pydict(arrays)

    return pieces


def _place(capacity: int):
    def place(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("ids_crc32", "ascending")])
        sequence, offset = pack(group["length"].to_numpy(), capacity)
        number = (group["slot"].to_numpy() << 32) + sequence
        return group.drop_columns(["slot"]).append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offset))

    return place


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    capacity: int = 1024,
    doc_id: str = "doc_id",
    text: str = "text",
    with_ids: bool = False,
    group_docs: int = GROUP_DOCS,
) -> DataFrame:
    """One row per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.

    ``with_ids`` adds ``ids``, the piece's ids as little-endian unsigned 32-bit integers.
    """
    schema = PIECE_SCHEMA + ", ids binary" * with_ids
    cut = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        _pieces(tokenizer_file(tokenizer), end_id, capacity, with_ids), schema
    )
    cut = stage(cut, "pieces")  # both branches read the ids' lengths, the texts are encoded once
    rest = cut.where(F.col("length") < capacity)
    groups = max(1, ceil(rest.count() / group_docs))
    # By the place in the staged table, so that copies are dealt out like any other rows.
    slot = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).alias("slot")
    packed = rest.select("*", slot).groupBy("slot").applyInArrow(_place(capacity), schema + ", sequence_id long, offset long")
    full = cut.where(F.col("length") == capacity).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)
