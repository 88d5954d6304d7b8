"""Token ids in directly addressable codes.

An id is cut into chunks of eight bits, lowest first.  Level 0 holds the lowest
chunk of every id, level k the next chunk of those ids that have one.  A
bitmap per level tells which ids continue, and a rank directory counts the set
bits in front of every 512 positions, so any token is read with one look per
level and no block is decoded.

A block holds whole documents in order of their ids.  Blocks are rows of a
Parquet table (``part``, ``seq``, ``inside``, ``n_docs``, ``n_tokens``, ``block``), so
Spark's committer writes them to any store and lost tasks are run again.
``inside`` counts the ids in front of a block that its task wrote; what earlier
tasks wrote is one number for each task.

Cases: null and empty texts hold the end id alone; rows with a null document
id come first; rows that share an id are in order of their texts' hashes, so
repeated rows are stored one after the other; an empty table gives an empty
file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from tracehold.llm.tokens import ID, encoder, tokenizer_file

BLOCK_TOKENS = 1 << 18
RANK_STEP = 512
MAGIC = b"DAC1"
_HEAD = struct.Struct("<4sIQI")
_POPCOUNT = np.array([bin(b).count("1") for b in range(256)], np.uint8)
FILE_SCHEMA = "part int, seq int, inside long, n_docs long, n_tokens long, block binary"


def write_block(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """Documents and their ids as one block."""
    levels, rest = [], ids.astype(np.uint32, copy=False)
    while len(rest):
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        bits = np.append(bits, np.zeros(-len(bits) % (RANK_STEP // 8), np.uint8))
        counts = _POPCOUNT[bits].reshape(-1, RANK_STEP // 8).sum(1, dtype=np.uint32)
        ranks = np.cumsum(counts, dtype=np.uint32) - counts
        levels += [struct.pack("<Q", len(rest)), (rest & 0xFF).astype(np.uint8).tobytes(), bits.tobytes(), ranks.tobytes()]
        rest = rest[more] >> 8
    head = _HEAD.pack(MAGIC, len(doc_ids), len(ids), len(levels) // 4)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    names = np.array([d or 0 for d in doc_ids], "<i8")
    return b"".join([head, known.tobytes(), names.tobytes(), np.array(lengths, "<u8").tobytes(), *levels])


class Block:
    """A written block: its documents, any token, or all ids."""

    def __init__(self, raw: bytes):
        magic, docs, self.n_tokens, depth = _HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("no block of directly addressable codes")
        at = _HEAD.size

        def take(kind, n):
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        known = take(np.uint8, docs)
        self.doc_ids = [d if k else None for d, k in zip(take("<i8", docs).tolist(), known.tolist())]
        self.lengths = take("<u8", docs).astype(np.int64)
        self.levels = []
        for _ in range(depth):
            (n,) = struct.unpack_from("<Q", raw, at)
            at += 8
            steps = -(-n // RANK_STEP)
            self.levels.append((take(np.uint8, n), take(np.uint8, steps * RANK_STEP // 8), take("<u4", steps)))

    def token(self, i: int) -> int:
        """The i-th id."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = shift = 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            step = i // RANK_STEP
            inside = bits[step * RANK_STEP // 8 : i >> 3]
            partial = int(bits[i >> 3]) & ((1 << (i & 7)) - 1)
            i = int(ranks[step]) + int(_POPCOUNT[inside].sum()) + partial.bit_count()
            shift += 8
        return value

    def ids(self) -> np.ndarray:
        """All ids in order."""
        rest = np.zeros(0, np.uint32)
        for chunks, bits, _ in reversed(self.levels):
            value = chunks.astype(np.uint32)
            more = np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)
            value[more] |= rest << np.uint32(8)
            rest = value
        return rest


def _encode(path: str, end_id: int, limit: int):
    end = np.array([end_id], ID).tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, inside, names, found, size = TaskContext.get().partitionId(), 0, 0, [], [], 0

        def block() -> pa.RecordBatch:
            nonlocal seq, inside, names, found, size
            lengths = [len(x) // ID.itemsize for x in found]
            raw = write_block(names, lengths, np.frombuffer(b"".join(found), ID))
            out = pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int32()),
                    "seq": pa.array([seq], pa.int32()),
                    "inside": [inside],
                    "n_docs": [len(names)],
                    "n_tokens": [size],
                    "block": pa.array([raw], pa.binary()),
                }
            )
            seq, inside, names, found, size = seq + 1, inside + size, [], [], 0
            return out

        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), encoder(path).encode_all(batch.column(1))):
                names.append(name)
                found.append(ids + end)
                size += len(found[-1]) // ID.itemsize
                if size >= limit:
                    yield block()
        if names:
            yield block()

    return encode


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    doc_id: str = "doc_id",
    text: str = "text",
    block_tokens: int = BLOCK_TOKENS,
) -> None:
    """Write the ids of every whole text, each followed by ``end_id``, in order of ``doc_id``.

    The text's hash and the row's place go behind the id, so that an id of many rows is
    cut into ranges like any others; rows that tie in all but their place are equal.
    """
    keys = ["d", "h", "k"]
    rows = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("k"))
    rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("d", "t").mapInArrow(_encode(tokenizer_file(tokenizer), end_id, block_tokens), FILE_SCHEMA).write.parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of a file with ``start``, the number of ids in front of each."""
    blocks = spark.read.schema(FILE_SCHEMA).parquet(path)
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    # One row for each task that wrote; the blocks themselves are not moved.
    return blocks.join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.col("inside"))


def _documents(with_ids: bool):
    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, raw in zip(batch.column("start").to_pylist(), batch.column("block")):
                block = Block(raw.as_py())
                ends = np.cumsum(block.lengths)
                ids = block.ids().astype(ID).tobytes()
                cut = [0, *(ends * ID.itemsize).tolist()]
                own = [ids[a:b] for a, b in zip(cut[:-1], cut[1:])]
                columns = {
                    "doc_id": pa.array(block.doc_ids, pa.int64()),
                    "start": pa.array(start + ends - block.lengths, pa.int64()),
                    "n_tokens": pa.array(block.lengths, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(x) for x in own], pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.array([np.frombuffer(x, ID).astype(np.int32) for x in own], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    return documents


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document: ``start``, ``n_tokens``, ``ids_crc32`` and, if asked for, ``ids``."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return read_blocks(spark, path).mapInArrow(_documents(with_ids), schema)


def read_token_at(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """The ids at global ``position`` rows, each read without decoding its block.

    Every position meets its block by ranges of ``BLOCK_TOKENS`` positions; positions
    that are null or beyond the end give no row.
    """
    wide = read_blocks(spark, path)
    cells = F.explode(F.sequence(F.expr(f"start div {BLOCK_TOKENS}"), F.expr(f"(start + n_tokens - 1) div {BLOCK_TOKENS}")))
    index = wide.select("part", "seq", "start", "n_tokens", cells.alias("cell"))
    asked = positions.select(F.col("position").cast("long").alias("position")).where("position >= 0").distinct()
    placed = asked.withColumn("cell", F.expr(f"position div {BLOCK_TOKENS}")).join(index, "cell")
    placed = placed.where("position >= start and position < start + n_tokens").groupBy("part", "seq").agg(F.collect_list(F.expr("position - start")).alias("at"))
    hit = placed.join(wide.select("part", "seq", "start", "block"), ["part", "seq"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, at, raw in zip(batch.column("start").to_pylist(), batch.column("at").to_pylist(), batch.column("block")):
                block = Block(raw.as_py())
                yield pa.RecordBatch.from_pydict({"position": [start + i for i in at], "id": [block.token(i) for i in at]})

    return hit.mapInArrow(look, T.StructType().add("position", "long").add("id", "long"))
