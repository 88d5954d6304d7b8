"""Benchmark decontamination: a broadcast set of test n-grams against every token window.

Texts and items are lowered (A-Z) and cut to words of letters, digits and
non-ASCII characters.  A window is ``size`` consecutive words of an item; an
item with fewer words, but not none, is one window.  A task looks window
hashes up in a bit table and compares the words of those that it has, so a
hash alone never decides.  Nothing of the documents is shuffled.

The items are broadcast in slices of at most ``SLICE_BYTES`` of text.  A
benchmark of more slices is passed over the documents slice by slice, with the
hits so far in a staged table; the result is the same.  A worker's index of a slice
takes less than five times its text, besides 4 MB for each window size below ``size``.

Cases: null and empty texts have no words and no hits; an empty benchmark hits
nothing; repeated rows each get their own result; items that share an id count
once and a null item id reads as the empty string; other columns of the inputs
are passed by unless listed in ``keep``.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Sequence
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tracehold.llm.words import NOT_ALNUM, Words, full_windows, window_hashes, words
from tracehold.session import stage

#: Item text in one broadcast.
SLICE_BYTES = 16 << 20
TABLE_BITS = 22
_FOUND = "__hit_words"
_ITEMS = "__hit_items"


class WindowIndex:
    """The windows of some items as flat arrays.

    The items' words stand one after the other in one buffer, each followed by a space; a window
    is the number of its first word.  Per window size the hashes are in order, with the
    first words beside them.
    """

    def __init__(self, ids: Sequence[str], texts: pa.Array | pa.ChunkedArray, size: int):
        self.ids = list(ids)
        spelled, begins, owners = [], [], []
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        n_words = n_bytes = 0
        for w in words(texts, NOT_ALNUM, lower=True):
            hashes, count = w.hashes(), w.lengths()
            length = w.end - w.start + 1
            ends = np.cumsum(length)
            place = np.repeat(w.start - ends + length, length) + np.arange(int(ends[-1]) if len(ends) else 0)
            part = np.append(w.data, np.uint8(0x20))[place]
            part[ends - 1] = 0x20
            spelled.append(part)
            begins.append(n_bytes + ends - length)
            owners.append((n_words + w.offset[:-1], w.first + np.arange(w.n)))
            for n in np.unique(np.minimum(count, size)).tolist():
                if n == size:
                    first = np.flatnonzero(full_windows(w.offset, n, len(hashes)))
                elif n:
                    first = w.offset[:-1][count == n]
                else:
                    continue
                found.setdefault(n, []).append((window_hashes(hashes, n)[first], n_words + first))
            n_words, n_bytes = n_words + len(hashes), n_bytes + len(part)
        small = np.uint32 if max(n_words, n_bytes) < 1 << 32 else np.uint64
        self.spelled = np.concatenate([np.zeros(0, np.uint8), *spelled]).tobytes()
        self.begin = np.concatenate([np.zeros(0, np.int64), *begins, [n_bytes]]).astype(small)
        self.first = np.concatenate([np.zeros(0, np.int64), *(a for a, _ in owners)])
        self.item = np.concatenate([np.zeros(0, np.int64), *(b for _, b in owners)])
        self.found, self.tables = {}, {}
        for n in sorted(found):
            hashes, first = (np.concatenate(x) for x in zip(*found.pop(n)))
            order = np.argsort(hashes)
            self.found[n] = hashes[order], first[order].astype(small)
            self.tables[n] = np.zeros(1 << TABLE_BITS, bool)
            self.tables[n][hashes & np.uint64((1 << TABLE_BITS) - 1)] = True

    def nbytes(self) -> int:
        """Bytes of all that grows with the items."""
        windows = sum(h.nbytes + f.nbytes for h, f in self.found.values())
        return len(self.spelled) + self.begin.nbytes + self.first.nbytes + self.item.nbytes + windows

    def search(self, w: Words) -> Iterator[tuple[int, int, set[str]]]:
        """(first word, number of words, items) of each window of ``w`` that an item has."""
        hashes = w.hashes()
        for n, table in self.tables.items():
            wide = window_hashes(hashes, n)
            maybe = np.flatnonzero(table[wide & np.uint64((1 << TABLE_BITS) - 1)] & full_windows(w.offset, n, len(hashes)))
            known, first = self.found[n]
            low, high = np.searchsorted(known, wide[maybe], "left"), np.searchsorted(known, wide[maybe], "right")
            hit = np.flatnonzero(low < high)
            for i, a, b in zip(maybe[hit].tolist(), low[hit].tolist(), high[hit].tolist()):
                own = b" ".join(w.bytes(i, i + n))
                same = [f for f in first[a:b].tolist() if self.spelled[self.begin[f] : int(self.begin[f + n]) - 1] == own]
                if same:
                    # Items without words share their place with the next one, so the last counts.
                    at = np.searchsorted(self.first, same, "right") - 1
                    yield i, n, {self.ids[k] for k in self.item[at].tolist()}


_indexes: dict[str, WindowIndex] = {}


def _index(name: str, rows, size: int) -> WindowIndex:
    """The index of one broadcast, kept by the worker until another one comes."""
    if name not in _indexes:
        _indexes.clear()
        _indexes[name] = WindowIndex(rows.value["i"].to_pylist(), rows.value["t"], size)
    return _indexes[name]


def _scan(rows, size: int, schema: pa.Schema, last: bool):
    name = uuid.uuid4().hex

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(name, rows, size)
        for batch in batches:
            texts = batch.column("__text")
            spans, names, counts, kept_text = [], [], [], []
            before = batch.column(_FOUND).to_pylist()
            items_before = batch.column(_ITEMS).to_pylist()
            for w in words(texts, NOT_ALNUM, lower=True):
                cover = np.zeros(len(w.start) + 1, np.int32)
                items: dict[int, set[str]] = {}
                found = list(index.search(w))
                at = np.fromiter((i for i, _, _ in found), np.int64, len(found))
                np.add.at(cover, at, 1)
                np.add.at(cover, at + np.fromiter((n for _, n, _ in found), np.int64, len(found)), -1)
                for k, (_, _, names_of) in zip((np.searchsorted(w.offset, at, "right") - 1).tolist(), found):
                    items.setdefault(k, set()).update(names_of)
                hit = np.cumsum(cover[:-1]) > 0
                bound = w.offset.tolist()
                for k in range(w.n):
                    a, b = bound[k], bound[k + 1]
                    row = w.first + k
                    own = hit[a:b]
                    if before[row]:
                        own = own | np.unpackbits(np.frombuffer(before[row], np.uint8), count=b - a).astype(bool)
                    names.append(sorted(items.get(k, set()).union(items_before[row] or ())))
                    counts.append((b - a, int(own.sum())))
                    spans.append(np.packbits(own).tobytes() if own.any() else b"")
                    if last:
                        kept_text.append(_without(texts[row].as_py(), w, a, own) if own.any() else texts[row].as_py())
            columns = {
                **{c: batch.column(c) for c in schema.names if c in batch.schema.names},
                _FOUND: pa.array(spans, pa.binary()),
                _ITEMS: pa.array(names, pa.list_(pa.string())),
                "n_words": pa.array([n for n, _ in counts], pa.int64()),
                "n_hit": pa.array([n for _, n in counts], pa.int64()),
                "clean_text": pa.array(kept_text, pa.string()) if last else None,
                "items_sha256": pa.array([hashlib.sha256(",".join(n).encode()).hexdigest() for n in names], pa.string()) if last else None,
            }
            yield pa.RecordBatch.from_arrays([columns[c].cast(schema.field(c).type) for c in schema.names], schema=schema)

    return scan


def _without(text: str, w: Words, first: int, hit: np.ndarray) -> str:
    """The text without its hit words and what stands between them."""
    raw, begin = text.encode(), int(w.text[np.searchsorted(w.text, w.start[first], "right") - 1])
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    out, at = [], 0
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        out.append(raw[at : int(w.start[first + a]) - begin])
        at = int(w.end[first + b - 1]) - begin
    return b"".join([*out, raw[at:]]).decode()


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = 10,
    text: str | Column = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    keep: Sequence[str] = ("doc_id",),
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: the ``keep`` columns and what was found.

    ``n_words``, ``n_hit`` (words inside an occurring window), ``items`` (sorted ids
    of items with an occurring window), ``items_sha256`` of the ids joined by commas,
    ``contaminated`` and ``clean_text``, the text without the hit words.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(item_text).alias("t")).where("t is not null")
    total = items.agg(F.sum(F.octet_length("t") + F.octet_length("i") + 16)).first()[0] or 0
    parts = max(1, ceil(total / slice_bytes))
    column = F.col(text) if isinstance(text, str) else text
    names = [f"__k{i}" for i in range(len(keep))]
    work = docs.select(
        *[F.col(c).alias(n) for c, n in zip(keep, names)],
        column.alias("__text"),
        F.lit(None).cast("binary").alias(_FOUND),
        F.lit(None).cast("array<string>").alias(_ITEMS),
    )
    fields = [f for f in work.schema.fields if f.name in names]
    state = [T.StructField(_FOUND, T.BinaryType()), T.StructField(_ITEMS, T.ArrayType(T.StringType()))]
    for k in range(parts):
        part = items if parts == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k)
        rows = spark.sparkContext.broadcast(part.toArrow())
        last = k == parts - 1
        more = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items_sha256", T.StringType()), T.StructField("clean_text", T.StringType())]
        out = T.StructType([*fields, *state, *more] if last else [*fields, T.StructField("__text", T.StringType()), *state])
        work = work.mapInArrow(_scan(rows, size, to_arrow_schema(out), last), out)
        if not last:
            work = stage(work, "decontaminate")
    return work.select(
        *[F.col(n).alias(c) for c, n in zip(keep, names)],
        "n_words",
        "n_hit",
        F.col(_ITEMS).alias("items"),
        "items_sha256",
        (F.col("n_hit") > 0).alias("contaminated"),
        "clean_text",
    )
