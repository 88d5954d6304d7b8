"""Words of whole texts, found and counted in bulk inside tasks.

Many texts are one run of code points.  What belongs to a word is asked of Java once, so that
the words are those of :func:`tracehold.operators.features.words`, whatever Unicode version
Python knows.  Equal words are found by 64 bits made from all their letters.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIECE = 1 << 21  # characters split at once, and the text that reaches that number
WINDOW = 1 << 20  # characters hashed at once, and the word that reaches beyond
LEAST = 2  # letters of a word
LETTER = r"[\p{L}\p{N}_]"
U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
TERMS = "term string, total long, df long"


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, U64(BASE)), np.full(size, U64(pow(BASE, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_runs: list[tuple[int, int]] = []


def letter_runs(spark: SparkSession) -> list[tuple[int, int]]:
    """First and last code points of all runs of letters, as Java knows them."""
    if not _runs:
        every = "".join(map(chr, [*range(1, 0xD800), *range(0xE000, 0x110000)]))
        found = F.regexp_extract_all(F.lit(every), F.lit(f"({LETTER}+)"), F.lit(1))
        _runs.extend((ord(r[0]), ord(r[-1])) for r in spark.range(1).select(found).first()[0])
    return _runs


class Splitter:
    def __init__(self, runs: list[tuple[int, int]]):
        self.letter = np.zeros(0x110000, bool)
        for first, last in runs:
            self.letter[first : last + 1] = True
        self.value = mix(np.arange(1, 0x110001, dtype=U64) * U64(BASE))

    def words(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, 64 bits) of the words of a text."""
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        inside = np.zeros(len(codes) + 2, np.int8)
        inside[1:-1] = self.letter[codes]
        turn = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = turn[::2], turn[1::2]
        long = end - start >= LEAST
        start, end = start[long], end[long]
        named = np.zeros(len(start), U64)
        cuts = np.searchsorted(start, range(0, len(codes) + WINDOW, WINDOW))
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a < b:
                low, length = start[a], int(end[b - 1] - start[a])
                up, down = _powers(max(WINDOW, 1 << length.bit_length()))
                total = np.zeros(length + 1, U64)
                np.cumsum(self.value[codes[low : low + length]] * up[:length], out=total[1:])
                s, e = start[a:b] - low, end[a:b] - low
                named[a:b] = mix((total[e] - total[s]) * down[s] + (e - s).astype(U64))
        return start, end, named

    def pieces(self, texts: pa.Array):
        """(first row, rows, their joined texts, row of each word from the first on, starts, ends, 64 bits)."""
        held, size, first = [], 0, 0
        for at in range(0, len(texts), 64):
            for text in texts.slice(at, 64).to_pylist():
                held.append(text)
                size += len(text) + 1
                if size >= PIECE:
                    yield self._piece(first, held)
                    first, held, size = first + len(held), [], 0
        if held:
            yield self._piece(first, held)

    def _piece(self, first: int, texts: list[str]):
        joined = "\n".join(texts)
        start, end, named = self.words(joined)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
        return first, len(texts), joined, np.searchsorted(begins, start, side="right") - 1, start, end, named


def _by_word(named: np.ndarray) -> np.ndarray:
    """The order that puts equal words together, each in its own order."""
    shift = U64(len(named).bit_length())
    keys = named >> shift << shift | np.arange(len(named), dtype=U64)
    keys.sort()
    order = (keys & ((U64(1) << shift) - U64(1))).astype(np.int64)
    keys, found = keys >> shift, named[order]
    # Different words that agree in the bits above the number are rare.
    if ((keys[1:] == keys[:-1]) & (found[1:] != found[:-1])).any():
        return np.argsort(named, kind="stable")
    return order


def term_totals(texts: DataFrame) -> DataFrame:
    """(term, total, df): occurrences and texts of every word of the column ``_text``, in part sums."""
    runs = letter_runs(texts.sparkSession)

    def count(batches):
        splitter = Splitter(runs)
        for batch in batches:
            for _, _, joined, row, start, end, named in splitter.pieces(batch.column("_text")):
                if not len(named):
                    continue
                order = _by_word(named)
                named, row = named[order], row[order]
                new = np.append(True, named[1:] != named[:-1])
                first = np.flatnonzero(new)
                total = np.diff(np.append(first, len(named)))
                new[1:] |= row[1:] != row[:-1]
                at = order[first]
                terms = [joined[a:b] for a, b in zip(start[at].tolist(), end[at].tolist())]
                columns = [pa.array(terms, pa.string()), pa.array(total), pa.array(np.add.reduceat(new.astype(np.int64), first))]
                yield pa.RecordBatch.from_arrays(columns, ["term", "total", "df"])

    return texts.select("_text").mapInArrow(count, TERMS)


class TermCounts:
    """Counts the given terms in texts."""

    def __init__(self, runs: list[tuple[int, int]], terms: list[str]):
        self.splitter, self.terms = Splitter(runs), len(terms)
        named = np.array([self.splitter.words(t)[2][0] for t in terms], U64)
        self.place = np.argsort(named)
        self.named = named[self.place]
        self.likely = np.zeros(1 << 16, bool)
        self.likely[(named & U64(0xFFFF)).astype(np.int64)] = True

    def __call__(self, texts: pa.Array) -> np.ndarray:
        """One row of counts for each text."""
        found = np.zeros((len(texts), self.terms), np.int64)
        if not self.terms:
            return found
        for first, rows, _, row, _, _, named in self.splitter.pieces(texts):
            some = np.flatnonzero(self.likely[(named & U64(0xFFFF)).astype(np.int64)])
            named, row = named[some], row[some]
            at = np.minimum(np.searchsorted(self.named, named), self.terms - 1)
            same = self.named[at] == named
            cells = np.bincount(row[same] * self.terms + self.place[at[same]], minlength=rows * self.terms)
            found[first : first + rows] = cells.reshape(rows, self.terms)
        return found
