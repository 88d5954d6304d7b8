"""Words of whole texts as arrays, for use inside tasks.

A batch of texts is one run of UTF-8 bytes.  All separators in use are ASCII,
so words are found and hashed on the bytes of many texts at once, in slices of
bounded size; one text is never cut.  Word hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
U64 = np.uint64
#: An odd multiplier per use; byte values and mixing come from the generator below.
BASE = 0x9E3779B97F4A7C15

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: ASCII but for digits and lower-case letters; capitals are lowered before.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values (a finalizer of two multiplications)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


VALUE = mix(np.arange(1, 257, dtype=U64) * U64(BASE))


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(BASE, -1, 1 << 64)
    up, down = np.full(size, U64(BASE)), np.full(size, U64(inverse))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


@dataclass
class Words:
    """Words of the texts ``first`` to ``first + n - 1`` of a batch."""

    first: int
    data: np.ndarray  #: bytes of the texts, lowered if asked for
    text: np.ndarray  #: n + 1 byte offsets of the texts
    start: np.ndarray  #: byte offsets of the words
    end: np.ndarray
    offset: np.ndarray  #: n + 1 positions of each text's first word

    @property
    def n(self) -> int:
        return len(self.text) - 1

    def lengths(self) -> np.ndarray:
        return np.diff(self.offset)

    def owner(self) -> np.ndarray:
        """The text of each word, counted from ``first``."""
        return np.repeat(np.arange(self.n), self.lengths())

    def hashes(self) -> np.ndarray:
        """One 64-bit value per word, from its bytes only."""
        up, down = _powers(max(SLICE_BYTES, 1 << int(len(self.data)).bit_length()))
        total = np.zeros(len(self.data) + 1, U64)
        np.cumsum(VALUE[self.data] * up[: len(self.data)], out=total[1:])
        return mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(U64))

    def bytes(self, i: int, j: int) -> list[bytes]:
        """The words from ``i`` up to ``j`` themselves."""
        return [self.data[a:b].tobytes() for a, b in zip(self.start[i:j].tolist(), self.end[i:j].tolist())]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive texts of about ``limit`` bytes; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words_of(data: np.ndarray, text: np.ndarray, separators: np.ndarray, first: int = 0) -> Iterator[Words]:
    """The words of one slice: runs without separator bytes."""
    inside = ~separators[data]
    # A word begins inside after a gap or at a text's start, and ends likewise.
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[text] = True
    cut = np.flatnonzero(edge)
    a, b = cut[:-1], cut[1:]
    keep = inside[a] if len(a) else np.zeros(0, bool)
    start, end = a[keep], b[keep]
    yield Words(first, data, text, start, end, np.searchsorted(start, text, "left"))


def words(texts: pa.Array, separators: np.ndarray = SPACE, lower: bool = False, limit: int = SLICE_BYTES) -> Iterator[Words]:
    """The words of each slice of ``texts``."""
    for first, data, text in slices(texts, limit):
        yield from words_of(LOWER[data] if lower else data, text, separators, first)


def window_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of ``values[i : i + size]`` for each i with that many values left; ends of texts are the caller's."""
    if len(values) < size:
        return np.zeros(0, U64)
    up, down = _powers(1 << int(max(len(values), SLICE_BYTES)).bit_length())
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[size:] - total[:-size]) * down[: len(values) - size + 1])


def full_windows(offset: np.ndarray, size: int, count: int) -> np.ndarray:
    """Which of ``count`` window starts have their ``size`` values inside one text."""
    n = max(0, count - size + 1)
    last = np.repeat(offset[1:], np.diff(offset))[:n]
    return np.arange(n) + size <= last
