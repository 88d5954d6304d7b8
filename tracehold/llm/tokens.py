"""Token ids of whole texts by a public tokenizer file.

Encoding calls the ``tokenizers`` library.  Both vocabularies used here never
merge across a gap between words, so a text is cut at gaps, every different
piece is encoded once per worker and its ids are kept as packed bytes.  The
memo is emptied when it is full, which bounds memory and changes no result.
The strings of added tokens stand for those tokens, as the library has it by
default: texts are cut at them first.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tracehold.llm.words import LOWER, Words, slices

#: Different pieces one worker remembers, about 200 bytes each.
MEMO_ENTRIES = 400_000
ID = np.dtype("<u4")
DROPPED_SPACE = np.zeros(256, bool)
DROPPED_SPACE[[0x20, 0x09, 0x0A, 0x0D]] = True
#: First bytes of characters none of which is white space in Unicode.
VISIBLE = np.zeros(256, bool)
VISIBLE[[*range(0x21, 0x7F), *range(0xC3, 0xE1), *range(0xE4, 0xF5)]] = True
ASCII_VISIBLE = VISIBLE & (np.arange(256) < 0x7F)
LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: Marks that never stand inside a pattern's match behind a letter; the apostrophe does.
MARK = ASCII_VISIBLE & ~LETTER
MARK[[0x27, *range(0x30, 0x3A)]] = False
#: From here on the library and ``regex`` may know different letters.
GREEK = "\u0370"
#: Fixed value: the pre-tokenizing pattern of byte-level vocabularies.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_characters() -> dict[int, int]:
    """Byte-level vocabularies write a byte without a visible Latin-1 character as the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(hidden)}


BYTE_CHARACTERS = _byte_characters()


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer file; any other path is returned as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceEncoder:
    """Ids of texts as little-endian 32-bit bytes, equal to ``Tokenizer.encode(..., add_special_tokens=False)``.

    Works for files whose pre-tokenizer is one ``Split`` pattern with removed
    gaps, or the plain byte-level one.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        settings = json.loads(self.tokenizer.to_str())
        step, added = settings["pre_tokenizer"], settings["added_tokens"]
        if any(a[flag] for a in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens with conditions are not supported")
        self.added = {a["content"]: np.array([a["id"]], ID).tobytes() for a in added}
        strings = sorted(map(re.escape, self.added), key=len, reverse=True)
        self.at_added = re.compile(f"({'|'.join(strings)})") if strings else None
        split = step["pretokenizers"][0] if step["type"] == "Sequence" else {}
        self.drops_space = bool(split)
        self.normalize = self.tokenizer.normalizer.normalize_str if self.tokenizer.normalizer else None
        self.pattern = regex.compile(split["pattern"]["Regex"] if split else BYTE_LEVEL).findall
        self.tokenize = self.tokenizer.model.tokenize
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _find(self, piece: str) -> list[str]:
        if piece.isascii() or max(piece) < GREEK:
            return self.pattern(piece)
        return [piece[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(piece)]

    def _ids(self, word: str) -> bytes:
        raw = word if word.isalnum() and word.isascii() else word.encode().decode("latin-1").translate(BYTE_CHARACTERS)
        return array("I", [t.id for t in self.tokenize(raw)]).tobytes()

    def _word(self, word: str) -> bytes:
        ids = self._ids(word)
        if len(word) < 64:
            if len(self.words) >= MEMO_ENTRIES:
                self.words.clear()
            self.words[word] = ids
        return ids

    def _piece(self, raw: bytes) -> bytes:
        get, piece = self.words.get, raw.decode()
        words = self._find(piece if self.normalize is None or piece.isascii() and piece.islower() else self.normalize(piece))
        ids = b"".join([get(w) or self._word(w) for w in words]) if len(words) > 1 else self._ids(words[0]) if words else b""
        if len(raw) < 64:
            if len(self.pieces) >= MEMO_ENTRIES:
                self.pieces.clear()
            self.pieces[raw] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids of one text."""
        return next(iter(self.encode_all(pa.array([text], pa.large_string()))))

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text."""
        found = [pc.any(pc.match_substring(texts, a)).as_py() for a in self.added]
        if not any(found):
            yield from self._plain(texts)
            return
        cut = [self.at_added.split(t or "") for t in texts.to_pylist()]
        ids = self._plain(pa.array([part for parts in cut for part in parts[::2]], pa.large_string()))
        for parts in cut:
            yield b"".join([next(ids), *(x for a in parts[1::2] for x in (self.added[a], next(ids)))])

    def _plain(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of texts without added tokens; different pieces of a slice are looked up once."""
        for _, data, text in slices(texts, 1 << 20):
            if self.drops_space:
                # The normalizer lowers; a capital before a combining mark is left to it.
                data = np.where(np.append(data[1:], 0) < 0x80, LOWER[data], data)
            w = pieces(data, text, self.drops_space)
            _, at, same = np.unique(w.hashes(), return_index=True, return_inverse=True)
            get = self.pieces.get
            raw, start, end = data.tobytes(), w.start[at].tolist(), w.end[at].tolist()
            found = [get(p := raw[a:b]) or self._piece(p) for a, b in zip(start, end)]
            size = np.fromiter(map(len, found), np.int64, len(found)) // ID.itemsize
            place = np.cumsum(size) - size
            ids = np.frombuffer(b"".join(found), ID)
            # Ids of all pieces in order: each piece's place, then counting up inside it.
            n = size[same]
            ends = np.cumsum(n)
            flat = ids[np.repeat(place[same] - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)]
            bound = np.concatenate([[0], ends])[w.offset].tolist()
            for a, b in zip(bound[:-1], bound[1:]):
                yield flat[a:b].tobytes()


def pieces(data: np.ndarray, text: np.ndarray, drops_space: bool) -> Words:
    """Parts of texts between which no token can reach.

    A part begins at a text's start, at a mark behind a letter and around line
    ends; besides, where gaps are dropped, at their ends, or else at a space in
    front of a character that is certainly no white space.
    """
    begins = np.zeros(len(data) + 1, bool)
    before, here = data[:-1], data[1:]
    # Latin-1 letters take two bytes, 0xC3 first; two signs among them are no letters.
    latin = np.zeros(len(before), bool)
    latin[1:] = (data[:-2] == 0xC3) & (before[1:] != 0x97) & (before[1:] != 0xB7)
    begins[1:-1] = MARK[here] & (LETTER[before] | latin)
    line_end = (here == 0x0A) & ASCII_VISIBLE[before]
    begins[1:-1] |= line_end
    begins[2:-1] |= line_end[:-1] & ASCII_VISIBLE[here[1:]]
    if drops_space:
        gap = DROPPED_SPACE[data]
        begins[1:-1] |= gap[1:] != gap[:-1]
    else:
        begins[:-2] |= (before == 0x20) & VISIBLE[here]
        last = text[1:-1] - 1  # a last space has no character behind it in its text
        begins[last[last >= 0]] &= ~(data[last[last >= 0]] == 0x20)
    begins[text] = True
    cut = np.flatnonzero(begins)
    start, end = cut[:-1], cut[1:]
    if drops_space and len(start):
        keep = ~gap[start]
        start, end = start[keep], end[keep]
    return Words(0, data, text, start, end, np.searchsorted(start, text, "left"))


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One encoder per worker process and file."""
    return PieceEncoder(path)
