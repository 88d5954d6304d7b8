"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

Of every prefix of a piece the encoding has one last token.  It is the only token
that ends the prefix and fits behind the last token of the prefix in front of it: two
neighbours fit if no merge that the vocabulary would do earlier crosses the gap between
them.  An automaton over all tokens, fed byte by byte, names the longest token that ends
at each place, and each token the next shorter one that ends it; the first that fits is
stored.  Following the stored tokens back from the end gives the ids, without merging.

Cases: null and empty texts have no ids; a string of an added token is that token; long
pieces take memory in proportion to their length and are never cut; repeated rows and
null document ids are encoded like others; an empty table gives no rows.  Only plain
byte-level vocabularies are taken, without prefixes or endings of their own.  Decoding
leaves ids out that the vocabulary does not have and null ids, writes U+FFFD for bytes
that are no UTF-8, and gives an empty text for null or no ids.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracehold.llm.tokens import BYTE_CHARACTERS, ID, PieceEncoder, tokenizer_file

#: Pairs of tokens one worker remembers as fitting or not, about 100 bytes each.
PAIR_ENTRIES = 200_000
#: Above any rank.
NEVER = 1 << 40
_BYTE_OF = {c: b for b, c in BYTE_CHARACTERS.items()}


def _bytes(token: str) -> bytes:
    return bytes(_BYTE_OF.get(ord(c), ord(c)) for c in token)


class Vocabulary:
    """Tokens, merges and the automaton of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            settings = json.load(file)
        model = settings["model"]
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            raise ValueError("no plain byte-level vocabulary")
        ids = model["vocab"]
        self.spelled = {i: _bytes(t) for t, i in ids.items()}
        self.pair: dict[int, int] = {}  #: left << 32 | right -> rank of their merge
        self.made: dict[int, tuple[int, int, int]] = {}  #: token -> (rank, left, right)
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            left, right, whole = ids[left], ids[right], ids[left + right]
            self.pair[left << 32 | right] = rank
            if whole in self.made:
                raise ValueError("two merges make one token")
            self.made[whole] = (rank, left, right)
        self._build()
        self.known: dict[int, bool] = {}

    def _build(self) -> None:
        """States are prefixes of tokens; state 0 is the empty one."""
        self.step: dict[int, int] = {}  #: state * 256 + byte -> state
        own = {0: -1}  #: the token that a state spells
        children: list[list[tuple[int, int]]] = [[]]
        for token, raw in self.spelled.items():
            if token not in self.made and len(raw) > 1:
                continue  # no merge makes it
            state = 0
            for byte in raw:
                key = state << 8 | byte
                if key not in self.step:
                    self.step[key] = len(children)
                    children[state].append((byte, len(children)))
                    children.append([])
                state = self.step[key]
            own[state] = token
        self.back = [0] * len(children)  #: the longest state that ends a state
        self.longest = [-1] * len(children)  #: the longest token that ends a state
        self.shorter: dict[int, int] = {}
        waiting = deque([0])
        while waiting:
            state = waiting.popleft()
            for byte, child in children[state]:
                other = self.back[state]
                while state and other and other << 8 | byte not in self.step:
                    other = self.back[other]
                self.back[child] = self.step.get(other << 8 | byte, 0) if state else 0
                inherited = self.longest[self.back[child]]
                token = own.get(child, -1)
                self.longest[child] = token if token >= 0 else inherited
                if token >= 0:
                    self.shorter[token] = inherited
                waiting.append(child)
        self.length = {token: len(raw) for token, raw in self.spelled.items()}

    def fits(self, left: int, right: int) -> bool:
        """Whether merging ``left`` and ``right``'s bytes together ends in these two tokens.

        Goes back in time: of the two tokens at the gap the one made last is undone.  A
        merge across the gap would have come first if its rank is below those of the
        merges that used the two up; of equal ranks the left place comes first.
        """
        made, used_left, used_right = self.made, NEVER, NEVER
        while True:
            rank = self.pair.get(left << 32 | right, NEVER)
            if rank < used_left and rank <= used_right and rank != NEVER:
                return False
            a, b = made.get(left), made.get(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and a[0] > b[0]:
                used_left, left = a[0], a[2]
            else:
                used_right, right = b[0], b[1]

    def last_tokens(self, raw: bytes) -> list[int]:
        """The last token of the encoding of each prefix of ``raw``."""
        step, back, longest, shorter, length, known = self.step, self.back, self.longest, self.shorter, self.length, self.known
        last: list[int] = []
        state = 0
        for end, byte in enumerate(raw, 1):
            while (key := state << 8 | byte) not in step:
                state = back[state]
            state = step[key]
            token = longest[state]
            while (before := end - length[token]) > 0:
                pair = last[before - 1] << 32 | token
                fit = known.get(pair)
                if fit is None:
                    if len(known) >= PAIR_ENTRIES:
                        known.clear()
                    fit = known[pair] = self.fits(last[before - 1], token)
                if fit:
                    break
                token = shorter[token]
            last.append(token)
        return last

    def encode(self, raw: bytes) -> list[int]:
        """Ids of one piece, followed back from its end."""
        last, out, end = self.last_tokens(raw), [], len(raw)
        while end:
            out.append(last[end - 1])
            end -= self.length[last[end - 1]]
        return out[::-1]


class PrefixEncoder(PieceEncoder):
    """Splits texts as the tokenizer file says and encodes each piece by its prefixes."""

    def __init__(self, path: str):
        super().__init__(path)
        self.vocabulary = Vocabulary(path)

    def _ids(self, word: str) -> bytes:
        return np.array(self.vocabulary.encode(word.encode()), ID).tobytes()


class Decoder:
    """Texts of ids: each id's bytes one after the other."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            settings = json.load(file)
        spelled = {i: _bytes(t) for t, i in settings["model"]["vocab"].items()}
        # An added token is spelled like any other one.
        spelled |= {a["id"]: a["content"].encode() for a in settings["added_tokens"]}
        self.n = max(spelled, default=-1) + 1
        strings = [spelled.get(i, b"") for i in range(self.n)] + [b""]
        self.size = np.array([len(s) for s in strings], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(strings), np.uint8)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ``ids``; place ``n`` of the table stands for all unknown ones."""
        ids = np.where((ids >= 0) & (ids < self.n), ids, self.n)
        size = self.size[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.start[ids] - ends + size, size) + np.arange(total)].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _encoder(path: str) -> PrefixEncoder:
    return PrefixEncoder(path)


@lru_cache(maxsize=2)
def _decoder(path: str) -> Decoder:
    return Decoder(path)


#: Ids of one list column handed on at once; a longer text is a batch of its own.
BATCH_IDS = 1 << 20


def _encode(path: str, decoded: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def listed(names, raws):
            ends = np.cumsum([0, *map(len, raws)]) // ID.itemsize
            flat = np.frombuffer(b"".join(raws), ID).view(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            columns = [pa.array(names, pa.int64()), ids]
            if decoded:
                columns.append(pa.array([_decoder(path).decode(np.frombuffer(r, ID)) for r in raws], pa.string()))
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "text"][: len(columns)])

        for batch in batches:
            names, raws, size = [], [], 0
            for name, raw in zip(batch.column(0).to_pylist(), _encoder(path).encode_all(batch.column(1))):
                names.append(name)
                raws.append(raw)
                size += len(raw) // ID.itemsize
                if size >= BATCH_IDS:
                    yield listed(names, raws)
                    names, raws, size = [], [], 0
            if names:
                yield listed(names, raws)

    return encode


def encode_texts(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``doc_id`` and ``ids``, an array of all ids of the whole text.

    ``decoded`` adds ``text``, decoded from the ids by the same workers as in ``decode_ids``.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_encode(tokenizer_file(tokenizer), decoded), "doc_id long, ids array<int>" + ", text string" * decoded)


def _decode(path: str):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy()
            flat = lists.values.fill_null(-1).to_numpy()
            known = lists.is_valid().to_numpy(zero_copy_only=False)
            texts = [_decoder(path).decode(flat[a:b]) if k else "" for a, b, k in zip(offsets[:-1].tolist(), offsets[1:].tolist(), known.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return decode


def decode_ids(encoded: DataFrame, tokenizer: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``doc_id``, ``ids`` and ``text``, the text that the ids spell, special tokens included."""
    rows = encoded.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids"))
    return rows.mapInArrow(_decode(tokenizer_file(tokenizer)), "doc_id long, ids array<int>, text string")
