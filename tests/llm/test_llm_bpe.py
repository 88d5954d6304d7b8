"""Encoding by prefixes against the library, decoding back."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from tracehold.llm.bpe import Decoder, PrefixEncoder, Vocabulary, decode_ids, encode_texts
from tracehold.llm.tokens import ID, tokenizer_file

NAME = "byte_bpe_50k.json"
EDGES = ["", " ", "\n\n", " a", "a  b", "it's. 'S don't!", "Ünïcode, naïve... ÉTÉ.", "a<|endoftext|>b <|endoftext|>", "<|endoftext", "中文　字 z", "9" * 300, "w" * 5000, "ab" * 3000, "\U0001f600\u200b\x00", "aaaa" * 7 + " the" * 5]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_file(NAME))


@pytest.fixture(scope="module")
def encoder():
    return PrefixEncoder(tokenizer_file(NAME))


def test_every_token_is_its_own_encoding(encoder):
    v = encoder.vocabulary
    assert all(v.encode(raw) == [token] for token, raw in v.spelled.items())


def test_last_tokens_are_those_of_the_prefixes(library, encoder):
    """Each prefix by itself, encoded by the library, ends in the stored token."""
    draw = random.Random(1)
    for _ in range(300):
        word = "".join(draw.choices("aeinrstthxyzé", k=draw.randint(1, 14)))
        last = encoder.vocabulary.last_tokens(word.encode())
        at = 0
        for k in range(1, len(word) + 1):
            at = len(word[:k].encode())
            assert last[at - 1] == library.encode(word[:k], add_special_tokens=False).ids[-1], (word, k)


def test_pairs_fit_as_the_library_merges(library, encoder):
    draw, v = random.Random(2), encoder.vocabulary
    plain = [t for t, raw in v.spelled.items() if raw.isalpha() and raw.isascii()]
    for _ in range(4000):
        a, b = draw.choice(plain), draw.choice(plain)
        both = (v.spelled[a] + v.spelled[b]).decode()
        assert v.fits(a, b) == (library.encode(both, add_special_tokens=False).ids == [a, b])


def test_texts_and_back(spark, library):
    draw = random.Random(3)
    letters = list("abcdehlnorstuABT1 '  \n\t.,-<|>éß×́​!\U0001f600\r\x00") + ["'s", " the", "<|endoftext|>", "ation", " "]
    texts = [*EDGES, None, *("".join(draw.choices(letters, k=draw.randint(0, 60))) for _ in range(2000)), EDGES[3], EDGES[3]]
    rows = [(i if i % 9 else None, t, "x", [1]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens array<int>")
    encoded = encode_texts(docs, NAME)
    got = sorted(((r.doc_id or -1, tuple(r.ids), r.text) for r in decode_ids(encoded, NAME).collect()))
    want = []
    for (i, t, *_) in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i or -1, tuple(ids), library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)
    both = encode_texts(docs, NAME, decoded=True).collect()
    assert sorted((r.doc_id or -1, tuple(r.ids), r.text) for r in both) == got
    assert encode_texts(docs.limit(0), NAME).count() == 0


def test_decoding_any_ids(spark, library):
    draw, decoder = np.random.default_rng(4), Decoder(tokenizer_file(NAME))
    for _ in range(500):
        ids = draw.integers(0, 50_257, draw.integers(0, 30))
        assert decoder.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False)
    rows = [(1, [50_256, None, 64, 99_999]), (2, None), (None, [])]
    got = decode_ids(spark.createDataFrame(rows, "doc_id long, ids array<int>"), NAME).collect()
    assert {(r.doc_id, r.text) for r in got} == {(1, "<|endoftext|>a"), (2, ""), (None, "")}


def test_long_pieces_and_other_vocabularies(library, encoder):
    text = "".join(random.Random(5).choices("abcdefgh", k=30_000))
    ids = np.frombuffer(encoder.encode(text), ID).tolist()
    assert ids == library.encode(text, add_special_tokens=False).ids
    with pytest.raises(ValueError):
        Vocabulary(tokenizer_file("word_bpe_49k.json"))
