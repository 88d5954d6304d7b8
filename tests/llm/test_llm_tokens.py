"""Token ids, the token file and packing against the library and plain loops."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tracehold.llm.packing import pack, pack_documents
from tracehold.llm.token_file import Block, read_token_at, read_tokens, write_block, write_tokens
from tracehold.llm.tokens import ID, encoder, tokenizer_file
from tracehold.llm.words import NOT_ALNUM, SPACE, words

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
EDGES = ["", " ", "  ", "\n\n", "a", " a", "a ", "a  b", "it's. 'S don't!", "Ünïcode, naïve... ÉTÉ.", "x\n\n<y", "<|endoftext|> <|startoftext|>", "中文　字 z", "a\x85b \x0bc", "T̈ ẗ", "9" * 300, "w" * 5000]


def random_texts(n, seed=3):
    draw = random.Random(seed)
    letters = list("abT1 '  \n\t.,-<|>éß×́​!\U0001f600\r\x00") + ["'s", " the", "<|endoftext|>", " "]
    return ["".join(draw.choices(letters, k=draw.randint(0, 40))) for _ in range(n)]


def table(spark, rows, schema="doc_id long, text string, lang string"):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("name", FILES)
def test_ids_equal_the_library(name):
    library = Tokenizer.from_file(tokenizer_file(name))
    texts = EDGES + random_texts(3000)
    assert any("<|endoftext|>" in t for t in texts[len(EDGES) :])
    for k in range(0x370, 0x20000, 7):  # letters that one of the two may not know yet
        if not 0xD800 <= k < 0xE000:
            texts.append(f"a{chr(k)}b {chr(k)}1 {chr(k)}. ")
    for text, ids in zip(texts, encoder(tokenizer_file(name)).encode_all(pa.array(texts)), strict=True):
        assert np.frombuffer(ids, ID).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_words_of_many_texts():
    texts = [*EDGES, None, *random_texts(200)]
    found = []
    for w in words(pa.array(texts), SPACE, limit=64):
        found += [[x.decode() for x in w.bytes(a, b)] for a, b in zip(w.offset[:-1], w.offset[1:])]
    import re

    assert found == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    lowered = [x.decode() for w in words(pa.array(["Ab-É9 z"]), NOT_ALNUM, lower=True) for x in w.bytes(0, len(w.start))]
    assert lowered == ["ab", "É9", "z"]
    one, two = (next(words(pa.array([t]))).hashes().tolist() for t in ("a b a", "x a b a"))
    assert one == two[1:] and one[0] == one[2] != one[1]


def test_block_gives_every_token():
    draw = np.random.default_rng(1)
    ids = np.concatenate([draw.integers(0, 256, 700), draw.integers(0, 49_408, 900), [0, 255, 256, 65_535, 65_536, 16_777_216, 2**32 - 1]]).astype(np.uint32)
    block = Block(write_block([None, 4], [len(ids) - 3, 3], ids))
    assert block.ids().tolist() == ids.tolist() == [block.token(i) for i in range(len(ids))]
    assert block.doc_ids == [None, 4] and block.lengths.tolist() == [len(ids) - 3, 3]
    with pytest.raises(IndexError):
        block.token(len(ids))


def test_token_file(spark, tmp_path):
    rows = [(7, "the end", "x"), (3, None, None), (5, "", "x"), (None, "no id", "x"), (7, "the end", "x"), (2, "long " * 30_000, "x")]
    path = str(tmp_path / "tokens")
    write_tokens(table(spark, rows), path, FILES[0], end_id=1, block_tokens=64)
    found = [tuple(r) for r in read_tokens(spark, path, with_ids=True).orderBy("start").collect()]
    library = Tokenizer.from_file(tokenizer_file(FILES[0]))
    start, flat = 0, []
    for (doc, text, _), row in zip(sorted(rows, key=lambda r: -1 if r[0] is None else r[0]), found, strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        crc = zlib.crc32(np.array(ids, ID).tobytes())
        assert row == (doc, start, len(ids), crc, ids)
        start, flat = start + len(ids), flat + ids
    asked = [0, 5, 30_001, len(flat) - 1, len(flat), -1, None]
    got = read_token_at(spark, path, spark.createDataFrame([(a,) for a in asked], "position long"))
    assert {tuple(r) for r in got.collect()} == {(a, flat[a]) for a in asked if a is not None and 0 <= a < len(flat)}


def test_token_file_of_nothing(spark, tmp_path):
    write_tokens(table(spark, []), str(tmp_path / "none"), FILES[0], end_id=1)
    assert read_tokens(spark, str(tmp_path / "none")).count() == 0


def test_packing_is_tight():
    draw = np.random.default_rng(2)
    for sizes in (draw.integers(1, 100, 4000), draw.integers(30, 50, 500), np.full(90, 50), np.array([], np.int64)):
        sizes = np.sort(sizes)[::-1].astype(np.int64)
        sequence, offset = pack(sizes, 100)
        least = -(-int(sizes.sum()) // 100)
        bins = {}
        for s, o, n in zip(sequence.tolist(), offset.tolist(), sizes.tolist()):
            bins.setdefault(s, []).append((o, n))
        for parts in bins.values():
            at = 0
            for o, n in sorted(parts):
                assert o == at
                at += n
            assert at <= 100
        if len(sizes) == 4000:
            assert len(bins) <= least * 1.01


@pytest.mark.parametrize("excess", [True, False])
def test_packing_follows_its_rule(excess):
    """A plain loop: of the gaps that hold the size, the one after whose use the stated sum is smallest."""
    draw = np.random.default_rng(5)
    for _ in range(6):
        top = int(draw.integers(8, 60))
        sizes = np.sort(draw.integers(1, top, 200))[::-1].astype(np.int64)
        gaps, want = [], []  # the gap of each sequence
        for k, size in enumerate(sizes.tolist()):
            later = sizes[k + 1 :].tolist()
            best = None
            for gap in sorted({g for g in gaps if g >= size} | {top}):
                rest = list(gaps)
                if gap in rest and gap < top:
                    rest.remove(gap)
                rest.append(gap - size)
                cost = 0
                for g in set(rest) - {0, top}:
                    cost += max(0, rest.count(g) - (later.count(g) if excess else 0)) ** 2
                cost += (gap - size) / 16 if excess else 0
                if best is None or cost < best[0]:
                    best = (cost, gap)
            if best[1] == top:
                gaps.append(top - size)
            else:
                gaps[gaps.index(best[1])] = best[1] - size
            want.append(top - best[1])
        assert pack(sizes, top, excess)[1].tolist() == want


def test_copies_and_null_ids_are_dealt_out(spark, tmp_path):
    rows = [(None, "same words", "x")] * 400 + [(7, "same words", "x")] * 400 + [(7, f"text {i}", "x") for i in range(100)]
    docs = table(spark, rows).repartition(8)
    path = str(tmp_path / "tokens")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small parts would be put together
    write_tokens(docs, path, FILES[0], end_id=1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    parts = spark.read.parquet(path).groupBy("part").sum("n_docs").collect()
    assert len(parts) >= 4 and max(r[1] for r in parts) < 450
    got = read_tokens(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None] * 400 + [7] * 500
    packed = pack_documents(docs, FILES[1], end_id=2, group_docs=100)
    assert packed.groupBy(packed.sequence_id.bitwiseAND(-(1 << 32)).alias("group")).count().count() == 9


def test_pack_documents(spark):
    draw = random.Random(4)
    rows = [(i, "word " * draw.choice([0, 1, 3, 40, 700, 1023, 1024, 3000]), "x") for i in range(120)]
    rows += [(None, "null id", None), (5, None, "x"), (6, rows[6][1], "x")]
    out = pack_documents(table(spark, rows), FILES[1], end_id=2, with_ids=True, group_docs=50).collect()
    library, want = Tokenizer.from_file(tokenizer_file(FILES[1])), []
    for doc, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        cut = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        want += [(doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], ID).tobytes())) for k, (a, b) in enumerate(zip(cut, cut[1:]))]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted([tuple(r)[:5] for r in out], key=key) == sorted(want, key=key)
    bins = {}
    for r in out:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        ends = [0, *np.cumsum([n for _, n in sorted(parts)]).tolist()]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 1024
    assert pack_documents(table(spark, []), FILES[1], end_id=2).count() == 0
