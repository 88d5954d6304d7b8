"""Phrases that stand together more often than their parts, by counting in a HAT-trie.

Each task counts packed word ids in a trie that is shallow: its nodes branch on a word,
and below them hash containers hold whole ranges of words.  A container that grows too
large bursts, first into two ranges of words, and once it holds a single word into a node
that branches on the next word.  At its limit the task spills the largest subtrees of the
root as sorted runs of (language, phrase, count).  Runs are merged in partitions that are
ranges of phrases, hence of prefixes; Spark draws their bounds from the runs, so a very
common first word is cut like any other stretch.

Single words and pairs are counted first.  A phrase of three words is counted only where
both of its pairs are frequent enough, by a bit table of the frequent pairs that may say
yes too often and never no: it saves work and changes no result.  Frequent parts of frequent
phrases are frequent, so scores come from joins of the frequent phrases alone.

Cases: a null text has no words and a null language is ``und``; an empty language is one of
its own; repeated rows count as often as they stand there; ties in score and count go by the
phrase's bytes; an empty table gives no rows; texts are never cut.  Column names of the table
other than the two asked for are not looked at.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import repeat
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from tracehold.llm.words import U64, Words, mix, words
from tracehold.session import stage

# What ends a piece, and what stands between words inside one.
PIECE_ENDS = [ord(c) for c in ".,;:!?"] + [*range(0x0A, 0x0E)]
GAPS = [0x20, 0x09]
NO_LANG = "und"

MIN_COUNT, TOP, ABSORB = 10, 2000, 50
#: Words of a phrase at most, and bits of a word's number in a packed key.
DEPTH, BITS = 3, 21
MASK = (1 << BITS) - 1
#: Entries of a container before it bursts, of a task's trie before it spills, words a task numbers.
BURST, ENTRIES, NUMBERED = 8192, 2_000_000, 400_000
#: Words that are numbered at once; with ``NUMBERED`` they stay below 2 to the power of ``BITS``.
WORDS = 1 << 20
#: Bits of the table of frequent pairs for each of them, and in all.
PAIR_BITS, TABLE_BITS = 16, 1 << 29
#: A segment of that table is made in one task.
SEGMENT_BITS = 1 << 20
RUN_SCHEMA = "lang string, phrase string, words int, n long"

_ENDS = np.zeros(256, bool)
_ENDS[PIECE_ENDS] = True
_SEPARATORS = _ENDS.copy()
_SEPARATORS[GAPS] = True


class Trie:
    """Counts of packed keys; a node covers the keys that share its first words.

    ``low`` has the least key of each child's range in order, ``parts`` the children:
    containers (``dict``) or nodes.
    """

    def __init__(self, depth: int = 0, low: int = 0, burst: int = BURST):
        self.depth, self.burst = depth, burst
        self.low, self.parts, self.entries = [low], [{}], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Count keys, which are in order and different."""
        cut = [*np.searchsorted(keys, self.low).tolist(), len(keys)]
        # From the last child on, since bursting moves the later ones.
        for k in range(len(self.low) - 1, -1, -1):
            a, b = cut[k], cut[k + 1]
            if a == b:
                continue
            part = self.parts[k]
            if isinstance(part, Trie):
                self.entries -= part.entries
                part.add(keys[a:b], counts[a:b])
                self.entries += part.entries
                continue
            before, here = len(part), keys[a:b].tolist()
            # Each key is looked up just before its new count is put there.
            part.update(zip(here, map(add, map(part.get, here, repeat(0)), counts[a:b].tolist())))
            self.entries += len(part) - before
            if len(part) > self.burst:
                self._burst(k)

    def _burst(self, k: int) -> None:
        """Containers from place ``k`` on, until none of its entries is in one too large."""
        waiting = [(self.low.pop(k), self.parts.pop(k))]
        shift = BITS * (DEPTH - 1 - self.depth)
        while waiting:
            low, part = waiting.pop()
            if len(part) <= self.burst:
                place = bisect_right(self.low, low)
                self.low.insert(place, low)
                self.parts.insert(place, part)
                continue
            keys = np.fromiter(part, np.int64, len(part))
            keys.sort()
            firsts = keys >> shift
            if firsts[0] == firsts[-1]:
                node = Trie(self.depth + 1, low, self.burst)
                node.add(keys, np.fromiter(map(part.__getitem__, keys.tolist()), np.int64, len(keys)))
                place = bisect_right(self.low, low)
                self.low.insert(place, low)
                self.parts.insert(place, node)
                continue
            # Two ranges of words, as even as whole words allow.
            middle = firsts[len(firsts) // 2]
            at = int(np.searchsorted(firsts, middle))
            at = at or int(np.searchsorted(firsts, middle, "right"))
            edge = int(firsts[at]) << shift
            waiting.append((low, {x: n for x, n in part.items() if x < edge}))
            waiting.append((edge, {x: n for x, n in part.items() if x >= edge}))

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys in order and their counts."""
        both = [_run(part) for part in self.parts]
        return np.concatenate([k for k, _ in both]), np.concatenate([n for _, n in both])

    def spill(self, keep: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Sorted (keys, counts) of the largest subtrees, which leave, until ``keep`` entries are left."""
        size = [part.entries if isinstance(part, Trie) else len(part) for part in self.parts]
        for k in sorted(range(len(size)), key=size.__getitem__, reverse=True):
            if self.entries <= keep:
                break
            run = _run(self.parts[k])
            self.parts[k] = {}
            self.entries -= size[k]
            if len(run[0]):
                yield run


def _run(part: Trie | dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(part, Trie):
        return part.run()
    keys = np.fromiter(part.keys(), np.int64, len(part))
    order = np.argsort(keys)
    return keys[order], np.fromiter(part.values(), np.int64, len(part))[order]


class Counter:
    """A task's trie and its numbers of words; numbers start at 1, and 0 is no word."""

    def __init__(self, entries: int, numbered: int, burst: int):
        self.trie, self.burst = Trie(burst=burst), burst
        self.limit, self.numbered = entries, min(numbered, MASK)
        self.number: dict[str, dict[bytes, int]] = {}
        self.names: list[tuple[str, bytes]] = [("", b"")]
        self.words = self.langs = pa.array([], pa.string())

    def numbers(self, w: Words, langs: list[str], owner: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The number of each word; a word of another language has another one."""
        _, first, same = np.unique(hashes, return_index=True, return_inverse=True)
        raw, names, found = w.data.tobytes(), self.names, np.zeros(len(first), np.int64)
        code = np.unique(langs, return_inverse=True)[1][owner[first]] if len(first) else found
        for c in np.unique(code).tolist():
            here = np.flatnonzero(code == c)
            lang = langs[owner[first[here[0]]]]
            number = self.number.setdefault(lang, {})
            spelled = [raw[a:b] for a, b in zip(w.start[first[here]].tolist(), w.end[first[here]].tolist())]
            for word in spelled:
                if word not in number:
                    number[word] = len(names)
                    names.append((lang, word))
            found[here] = np.fromiter(map(number.__getitem__, spelled), np.int64, len(spelled))
        return found[same]

    def add(self, keys: np.ndarray) -> None:
        if len(keys):
            self.trie.add(*np.unique(keys, return_counts=True))

    def runs(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        """Runs to hand on: all at the end or when words have run out of numbers."""
        full = last or len(self.names) > self.numbered
        if full or self.trie.entries > self.limit:
            for keys, counts in self.trie.spill(0 if full else self.limit // 2):
                yield from self._named(keys, counts)
        if full:
            self.trie, self.number = Trie(burst=self.burst), {}
            del self.names[1:]
            self.words, self.langs = self.words[:0], self.langs[:0]

    def _spelled(self) -> tuple[pa.Array, pa.Array]:
        """Words and languages by number, with those that came since the last call; the number 0 is null."""
        new = self.names[len(self.words) :]
        if new:
            none = len(self.words) == 0
            spelled = [None] * none + [name.decode() for _, name in new[none:]]
            self.words = pa.concat_arrays([self.words, pa.array(spelled, pa.string())])
            self.langs = pa.concat_arrays([self.langs, pa.array([lang for lang, _ in new], pa.string())])
        return self.words, self.langs

    def _named(self, keys: np.ndarray, counts: np.ndarray, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
        spelled, langs = self._spelled()
        for at in range(0, len(keys), rows):
            part = keys[at : at + rows]
            ids = [part >> (2 * BITS), (part >> BITS) & MASK, part & MASK]
            size = sum((i > 0).astype(np.int32) for i in ids)
            # No word is null here, which a join of words leaves out.
            phrase = pc.binary_join_element_wise(*[spelled.take(pa.array(i)) for i in ids], " ", null_handling="skip")
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(ids[0])), phrase, pa.array(size), pa.array(counts[at : at + rows])], ["lang", "phrase", "words", "n"])


def lang_hash(langs: list[str]) -> np.ndarray:
    """One 64-bit value for each language name."""
    values = [w.hashes() for w in words(pa.array([lang.encode().hex() + "." for lang in langs], pa.string()))]
    return np.concatenate([np.zeros(0, U64), *values])


def pair_hash(hashes: np.ndarray) -> np.ndarray:
    """Of each word and the next, from hashes that have the language mixed in."""
    return mix(hashes[:-1] * U64(0x9E3779B97F4A7C15) + mix(hashes[1:]))


def _word_hashes(w: Words, by_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    owner = w.owner() + w.first
    return owner, mix(w.hashes() + by_text[owner])


def _adjacent(w: Words) -> np.ndarray:
    """Whether each word but the last stands in one piece with the next one."""
    if len(w.start) < 2:
        return np.zeros(0, bool)
    ends = np.append(0, np.cumsum(_ENDS[w.data]))
    same = ends[w.start[1:]] == ends[w.end[:-1]]
    new = np.zeros(len(w.start) + 1, bool)
    new[w.offset] = True  # a text's first word has no word in front of it
    return same & ~new[1:-1]


def _count(pairs, entries: int, numbered: int, burst: int):
    """Words and pairs, or with ``pairs``, the table of frequent pairs, phrases of three words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None if pairs is None else pairs.value
        counter = Counter(entries, numbered, burst)
        for batch in batches:
            names = batch.column("lang").dictionary_encode()
            langs = names.dictionary.to_pylist()
            code = names.indices.to_numpy()
            by_text, lang_of = lang_hash(langs)[code], [langs[c] for c in code.tolist()]
            for w in words(batch.column("text"), _SEPARATORS, lower=True):
                owner, hashes = _word_hashes(w, by_text)
                near = _adjacent(w)
                if table is not None:
                    near[near] = set_bits(table, pair_hash(hashes)[near])
                # A stretch of words has no more different words than there are numbers left.
                for at in range(0, len(hashes), WORDS):
                    inside = slice(at, at + WORDS + DEPTH - 1)
                    part = Words(w.first, w.data, w.text, w.start[inside], w.end[inside], w.offset)
                    follows = near[at : at + WORDS + DEPTH - 2]
                    if table is None:
                        number = counter.numbers(part, lang_of, owner[inside], hashes[inside])
                        counter.add(number[:WORDS] << (2 * BITS))
                        first = np.flatnonzero(follows[:WORDS])
                        counter.add(number[first] << (2 * BITS) | number[first + 1] << BITS)
                    else:
                        three = np.flatnonzero(follows[:-1] & follows[1:])
                        used = np.zeros(len(part.start), bool)
                        for k in range(DEPTH):
                            used[three + k] = True
                        kept = np.flatnonzero(used)
                        number = np.zeros(len(used), np.int64)
                        part = Words(w.first, w.data, w.text, part.start[kept], part.end[kept], w.offset)
                        number[kept] = counter.numbers(part, lang_of, owner[inside][kept], hashes[inside][kept])
                        counter.add(number[three] << (2 * BITS) | number[three + 1] << BITS | number[three + 2])
                    yield from counter.runs()
        yield from counter.runs(last=True)

    return count


def set_bits(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether both bits of each hash are set."""
    n = U64(len(table) * 8)
    out = np.ones(len(hashes), bool)
    for place in (hashes % n, mix(hashes) % n):
        out &= (table[(place >> U64(3)).astype(np.int64)] >> (place & U64(7)).astype(np.uint8)) & 1 == 1
    return out


def _places(bits: int):
    """(segment, place) of both bits of each frequent pair."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_text = lang_hash(batch.column("lang").to_pylist())
            for w in words(batch.column("phrase"), _SEPARATORS):
                hashes = pair_hash(_word_hashes(w, by_text)[1])[_adjacent(w)]
                place = np.concatenate([hashes % U64(bits), mix(hashes) % U64(bits)]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(place // SEGMENT_BITS), pa.array(place % SEGMENT_BITS)], ["segment", "place"])

    return places


def _segment(group: pa.Table) -> pa.Table:
    bits = np.zeros(SEGMENT_BITS, np.uint8)
    bits[group["place"].to_numpy()] = 1
    return pa.table({"segment": group["segment"][:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})


def pair_table(pairs: DataFrame) -> np.ndarray:
    """Two bits for each of ``pairs`` in a table of ``TABLE_BITS`` at most.

    A segment's group has no more different places than the segment has bits.
    """
    wanted = max(1, pairs.count() * PAIR_BITS)
    bits = min(TABLE_BITS, -(-wanted // SEGMENT_BITS) * SEGMENT_BITS)
    placed = pairs.select("lang", "phrase").mapInArrow(_places(bits), "segment long, place long").distinct()
    table = np.zeros((bits // SEGMENT_BITS, SEGMENT_BITS // 8), np.uint8)
    for row in placed.groupBy("segment").applyInArrow(_segment, "segment long, bits binary").toLocalIterator():
        table[row["segment"]] = np.frombuffer(row["bits"], np.uint8)
    return table.reshape(-1)


def _merged(runs: DataFrame) -> DataFrame:
    """Counts of each phrase, added up per range of phrases."""
    return runs.select("lang", "phrase", "n").repartitionByRange("phrase", "lang").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def count_phrases(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    min_count: int = MIN_COUNT,
    entries: int = ENTRIES,
    numbered: int = NUMBERED,
    burst: int = BURST,
) -> tuple[DataFrame, DataFrame]:
    """(``lang``, ``phrase``, ``words``, ``n``) of words and phrases that stand ``min_count`` times or more, and (``lang``, ``total``) words of each language."""
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(text).alias("text"))
    runs = stage(texts.mapInArrow(_count(None, entries, numbered, burst), RUN_SCHEMA), "runs")
    totals = runs.where("words = 1").groupBy("lang").agg(F.sum("n").alias("total"))
    n_words = F.size(F.split("phrase", " ")).alias("words")
    shorter = stage(_merged(runs).where(F.col("n") >= min_count).select("lang", "phrase", n_words, "n"), "pairs")
    table = docs.sparkSession.sparkContext.broadcast(pair_table(shorter.where("words = 2")))
    runs = stage(texts.mapInArrow(_count(table, entries, numbered, burst), RUN_SCHEMA), "runs")
    longer = stage(_merged(runs).where(F.col("n") >= min_count).select("lang", "phrase", n_words, "n"), "triples")
    return shorter.unionByName(longer), totals


def _joined(first: int, last: int) -> Column:
    return F.array_join(F.slice("parts", first, last - first + 1), " ")


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    min_count: int = MIN_COUNT,
    top: int = TOP,
    absorb: int = ABSORB,
    **limits,
) -> DataFrame:
    """The first ``top`` phrases of two or three words of each language.

    One row each: ``lang``, ``rank``, ``phrase``, ``a`` (its count), ``l`` and ``r`` (counts of
    the parts of its weakest cut), ``n`` (the language's words) and ``score``, the whole part
    of 1000000 a a / (l r).  A pair inside a longer phrase that has ``absorb`` per cent of
    its count or more is left out.
    """
    counted, totals = count_phrases(docs, text, lang, min_count, **limits)
    part = counted.select("lang", F.col("phrase").alias("part"), F.col("n").alias("part_n"))
    phrases = counted.where("words >= 2").withColumn("parts", F.split("phrase", " "))
    cuts = phrases.select("lang", "phrase", "words", "n", "parts", F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "words", F.col("n").alias("a"), "k", F.array_join(F.expr("slice(parts, 1, k)"), " ").alias("left"), F.array_join(F.expr("slice(parts, k + 1, words - k)"), " ").alias("right"))
    cuts = cuts.join(part.select("lang", F.col("part").alias("left"), F.col("part_n").alias("l")), ["lang", "left"])
    cuts = cuts.join(part.select("lang", F.col("part").alias("right"), F.col("part_n").alias("r")), ["lang", "right"])
    # 38 digits hold what 64 bits may not.
    wide = {c: F.col(c).cast("decimal(19,0)") for c in "alr"}
    cuts = cuts.withColumn("square", wide["a"] * wide["a"] * F.lit(1_000_000).cast("decimal(7,0)")).withColumn("product", wide["l"] * wide["r"])
    scored = cuts.withColumn("score", F.expr("square div product"))
    best = scored.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inside = phrases.where("words = 3").select("lang", "n", F.explode(F.array(_joined(1, 2), _joined(2, 3))).alias("phrase"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    best = best.join(inside, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < absorb * F.col("a"), F.lit(True)))
    best = best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The first of each share of a language, then of the shares' firsts.
    share = F.pmod(F.xxhash64("phrase"), F.lit(64))
    firsts = best.withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order)))
    firsts = firsts.where(F.col("rank") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return firsts.where(F.col("rank") <= top).join(totals.withColumnRenamed("total", "n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
