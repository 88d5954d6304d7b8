"""Personal data: four patterns, and the terms that give a protected value away.

The patterns find addresses and numbers.  Of the words of the documents with a find the
corpus tells how much they reveal: a term discloses a value ``e`` by

    PMI(t, e) / IC(e) = log(N n(t, e) / (n(t) n(e))) / log(N / n(e))

with n counting documents, all of them.  It is 1 for a term that never stands
without the value.  Terms at ``DISCLOSURE`` or more, seen with the value in at least
``CONTEXTS`` documents of different words or, within ``AROUND`` words of it, different
surroundings (so not only in copies), are spans of kind ``term`` wherever they stand in
documents of that value; sanitizing generalises them like the values.  Documents that
differ in one word are different, so near copies should go first, as in the pipeline.

Cases: null and empty texts have no spans; rows sharing an id each have their own;
repeated rows count like any documents, though copies are one surrounding; an empty
table gives no rows; a corpus of one document reveals nothing by counts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracehold.llm.words import NOT_ALNUM, U64, words
from tracehold.session import stage

# The kinds in order, and their patterns.  A match of an address pattern
# can only begin where a run of its first characters begins, which keeps them linear.
KINDS = ("email", "ip", "card", "phone", "term")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWERED = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
LOCAL_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Words of context on each side; least surroundings; least share of a value's information.
AROUND, CONTEXTS, DISCLOSURE = 5, 3, 0.9
#: Candidate terms that are broadcast; more of them are joined instead.
BROADCAST_TERMS = 2_000_000


def luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    last = 0
    for m in DOMAIN.finditer(text):
        begin = m.start()
        while begin > last and text[begin - 1] in LOCAL_CHARACTERS:
            begin -= 1
        if begin < m.start():
            last = m.end()
            yield begin, last


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' finds in code points, in order; kinds as numbers of ``KINDS``."""
    found = []
    if "@" in text:
        found += [(a, 0, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part) <= 255 for part in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def spelled(spans: Sequence[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def value(text: str, span: tuple[int, int, int]) -> str:
    """The protected value itself: letters lowered, numbers without their punctuation."""
    a, kind, b = span
    return f"{kind}:" + (text[a:b].lower() if kind < 2 else re.sub("[^0-9]", "", text[a:b]))


def outside(start: np.ndarray, end: np.ndarray, taken: list[tuple[int, int]]) -> np.ndarray:
    """Which words overlap none of the spans, which are in order."""
    if not taken:
        return np.ones(len(start), bool)
    begins, ends = np.array(taken, np.int64).T
    before = np.searchsorted(begins, end, "left")
    return np.append(0, np.maximum.accumulate(ends))[before] <= start


def surroundings(text: str, spans: list[tuple[int, int, int]], around: int) -> list[tuple[str, str, str, int, int]]:
    """(value, term, digest of the surrounding, start, end) of the nearest words outside of all spans."""
    out = []
    free = [(m.start(), m.end()) for m in TERM.finditer(text.translate(LOWERED))]
    taken = [(a, b) for a, _, b in spans]
    at = np.array(free, np.int64).reshape(-1, 2)
    free = [free[k] for k in np.flatnonzero(outside(at[:, 0], at[:, 1], taken)).tolist()]
    starts = np.array([a for a, _ in free])
    for span in spans:
        i, j = np.searchsorted(starts, [span[0], span[2]]).tolist()
        near = [*free[max(0, i - around) : i], *free[j : j + around]]
        own = [text[a:b].translate(LOWERED) for a, b in near]
        digest = hashlib.blake2b("\0".join(own).encode(), digest_size=8).hexdigest()
        out += [(value(text, span), t, digest, a, b) for t, (a, b) in zip(own, near)]
    return out


def _find(around: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = pa.list_(pa.struct([("value", pa.string()), ("term", pa.string()), ("surrounding", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            spans, around_them, values, prints, held = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                found = base_spans(text) if text else []
                spans.append(found)
                around_them.append([dict(zip(("value", "term", "surrounding", "start", "end"), x)) for x in surroundings(text, found, around)] if found else [])
                values.append(sorted({value(text, x) for x in found}))
                prints.append(_words_print(text, found) if found else None)
                held.append(text if found else None)
            counts = [pa.array([sum(k == kind for _, k, _ in s) for s in spans], pa.int64()) for kind in range(4)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("print"), *counts, pa.array(map(spelled, spans), pa.string()), pa.array(around_them, near), pa.array(values, pa.list_(pa.string())), pa.array(prints, pa.binary()), pa.array(held, pa.string())],
                ["doc_id", "print", "n_email", "n_ip", "n_card", "n_phone", "base", "near", "values", "words", "text"],
            )

    return find


_FOUND = "doc_id long, print long, n_email long, n_ip long, n_card long, n_phone long, base string, near array<struct<value:string,term:string,surrounding:string,start:int,end:int>>, values array<string>, words binary, text string"


def _words_print(text: str, spans: list[tuple[int, int, int]]) -> bytes:
    """Digest of a document's words outside of its finds."""
    lowered = text.translate(LOWERED)
    at = np.array([(m.start(), m.end()) for m in TERM.finditer(lowered)], np.int64).reshape(-1, 2)
    at = at[outside(at[:, 0], at[:, 1], [(a, b) for a, _, b in spans])]
    return hashlib.blake2b("\0".join(lowered[a:b] for a, b in at.tolist()).encode(), digest_size=16).digest()


def free_words(texts: pa.Array, bases: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, hashes, starts, ends in code points) of each text's words outside of the finds in ``bases``."""
    for w in words(texts, NOT_ALNUM, lower=True):
        hashes, bound = w.hashes(), w.offset.tolist()
        for i in range(w.n):
            low, high = w.text[i], w.text[i + 1]
            # Code points before each byte.
            points = np.append(0, np.cumsum((w.data[low:high] & 0xC0) != 0x80))
            own = slice(bound[i], bound[i + 1])
            start, end = points[w.start[own] - low], points[w.end[own] - low]
            taken = [tuple(map(int, x.split(":")[1:])) for x in bases[w.first + i].split(",") if x]
            free = outside(start, end, taken)
            yield w.first + i, hashes[own][free], start[free], end[free]


#: Pairs of a value and a term that a task holds at once.
PAIRS = 1 << 20


def _free_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, n): documents of the batch that have the term."""
    for batch in batches:
        each = [np.unique(h) for _, h, _, _ in free_words(batch.column("text"), batch.column("base").to_pylist())]
        found, n = np.unique(np.concatenate([np.zeros(0, U64), *each]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["hash", "n"])


def _value_terms(known):
    """(v, hash, new) of each value and term of a document; ``known`` has the terms' counts, if few enough, to leave out what the bound excludes."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None if known is None else known.value
        out, size = [], 0

        def flush():
            v, h, f = (np.concatenate(x) for x in zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(v), pa.array(h.view(np.int64)), pa.array(f)], ["v", "hash", "new"])

        for batch in batches:
            held = batch.column("held").to_pylist()
            for i, hashes, _, _ in free_words(batch.column("text"), batch.column("base").to_pylist()):
                hashes, n = np.unique(hashes), None
                if table is not None:
                    at = np.searchsorted(table[0], hashes).clip(0, max(0, len(table[0]) - 1))
                    keep = table[0][at] == hashes if len(table[0]) else np.zeros(len(hashes), bool)
                    hashes, n = hashes[keep], table[1][at[keep]] if len(table[0]) else None
                for x in held[i]:
                    own = hashes if n is None else hashes[n <= x["bound"]]
                    out.append((np.full(len(own), x["v"], np.int64), own, np.full(len(own), x["new"], np.int64)))
                    size += len(own)
                    if size >= PAIRS or len(out) >= PAIRS >> 4:
                        yield flush()
                        out, size = [], 0
        if out:
            yield flush()

    return pairs


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, terms): where the terms of ``hashes`` stand."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        wanted, terms = batch.column("hashes").to_pylist(), []
        for i, hashes, start, end in free_words(batch.column("text"), batch.column("base").to_pylist()):
            keep = np.isin(hashes.view(np.int64), np.array(wanted[i], np.int64))
            terms.append([{"start": a, "end": b} for a, b in zip(start[keep].tolist(), end[keep].tolist())])
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(terms, kind)], ["row", "terms"])


def _near_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = [w.hashes() for w in words(batch.column("term"), NOT_ALNUM)]
        yield pa.RecordBatch.from_arrays([batch.column("value"), pa.array(np.concatenate([np.zeros(0, U64), *hashes]).view(np.int64))], ["value", "hash"])


def _document_counts(terms):
    """(hash, documents that have the term): of the broadcast terms, one row a task and term, or of all."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if terms is None else terms.value
        total = None if wanted is None else np.zeros(len(wanted), np.int64)
        for batch in batches:
            for w in words(batch.column(0), NOT_ALNUM, lower=True):
                hashes, owner = w.hashes(), w.owner()
                if wanted is not None:
                    at = np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)
                    keep = wanted[at] == hashes
                    # Places of the terms, each of a document once.
                    once = np.unique(owner[keep].astype(np.int64) * len(wanted) + at[keep])
                    found, n = np.unique(once % len(wanted), return_counts=True)
                    total[found] += n
                    continue
                order = np.lexsort((owner, hashes))
                hashes, owner = hashes[order], owner[order]
                new = np.ones(len(hashes), bool)
                new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
                found, n = np.unique(hashes[new], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["hash", "n"])
        if total is not None:
            found = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(wanted[found].view(np.int64)), pa.array(total[found])], ["hash", "n"])

    return counts


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("print"))


def revealing_terms(texts: DataFrame, found: DataFrame, contexts: int, disclosure: float) -> DataFrame:
    """(value, hash, disclosure) of the terms that reveal a value, by counts over all documents."""
    spark = texts.sparkSession
    total = float(found.count())
    held = found.select("row", "words", F.explode("values").alias("value"))
    groups = held.groupBy("value", "words").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    values = groups.groupBy("value").agg(F.sum("n").alias("n_value"), F.count("*").alias("different"))
    # Terms near a value in enough surroundings, in however few documents.
    near = found.select(F.inline("near")).groupBy("value", "term").agg(F.countDistinct("surrounding").alias("contexts"))
    near = near.where(F.col("contexts") >= contexts).select("value", "term").mapInArrow(_near_hash, "value string, hash long")
    near = stage(near, "near")
    # n_term <= n_both (N / n_value) ** (1 - disclosure), and n_both <= n_value.
    bound = F.col("n_value") * F.pow(total / F.col("n_value"), F.lit(1 - disclosure)) * (1 + 1e-9)
    values = values.where(F.col("n_value") < total).join(near.select("value").distinct().withColumn("near", F.lit(True)), "value", "left")
    values = values.where((F.col("different") >= contexts) | F.col("near"))
    values = stage(values.select(F.monotonically_increasing_id().alias("v"), "value", "n_value", bound.alias("bound")), "values")
    asked = held.join(values, "value").join(groups.select("value", "words", "first"), ["value", "words"])
    new = (F.col("row") == F.col("first")).cast("long").alias("new")
    asked = asked.groupBy("row").agg(F.collect_list(F.struct("v", "bound", new)).alias("held"))
    docs = stage(found.select("row", "base", "text").join(asked, "row"), "holders")
    # A term stands in all documents at least as often as in those with a value, so that a
    # count above every bound rules it out, and above a value's bound for that value.
    most = values.agg(F.max("bound")).first()[0] or 0.0
    hashed = docs.select("base", "text").mapInArrow(_free_terms, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    hashed = hashed.where(F.col("n") <= most).join(near.select("hash").distinct().withColumn("near", F.lit(True)), "hash", "left")
    hashed = stage(hashed.where((F.col("n") >= contexts) | F.col("near")).select("hash", "n"), "terms")
    known = None
    if hashed.count() <= BROADCAST_TERMS:
        rows = hashed.toArrow()
        hashes = rows["hash"].to_numpy().view(U64)
        order = np.argsort(hashes)
        known = spark.sparkContext.broadcast((hashes[order], rows["n"].to_numpy()[order]))
    pairs = docs.mapInArrow(_value_terms(known), "v long, hash long, new long").groupBy("v", "hash").agg(F.count("*").alias("n_both"), F.sum("new").alias("different"))
    pairs = pairs.join(values, "v").join(near.withColumn("near", F.lit(True)), ["value", "hash"], "left")
    pairs = pairs.where((F.col("different") >= contexts) | F.col("near"))
    if known is None:
        pairs = pairs.join(hashed, "hash").where("n <= bound").drop("n")
    pairs = stage(pairs, "candidates")
    asked = pairs.select("hash").distinct()
    wanted = None
    if asked.count() <= BROADCAST_TERMS:
        wanted = spark.sparkContext.broadcast(np.sort(np.append(asked.toArrow()["hash"].to_numpy().view(U64), U64(0))))
    counts = texts.select("text").mapInArrow(_document_counts(wanted), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n_term"))
    scored = pairs.join(counts, "hash")
    information = F.log(total / F.col("n_value"))
    shared = F.log(total * F.col("n_both") / (F.col("n_term") * F.col("n_value")))
    scored = scored.withColumn("disclosure", shared / information)
    return scored.where(F.col("disclosure") >= disclosure).select("value", "hash", "disclosure")


def find_personal_data(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    around: int = AROUND,
    contexts: int = CONTEXTS,
    disclosure: float = DISCLOSURE,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, counts of the four kinds, ``base`` and ``spans`` (kind:start:end lists), ``terms`` and ``print``.

    Positions are code points, ends exclusive; ``print`` is the text's ``xxhash64``.
    """
    texts = _texts(docs, doc_id, text)
    found = stage(texts.mapInArrow(_find(around), _FOUND).withColumn("row", F.monotonically_increasing_id()), "personal")
    terms = stage(revealing_terms(texts, found, contexts, disclosure), "revealing")
    wanted = found.select("row", F.explode("values").alias("value")).join(terms, "value").groupBy("row").agg(F.collect_set("hash").alias("hashes"))
    marked = found.select("row", "base", "text").join(wanted, "row").mapInArrow(_mark, "row long, terms array<struct<start:int,end:int>>")
    out = found.drop("near", "values", "words", "text").join(marked.where(F.size("terms") > 0), "row", "left")
    listed = F.transform("terms", lambda t: F.concat_ws(":", F.lit("term"), t["start"], t["end"]))
    both = F.filter(F.concat(F.split("base", ","), F.coalesce(listed, F.array().cast("array<string>"))), lambda s: s != "")
    # Terms never begin where a find of the patterns does, so the start alone orders them.
    ordered = F.array_sort(
        both, lambda a, b: F.split(a, ":")[1].cast("int") * 8 + _rank(a) - F.split(b, ":")[1].cast("int") * 8 - _rank(b)
    )
    return out.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", F.when(F.col("terms").isNull(), F.col("base")).otherwise(F.array_join(ordered, ",")).alias("spans"), "terms", "print"
    )


def _rank(span):
    return F.array_position(F.lit(list(KINDS)), F.split(span, ":")[0]).cast("int")


def replace_spans(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each span, or run of overlapping spans, as its first kind in brackets."""
    out, at = [], 0
    for a, kind, b in sorted(spans):
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _replace(schema_names: list[str], text: str):
    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for t, terms in zip(batch.column(text).to_pylist(), batch.column("__terms").to_pylist()):
                spans = base_spans(t) + [(x["start"], 4, x["end"]) for x in terms or ()] if t else []
                texts.append(replace_spans(t, spans) if spans else t)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text else batch.column(c) for c in schema_names], schema_names)

    return replace


def sanitize_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """``docs`` with every found value and revealing term replaced by its kind."""
    found = find_personal_data(docs, doc_id, text, **settings).where("terms is not null")
    found = found.select(F.col("doc_id").alias("__doc"), F.col("print").alias("__print"), F.col("terms").alias("__terms")).dropDuplicates(["__doc", "__print"])
    same = docs[doc_id].cast("long").eqNullSafe(F.col("__doc")) & (F.xxhash64(docs[text]) == F.col("__print"))
    joined = docs.join(found, same, "left").drop("__doc", "__print")
    return joined.mapInArrow(_replace(docs.columns, text), docs.schema)
