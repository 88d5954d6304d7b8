"""Quality of documents: random-indexing word vectors, pooled, under a two-layer network.

1. Every word has a sparse random vector made from its hash.  A word's context vector
   is the sum of the random vectors two words to either side, over all documents;
   words share ``BUCKETS`` context vectors by hash.  Each task sums its own part of the
   table, which has a fixed size; Spark adds the parts by bucket.
2. A document's features are the means of its words' random vectors and of their centred
   context vectors, with both lengths, and the mean products of random vectors one and
   two words apart.
3. A two-layer network is trained in numpy on at most ``SAMPLE`` labelled documents, those
   with the smallest hashes of their ids; a part of them sets the temperature that
   calibrates the probabilities.  Everything else covers all documents.

Words are runs of letters and digits or runs of marks, as they are written.

Cases: null and empty texts have zero features and are scored like any other; repeated
rows get equal scores; labels that are null or not 0 or 1 teach nothing, of several for one
id the smallest does; without labels of both kinds the score is the share of label 1, and 1
without any; rows with a null id are never learnt from and not held out; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tracehold.llm.words import U64, Words, slices

BUCKETS, DIMENSIONS, REACH = 1 << 14, 64, 2
#: Labelled documents that the network is trained on.
SAMPLE = 20_000
HIDDEN, STEPS, BATCH, RATE, DECAY, SEED = 32, 5000, 128, 3e-3, 1e-3, 7

_CLASS = np.ones(256, np.uint8)  # letters, digits, bytes of other characters
_CLASS[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 2
_CLASS[[*range(0x00, 0x21), 0x7F]] = 0


def runs(texts: pa.Array) -> Iterator[Words]:
    """Words: runs of bytes of one class, without white space and control characters."""
    for first, data, text in slices(texts):
        kind = _CLASS[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[1:-1] = kind[1:] != kind[:-1]
        edge[text] = True
        cut = np.flatnonzero(edge)
        keep = kind[cut[:-1]] > 0 if len(cut) > 1 else np.zeros(0, bool)
        start, end = cut[:-1][keep], cut[1:][keep]
        yield Words(first, data, text, start, end, np.searchsorted(start, text, "left"))


def random_vectors(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, two dimensions and their signs of each word."""
    bucket = (hashes & U64(BUCKETS - 1)).astype(np.int64)
    places = np.stack([(hashes >> U64(s)) & U64(DIMENSIONS - 1) for s in (20, 30)]).astype(np.int64)
    signs = np.stack([(hashes >> U64(s)) & U64(1) for s in (40, 41)]).astype(np.float64) * 2 - 1
    return bucket, places, signs


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, count = np.zeros(BUCKETS * DIMENSIONS), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for w in runs(batch.column(0)):
            bucket, places, signs = random_vectors(w.hashes())
            owner, at, weight = w.owner(), [], []
            for step in range(1, REACH + 1):
                same = np.flatnonzero(owner[step:] == owner[:-step])
                for me, other in ((same, same + step), (same + step, same)):
                    for place, sign in zip(places, signs):
                        at.append(bucket[me] * DIMENSIONS + place[other])
                        weight.append(sign[other])
            if len(bucket):
                table += np.bincount(np.concatenate(at), np.concatenate(weight), minlength=len(table))
                count += np.bincount(bucket, minlength=BUCKETS)
    used = np.flatnonzero(count)
    rows = table.reshape(BUCKETS, DIMENSIONS)[used].astype(np.float32)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), pa.array([r.tobytes() for r in rows], pa.binary())], ["bucket", "n", "vector"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of the table added within a partition that has all parts of its buckets."""
    total: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        for bucket, n, raw in zip(*[c.to_pylist() for c in batch.columns]):
            n0, v0 = total.get(bucket, (0, 0.0))
            total[bucket] = (n0 + n, v0 + np.frombuffer(raw, np.float32).astype(np.float64))
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int64()), pa.array([n for n, _ in total.values()], pa.int64()), pa.array([v.astype(np.float32).tobytes() for _, v in total.values()], pa.binary())],
        ["bucket", "n", "vector"],
    )


def word_vectors(texts: DataFrame) -> np.ndarray:
    """The table of context vectors over all texts: means, centred, of length 1; a fixed size."""
    schema = "bucket long, n long, vector binary"
    parts = texts.mapInArrow(_contexts, schema).repartition("bucket").mapInArrow(_added, schema)
    table, count = np.zeros((BUCKETS, DIMENSIONS)), np.zeros(BUCKETS)
    for r in parts.collect():  # at most BUCKETS rows
        table[r.bucket], count[r.bucket] = np.frombuffer(r.vector, np.float32), r.n
    mean = table / np.maximum(count, 1)[:, None]
    mean -= table.sum(0) / max(1.0, count.sum())
    mean[count == 0] = 0
    return (mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def features(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """A row per text: pooled random vectors, pooled context vectors, their lengths, products of near words."""
    out = np.zeros((len(texts), 2 * DIMENSIONS + 2 + REACH), np.float32)
    for w in runs(texts):
        n, size = w.n, w.lengths()
        bucket, places, signs = random_vectors(w.hashes())
        owner = w.owner()
        index = np.bincount(
            np.concatenate([owner * DIMENSIONS + p for p in places]), np.concatenate(list(signs)), minlength=n * DIMENSIONS
        ).reshape(n, DIMENSIONS)
        context = np.zeros((n, DIMENSIONS), np.float32)
        filled = np.flatnonzero(size)
        if len(filled):
            context[filled] = np.add.reduceat(vectors[bucket], w.offset[:-1][filled], axis=0)
        per = np.maximum(size, 1)[:, None]
        mine = out[w.first : w.first + n]
        mine[:, :DIMENSIONS], mine[:, DIMENSIONS : 2 * DIMENSIONS] = index / per, context / per
        mine[:, 2 * DIMENSIONS] = np.linalg.norm(mine[:, :DIMENSIONS], axis=1)
        mine[:, 2 * DIMENSIONS + 1] = np.linalg.norm(mine[:, DIMENSIONS : 2 * DIMENSIONS], axis=1)
        for step in range(1, REACH + 1):
            here, there = slice(None, -step), slice(step, None)
            products = sum((p[here] == q[there]) * (s[here] * t[there]) for p, s in zip(places, signs) for q, t in zip(places, signs))
            products = np.where(owner[here] == owner[there], products, 0)
            mine[:, 2 * DIMENSIONS + 1 + step] = np.bincount(owner[here], products, minlength=n) / per[:, 0]
    return out


class Network:
    """One hidden layer of rectified units, one output, a temperature."""

    def __init__(self, constant: float):
        self.constant, self.weights = constant, None

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return (np.maximum((x - self.mean) / self.scale @ a + b, 0) @ c + d)[:, 0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x.astype(np.float64)) / self.temperature, -500, 500)))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Network:
        draw = np.random.default_rng(SEED)
        order = draw.permutation(len(y))
        hold, learn = order[: len(y) // 6], order[len(y) // 6 :]
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = (x - self.mean) / self.scale
        shapes = [(x.shape[1], HIDDEN), (HIDDEN,), (HIDDEN, 1), (1,)]
        self.weights = [draw.normal(0, np.sqrt(2 / s[0]), s) if len(s) == 2 else np.zeros(s) for s in shapes]
        first, second = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
        for t in range(1, STEPS + 1):
            at = draw.choice(learn, BATCH)
            a, b, c, d = self.weights
            hidden = np.maximum(z[at] @ a + b, 0)
            error = (1 / (1 + np.exp(-np.clip(hidden @ c + d, -500, 500))) - y[at, None]) / BATCH
            back = error @ c.T * (hidden > 0)
            slopes = [z[at].T @ back + DECAY * a, back.sum(0), hidden.T @ error + DECAY * c, error.sum(0)]
            for k, g in enumerate(slopes):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                self.weights[k] = self.weights[k] - RATE * first[k] / (1 - 0.9**t) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
        logit, truth = self.logits(x[hold]), y[hold]
        loss = lambda s: np.mean(np.logaddexp(0, logit / s) - truth * logit / s) if len(hold) else 0.0
        self.temperature = min(np.geomspace(0.25, 8, 41).tolist(), key=loss)
        return self


def _held_out(doc_id: str):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, doc_id: str, text: str, label: str, sample: int) -> Network:
    """The network of at most ``sample`` labelled documents that are not held out."""
    spark = docs.sparkSession
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & ~_held_out(doc_id))
    known = known.groupBy(F.col(doc_id).alias("__doc")).agg(F.min(label).cast("int").alias("__label"))
    chosen = known.orderBy(F.xxhash64("__doc"), "__doc").limit(sample)
    table = spark.sparkContext.broadcast(vectors)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = features(batch.column("t"), table.value)
            yield pa.RecordBatch.from_arrays([batch.column("__doc"), batch.column("__label"), pa.array([r.tobytes() for r in rows], pa.binary())], ["d", "y", "x"])

    # At most ``sample`` rows of an id and a label are broadcast, and as many of features come back.
    measured = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("t")).join(F.broadcast(chosen), F.col("__id") == F.col("__doc"))
    kind = dict(docs.dtypes)[doc_id]
    rows = measured.select("__doc", "__label", "t").mapInArrow(measure, f"d {kind}, y int, x binary").dropDuplicates(["d"]).orderBy("d").collect()
    if len({r.y for r in rows}) < 2:
        return Network(sum(r.y for r in rows) / len(rows) if rows else 1.0)
    x = np.stack([np.frombuffer(r.x, np.float32) for r in rows]).astype(np.float64)
    return Network(0.0).fit(x, np.array([r.y for r in rows], np.float64))


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    keep: Sequence[str] = ("doc_id",),
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    sample: int = SAMPLE,
) -> DataFrame:
    """The ``keep`` columns of every row with ``held_out``, ``score`` and ``predicted``.

    Learns only from labels whose crc32(id as text) mod 3 is not 1; the others are held out.
    """
    vectors = word_vectors(docs.select(text))
    network = train(docs, labels, vectors, doc_id, text, label, sample)
    both = docs.sparkSession.sparkContext.broadcast((vectors, network))
    names = [f"__k{i}" for i in range(len(keep))]
    work = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col(text).alias("__text"), _held_out(doc_id).alias("held_out"))
    schema = T.StructType([f for f in work.schema.fields if f.name != "__text"]).add("score", T.DoubleType()).add("predicted", T.IntegerType())
    arrow = to_arrow_schema(schema)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = both.value
        for batch in batches:
            p = network.probability(features(batch.column("__text"), vectors))
            columns = [batch.column(c).cast(arrow.field(c).type) for c in arrow.names[:-2]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], schema=arrow)

    scored = work.mapInArrow(score, schema)
    return scored.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], "held_out", "score", "predicted")
