"""Density clustering (DBSCAN) over numeric fields, categories and sparse TF-IDF vectors.

A text is kept as the counts of its terms, packed into some fifty bytes; its vector of
length one is made from them in the tasks.

Points are sorted by categories and numeric fields and cut into slices.  Two slices
meet only if categories and the first number allow a near pair.  A task compares them tile
by tile in single precision, and anew in double precision where rounding could
decide; it leaves out pairs of tiles whose categories or bounding boxes allow no near
pair.  A pair of points meets once.

Tasks give neighbour counts per point, and the few neighbours of points that are no core
points by what the task saw; outliers follow from these.  Clusters need a second pass, which
gives one forest of the core points a task saw, never the pairs themselves: slices first, then
what joins two slices.  Core points known to be connected are not compared again.  The
comparisons still grow with the square of the points that are alike in categories and numbers.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracehold.operators.graph import components
from tracehold.operators.ordered import numbered, with_position
from tracehold.operators.skew import join_unique
from tracehold.operators.word_counts import TermCounts, letter_runs
from tracehold.session import stage

SLICE = 32_768  # points that are compared as a block with those of another slice, at most
SLICES = 32  # slices a smaller table is cut into
TILE = 512  # points that are compared at once
RARE = 4  # points whose last terms differ less may share a tile
TASK_PAIRS = 20_000_000  # pairs of points from which on a block has a task of its own
HEAVY = 1_000  # rows of a merged point from which on they are spread over tasks
PAIR_BITS = 31
_COUNTS = "spot long, close long, beside array<long>"
_LINKS = "core long, other long, joins boolean"


def packed(counts: np.ndarray) -> list[bytes]:
    """Each row of counts as bytes: the width of a count, one bit a place, the counts above 0."""
    bits, most = np.packbits(counts > 0, axis=1), counts.max(axis=1, initial=0)
    widths = np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 8)).tolist()
    return [bytes([w]) + b.tobytes() + row[row > 0].astype(f"<u{w}").tobytes() for w, b, row in zip(widths, bits, counts)]


def unpacked(rows: pa.BinaryArray, places: int) -> np.ndarray:
    """The counts of :func:`packed` rows."""
    counts = np.zeros((len(rows), places))
    if not counts.size:
        return counts
    start = np.frombuffer(rows.buffers()[1], np.int32)[rows.offset : rows.offset + len(rows) + 1].astype(np.int64)
    data, size = np.frombuffer(rows.buffers()[2], np.uint8), -(-places // 8)
    held = np.unpackbits(data[start[:-1, None] + 1 + np.arange(size)], axis=1, count=places).astype(bool)
    for width in (1, 2, 8):
        mine = np.flatnonzero(data[start[:-1]] == width)
        length = held[mine].sum(axis=1) * width
        first = np.repeat(start[mine] + 1 + size - (np.cumsum(length) - length), length)
        some = np.zeros((len(mine), places))
        some[held[mine]] = data[first + np.arange(length.sum())].view(f"<u{width}")
        counts[mine] = some
    return counts


def counted_terms(rows: DataFrame, terms: list[str]) -> DataFrame:
    """``rows`` with the packed counts of the terms in ``_text`` as ``text`` in its stead."""
    kept, runs = rows.drop("_text"), letter_runs(rows.sparkSession)
    names = kept.columns

    def count(batches):
        counts = TermCounts(runs, terms)
        for batch in batches:
            text = pa.array(packed(counts(batch.column("_text"))), pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(name) for name in names], text], [*names, "text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return rows.mapInArrow(count, f"{schema}, text binary")


def forest_of(near: np.ndarray) -> np.ndarray:
    """Per point the first point of its connected part."""
    part = np.full(len(near), -1)
    for start in range(len(near)):
        if part[start] >= 0:
            continue
        part[start], edge = start, np.array([start])
        while len(edge):
            edge = np.flatnonzero(near[edge].any(axis=0) & (part < 0))
            part[edge] = start
    return part


def blocks_of(batches):
    """The tables of a partition that is sorted by ``pair``, one for each; what one batch leaves open is carried to the next."""
    held, key = [], None
    for batch in batches:
        pair = batch.column("pair").to_numpy()
        edges = [0, *(np.flatnonzero(pair[1:] != pair[:-1]) + 1).tolist(), len(pair)]
        for a, b in zip(edges[:-1], edges[1:]):
            if a == b:
                continue
            if held and pair[a] != key:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            key = pair[a]
    if held:
        yield pa.Table.from_batches(held)


def _flat(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays([chunk.flatten() for chunk in column.chunks])


def places_of(mask: np.ndarray) -> np.ndarray:
    """Flat places of the few that hold."""
    flat = mask.ravel()
    if len(flat) % 8:
        return np.flatnonzero(flat)
    eights = np.flatnonzero(flat.view(np.uint64))
    at = (eights[:, None] * 8 + np.arange(8)).ravel()
    return at[flat[at]]


def _codes(values: pa.Array) -> np.ndarray:
    return values.dictionary_encode().indices.to_numpy()


class Block:
    """The points of one slice, or of two, in the order of their places, and the tiles to compare.

    ``scale`` are the weights of the terms where texts are packed counts; ``minimum`` is the number of
    rows within ``eps`` that makes a core point.
    """

    def __init__(self, table: pa.Table, eps: float, size: int, scale: list[float] | None = None, minimum: int = 0):
        n, self.eps, self.minimum = table.num_rows, eps, minimum
        self.spot, self.w = table["spot"].to_numpy(), table["w"].to_numpy()
        texts = self._vectors(table["text"], n, scale)
        held = texts > 0
        # Terms that most texts hold come first, so that a product ends at the last one that both sides hold.
        terms = np.argsort(-held.sum(axis=0), kind="stable")
        # Rows stay together in memory: they are looked up by the thousand.
        self.texts, held = texts.take(terms, axis=1), held.take(terms, axis=1)
        del texts
        self.own = held.any(axis=1).astype(float)
        self.last = np.where(self.own > 0, len(terms) - held[:, ::-1].argmax(axis=1) if len(terms) else 0, 0)
        self.xs = _flat(table["xs"]).to_numpy(zero_copy_only=False).reshape(n, -1)
        xs = self.xs - self.xs.mean(axis=0)
        # A place more each for the factor 1 and the square, so that one product gives distances.
        self.square = np.einsum("ij,ij->i", self.texts, self.texts) + np.einsum("ij,ij->i", xs, xs)
        self.points = np.empty((n, self.xs.shape[1] + 2 + len(terms)), np.float32)
        for place, values in enumerate((*xs.T, 1, self.square, *self.texts.T)):
            self.points[:, place] = values
        self.kinds = _codes(table["kind"].combine_chunks())
        cats, self.cats = _flat(table["cats"]), []
        # Equal kinds have equal categories where a different one is too far anyway.
        places = len(cats) // n if eps >= 1 else 0
        for k in range(places):
            level = cats.take(pa.array(np.arange(n) * places + k))
            self.cats.append((_codes(level), np.array([v == "" for v in level.to_pylist()])))
        pair = table["pair"][0].as_py()
        second = pair & ((1 << PAIR_BITS) - 1)
        split = 0 if pair >> PAIR_BITS == second else int(np.searchsorted(self.spot, second * size))
        self.tiles = [*self._tiled(0, split), *self._tiled(split, n)]
        self.pairs = self._pairs(-(-split // TILE))

    def _tiled(self, a: int, b: int) -> list[np.ndarray]:
        """The points from ``a`` to ``b`` in tiles; those that hold rare terms are by themselves."""
        order = a + np.lexsort((self.last[a:b] // RARE, self.kinds[a:b]))
        return [order[k : k + TILE] for k in range(0, b - a, TILE)]

    @staticmethod
    def _vectors(column: pa.ChunkedArray, n: int, scale: list[float] | None) -> np.ndarray:
        if scale is None:
            return _flat(column).to_numpy(zero_copy_only=False).reshape(n, -1)
        texts = unpacked(pa.concat_arrays(column.cast(pa.binary()).chunks), len(scale))
        texts *= np.array(scale)
        length = np.sqrt(np.einsum("ij,ij->i", texts, texts))[:, None]
        texts /= np.where(length > 0, length, 1)
        return texts

    def _pairs(self, split: int) -> list[tuple[int, int]]:
        """Pairs of tiles that may hold a near pair, those of a tile with itself first."""
        order, starts = np.concatenate(self.tiles), np.cumsum([0, *map(len, self.tiles[:-1])])
        low, high = (f.reduceat(self.kinds[order], starts) for f in (np.minimum, np.maximum))
        meet = (low[:, None] <= high[None, :]) & (low[None, :] <= high[:, None])
        apart = np.zeros(meet.shape)
        for values in (*self.texts.T, *self.xs.T):
            low, high = (f.reduceat(values[order], starts) for f in (np.minimum, np.maximum))
            apart += np.maximum(np.maximum(low[:, None] - high[None, :], low[None, :] - high[:, None]), 0.0) ** 2
        # A trifle more than needed: rounding must not lose a pair.
        meet &= apart <= self.eps**2 + 1e-9
        first = np.arange(len(starts)) < split
        meet &= (first[:, None] & ~first[None, :]) if split else np.triu(np.ones(meet.shape, bool))
        return sorted(zip(*(k.tolist() for k in np.nonzero(meet))), key=lambda p: (p[0] != p[1], p))

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which points of ``a`` are within ``eps`` of which of ``b``."""
        if self.cats:
            return self._near_of_all_kinds(a, b)
        numbers, limit = self.xs.shape[1], self.eps * self.eps
        places = numbers + 2 + int(min(self.last[a].max(), self.last[b].max()))
        left, right = (self.points.take(k, axis=0)[:, :places] for k in (a, b))
        left *= -2
        left[:, numbers], left[:, numbers + 1] = self.square[a], 1
        apart = left @ right.T
        # How far off single precision may be, twice over.
        slack = (places + 4) * 2.0**-22 * float(self.square[a].max() + self.square[b].max())
        near, sure = apart <= limit + slack, apart < limit - slack
        if np.count_nonzero(sure) < np.count_nonzero(near):
            self._judge(near, a, b, places_of(near ^ sure))
        kinds = self.kinds[a], self.kinds[b]
        if min(k.min() for k in kinds) != max(k.max() for k in kinds):
            near &= kinds[0][:, None] == kinds[1]
        return near

    def _judge(self, near: np.ndarray, a: np.ndarray, b: np.ndarray, at: np.ndarray) -> None:
        """Decide the pairs at the flat places ``at`` in double precision."""
        for start in range(0, len(at), 8192):
            some = at[start : start + 8192]
            p, q = a[some // near.shape[1]], b[some % near.shape[1]]
            apart = self.own[p] + self.own[q] - 2.0 * np.einsum("ij,ij->i", self.texts[p], self.texts[q])
            np.maximum(apart, 0.0, out=apart)
            for x in self.xs.T:
                apart += (x[p] - x[q]) ** 2
            near.flat[some] = apart <= self.eps * self.eps

    def _near_of_all_kinds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        apart = self.texts[a] @ self.texts[b].T
        apart *= -2.0
        apart += self.own[a][:, None]
        apart += self.own[b]
        np.maximum(apart, 0.0, out=apart)
        for x in self.xs.T:
            step = x[a][:, None] - x[b]
            step *= step
            apart += step
        for codes, none in self.cats:
            differ = codes[a][:, None] != codes[b]
            apart += np.where(differ, np.where(none[a][:, None] | none[b], 1.0, 2.0), 0.0)
        return apart <= self.eps * self.eps

    def close(self) -> np.ndarray:
        """Rows within ``eps`` of each point, without those of the point itself."""
        close = np.zeros(len(self.spot), np.int64)
        # Sums stay exact: whole numbers below 2**24 in single precision.
        real = np.float32 if self.w.max() * TILE < 1 << 24 else np.float64
        w, self.beside = self.w.astype(real), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]

        def gather(a: np.ndarray, b: np.ndarray, near: np.ndarray, rows: np.ndarray) -> None:
            close[a] += rows.astype(np.int64)
            few = np.flatnonzero((rows > 0) & (close[a] + self.w[a] < self.minimum))
            if len(few):
                p, q = np.nonzero(near[few])
                self.beside.append((a[few[p]], b[q]))

        for i, j in self.pairs:
            a, b = self.tiles[i], self.tiles[j]
            near = self.near(a, b)
            if i == j:
                np.fill_diagonal(near, False)
            if near.any():
                ones = near.astype(real)
                gather(a, b, near, ones @ w[b])
                if i != j:
                    gather(b, a, near.T, w[a] @ ones)
        return close

    def counted(self) -> pa.RecordBatch:
        """(spot, close, beside) of the points with others within ``eps``.

        ``beside`` are these others where they do not make a core point: fewer than ``minimum``.
        """
        close = self.close()
        point, other = (np.concatenate(k) for k in zip(*self.beside))
        few = close[point] + self.w[point] < self.minimum
        point, other = point[few], other[few]
        order, found = np.argsort(point, kind="stable"), np.flatnonzero(close)
        starts = np.searchsorted(point[order], [*found, len(close)]).astype(np.int32)
        beside = pa.ListArray.from_arrays(pa.array(starts), pa.array(self.spot[other[order]]))
        return pa.RecordBatch.from_arrays([pa.array(self.spot[found]), pa.array(close[found]), beside], ["spot", "close", "beside"])

    def links(self, core: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a place of each part, places of border points, places of core points they touch).

        ``start`` holds for each point the place of a core point that it is known to be
        connected with, or its own.
        """
        part, root = start.copy(), np.arange(len(start))
        edge, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        def touch(border: np.ndarray, cores: np.ndarray) -> None:
            near = self.near(border, cores)
            for one in np.unique(part[cores]):
                hit = border[near[:, part[cores] == one].any(axis=1)]
                edge.append(hit)
                at.append(np.full(len(hit), one))

        for i, j in self.pairs:
            a, b = self.tiles[i], self.tiles[j]
            inner, outer = (a[core[a]], b[core[b]]), (a[~core[a]], b[~core[b]])
            if all(len(k) for k in inner) and len(np.unique(np.concatenate([part[k] for k in inner]))) > 1:
                near = self.near(*inner)
                if i == j:
                    part[a[core[a]]] = inner[0][forest_of(near)]
                else:
                    for one in np.unique(part[inner[0]]):
                        met = near[part[inner[0]] == one].any(axis=0)
                        for other in np.unique(part[inner[1][met]]).tolist():
                            x, y = find(int(one)), find(other)
                            root[max(x, y)] = min(x, y)
                    while (root[part] != part).any():
                        part = root[part]
            if len(outer[0]) and len(inner[1]):
                touch(outer[0], inner[1])
            if i != j and len(outer[1]) and len(inner[0]):
                touch(outer[1], inner[0])
        return part, np.concatenate(edge), part[np.concatenate(at)]


class TextDensity:
    """One clustering run over points ``row_id, xs, cats, text``.

    ``xs`` is an array of numbers, ``cats`` of category levels (the dropped first
    one and null as the empty string), ``text`` the packed counts of the terms, whose
    weights are ``scale``.  All may be empty.
    Equal points are merged into one weighted point first.
    """

    def __init__(self, points: DataFrame, row_id: str, eps: float, min_samples: int, scale: list[float]):
        self.points, self.row_id, self.eps, self.scale = points, row_id, eps, scale
        merged = points.groupBy("xs", "cats", "text").agg(F.count("*").alias("w"), F.min(row_id).alias("first_row"))
        self.spots = stage(self._placed(merged), "spots")
        self.members = stage(self._members(), "members")
        self.size = size = max(min(SLICE, max(4 * TILE, -(-self.spots.count() // SLICES))), 1)
        self.meetings = self._meetings()

        def count(batches):
            for table in blocks_of(batches):
                yield Block(table, eps, size, scale, min_samples).counted()

        counted = self._blocks(self.spots.drop("first_row"), self.meetings).mapInArrow(count, _COUNTS)
        self.counted = stage(counted, "counted")
        close = self.counted.groupBy("spot").agg(F.sum("close").alias("close"))
        judged = self.spots.select("spot", "w", "first_row").join(close.hint("merge"), "spot", "left")
        total = F.col("w") + F.coalesce("close", F.lit(0))
        self.judged = stage(judged.select("spot", "w", "first_row", total.alias("close"), (total >= min_samples).alias("core")), "judged")

    @cached_property
    def links(self) -> DataFrame:
        """(core, other, joins): core points of one cluster, and border points with core points they touch."""
        eps, size, scale = self.eps, self.size, self.scale

        def link(batches):
            for table in blocks_of(batches):
                block, core = Block(table, eps, size, scale), table["core"].to_numpy()
                start = np.searchsorted(block.spot, table["start"].to_numpy())
                part, edge, at = block.links(core, start)
                # Each part of a slice is linked once, not each of its points.
                inner = np.flatnonzero(core & (start == np.arange(len(start))) & (part != start))
                touched = np.unique(np.stack([edge, at]), axis=1)
                found = np.concatenate([part[inner], touched[1]]), np.concatenate([inner, touched[0]])
                joins = np.arange(len(found[0])) < len(inner)
                yield pa.RecordBatch.from_arrays([*[pa.array(block.spot[f]) for f in found], pa.array(joins)], ["core", "other", "joins"])

        flagged = self.spots.drop("first_row").join(self.judged.select("spot", "core").hint("merge"), "spot")
        alone = [m for m in self.meetings if m[0] == m[1]]
        alone = stage(self._blocks(flagged.withColumn("start", F.col("spot")), alone).mapInArrow(link, _LINKS), "links")
        starts = alone.where("joins").select(F.col("other").alias("spot"), F.col("core").alias("start"))
        started = flagged.join(starts.hint("merge"), "spot", "left").withColumn("start", F.coalesce("start", "spot"))
        both = [m for m in self.meetings if m[0] != m[1]]
        both = self._blocks(started, both).mapInArrow(link, _LINKS)
        return stage(alone.union(both).distinct(), "links")

    def _placed(self, merged: DataFrame) -> DataFrame:
        """Points with ``kind`` and ``spot``, their place in the order that keeps like ones together."""
        marked = merged.withColumn("kind", F.to_json("cats") if self.eps < 1 else F.lit(""))
        return with_position(marked, ["kind", "xs", "text", "cats"], "spot")

    def _meetings(self) -> list[tuple[int, int, int]]:
        """(slice, slice, pairs of points) of the blocks; the slices, one row each, are known to the driver."""
        x = F.coalesce(F.get("xs", F.lit(0)), F.lit(0.0))
        rows = self._sliced(self.spots).select("slice", "kind", x.alias("x"))
        ends = [f(c).alias(f"{name}_{c}") for c in ("kind", "x") for name, f in (("low", F.min), ("high", F.max))]
        slices = sorted(rows.groupBy("slice").agg(*ends, F.count("*").alias("n")).collect(), key=lambda s: s.slice)
        found = []
        for place, a in enumerate(slices):
            if a.n > 1:
                found.append((a.slice, a.slice, a.n * a.n // 2))
            for b in slices[place + 1 :]:
                # Slices follow each other by kind, so two of them share no other kind than this.
                if b.low_kind != a.high_kind:
                    break
                if max(a.low_x, b.low_x) - min(a.high_x, b.high_x) <= self.eps * (1 + 1e-9):
                    found.append((a.slice, b.slice, a.n * b.n))
        return found

    def _sliced(self, spots: DataFrame) -> DataFrame:
        return spots.withColumn("slice", F.floor(F.col("spot") / self.size))

    def _blocks(self, spots: DataFrame, meetings: list[tuple[int, int, int]]) -> DataFrame:
        """Points of each pair of slices together, in the order of their places; a task takes many small blocks."""
        parts = max(1, min(len(meetings), sum(pairs for *_, pairs in meetings) // TASK_PAIRS))
        rows = []
        for rank, (a, b, _) in enumerate(sorted(meetings, key=lambda m: -m[2])):
            rows += [(end, a << PAIR_BITS | b, rank % parts) for end in sorted({a, b})]
        # Bounded: a row for each slice of a block.
        columns = zip(*rows) if rows else ((), (), ())
        types = pa.schema([("slice", pa.int64()), ("pair", pa.int64()), ("part", pa.int32())])
        table = F.broadcast(spots.sparkSession.createDataFrame(pa.table([pa.array(c, t.type) for c, t in zip(columns, types)], schema=types)))
        met = self._sliced(spots).join(table, "slice").drop("slice")
        return met.repartitionById(parts, F.col("part")).sortWithinPartitions("pair", "spot")

    def noise(self) -> DataFrame:
        """Row ids of the points that are no core points and have none within ``eps``."""
        # A point that is no core point has all its neighbours listed, since it was none in any block.
        beside = self.counted.select("spot", F.explode("beside").alias("other"))
        cores = self.judged.where("core").select(F.col("spot").alias("other"))
        touched = beside.join(cores.hint("merge"), "other").select("spot")
        lonely = self.judged.where(~F.col("core")).join(touched.hint("merge"), "spot", "left_anti").select("spot", "w")
        return self._rows(lonely, "inner").select(self.row_id)

    def neighbours(self) -> DataFrame:
        """Rows within ``eps`` of each row, itself included: (row id, close)."""
        return self._rows(self.judged.select("spot", "w", "close"), "inner").select(self.row_id, "close")

    def clusters(self) -> DataFrame:
        """All rows with ``cluster``: numbered from 0 by smallest row id of a core point, -1 for noise.

        A border point takes the lowest-numbered cluster it touches.
        """
        parts = components(self.links.where("joins").select("core", "other"))
        cores = self.judged.where("core").join(parts.withColumnRenamed("node", "spot"), "spot", "left")
        cores = stage(cores.select("spot", "first_row", F.coalesce("component", "spot").alias("component")), "cores")
        firsts = cores.groupBy("component").agg(F.min("first_row").alias("first_row"))
        numbers = numbered(firsts, [], ["first_row"], "rank").select("component", (F.col("rank") - 1).alias("cluster"))
        named = stage(join_unique(cores, numbers, ["component"], F.col("spot")).select("spot", "cluster"), "named")
        border = self.links.where(~F.col("joins")).select(F.col("core").alias("spot"), "other")
        border = join_unique(border, named, ["spot"], F.col("other")).groupBy(F.col("other").alias("spot")).agg(F.min("cluster").alias("cluster"))
        labels = self.spots.join(named.unionByName(border), "spot", "left")
        return self._rows(labels, "left").select(self.row_id, F.coalesce("cluster", F.lit(-1)).cast("long").alias("cluster"))

    def _members(self) -> DataFrame:
        """(row id, spot, heavy); only the few heavy points are copied for a spread join."""
        point = ["xs", "cats", "text"]
        named = self.spots.select(*point, "spot", "w")
        light = self.points.join(named.where(F.col("w") < HEAVY).hint("merge"), point)
        heavy = join_unique(self.points, named.where(F.col("w") >= HEAVY), point, F.col(self.row_id), grows=True)
        return light.select(self.row_id, "spot", F.lit(False).alias("heavy")).union(heavy.select(self.row_id, "spot", F.lit(True)))

    def _rows(self, spots: DataFrame, how: str) -> DataFrame:
        """Every row joined to the values of its merged point, which has its weight ``w``."""
        spots = spots.drop("first_row", "kind", "xs", "cats", "text")
        light, heavy = (spots.where(c).drop("w") for c in (F.col("w") < HEAVY, F.col("w") >= HEAVY))
        few = self.members.where(~F.col("heavy")).join(light.hint("merge"), "spot", how)
        many = join_unique(self.members.where("heavy"), heavy, ["spot"], F.col(self.row_id), how, grows=True)
        return few.unionByName(many)
