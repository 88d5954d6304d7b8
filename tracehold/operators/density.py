"""Density clustering (DBSCAN) on a grid, without comparing all pairs.

Cells have the diagonal ``eps``, so all points of one cell are neighbours: a
cell holding ``min_samples`` points makes them all core points without a single
comparison, however many there are.  Only points of sparse cells are compared
with the cells around them, and a sparse cell has fewer than ``min_samples``
points.  Identical points are merged into one weighted point first.

Two dense cells belong together when some pair of their points is within
``eps``.  That is decided on bounding boxes, which are cut finer until they answer:
a box pair that is near enough joins the cells, one too far apart is dropped.
"""

from __future__ import annotations

import itertools
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracehold.operators.anomaly import known
from tracehold.operators.graph import components
from tracehold.operators.ordered import numbered
from tracehold.operators.skew import join_unique
from tracehold.session import stage

STEERED = 4  # axes along which neighbouring cells are looked up; the others are compared
BOX_CUT = 4  # parts per axis a box is cut into
CELL_SLICE = 100_000  # points of one cell handled by one task


def scaled(df: DataFrame, fields: list[str], row_id: str, keep: tuple = ()) -> DataFrame:
    """Mean-filled fields divided by their population deviation, as x0, x1, ..."""
    stats = df.agg(
        *[F.avg(known(f)).alias(f"m{i}") for i, f in enumerate(fields)],
        *[F.stddev_pop(known(f)).alias(f"d{i}") for i, f in enumerate(fields)],
        *[F.count(known(f)).alias(f"n{i}") for i, f in enumerate(fields)],
        F.count("*").alias("n"),
    )
    row = stats.select(F.struct(*stats.columns)).scalar()
    columns = []
    for i, f in enumerate(fields):
        # Filling by the mean leaves the sum of squares and adds rows.
        deviation = row[f"d{i}"] * F.sqrt(row[f"n{i}"] / row["n"])
        value = F.coalesce(known(f), row[f"m{i}"]) - row[f"m{i}"]
        columns.append((value / F.when(deviation > 0, deviation).otherwise(1.0) + F.lit(0.0)).alias(f"x{i}"))
    return df.select(row_id, *keep, *columns)


class DensityModel:
    """The stages of one clustering run over points ``row_id, x0 .. xd-1 [, cats]``.

    ``cats`` is an optional array of category levels (the dropped first level and
    null as the empty string) standing for one-hot columns.

    Tables of points and boxes are asked to be shuffled where they are joined: their
    files are many times smaller than what the driver of a broadcast would hold.
    """

    def __init__(self, points: DataFrame, row_id: str, dims: int, eps: float, min_samples: int, cats: bool = False):
        if dims < 1:
            raise ValueError("density clustering needs a numeric field")
        self.points, self.row_id, self.dims, self.eps, self.min_samples = points, row_id, dims, eps, min_samples
        self.xs = [f"x{i}" for i in range(dims)]
        self.spot = self.xs + (["cats"] if cats else [])
        self.cats = cats
        # A trifle narrower than eps / sqrt(d): rounding must not stretch a cell.
        self.side = eps / math.sqrt(dims) * (1 - 1e-9)
        self._prepare()

    def _distance2(self, a: str, b: str) -> Column:
        parts = [(F.col(f"{a}{x}") - F.col(f"{b}{x}")) ** 2 for x in self.xs]
        total = reduce(lambda p, q: p + q, parts)
        if self.cats:
            pairs = F.zip_with(
                F.col(f"{a}cats"),
                F.col(f"{b}cats"),
                lambda p, q: F.when(p == q, 0.0).when((p == "") | (q == ""), 1.0).otherwise(2.0),
            )
            total = total + F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)
        return total

    def _prepare(self) -> None:
        cell = F.array(*[F.floor(F.col(x) / self.side) for x in self.xs])
        spots = self.points.groupBy(*self.spot).agg(F.count("*").alias("w"))
        spots = spots.withColumn("grid", cell).withColumn("group", F.col("cats") if self.cats else F.array().cast("array<string>"))
        cells = spots.groupBy("grid", "group").agg(F.sum("w").alias("n"), F.count("*").alias("m"))
        self.cells = stage(
            cells.select("grid", "group", "n", F.ceil(F.col("m") / CELL_SLICE).cast("int").alias("slices")), "cells"
        )
        tagged = join_unique(spots, self.cells, ["grid", "group"], F.struct(*self.spot), grows=True)
        slice_no = F.pmod(F.xxhash64(*self.xs), F.col("slices")).cast("int")
        self.spots = stage(
            tagged.withColumn("slice", slice_no).withColumn("dense", F.col("n") >= self.min_samples), "spots"
        )
        self._near()

    def _neighbour_cells(self, cells: DataFrame) -> DataFrame:
        """Pairs of existing cells that can hold points within eps: (grid, group, to_grid, to_group, slices)."""
        reach, steered = math.ceil(math.sqrt(self.dims)), min(self.dims, STEERED)
        steps = [
            o
            for o in itertools.product(range(-reach, reach + 1), repeat=steered)
            if sum((max(abs(v) - 1, 0) * self.side) ** 2 for v in o) <= self.eps**2
        ]
        offsets = F.array(*[F.array(*[F.lit(v).cast("long") for v in o]) for o in steps])
        moved = cells.select("grid", "group", F.explode(offsets).alias("o")).select(
            "grid", "group", F.zip_with(F.slice("grid", 1, steered), "o", lambda g, o: g + o).alias("steer")
        )
        other = self.cells.select(
            F.slice("grid", 1, steered).alias("steer"), F.col("grid").alias("to_grid"), F.col("group").alias("to_group"), "slices", "n"
        )
        if self.eps < 1:  # a different category alone is already a distance of one
            met = moved.withColumn("to_group", F.col("group")).join(other, ["steer", "to_group"])
        else:
            met = moved.join(other, "steer")
        apart = F.zip_with("grid", "to_grid", lambda g, o: F.pow(F.greatest(F.abs(g - o) - 1, F.lit(0)) * self.side, F.lit(2.0)))
        near = F.aggregate(apart, F.lit(0.0), lambda total, v: total + v) <= self.eps**2
        return (met.where(near) if steered < self.dims else met).drop("steer")

    def _near(self) -> None:
        """Per sparse point and neighbouring cell: how many points are within eps."""
        sparse_cells = self.cells.where(F.col("n") < self.min_samples)
        around = self._neighbour_cells(sparse_cells).select("grid", "group", "to_grid", "to_group", "slices")
        mine = self.spots.where(~F.col("dense")).select(*[F.col(c).alias(f"a_{c}") for c in self.spot], "grid", "group")
        wanted = mine.join(around.hint("merge"), ["grid", "group"]).withColumn(
            "slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
        )
        other = self.spots.select(
            *[F.col(c).alias(f"b_{c}") for c in self.spot],
            "w",
            "dense",
            "slice",
            F.col("grid").alias("to_grid"),
            F.col("group").alias("to_group"),
        )
        pairs = wanted.join(other.hint("merge"), ["to_grid", "to_group", "slice"])
        close = pairs.where(self._distance2("a_", "b_") <= self.eps**2)
        here = [f"a_{c}" for c in self.spot]
        there = F.when(~F.col("dense"), F.struct(*[F.col(f"b_{c}").alias(c) for c in self.spot]))
        near = close.groupBy(*here, "grid", "group", "to_grid", "to_group").agg(
            F.sum("w").alias("close"),
            F.max("dense").alias("dense"),
            F.collect_set(there).alias("others"),  # fewer than min_samples: a sparse cell's points
        )
        self.near = stage(near, "near")
        counts = self.near.groupBy(*here).agg(F.sum("close").alias("close"), F.max("dense").alias("touches_dense"))
        self.sparse = stage(counts.withColumn("core", F.col("close") >= self.min_samples), "sparse")
        links = self.near.where(~F.col("dense")).select(
            *here, "grid", "group", "to_grid", "to_group", F.explode("others").alias("o")
        )
        cores = self.sparse.where("core").select(*[F.col(f"a_{c}").alias(f"o_{c}") for c in self.spot])
        links = links.select(
            *here, "grid", "group", "to_grid", "to_group", *[F.col(f"o.{c}").alias(f"o_{c}") for c in self.spot]
        )
        self.core_links = links.join(cores.hint("merge"), [f"o_{c}" for c in self.spot])

    def noise_spots(self) -> DataFrame:
        """Points that are no core points and have none within eps."""
        here = [f"a_{c}" for c in self.spot]
        lonely = self.sparse.where(~F.col("core") & ~F.col("touches_dense"))
        lonely = lonely.join(self.core_links.select(*here).hint("merge"), here, "left_anti")
        return lonely.select(*[F.col(f"a_{c}").alias(c) for c in self.spot])

    def noise(self) -> DataFrame:
        """Row ids of the noise points."""
        return join_unique(self.points, self.noise_spots(), self.spot, F.col(self.row_id), grows=True).select(self.row_id)

    def _cell_edges(self) -> DataFrame:
        """Cell pairs whose core points touch."""
        here = [f"a_{c}" for c in self.spot]
        cores = self.sparse.where("core").select(*here).hint("merge")
        to_dense = self.near.where("dense").join(cores, here, "left_semi")
        pair = ["grid", "group", "to_grid", "to_group"]
        sparse_links = self.core_links.join(cores, here, "left_semi")
        edges = to_dense.select(*pair).unionByName(sparse_links.select(*pair))
        return edges.unionByName(self._dense_edges().select(*pair)).distinct()

    def _dense_edges(self) -> DataFrame:
        """Pairs of dense cells with two points within eps, by ever finer bounding boxes."""
        dense_cells = self.cells.where(F.col("n") >= self.min_samples)
        pairs = self._neighbour_cells(dense_cells).where(F.col("n") >= self.min_samples)
        after = F.struct("to_grid", "to_group") > F.struct("grid", "group")
        open_pairs = stage(pairs.where(after).select("grid", "group", "to_grid", "to_group"), "pairs")
        found, level = None, 0
        while not open_pairs.isEmpty():
            boxes = self._boxes(open_pairs, level)
            here = boxes.select(*[F.col(c).alias(c if c in ("grid", "group") else f"a_{c}") for c in boxes.columns])
            there = boxes.select(
                *[F.col(c).alias(f"to_{c}" if c in ("grid", "group") else f"b_{c}") for c in boxes.columns]
            )
            keep = ["grid", "group", "to_grid", "to_group"]
            here, there = here.hint("merge"), there.hint("merge")
            if level:
                here = here.withColumn("a_parent", F.transform("a_box", lambda v: F.floor(v / BOX_CUT)))
                there = there.withColumn("b_parent", F.transform("b_box", lambda v: F.floor(v / BOX_CUT)))
                both = open_pairs.join(here, ["grid", "group", "a_parent"]).join(there, ["to_grid", "to_group", "b_parent"])
            else:
                both = open_pairs.join(here, ["grid", "group"]).join(there, ["to_grid", "to_group"])
            apart, across = F.lit(0.0), F.lit(0.0)
            for x in self.xs:
                gap = F.greatest(
                    F.col(f"a_lo_{x}") - F.col(f"b_hi_{x}"), F.col(f"b_lo_{x}") - F.col(f"a_hi_{x}"), F.lit(0.0)
                )
                reach = F.greatest(F.col(f"a_hi_{x}") - F.col(f"b_lo_{x}"), F.col(f"b_hi_{x}") - F.col(f"a_lo_{x}"))
                apart, across = apart + gap**2, across + reach**2
            cats = self._category_distance()
            sample = reduce(
                lambda p, q: p + q, [(F.col("a_any")[x] - F.col("b_any")[x]) ** 2 for x in self.xs]
            )
            limit = F.lit(self.eps**2)
            judged = stage(
                both.where(apart + cats <= limit).withColumn(
                    "joined", (F.least(across, sample) + cats) <= limit
                ).select(*keep, "a_box", "b_box", "joined"),
                "boxes",
            )
            joined = judged.where("joined").select(*keep).distinct()
            found = joined if found is None else found.unionByName(joined)
            rest = judged.join(joined, keep, "left_anti")
            open_pairs = stage(
                rest.select(*keep, F.col("a_box").alias("a_parent"), F.col("b_box").alias("b_parent")), "pairs"
            )
            level += 1
        if found is None:
            return pairs.limit(0).select("grid", "group", "to_grid", "to_group")
        return found

    def _category_distance(self) -> Column:
        if not self.cats:
            return F.lit(0.0)
        pairs = F.zip_with(
            "group",
            "to_group",
            lambda p, q: F.when(p == q, 0.0).when((p == "") | (q == ""), 1.0).otherwise(2.0),
        )
        return F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)

    def _boxes(self, open_pairs: DataFrame, level: int) -> DataFrame:
        """Bounding boxes of the core points of the open cells, every axis cut ``level`` times."""
        cells = open_pairs.select("grid", "group").unionByName(
            open_pairs.select(F.col("to_grid").alias("grid"), F.col("to_group").alias("group"))
        ).distinct()
        rows = join_unique(self.spots.where("dense"), cells, ["grid", "group"], F.struct(*self.xs), grows=True)
        box = F.array(*[F.floor(F.col(x) / (self.side / BOX_CUT**level)) for x in self.xs])
        bounds = [b for x in self.xs for b in (F.min(x).alias(f"lo_{x}"), F.max(x).alias(f"hi_{x}"))]
        return rows.groupBy("grid", "group", box.alias("box")).agg(*bounds, F.min(F.struct(*self.xs)).alias("any"))

    def clusters(self) -> DataFrame:
        """All rows with their ``cluster``: numbered from 0 by smallest row id of a core point, -1 for noise.

        A border point takes the lowest-numbered cluster it touches.
        """
        here = [f"a_{c}" for c in self.spot]
        sparse_cores = self.sparse.where("core").select(*[F.col(f"a_{c}").alias(c) for c in self.spot])
        core_spots = self.spots.where("dense").select(*self.spot, "grid", "group").unionByName(
            join_unique(self.spots, sparse_cores, self.spot, F.struct(*self.xs), grows=True).select(*self.spot, "grid", "group")
        )
        node = F.struct("grid", "group")
        nodes = core_spots.select(node.alias("node")).distinct()
        edges = self._cell_edges().select(
            node.alias("a"), F.struct(F.col("to_grid").alias("grid"), F.col("to_group").alias("group")).alias("b")
        )
        parts = connected_components(nodes, edges)
        labelled = stage(
            join_unique(core_spots.withColumn("node", node), parts, ["node"], F.struct(*self.xs), grows=True).select(
                *self.spot, "node", "component"
            ),
            "cores",
        )
        core_rows = join_unique(self.points, labelled, self.spot, F.col(self.row_id), grows=True)
        firsts = core_rows.groupBy("component").agg(F.min(self.row_id).alias("first_row"))
        numbers = stage(
            numbered(firsts, [], ["first_row"], "rank").select("component", (F.col("rank") - 1).alias("cluster")),
            "clusters",
        )
        cell_numbers = parts.join(numbers, "component").select("node", "cluster")
        touching = self.near.where("dense").select(
            *here, F.struct(F.col("to_grid").alias("grid"), F.col("to_group").alias("group")).alias("node")
        ).unionByName(
            self.core_links.select(
                *here, F.struct(F.col("to_grid").alias("grid"), F.col("to_group").alias("group")).alias("node")
            )
        )
        borders = touching.join(self.sparse.where(~F.col("core")).select(*here).hint("merge"), here, "left_semi")
        border_numbers = borders.join(cell_numbers, "node").groupBy(*here).agg(F.min("cluster").alias("cluster"))
        spot_numbers = labelled.join(numbers, "component").select(*self.spot, "cluster").unionByName(
            border_numbers.select(*[F.col(f"a_{c}").alias(c) for c in self.spot], "cluster")
        )
        rows = join_unique(self.points, spot_numbers, self.spot, F.col(self.row_id), "left", grows=True)
        return rows.select(self.row_id, F.coalesce("cluster", F.lit(-1)).cast("long").alias("cluster"))


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, component``: the smallest node of each connected part, for nodes without edges too."""
    found = components(edges.select("a", "b"))
    whole = nodes.join(found, "node", "left")
    return stage(whole.select("node", F.coalesce("component", "node").alias("component")), "parts")


def dbscan_anomalies(df: DataFrame, fields: list[str], row_id: str, eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """Noise points of the scaled fields; the neighbourhood holds the point itself and its rim."""
    points = stage(scaled(df, fields, row_id), "points")
    model = DensityModel(points, row_id, len(fields), eps, min_samples)
    return model.noise().select(F.lit("dbscan").alias("method"), row_id)
