"""Isolation forest: trees grown in parallel from small samples, rows scored in place.

Sampling is part of the method (256 rows per tree), so the forest's size does
not grow with the data: 100 trees of at most 511 nodes, broadcast to the tasks
that score all rows.  Each tree draws its own rows in one pass over the table and
is grown in the task where its sample ends up; no rows pass through the driver.

A categorical field is one number per row, its level's code.  It stands for the
one-hot columns of all levels but the first: a node on it asks for one code.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracehold.operators.anomaly import fill_with_mean, numeric_fields
from tracehold.operators.quantiles import exact_quantile
from tracehold.session import stage

TREES = 100
SAMPLE_ROWS = 256
SEED = 42
# Rows expected to pass a tree's threshold beyond the wanted ones; that fewer than those pass has a probability below e^-800.
MARGIN = 1_256
_NODE_SCHEMA = "tree int, node int, feature int, code double, cut double, child int, path double"


def average_path(n) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, dtype=float)
    harmonic = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def cuttable(part: np.ndarray, coded: frozenset[int]) -> list[tuple[int, float]]:
    """(column, code) of what differs among the rows; numbers have no code (-1), a level one column per code."""
    found = []
    for k in range(part.shape[1] if len(part) else 0):
        if k not in coded:
            if part[:, k].max() > part[:, k].min():
                found.append((k, -1.0))
            continue
        codes, n = np.unique(part[:, k], return_counts=True)
        found += [(k, float(c)) for c, m in zip(codes, n) if c > 0 and m < len(part)]
    return found


def grow_tree(rows: np.ndarray, rng: np.random.Generator, max_depth: int, coded: frozenset[int] = frozenset()) -> list[tuple]:
    """Random axis-parallel cuts; a node is (feature, code, cut, left child, path length).

    The right child follows the left one; leaves have feature -1.
    """
    nodes: list = [None]
    todo = [(0, rows, 0)]
    while todo:
        at, part, depth = todo.pop()
        usable = [] if depth >= max_depth or len(part) <= 1 else cuttable(part, coded)
        if not usable:
            nodes[at] = (-1, -1.0, 0.0, -1, depth + float(average_path(len(part))))
            continue
        feature, code = usable[int(rng.integers(len(usable)))]
        values = part[:, feature] if code < 0 else (part[:, feature] == code).astype(float)
        cut = rng.uniform(values.min(), values.max())
        left = values <= cut
        child = len(nodes)
        nodes += [None, None]
        nodes[at] = (feature, code, float(cut), child, 0.0)
        todo += [(child, part[left], depth + 1), (child + 1, part[~left], depth + 1)]
    return nodes


@dataclass
class IsolationForest:
    """A grown forest; ``offset`` is the score below which a row is an anomaly."""

    fields: list[str]
    nodes: pd.DataFrame
    sample_rows: int
    offset: float | None = None

    def score(self, spark, values: Column) -> Column:
        """Score of each row from an array of its values: the lower, the easier to isolate (-1 to 0)."""
        trees = []
        for _, part in self.nodes.sort_values(["tree", "node"]).groupby("tree"):
            trees.append(tuple(part[c].to_numpy() for c in ("feature", "code", "cut", "child", "path")))
        shared = spark.sparkContext.broadcast((trees, float(average_path(self.sample_rows))))

        @F.pandas_udf("double")
        def score(rows: pd.Series) -> pd.Series:
            forest, normal = shared.value
            x = np.stack(rows.to_numpy()).astype(float) if len(rows) else np.zeros((0, 1))
            total, each = np.zeros(len(x)), np.arange(len(x))
            for feature, code, cut, child, path in forest:
                at = np.zeros(len(x), dtype=int)
                while True:
                    inner = feature[at] >= 0
                    if not inner.any():
                        break
                    value = x[each, np.maximum(feature[at], 0)]
                    right = np.where(code[at] < 0, value, value == code[at]) > cut[at]
                    at = np.where(inner, child[at] + right, at)
                total += path[at]
            return pd.Series(-np.power(2.0, -total / max(len(forest), 1) / max(normal, 1e-12)))

        return score(values)

    def to_json(self) -> str:
        body = {"fields": self.fields, "sample_rows": self.sample_rows, "offset": self.offset}
        return json.dumps({**body, "nodes": self.nodes.to_dict("list")})

    @staticmethod
    def from_json(text: str) -> "IsolationForest":
        body = json.loads(text)
        return IsolationForest(body["fields"], pd.DataFrame(body["nodes"]), body["sample_rows"], body["offset"])


def draws(rows: DataFrame, values: str, trees: int = TREES, seed: int = SEED) -> DataFrame:
    """(tree, draw, at, x): each tree's own uniform sample, the rows with its smallest hashes.

    ``rows`` is a staged table.  A row is known by its place in it, so equal rows and
    equal ids are drawn one by one.  Per tree the hashes pass a threshold that lets
    some 1,500 through; a task keeps the smallest of its own.
    """
    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long")
    at = F.struct(part.alias("part"), F.col("_metadata.row_index").alias("row"))
    total = rows.count()
    share = min(1.0, (SAMPLE_ROWS + MARGIN) / max(1, total))
    limit = int(share * float(1 << 62))
    placed = rows.select(F.col(values).cast("array<double>").alias("x"), at.alias("at"))
    hashes = F.transform(
        F.sequence(F.lit(0), F.lit(trees - 1)),
        lambda t: F.struct(t.cast("int").alias("tree"), F.shiftrightunsigned(F.xxhash64(F.lit(seed), t, "at.part", "at.row"), 2).alias("draw")),
    )
    drawn = placed.withColumn("d", F.explode(F.filter(hashes, lambda h: h["draw"] <= limit)))
    drawn = drawn.select("d.tree", "d.draw", "at", "x")

    def smallest(batches):
        kept = None
        for batch in batches:
            batch = batch if kept is None else pd.concat([kept, batch])
            place = batch["at"].map(lambda p: (p["part"], p["row"]))
            batch = batch.assign(place=place).sort_values(["tree", "draw", "place"]).drop(columns="place")
            kept = batch.groupby("tree").head(SAMPLE_ROWS)
        if kept is not None:
            yield kept

    return drawn.mapInPandas(smallest, "tree int, draw long, at struct<part:long,row:long>, x array<double>")


def tree_of(tree: int, sample: np.ndarray, seed: int, coded: frozenset[int] = frozenset()) -> list[tuple]:
    """The tree with this number over its sample, in the order of the draws."""
    depth = int(np.ceil(np.log2(max(len(sample), 2))))
    return grow_tree(sample, np.random.default_rng([seed, tree]), depth, coded)


def grow_forest(
    rows: DataFrame, values: str, fields: list[str], trees: int = TREES, seed: int = SEED, coded: frozenset[int] = frozenset()
) -> IsolationForest:
    """Grow each tree where its sample is.

    ``rows`` is a staged table with the array ``values`` of a row's numbers, named
    by ``fields``; the positions in ``coded`` hold codes of levels.  The same table
    gives the same forest; where its rows lie decides which are drawn.
    """

    def grow(key: tuple, sample: pd.DataFrame) -> pd.DataFrame:
        place = sample["at"].map(lambda p: (p["part"], p["row"]))
        sample = sample.assign(place=place).sort_values(["draw", "place"]).head(SAMPLE_ROWS)
        nodes = tree_of(int(key[0]), np.stack(sample["x"].to_numpy()).astype(float), seed, coded)
        table = pd.DataFrame(nodes, columns=["feature", "code", "cut", "child", "path"])
        return table.assign(tree=int(key[0]), node=range(len(table)))[["tree", "node", "feature", "code", "cut", "child", "path"]]

    grown = draws(rows, values, trees, seed).groupBy("tree").applyInPandas(grow, _NODE_SCHEMA).toPandas()
    return IsolationForest(list(fields), grown, min(SAMPLE_ROWS, rows.count()))


def isolation_forest_anomalies(
    df: DataFrame, fields: list[str], row_id: str, contamination: float = 0.05, trees: int = TREES, seed: int = SEED
) -> DataFrame:
    """The rows scoring below the ``contamination`` quantile of all scores.

    Nulls are replaced by the field's mean.
    """
    names = numeric_fields(df, fields)
    if not names:
        raise ValueError("no numeric fields")
    filled = fill_with_mean(df.select(row_id, *names), names)
    rows = stage(filled.select(row_id, F.array(*names).alias("_x")), "values")
    forest = grow_forest(rows, "_x", names, trees, seed)
    scored = stage(rows.select(row_id, forest.score(df.sparkSession, F.col("_x")).alias("score")), "scores")
    cut = exact_quantile(scored, "score", contamination)
    return scored.where(F.col("score") < F.lit(cut)).select(F.lit("isolation_forest").alias("method"), row_id, "score")
