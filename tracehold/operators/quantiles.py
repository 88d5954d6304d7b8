"""Exact quantiles of large columns.

Spark's exact ``percentile`` keeps every distinct value of a group in memory.
Here approximate quantiles only bracket the wanted rank; counting what lies
below keeps the rank exact, and the bracket is narrowed until few distinct
values are left.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Distinct values that one task may sort in the last step.
FINAL_VALUES = 200_000
_ACCURACY = 10_000


def exact_quantile(df: DataFrame, column: str, q: float, final_values: int = FINAL_VALUES) -> float | None:
    """Quantile with linear interpolation over the non-null values of a column."""
    values = df.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).select(
        F.col(column).cast("double").alias("x")
    )
    total = values.count()
    if total == 0:
        return None
    rank = q * (total - 1)
    low, high = math.floor(rank), math.ceil(rank)
    at_low, at_high = _at_ranks(values, low, high, total, final_values)
    return at_low + (at_high - at_low) * (rank - low)


def exact_median(df: DataFrame, column: str, final_values: int = FINAL_VALUES) -> float | None:
    return exact_quantile(df, column, 0.5, final_values)


def _at_ranks(values: DataFrame, low: int, high: int, total: int, final_values: int) -> tuple[float, float]:
    """Values at two neighbouring 0-based ranks.

    Each round cuts the open interval around the ranks at approximate quantiles and at
    its middle and counts the parts, so that it always becomes smaller, until few
    distinct values are left or both ranks lie on one value.
    """
    below, size = 0, total
    while size > final_values and values.select("x").distinct().limit(final_values + 1).count() > final_values:
        share_low, share_high = (max(low - below, 0)) / size, min(high - below + 1, size) / size
        shares = [max(share_low - 2 / _ACCURACY, 0.0), min(share_high + 2 / _ACCURACY, 1.0)]
        bounds = values.agg(F.percentile_approx("x", shares, _ACCURACY).alias("p"), F.min("x").alias("a"), F.max("x").alias("b")).first()
        middle = bounds["a"] / 2 + bounds["b"] / 2
        cuts = sorted({*bounds["p"], 0.0 if math.isnan(middle) else middle})
        less = values.agg(*[F.count_if(F.col("x") < c).alias(f"l{i}") for i, c in enumerate(cuts)], *[F.count_if(F.col("x") <= c).alias(f"u{i}") for i, c in enumerate(cuts)]).first()
        for i, c in enumerate(cuts):
            for part, x in ((f"l{i}", F.col("x") < c), (f"u{i}", F.col("x") <= c)):
                if low < high and below + less[part] == high:  # exactly between the two ranks
                    row = values.agg(F.max(F.when(x, F.col("x"))).alias("low"), F.min(F.when(~x, F.col("x"))).alias("high")).first()
                    return row["low"], row["high"]
        # Of the values and gaps between cuts, the range that holds both ranks.
        floor = max(((c, below + less[f"l{i}"], True) for i, c in enumerate(cuts) if below + less[f"l{i}"] <= low), default=None)
        above = max(((c, below + less[f"u{i}"], False) for i, c in enumerate(cuts) if below + less[f"u{i}"] <= low), default=None)
        start = max((x for x in (floor, above) if x), key=lambda x: (x[1], x[0]), default=None)
        stops = [(c, below + less[f"u{i}"], True) for i, c in enumerate(cuts) if below + less[f"u{i}"] > high]
        stops += [(c, below + less[f"l{i}"], False) for i, c in enumerate(cuts) if below + less[f"l{i}"] > high]
        stop = min(stops, key=lambda x: (x[1], x[0]), default=None)
        x = F.col("x")
        if start:
            values = values.where(x >= start[0] if start[2] else x > start[0])
        if stop:
            values = values.where(x <= stop[0] if stop[2] else x < stop[0])
        below, size = start[1] if start else below, (stop[1] if stop else below + size) - (start[1] if start else below)
        if start and stop and start[2] and stop[2] and start[0] == stop[0]:
            return start[0], start[0]
    counts = values.groupBy("x").agg(F.count("*").alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy("x")) + below)
    row = upto.agg(
        F.min(F.when(F.col("upto") > low, F.col("x"))).alias("low"),
        F.min(F.when(F.col("upto") > high, F.col("x"))).alias("high"),
    ).first()
    return row["low"], row["high"]
