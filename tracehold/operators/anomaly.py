"""Statistical outliers in numeric fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracehold.operators.quantiles import FINAL_VALUES, exact_median

# Limits and the factor that scales a MAD to a deviation.
Z_LIMIT = 3.0
MAD_LIMIT = 3.5
MAD_FACTOR = 0.6745


def numeric_fields(df: DataFrame, fields: list[str]) -> list[str]:
    """The fields that exist and are numeric."""
    return [f.name for f in df.schema.fields if f.name in fields and isinstance(f.dataType, T.NumericType)]


def known(name: str) -> Column:
    """A numeric column as a double in which NaN is missing like null."""
    value = F.col(name).cast("double")
    return F.when(~F.isnan(value), value)


def _flagged(df: DataFrame, method: str, scores: dict, row_id: str, limit: float, extra=()) -> DataFrame:
    """One row per (row, field) whose score exceeds the limit; a single scan."""
    cells = F.array(
        *[
            F.struct(
                F.lit(name).alias("field"),
                known(name).alias("value"),
                score.alias("score"),
                *[c.alias(n) for n, c in (extra[name].items() if extra else ())],
            )
            for name, score in scores.items()
        ]
    )
    hits = df.select(F.col(row_id), F.explode(cells).alias("c")).where(F.col("c.score") > limit)
    return hits.select(F.lit(method).alias("method"), row_id, "c.*")


def zscore_anomalies(df: DataFrame, fields: list[str], row_id: str, limit: float = Z_LIMIT) -> DataFrame:
    """Values more than ``limit`` population deviations from the mean; nulls and NaN are skipped.

    All fields share one aggregation, which enters the scan as a scalar subquery.
    """
    names = numeric_fields(df, fields)
    if not names:
        raise ValueError("no numeric fields")
    stats = df.agg(
        *[F.avg(known(n)).alias(f"m_{n}") for n in names], *[F.stddev_pop(known(n)).alias(f"s_{n}") for n in names]
    )
    row = stats.select(F.struct(*stats.columns)).scalar()
    scores = {
        n: F.abs(known(n) - row[f"m_{n}"]) / F.when(row[f"s_{n}"] > 0, row[f"s_{n}"]) for n in names
    }
    return _flagged(df, "z_score", scores, row_id, limit)


def mad_anomalies(
    df: DataFrame, fields: list[str], row_id: str, limit: float = MAD_LIMIT, final_values: int = FINAL_VALUES
) -> DataFrame:
    """Values far from the median in units of the median absolute deviation.

    Medians are exact; nulls and NaN are skipped, and so is a field whose MAD is zero.
    """
    scores, extra = {}, {}
    for name in numeric_fields(df, fields):
        median = exact_median(df, name, final_values)
        if median is None:
            continue
        distance = F.abs(known(name) - F.lit(median))
        mad = exact_median(df.select(distance.alias("d")), "d", final_values)
        if mad:
            scores[name] = F.lit(MAD_FACTOR) * distance / F.lit(mad)
            extra[name] = {"median": F.lit(median), "mad": F.lit(mad)}
    if not scores:
        schema = f"method string, {row_id} {df.schema[row_id].dataType.simpleString()}, field string, value double, score double, median double, mad double"
        return df.sparkSession.createDataFrame([], schema)
    return _flagged(df, "median_absolute_deviation", scores, row_id, limit, extra)


def fill_with_mean(df: DataFrame, fields: list[str]) -> DataFrame:
    """Replace nulls and NaN of numeric fields by the field's mean."""
    stats = df.agg(*[F.avg(known(f)).alias(f) for f in fields])
    row = stats.select(F.struct(*fields)).scalar()
    return df.withColumns({f: F.coalesce(known(f), row[f]) for f in fields})


def anomaly_all(results: list[DataFrame], row_id: str) -> DataFrame:
    """All methods' findings as (method, row id, field, value, score)."""
    shape = {"field": "string", "value": "double", "score": "double"}
    aligned = []
    for found in results:
        missing = {n: F.lit(None).cast(t) for n, t in shape.items() if n not in found.columns}
        aligned.append(found.withColumns(missing).select("method", row_id, "field", "value", "score"))
    return reduce(DataFrame.unionByName, aligned)


def anomaly_summary(findings: DataFrame) -> DataFrame:
    """Findings per method, with the total over all methods in the row ``all``."""
    return findings.rollup("method").agg(F.count("*").alias("anomalies")).select(
        F.coalesce("method", F.lit("all")).alias("method"), "anomalies"
    )
