"""Event counts over time, spikes and attack sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracehold.functions.times import micros
from tracehold.operators.sessions import Measure, sessionize

# Pandas-style offsets accepted as bin sizes, in seconds.
BIN_UNITS = {"s": 1, "S": 1, "min": 60, "T": 60, "h": 3600, "H": 3600, "D": 86400, "d": 86400}

_STRIDE = 10_000  # bins generated per row when filling gaps


def bin_seconds(size: str) -> int:
    """Seconds of a bin size such as ``1h``, ``15min`` or ``D``."""
    digits = "".join(c for c in size if c.isdigit())
    unit = size[len(digits):]
    if unit not in BIN_UNITS:
        raise ValueError(f"unknown bin size {size!r}")
    return int(digits or 1) * BIN_UNITS[unit]


def _bin_counts(events: DataFrame, seconds: int, ts: str) -> DataFrame:
    """Non-empty bins, numbered from the midnight of the first day."""
    origin = events.agg(F.date_trunc("day", F.min(ts)).alias("origin")).scalar()
    number = F.floor((micros(ts) - micros(origin)) / F.lit(seconds * 1_000_000))
    return (
        events.where(F.col(ts).isNotNull())
        .select(number.alias("_bin"), F.lit(1).alias("_one"))
        .groupBy("_bin")
        .agg(F.count("_one").alias("event_count"))
        .withColumn("bin_start", F.timestamp_micros(micros(origin) + F.col("_bin") * (seconds * 1_000_000)))
    )


def event_frequency(events: DataFrame, size: str = "1h", ts: str = "ts") -> DataFrame:
    """Events per bin from the first to the last bin, empty bins included.

    The empty bins are generated in strides, so no row holds more than
    ``_STRIDE`` of them whatever the time span.
    """
    seconds = bin_seconds(size)
    counts = _bin_counts(events, seconds, ts)
    span = counts.agg(
        F.min("_bin").alias("lo"), F.max("_bin").alias("hi"), F.min("bin_start").alias("start")
    ).where("lo is not null")
    strides = span.withColumn("_from", F.explode(F.sequence("lo", "hi", F.lit(_STRIDE).cast("long"))))
    grid = strides.repartition("_from").withColumn(
        "_bin", F.explode(F.sequence("_from", F.least(F.col("_from") + _STRIDE - 1, F.col("hi"))))
    )
    grid = grid.select(
        "_bin",
        F.timestamp_micros(micros("start") + (F.col("_bin") - F.col("lo")) * (seconds * 1_000_000)).alias("bin_start"),
    )
    filled = grid.join(counts.select("_bin", "event_count"), "_bin", "left")
    return filled.select("bin_start", F.coalesce("event_count", F.lit(0)).alias("event_count"))


def _moments(counts: DataFrame) -> DataFrame:
    """Mean and sample deviation over all bins, empty ones counted, from the non-empty ones.

    The deviations are summed around the mean, which needs no large squares; an
    empty bin adds the squared mean.
    """
    total, bins = F.sum("event_count"), F.max("_bin") - F.min("_bin") + 1
    first = counts.agg((total / bins).alias("mean"), bins.alias("bins"))
    known = first.select(F.struct("mean", "bins")).scalar()
    mean, empty = known["mean"], known["bins"] - F.count("*")
    spread = F.sum((F.col("event_count") - mean) ** 2) + empty * mean * mean
    return counts.agg(
        total.alias("total_events"),
        bins.alias("periods"),
        (total / bins).alias("mean_events"),
        F.when(bins > 1, F.sqrt(spread / (bins - 1))).alias("std_events"),
        F.max("event_count").alias("max_events"),
        F.min_by("bin_start", F.struct(-F.col("event_count"), F.col("bin_start"))).alias("max_events_start"),
    )


def frequency_stats(events: DataFrame, size: str = "1h", ts: str = "ts") -> DataFrame:
    """Total, mean, sample deviation, maximum and first bin of the maximum."""
    return _moments(_bin_counts(events, bin_seconds(size), ts))


def activity_spikes(events: DataFrame, threshold: float = 2.0, size: str = "1min", ts: str = "ts") -> DataFrame:
    """Bins whose z-score (sample deviation, empty bins counted) exceeds the threshold."""
    counts = _bin_counts(events, bin_seconds(size), ts)
    stats = _moments(counts).select(F.struct("mean_events", "std_events")).scalar()
    # Empty bins lie below the mean, so only a negative threshold can select them.
    bins = counts.select("bin_start", "event_count") if threshold >= 0 else event_frequency(events, size, ts)
    deviation = F.col("event_count") - stats["mean_events"]
    z = deviation / F.when(stats["std_events"] > 0, stats["std_events"])
    return bins.select(
        "bin_start", "event_count", z.alias("z_score"), deviation.alias("deviation_from_mean")
    ).where(F.col("z_score") > threshold)


def attack_sequences(
    alerts: DataFrame, min_sequence: int = 3, max_gap: float = 300, rule_field: str = "RULE_ID"
) -> DataFrame:
    """Gap sessions with enough alerts and at least two rule types (three leading characters)."""
    kinds = {"rule_types": Measure("set", F.substring(rule_field, 1, 3))}
    runs = sessionize(alerts, [], max_gap, kinds)
    keep = (F.col("event_count") >= min_sequence) & (F.size("rule_types") >= 2)
    return runs.where(keep).select(
        F.col("session_start").alias("start_time"),
        F.col("session_end").alias("end_time"),
        ((micros("session_end") - micros("session_start")) / F.lit(1_000_000.0)).alias("duration_seconds"),
        F.col("event_count").alias("num_events"),
        "rule_types",
    )
