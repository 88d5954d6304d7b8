"""Managing alerts: duplicates, throttling, response candidates, reports."""

from __future__ import annotations

import fnmatch

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracehold.operators.correlate import correlate_by_time_window
from tracehold.operators.sessions import first_of_bursts

DUPLICATE_KEYS = ["RULE_ID", "ip_address", "username"]
THROTTLE_SLICES = 64


def suppress_duplicates(
    alerts: DataFrame, window_seconds: float = 3600, keys: list[str] | None = None, row_id: str = "event_id"
) -> DataFrame:
    """Keep an alert when the same rule, address and user was last seen more than the window ago.

    A steady repeat stays suppressed.  Alerts without a time cannot repeat and are kept.
    """
    kept = first_of_bursts(alerts, keys or DUPLICATE_KEYS, window_seconds, row_id)
    return kept.unionByName(alerts.where(F.col("ts").isNull()))


def throttle_alerts(
    alerts: DataFrame, count: int = 5, window_seconds: int = 300, row_id: str = "event_id"
) -> DataFrame:
    """The first ``count`` alerts of each rule in each window; alerts without a time are all kept.

    Ranked twice: within slices of a rule's window first, so that a noisy rule is
    spread over tasks and each slice hands on at most ``count`` alerts.
    """
    placed = alerts.withColumns(
        {
            "_window": F.floor(F.unix_micros("ts") / F.lit(window_seconds * 1_000_000)),  # ``window`` would drop a missing time
            "_own": F.when(F.col("ts").isNull(), F.xxhash64(row_id)),  # without a time an alert shares its place with no other
            "_slice": F.pmod(F.xxhash64(row_id), F.lit(THROTTLE_SLICES)),
        }
    )
    for keys in (["RULE_ID", "_window", "_own", "_slice"], ["RULE_ID", "_window", "_own"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("ts", row_id))
        placed = placed.withColumn("_rank", rank).where(F.col("_rank") <= count).drop("_rank")
    return placed.drop("_window", "_own", "_slice")


def response_candidates(
    alerts: DataFrame, rule_glob: str, action: str, field: str = "ip_address", threshold: int = 5, whitelist=()
) -> DataFrame:
    """Values of a field whose matching alerts reach the threshold, without the whitelisted ones."""
    pattern = "^" + fnmatch.translate(rule_glob).replace(r"\Z", r"\z")
    groups = (
        alerts.where(F.col("RULE_ID").rlike(pattern) & F.col(field).isNotNull() & (F.col(field) != ""))
        .groupBy(F.col(field).alias("target"))
        .agg(F.count("*").alias("event_count"), F.max("ts").alias("last_seen"))
        .where(F.col("event_count") >= threshold)
    )
    if isinstance(whitelist, DataFrame):
        listed = whitelist.select(F.col(whitelist.columns[0]).alias("target"))
        groups = groups.join(listed, "target", "left_anti")
    elif whitelist:
        groups = groups.where(~F.col("target").isin(list(whitelist)))
    return groups.select(F.lit(action).alias("action"), F.lit(rule_glob).alias("rule_pattern"), "target", "event_count", "last_seen")


def daily_report(alerts: DataFrame) -> DataFrame:
    """Counts by day, severity and rule category; subtotals are marked ``all``, missing values ``none``."""
    category = F.regexp_extract("RULE_ID", r"^([A-Z0-9]+)-", 1)
    levels = ["day", "severity", "category"]
    named = alerts.select(F.to_date("ts").cast("string").alias("day"), F.col("SEVERITY").alias("severity"), category.alias("category"))
    rolled = named.rollup(*levels).agg(F.count("*").alias("event_count"), *[F.grouping(c).alias(f"_all_{c}") for c in levels])
    cells = [F.when(F.col(f"_all_{c}") == 1, "all").otherwise(F.coalesce(c, F.lit("none"))).alias(c) for c in levels]
    return rolled.select(*cells, "event_count")


def format_alerts(
    alerts: DataFrame,
    rule_id: bool = True,
    timestamp: bool = True,
    source_info: bool = True,
    raw_log: bool = True,
    max_message_length: int = 1000,
) -> DataFrame:
    """The columns an alert message shows; the message is cut at its maximum length."""
    columns = [F.col("RULE_ID")] if rule_id else []
    columns += [F.col("SEVERITY"), F.col("DESCRIPTION")]
    columns += [F.col("timestamp")] if timestamp else []
    columns += [F.col("source_type"), F.col("source_name"), F.col("hostname")] if source_info else []
    columns += [F.substring("message", 1, max_message_length).alias("message")] if raw_log else []
    return alerts.select(*columns)


def incidents(alerts: DataFrame, window_seconds: float = 300) -> DataFrame:
    """Runs of alerts numbered per day as ``INC-yyyymmdd-nnn`` in order of their start."""
    runs = correlate_by_time_window(alerts, window_seconds).withColumn("day", F.date_format("start_time", "yyyyMMdd"))
    # A day has at most 86400 / window runs, since runs are further apart than the window.
    number = F.row_number().over(Window.partitionBy("day").orderBy("start_time"))
    return runs.select(
        F.format_string("INC-%s-%03d", F.col("day"), number).alias("incident_id"),
        "start_time",
        "end_time",
        "event_count",
        "severity",
    )
