"""The same analysis on streams.

Parsing and rule matching are stateless and shared with the batch jobs.  The
stateful parts carry a watermark: state older than the newest event minus the
delay is dropped, and events later than that are ignored.  Correlation that must equal
the batch operators keeps its state in tables (``carried``).
"""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracehold.functions.severity import max_severity
from tracehold.operators.correlate import present
from tracehold.operators.detect import detect
from tracehold.operators.parse import SourceConfig, parse_source
from tracehold.sources.logs import keep_lines
from tracehold.sources.rules import Rule

DELAY = "10 minutes"


def stream_log_lines(
    spark: SparkSession, folder: str, filter_regex: str = "", exclude_regex: str = "", files_per_trigger: int = 1000
) -> DataFrame:
    """New lines of the files arriving in a folder."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return keep_lines(lines, filter_regex, exclude_regex)


def stream_table(spark: SparkSession, folder: str, schema, file_glob: str, files_per_trigger: int = 1000) -> DataFrame:
    """New rows of the parquet files arriving in a folder."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    return reader.option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def stream_detect(lines: DataFrame, config: SourceConfig, rules: list[Rule], default_year: int) -> DataFrame:
    """Lines to alerts; no state."""
    return detect(parse_source(lines, config, default_year), rules)


def stream_dedup(alerts: DataFrame, window_seconds: int = 3600) -> DataFrame:
    """First alert of each rule, address and user; a repeat passes again once the window has expired."""
    return alerts.withWatermark("ts", f"{window_seconds} seconds").dropDuplicatesWithinWatermark(
        ["RULE_ID", "ip_address", "username"]
    )


def stream_throttle(alerts: DataFrame, count: int = 5, window_seconds: int = 300, delay: str = DELAY) -> DataFrame:
    """Alerts per rule and window with how many pass and how many are held back."""
    counts = (
        alerts.withWatermark("ts", delay)
        .groupBy(F.window("ts", f"{window_seconds} seconds"), "RULE_ID")
        .agg(F.count("*").alias("alerts"))
    )
    return counts.select(
        F.col("window.start").alias("window_start"),
        "RULE_ID",
        F.least("alerts", F.lit(count)).alias("passed"),
        F.greatest(F.col("alerts") - count, F.lit(0)).alias("held"),
    )


_THROTTLE_STATE = "passed long"


def stream_throttle_alerts(
    alerts: DataFrame, count: int = 5, window_seconds: int = 300, row_id: str = "event_id", delay: str = DELAY
) -> DataFrame:
    """The alerts that pass: the first ``count`` of each rule and window, in order of time inside a micro-batch.

    A key's state is one number, dropped with its window.  Of a key's alerts in one
    micro-batch no more than ``count`` are held at a time.  Alerts without a time are in no
    window and all pass.
    """
    columns = alerts.columns
    keyed = alerts.where(F.col("ts").isNotNull()).withWatermark("ts", delay).withColumn("_window", F.window("ts", f"{window_seconds} seconds")["end"])

    def first(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        passed = state.get[0] if state.exists else 0
        kept = None
        for batch in batches:
            both = batch[columns] if kept is None else pd.concat([kept, batch[columns]])
            kept = both.sort_values(["ts", row_id]).head(max(count - passed, 0))
        kept = kept if kept is not None else pd.DataFrame(columns=columns)
        state.update((passed + len(kept),))
        end = int(pd.Timestamp(key[1]).tz_localize("UTC").timestamp() * 1000)
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        yield kept

    passed = keyed.groupBy("RULE_ID", "_window").applyInPandasWithState(
        first, alerts.schema, _THROTTLE_STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
    return passed.union(alerts.where(F.col("ts").isNull()))


def stream_correlate_ip(alerts: DataFrame, gap_seconds: int = 300, delay: str = DELAY) -> DataFrame:
    """Sessions of more than one alert per address."""
    sessions = (
        alerts.where(present(["ip_address"]))
        .withWatermark("ts", delay)
        .groupBy(F.session_window("ts", f"{gap_seconds} seconds"), "ip_address")
        .agg(F.count("*").alias("event_count"), max_severity("SEVERITY").alias("severity"), F.max("ts").alias("end_time"))
    )
    return sessions.where("event_count > 1").select(
        "ip_address", F.col("session_window.start").alias("start_time"), "end_time", "event_count", "severity"
    )


def stream_frequency(events: DataFrame, size: str = "1 hour", slide: str | None = None, delay: str = DELAY) -> DataFrame:
    """Events per window; ``slide`` makes the windows overlap."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    counts = events.withWatermark("ts", delay).groupBy(window).agg(F.count("*").alias("event_count"))
    return counts.select(F.col("window.start").alias("window_start"), "event_count")


def write_stream(df: DataFrame, path: str, checkpoint: str, seconds: int | None = None) -> StreamingQuery:
    """Append to parquet, exactly once; restarts resume from the checkpoint.

    Without an interval everything available is processed and the query ends.
    """
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if seconds is None else {"processingTime": f"{seconds} seconds"}
    return writer.outputMode("append").trigger(**trigger).start()


def for_each_change(df: DataFrame, callback, checkpoint: str, seconds: int | None = None) -> StreamingQuery:
    """Call ``callback(batch, batch_id)`` for every micro-batch."""
    trigger = {"availableNow": True} if seconds is None else {"processingTime": f"{seconds} seconds"}
    return df.writeStream.foreachBatch(callback).option("checkpointLocation", checkpoint).trigger(**trigger).start()
