"""All correlation results side by side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracehold.operators import chains, correlate


def correlate_all(alerts: DataFrame, window_seconds: float = 300, row_id: str = "event_id") -> DataFrame:
    """Rows of every method as (correlation_type, value, event_count, start_time, end_time, severity)."""
    none = F.lit(None).cast("string")
    found = [
        ("ip_address", correlate.correlate_by_ip(alerts), F.col("ip_address"), F.col("event_count")),
        ("time_window", correlate.correlate_by_time_window(alerts, window_seconds), none, F.col("event_count")),
        (
            "attack_chain",
            chains.match_patterns(alerts, row_id=row_id),
            F.col("pattern_name"),
            F.size("chain").cast("long"),
        ),
        ("multi_stage_attack", correlate.multi_stage_attacks(alerts), F.col("attack_pattern"), F.col("event_count")),
        ("attack_velocity", correlate.attack_velocity(alerts, row_id=row_id), F.col("category"), F.col("event_count")),
    ]
    rows = [
        df.select(
            F.lit(kind).alias("correlation_type"),
            value.alias("value"),
            count.alias("event_count"),
            "start_time",
            "end_time",
            "severity",
        )
        for kind, df, value, count in found
    ]
    return reduce(DataFrame.unionByName, rows)
