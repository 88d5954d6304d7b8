"""The tables behind the charts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracehold.functions.times import DAY_NAMES
from tracehold.operators.ordered import numbered
from tracehold.operators.skew import join_unique

TOP_RULES = 20


def timeline_data(
    events: DataFrame, category: str | None = None, row_id: str = "event_id", ts: str = "ts"
) -> DataFrame:
    """Events with the lane of their category; lanes count from 0 by first appearance.

    Without a category all events share lane 0.
    """
    if category is None:
        return events.where(F.col(ts).isNotNull()).select(row_id, ts, F.lit(0).cast("long").alias("lane"))
    firsts = (
        events.where(F.col(ts).isNotNull())
        .groupBy(category)
        .agg(F.min(F.struct(F.col(ts).alias("t"), F.col(row_id).alias("i"))).alias("_first"))
    )
    ranked = numbered(firsts, [], ["_first", category], "_lane")
    lanes = ranked.select(category, (F.col("_lane") - 1).alias("lane"))
    return join_unique(events.where(F.col(ts).isNotNull()), lanes, [category], F.col(row_id)).select(
        row_id, ts, category, "lane"
    )


def alert_heatmap(alerts: DataFrame, ts: str = "ts") -> DataFrame:
    """Alerts per weekday (rows, Monday first) and hour (columns h00 to h23), zeros filled."""
    hours = [F.count_if(F.hour(ts) == h).alias(f"h{h:02d}") for h in range(24)]
    counts = alerts.where(F.col(ts).isNotNull()).groupBy(F.weekday(ts).alias("day_index")).agg(*hours)
    days = alerts.sparkSession.createDataFrame(list(enumerate(DAY_NAMES)), "day_index int, day string")
    filled = days.join(counts, "day_index", "left")
    names = [f"h{h:02d}" for h in range(24)]
    return filled.select("day_index", "day", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def rule_distribution(alerts: DataFrame, top: int = TOP_RULES) -> DataFrame:
    """The most frequent rules with their most common severity; ties go by name."""
    pairs = alerts.groupBy("RULE_ID", "SEVERITY").agg(F.count("*").alias("n"))
    rules = pairs.groupBy("RULE_ID").agg(
        F.sum("n").alias("event_count"), F.min_by("SEVERITY", F.struct(-F.col("n"), "SEVERITY")).alias("severity")
    )
    return rules.orderBy(F.desc("event_count"), "RULE_ID").limit(top)


def communication_edges(pairs: DataFrame, source: str = "source_ip", target: str = "target_ip") -> DataFrame:
    """Undirected edges with their number of records."""
    return (
        pairs.where(F.col(source).isNotNull() & F.col(target).isNotNull())
        .groupBy(F.least(source, target).alias("src"), F.greatest(source, target).alias("dst"))
        .agg(F.count("*").alias("weight"))
    )


def node_degrees(edges: DataFrame) -> DataFrame:
    """Distinct edges per node; a loop counts twice."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def message_endpoints(logs: DataFrame) -> DataFrame:
    """``src=`` and ``dst=`` addresses named in messages."""
    return logs.where(F.col("message").rlike("src=[^ ]+ .*dst=[^ ]+")).select(
        F.regexp_extract("message", "src=([^ ]+)", 1).alias("source_ip"),
        F.regexp_extract("message", "dst=([^ ]+)", 1).alias("target_ip"),
    )
