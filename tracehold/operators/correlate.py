"""Grouping alerts that belong together."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracehold.functions.severity import max_severity, severity_level, severity_name
from tracehold.functions.times import micros, seconds_between
from tracehold.operators.ordered import drop_helpers, trailing
from tracehold.operators.sessions import Measure, session_members, sessionize
from tracehold.operators.skew import join_unique

# Conditions and the column each compares.
CONDITION_COLUMNS = {"same_ip_address": "ip_address", "same_username": "username"}


@dataclass(frozen=True)
class Stage:
    category: str
    rules: tuple[str, ...]
    min_count: int = 1


@dataclass(frozen=True)
class StagedPattern:
    name: str
    stages: tuple[Stage, ...]
    max_time_gap: float
    conditions: tuple[str, ...] = ()
    severity: str = "HIGH"


# The built-in multi-stage patterns.
MULTI_STAGE_PATTERNS = (
    StagedPattern(
        "Reconnaissance to Exploitation to Persistence",
        (
            Stage("reconnaissance", ("UA-.*", "BF-SSH-.*"), 3),
            Stage("exploitation", ("PE-.*",), 1),
            Stage("persistence", ("MW-PERS-.*",), 1),
        ),
        3600,
        ("same_ip_address", "same_username"),
        "CRITICAL",
    ),
    StagedPattern(
        "Data Exfiltration Campaign",
        (
            Stage("access", ("UA-.*",), 1),
            Stage("internal_recon", ("UA-FILE-.*",), 2),
            Stage("exfiltration", ("DE-.*",), 1),
        ),
        7200,
        ("same_ip_address",),
        "HIGH",
    ),
)


def anchored(rule_id: Column, pattern: str) -> Column:
    """Match from the start of the rule id, as ``re.match`` does."""
    return rule_id.rlike(f"^(?:{pattern})")


def key_columns(conditions) -> list[str]:
    unknown = [c for c in conditions if c not in CONDITION_COLUMNS]
    if unknown:
        raise ValueError(f"unknown conditions: {unknown}")
    return [CONDITION_COLUMNS[c] for c in conditions]


def present(keys: list[str]) -> Column:
    """All key columns hold a value; missing and empty keys join nothing."""
    return reduce(and_, [F.col(k).isNotNull() & (F.col(k) != "") for k in keys], F.lit(True))


def correlate_by_ip(alerts: DataFrame) -> DataFrame:
    """Addresses with more than one alert."""
    groups = (
        alerts.where(present(["ip_address"]))
        .groupBy("ip_address")
        .agg(
            F.count("*").alias("event_count"),
            max_severity("SEVERITY").alias("severity"),
            F.min("ts").alias("start_time"),
            F.max("ts").alias("end_time"),
        )
    )
    return groups.where("event_count > 1")


def ip_group_members(alerts: DataFrame, row_id: str = "event_id") -> DataFrame:
    """The alerts of every address group, one row each."""
    groups = correlate_by_ip(alerts).select("ip_address", F.col("event_count").alias("group_size"))
    return join_unique(alerts, groups, ["ip_address"], F.struct(row_id, "RULE_ID"))


def correlate_by_time_window(alerts: DataFrame, window_seconds: float = 300) -> DataFrame:
    """Runs of more than one alert whose consecutive gaps are at most the window."""
    level = {"level": Measure("max", severity_level("SEVERITY"))}
    runs = sessionize(alerts, [], window_seconds, level).where("event_count > 1")
    return runs.select(
        F.col("session_start").alias("start_time"),
        F.col("session_end").alias("end_time"),
        "event_count",
        severity_name("level").alias("severity"),
    )


def time_window_members(alerts: DataFrame, window_seconds: float = 300, row_id: str = "event_id") -> DataFrame:
    """The alerts of every run, one row each; single alerts are left out."""
    members = session_members(alerts, [], window_seconds, row_id)
    runs = correlate_by_time_window(alerts, window_seconds).select(F.col("start_time").alias("session_start"))
    return join_unique(members, runs, ["session_start"], F.struct(row_id, "RULE_ID"))


def multi_stage_attacks(alerts: DataFrame, patterns=MULTI_STAGE_PATTERNS) -> DataFrame:
    """Key groups in which every stage occurs often enough and soon enough.

    An alert counts once per rule expression of a stage it matches, so in
    overlapping stages it counts more than once.  One aggregation per pattern.
    """
    found = [_staged(alerts, p) for p in patterns]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)


def _staged(alerts: DataFrame, pattern: StagedPattern) -> DataFrame:
    keys = key_columns(pattern.conditions)
    per_stage, any_stage = [], F.lit(False)
    for i, stage in enumerate(pattern.stages):
        tests = [anchored(F.col("RULE_ID"), r) for r in stage.rules]
        hits = reduce(lambda a, b: a + b, [F.coalesce(t.cast("int"), F.lit(0)) for t in tests])
        per_stage += [
            F.sum(hits).alias(f"_n{i}"),
            F.min(F.when(hits > 0, F.col("ts"))).alias(f"_first{i}"),
            F.max(F.when(hits > 0, F.col("ts"))).alias(f"_last{i}"),
        ]
        any_stage = any_stage | (hits > 0)
    rows = alerts.where(any_stage & present(keys) & F.col("ts").isNotNull())
    groups = rows.groupBy(*keys).agg(
        F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), *per_stage
    )
    steps = range(len(pattern.stages))
    enough = reduce(and_, [F.col(f"_n{i}") >= s.min_count for i, s in enumerate(pattern.stages)])
    soon = reduce(
        and_,
        [micros(f"_first{i}") - micros(f"_last{i - 1}") <= int(pattern.max_time_gap * 1_000_000) for i in steps if i],
        F.lit(True),
    )
    return groups.where(enough & soon).select(
        F.lit(pattern.name).alias("attack_pattern"),
        *keys,
        reduce(lambda a, b: a + b, [F.col(f"_n{i}") for i in steps]).alias("event_count"),
        "start_time",
        "end_time",
        F.lit(pattern.severity).alias("severity"),
    )


def attack_velocity(
    alerts: DataFrame,
    ratio: float = 0.2,
    min_events: int = 10,
    per_category: bool = False,
    row_id: str = "event_id",
    **chunking,
) -> DataFrame:
    """Rule categories whose alerts come unusually regularly.

    The interval of an alert reaches back to the previous alert of any
    category (``per_category`` limits it to its own).  Categories are the two or
    three capitals in front of the rule id.
    """
    timed = alerts.where(F.col("ts").isNotNull()).select(
        "ts", row_id, "RULE_ID", F.regexp_extract("RULE_ID", r"^([A-Z]{2,3})-", 1).alias("category")
    )
    keys = ["category"] if per_category else []
    copies, order = trailing(timed, keys, ["ts", row_id, "RULE_ID"], 1, **chunking)
    spaced = drop_helpers(copies.withColumn("gap", seconds_between(F.col("ts"), F.lag("ts").over(order))))
    stats = (
        spaced.where("category <> ''")
        .groupBy("category")
        .agg(
            F.count("*").alias("event_count"),
            F.avg("gap").alias("mean_interval"),
            F.stddev_samp("gap").alias("std_interval"),
            F.min("gap").alias("min_interval"),
            F.min("ts").alias("start_time"),
            F.max("ts").alias("end_time"),
        )
    )
    regular = (F.col("std_interval") < F.col("mean_interval") * ratio) & (F.col("event_count") > min_events)
    return stats.where(regular).withColumn("severity", F.when(F.col("min_interval") < 1.0, "HIGH").otherwise("MEDIUM"))


def first_step_chain(alerts: DataFrame, name: str, prefixes: list[str], max_time_gap: float) -> DataFrame:
    """The first alert of each rule-id prefix, if all exist and follow closely enough."""
    firsts = [F.min(F.when(F.col("RULE_ID").startswith(p), F.col("ts"))).alias(f"_t{i}") for i, p in enumerate(prefixes)]
    row = alerts.agg(*firsts)
    steps = range(len(prefixes))
    complete = reduce(and_, [F.col(f"_t{i}").isNotNull() for i in steps])
    soon = reduce(
        and_,
        [micros(f"_t{i}") - micros(f"_t{i - 1}") <= int(max_time_gap * 1_000_000) for i in steps if i],
        F.lit(True),
    )
    last = f"_t{len(prefixes) - 1}"
    return row.where(complete & soon).select(
        F.lit(name).alias("pattern_name"),
        F.col("_t0").alias("start_time"),
        F.col(last).alias("end_time"),
        seconds_between(last, "_t0").alias("duration_seconds"),
        F.lit("HIGH").alias("severity"),
    )
