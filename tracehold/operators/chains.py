"""Attack chains: an alert of step one followed by alerts of the later steps.

All conditions are equalities with the whole chain, so a chain lives inside one
key.  An alert of step i can continue when some viable alert of step i+1 of its
key is at most ``max_gap`` later.  The gap is only bounded from above, hence the
alert a chain takes next is simply the earliest viable one of the key: one
grouped minimum per step, going backwards, and no pair of alerts is built.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracehold.functions.times import micros, seconds_between
from tracehold.operators.correlate import anchored, key_columns, present
from tracehold.operators.ordered import next_value
from tracehold.operators.skew import join_unique


@dataclass(frozen=True)
class Step:
    rule_pattern: str = ".*"
    min_count: int = 1
    max_time: float | None = None


@dataclass(frozen=True)
class AttackPattern:
    pattern_id: str
    name: str
    sequence: tuple[Step, ...]
    conditions: tuple[str, ...] = ()
    max_gap: float = 3600
    severity: str = "MEDIUM"


# The built-in chains.
DEFAULT_CHAINS = (
    AttackPattern(
        "brute_force_to_privilege",
        "Brute Force to Privilege Escalation",
        (Step("BF-.*", 3, 300), Step("PE-.*", 1, 1800)),
        ("same_ip_address",),
        3600,
        "HIGH",
    ),
    AttackPattern(
        "unauthorized_to_malware",
        "Unauthorized Access to Malware Execution",
        (Step("UA-.*", 1), Step("MW-.*", 1)),
        ("same_ip_address",),
        1800,
        "HIGH",
    ),
)


def load_patterns(text: str) -> tuple[AttackPattern, ...]:
    """Patterns from a JSON document ``{id: {name, sequence, conditions, max_gap, severity}}``."""
    patterns = []
    for pattern_id, body in json.loads(text).items():
        steps = tuple(
            Step(s.get("rule_pattern", ".*"), s.get("min_count", 1), s.get("max_time")) for s in body.get("sequence", [])
        )
        patterns.append(
            AttackPattern(
                pattern_id,
                body["name"],
                steps,
                tuple(body.get("conditions", [])),
                body.get("max_gap", 3600),
                body.get("severity", "MEDIUM"),
            )
        )
    return tuple(patterns)


def match_patterns(
    alerts: DataFrame,
    patterns=DEFAULT_CHAINS,
    row_id: str = "event_id",
    ordered: bool = False,
    per_key_count: bool = False,
) -> DataFrame:
    """One row per step-one alert that starts a complete chain.

    ``chain`` lists time, row id and rule of the chain's alerts.  Every step
    needs ``min_count`` alerts over the whole input, or per key with
    ``per_key_count``.  ``ordered`` also asks each step not to precede the one
    before it.
    """
    build = _ordered_chain if ordered else _chain
    return reduce(DataFrame.unionByName, [build(alerts, p, row_id, per_key_count) for p in patterns])


def _steps(alerts: DataFrame, pattern: AttackPattern, row_id: str, per_key_count: bool):
    """Alerts flagged per step, with steps that lack ``min_count`` alerts gated off."""
    keys = key_columns(pattern.conditions)
    flags = {f"_s{i}": anchored(F.col("RULE_ID"), s.rule_pattern) for i, s in enumerate(pattern.sequence)}
    rows = alerts.where(F.col("ts").isNotNull()).select(
        *keys, F.struct(F.col("ts"), F.col(row_id).alias("row_id"), F.col("RULE_ID").alias("rule_id")).alias("_e")
    )
    rows = rows.withColumns({n: anchored(F.col("_e.rule_id"), s.rule_pattern) for n, s in zip(flags, pattern.sequence)})
    if len(pattern.sequence) > 1 or per_key_count:
        rows = rows.where(present(keys))
    rows = rows.where(reduce(lambda a, b: a | b, [F.col(n) for n in flags]))
    counts = [F.count_if(F.col(n)).alias(f"_c{n}") for n in flags]
    enough = reduce(
        lambda a, b: a & b, [F.col(f"_c_s{i}") >= s.min_count for i, s in enumerate(pattern.sequence)]
    )
    if per_key_count:
        good = rows.groupBy(*keys).agg(*counts).where(enough).select(*keys)
        rows = join_unique(rows, good, keys, F.col("_e")) if keys else rows
    # The gate over the whole input looks at alerts with missing keys as well.
    gate = alerts.select(
        *[F.count_if(f).alias(f"_c{n}") for n, f in flags.items()]
    ).select(enough.alias("ok"))
    return keys, rows.where(gate.scalar())


def _result(rows: DataFrame, pattern: AttackPattern, keys: list[str]) -> DataFrame:
    """``rows`` carries ``_chain``, an array of the chain's alerts."""
    first, last = F.element_at("_chain", 1), F.element_at("_chain", -1)
    return rows.select(
        F.lit(pattern.pattern_id).alias("pattern_id"),
        F.lit(pattern.name).alias("pattern_name"),
        (F.col("ip_address") if "ip_address" in keys else F.lit(None).cast("string")).alias("ip_address"),
        (F.col("username") if "username" in keys else F.lit(None).cast("string")).alias("username"),
        F.col("_chain").alias("chain"),
        first["ts"].alias("start_time"),
        last["ts"].alias("end_time"),
        seconds_between(last["ts"], first["ts"]).alias("duration_seconds"),
        F.lit(1.0).alias("confidence"),
        F.lit(pattern.severity).alias("severity"),
    )


def _chain(alerts: DataFrame, pattern: AttackPattern, row_id: str, per_key_count: bool) -> DataFrame:
    keys, rows = _steps(alerts, pattern, row_id, per_key_count)
    gap = int(pattern.max_gap * 1_000_000)
    keyed = keys or ["_all"]
    if not keys:
        rows = rows.withColumn("_all", F.lit(1))
    tail = None  # per key: the chain the later steps would take
    for i in reversed(range(len(pattern.sequence))):
        candidates = rows.where(F.col(f"_s{i}"))
        if tail is None:
            candidates = candidates.withColumn("_chain", F.array("_e"))
        else:
            candidates = join_unique(candidates, tail, keyed, F.col("_e"))
            near = micros(F.element_at("_tail", 1)["ts"]) - micros("_e.ts") <= gap
            candidates = candidates.where(near).withColumn("_chain", F.concat(F.array("_e"), F.col("_tail"))).drop("_tail")
        if i:
            tail = candidates.groupBy(*keyed).agg(F.min_by("_chain", "_e").alias("_tail"))
    return _result(candidates, pattern, keys)


def _ordered_chain(alerts: DataFrame, pattern: AttackPattern, row_id: str, per_key_count: bool) -> DataFrame:
    """Each step takes the first viable alert after the one before it (as-of join)."""
    keys, rows = _steps(alerts, pattern, row_id, per_key_count)
    gap = int(pattern.max_gap * 1_000_000)
    last = len(pattern.sequence) - 1
    rows = rows.withColumn("_chain", F.when(F.col(f"_s{last}"), F.array("_e")))
    for i in reversed(range(last)):
        order = ["_e.ts", "_e.row_id", "_e.rule_id"]
        rows = next_value(rows, keys, order, F.col("_chain"), "_tail")
        near = micros(F.element_at("_tail", 1)["ts"]) - micros("_e.ts") <= gap
        mine = F.when(F.col(f"_s{i}") & near, F.concat(F.array("_e"), F.col("_tail")))
        rows = rows.withColumn("_chain", mine).drop("_tail")
    return _result(rows.where(F.col("_chain").isNotNull()), pattern, keys)
