"""Correlation: worked examples and random comparison with plain search."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tracehold.operators import chains, correlate
from tracehold.operators.timeseries import attack_sequences


def test_by_ip(sample_alerts):
    got = {r.ip_address: (r.event_count, r.severity) for r in correlate.correlate_by_ip(sample_alerts).collect()}
    assert got == {"192.168.1.100": (5, "HIGH"), "192.168.1.102": (2, "MEDIUM")}


@pytest.mark.parametrize(
    "window,expected",
    [
        (300, [("10:00:00", "10:00:30", 3, "MEDIUM"), ("15:00:00", "15:00:10", 2, "MEDIUM")]),
        (3600, [("10:00:00", "10:15:00", 4, "HIGH"), ("14:00:00", "15:00:10", 3, "HIGH")]),
    ],
)
def test_by_time_window(sample_alerts, window, expected):
    rows = correlate.correlate_by_time_window(sample_alerts, window).orderBy("start_time").collect()
    assert [(f"{r.start_time:%H:%M:%S}", f"{r.end_time:%H:%M:%S}", r.event_count, r.severity) for r in rows] == expected


def test_chains(sample_alerts):
    rows = chains.match_patterns(sample_alerts).orderBy("start_time").collect()
    assert [(r.pattern_id, r.ip_address, r.duration_seconds) for r in rows] == [
        ("brute_force_to_privilege", "192.168.1.100", d) for d in (900.0, 885.0, 870.0)
    ]


def test_nothing_else(sample_alerts):
    assert correlate.multi_stage_attacks(sample_alerts).count() == 0
    assert correlate.attack_velocity(sample_alerts).count() == 0
    assert attack_sequences(sample_alerts).count() == 0


def test_velocity_flags_regular_alerts(spark):
    data = [(i, "BF-SSH-001", "HIGH", 1_700_000_000 + 2 * i) for i in range(40)]
    df = spark.createDataFrame(data, "event_id long, RULE_ID string, SEVERITY string, s long").withColumn("ts", F.timestamp_seconds("s"))
    (row,) = correlate.attack_velocity(df, chunk_rows=7).collect()
    assert (row.category, row.event_count, row.mean_interval, row.severity) == ("BF", 40, 2.0, "MEDIUM")


def search(events, pattern, keys):
    """All first-step events with a complete chain, by trying the later steps in time order."""
    import re

    steps = [[e for e in events if re.match(s.rule_pattern, e[2])] for s in pattern.sequence]
    if any(len(found) < s.min_count for found, s in zip(steps, pattern.sequence)):
        return []

    def extend(chain, rest):
        if not rest:
            return chain
        for e in rest[0]:
            if (e[0] - chain[-1][0]).total_seconds() > pattern.max_gap:
                continue
            if all(e[3 + k] and e[3 + k] == c[3 + k] for k in keys for c in chain):
                found = extend(chain + [e], rest[1:])
                if found:
                    return found
        return None

    out = []
    for e in steps[0]:
        found = extend([e], steps[1:])
        if found:
            out.append(tuple(x[1] for x in found))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_chains_like_search(spark, seed):
    rng = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    events = []
    for i in range(150):
        ip = rng.choice(["a", "a", "a", "b", "c", None, ""])
        events.append((base + dt.timedelta(seconds=rng.randrange(2000)), i, rng.choice(["AA-1", "BB-1", "CC-1", "DD-1"]), ip, rng.choice(["u", "v"])))
    events.sort(key=lambda e: (e[0], e[1]))
    df = spark.createDataFrame([(e[0], e[1], e[2], "LOW", e[3], e[4]) for e in events], "ts timestamp, event_id long, RULE_ID string, SEVERITY string, ip_address string, username string")
    n = 1 + seed % 4
    steps = tuple(chains.Step(f"{c}-.*", rng.choice([1, 2])) for c in ["AA", "BB", "CC", "DD"][:n])
    conditions, keys = rng.choice([(("same_ip_address",), [0]), (("same_ip_address", "same_username"), [0, 1]), ((), [])])
    pattern = chains.AttackPattern("p", "p", steps, conditions, rng.choice([60, 300]), "LOW")
    got = sorted(tuple(x["row_id"] for x in r.chain) for r in chains.match_patterns(df, [pattern]).collect())
    assert got == search(events, pattern, keys)


def test_per_key_count_and_loading(sample_alerts):
    text = json.dumps(
        {"p": {"name": "n", "sequence": [{"rule_pattern": "BF-.*", "min_count": 3}, {"rule_pattern": "PE-.*"}], "conditions": ["same_ip_address"], "max_gap": 3600}}
    )
    (pattern,) = chains.load_patterns(text)
    assert pattern.severity == "MEDIUM"
    assert chains.match_patterns(sample_alerts, [pattern], per_key_count=True).count() == 3
    strict = chains.AttackPattern("q", "q", (chains.Step("BF-.*", 4), chains.Step("PE-.*")), ("same_ip_address",), 3600)
    assert chains.match_patterns(sample_alerts, [strict], per_key_count=True).count() == 0
    with pytest.raises(ValueError):
        correlate.key_columns(["same_shoes"])
