"""State carried in tables: ten micro-batches, restarts and repeated batches against one batch run."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracehold.functions.severity import severity_level
from tracehold.operators.alerts import suppress_duplicates
from tracehold.operators.chains import AttackPattern, Step, match_patterns
from tracehold.operators.sessions import Measure, sessionize
from tracehold.streaming import carried, jobs

START = datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp, RULE_ID string, SEVERITY string, ip_address string, username string"
CHAIN = AttackPattern("p", "P", (Step("A.*"), Step("B.*"), Step("C.*")), ("same_ip_address",), 900, "HIGH")
DELAY = 600


def alerts(seed, n=500, hours=10):
    """Ties in time, several alerts of one event, missing keys and times, a hot address."""
    draw, rows = random.Random(seed), []
    for i in range(n):
        ts = START + timedelta(seconds=draw.randint(0, hours * 360) * 10)
        row = (ts if draw.random() > 0.02 else None, draw.choice(["hot", "hot", "b", "c", "", None]), draw.choice(["u", "v", None]))
        for rule in draw.sample(["A-1", "B-1", "C-1", "A-2", "X"], draw.choice([1, 1, 2, 3])):
            rows.append((i, row[0], rule, draw.choice(["LOW", "HIGH"]), row[1], row[2]))
    return rows


def in_batches(rows, n, seed):
    """Slices of arrival: an alert arrives up to the delay after its time."""
    draw = random.Random(seed)
    arrival = [((r[1] or START) - START).total_seconds() + draw.randint(0, DELAY - 1) for r in rows]
    width = max(arrival) / n + 1
    out = [[] for _ in range(n)]
    for r, at in sorted(zip(rows, arrival), key=lambda x: x[1]):
        out[int(at // width)].append(r)
    return out


def run(spark, step, batches, path, again=()):
    merge = carried.merge_batch(step, path)
    for n, batch in enumerate(batches):
        df = spark.createDataFrame(batch, SCHEMA)
        merge(df, n)
        if n in again:
            merge(df, n)


def horizon(rows):
    return max(r[1] for r in rows if r[1]) - timedelta(seconds=DELAY)


def as_set(df):
    rows = [repr(r) for r in df.select(*sorted(df.columns)).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("seed,keys", [(1, []), (2, ["ip_address"])])
def test_sessions(spark, tmp_path, seed, keys):
    rows, level = alerts(seed), {"level": Measure("max", severity_level("SEVERITY"))}
    run(spark, carried.Sessions(keys, 60, level, DELAY), in_batches(rows, 10, seed), str(tmp_path), again=(0, 4, 9))
    whole = spark.createDataFrame(rows, SCHEMA)
    if keys:
        whole = whole.where("ip_address <> ''")
    want = sessionize(whole, keys, 60, level).where(F.col("session_end") + F.expr("INTERVAL 60 SECONDS") <= F.lit(horizon(rows)))
    got = carried.results(spark, str(tmp_path))
    assert as_set(got) == as_set(want) and want.count() > 20
    assert carried.results(spark, str(tmp_path), "late").count() == 0
    assert carried.versions(spark, str(tmp_path)) == [8, 9]


def test_suppression(spark, tmp_path):
    rows = alerts(3)
    batches = in_batches(rows, 10, 3)
    run(spark, carried.Suppress(300, delay_seconds=DELAY), batches, str(tmp_path), again=(1, 9))
    whole = suppress_duplicates(spark.createDataFrame(rows, SCHEMA), 300)
    want = whole.where(F.col("ts").isNull() | (F.col("ts") <= F.lit(horizon(rows))))
    got = carried.results(spark, str(tmp_path)).select(*whole.columns)
    key = ["RULE_ID", "ip_address", "username", "ts"]  # of alerts at one time any may stand for all
    assert sorted(map(repr, got.select(*key).collect())) == sorted(map(repr, want.select(*key).collect()))
    assert got.where("ts is null").count() == sum(r[1] is None for r in rows) > 0


def test_chains(spark, tmp_path):
    rows = alerts(4, n=700, hours=14)
    run(spark, carried.Chain(CHAIN, delay_seconds=DELAY), in_batches(rows, 10, 4), str(tmp_path), again=(2, 9))
    whole = match_patterns(spark.createDataFrame(rows, SCHEMA), [CHAIN], ordered=True)
    want = whole.where(F.col("start_time") <= F.lit(horizon(rows) - timedelta(seconds=1800)))
    got = carried.results(spark, str(tmp_path))
    assert as_set(got) == as_set(want) and want.count() > 50
    with pytest.raises(ValueError):
        twice = AttackPattern("q", "Q", (Step("A.*", 2), Step("B.*")), ("same_ip_address",))
        run(spark, carried.Chain(twice), [rows[:3]], str(tmp_path / "q"))


def test_groups_over_restarts(spark, tmp_path):
    """Real queries, stopped and started again, each with new files; one run finds nothing new."""
    rows, path = alerts(5, n=200), str(tmp_path)
    step = carried.Groups(["ip_address"], {"level": Measure("max", severity_level("SEVERITY")), "last": Measure("max", F.col("ts"))})
    schema = spark.createDataFrame([], SCHEMA).schema
    for batch in [*in_batches(rows, 3, 5), None]:
        if batch:
            spark.createDataFrame(batch, SCHEMA).write.mode("append").parquet(f"{path}/in")
        carried.carry(jobs.stream_table(spark, f"{path}/in", schema, "*.parquet", 1000), step, path).awaitTermination()
    whole = spark.createDataFrame(rows, SCHEMA).where("ip_address <> ''").groupBy("ip_address")
    want = whole.agg(F.count("*").alias("event_count"), F.max(severity_level("SEVERITY")).alias("level"), F.max("ts").alias("last"))
    late = carried.results(spark, path, "late")
    assert late.count() == 0 and as_set(carried.state_table(spark, path, "groups")) == as_set(want)


def test_late_and_empty_batches(spark, tmp_path):
    rows = [(1, START + timedelta(hours=5), "A-1", "LOW", "b", "u")]
    late = [(2, START, "A-1", "LOW", "b", "u"), (3, None, "A-1", "LOW", "b", "u")]
    run(spark, carried.Suppress(300, delay_seconds=DELAY), [[], rows, [], late], str(tmp_path))
    assert [r.event_id for r in carried.results(spark, str(tmp_path), "late").collect()] == [2]
    assert [r.event_id for r in carried.results(spark, str(tmp_path)).collect()] == [3]
    assert [r.event_id for r in carried.state_table(spark, str(tmp_path), "waiting").collect()] == [1]


def test_throttled_stream_keeps_alerts_without_a_time(spark, tmp_path):
    rows = [(i, START + timedelta(seconds=i), "A-1", "LOW", "b", "u") for i in range(8)] + [(9, None, "A-1", "LOW", "b", "u")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/in")
    stream = jobs.stream_table(spark, f"{tmp_path}/in", spark.createDataFrame([], SCHEMA).schema, "*.parquet")
    jobs.write_stream(jobs.stream_throttle_alerts(stream, 5, 300), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [0, 1, 2, 3, 4, 9]
