"""Order helpers against plain windows, with chunks small enough to matter."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracehold.operators.ordered import drop_helpers, next_value, numbered, trailing, with_position
from tracehold.operators.quantiles import exact_quantile
from tracehold.operators.sessions import Measure, first_of_bursts, session_members, sessionize


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = []
    for i in range(3000):
        # One key holds a third of the rows; times repeat.
        key = "hot" if rng.random() < 0.34 else f"k{rng.randrange(40)}"
        data.append((i, key, 1_700_000_000 + rng.randrange(200_000), rng.randrange(5), rng.random()))
    df = spark.createDataFrame(data, "event_id long, key string, s long, kind int, x double")
    return df.withColumn("ts", F.timestamp_seconds("s")).cache()


def as_set(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_positions_are_dense(rows):
    got = with_position(rows, ["key", "ts", "event_id"])
    want = rows.withColumn("_pos", F.row_number().over(Window.orderBy("key", "ts", "event_id")) - 1)
    assert as_set(got, "event_id", "_pos") == as_set(want, "event_id", "_pos")


def test_numbered(rows):
    got = numbered(rows, ["key"], ["ts", "event_id"], "n")
    want = rows.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("ts", "event_id")))
    assert as_set(got, "event_id", "n") == as_set(want, "event_id", "n")


@pytest.mark.parametrize("size", [7, 100, 10_000])
@pytest.mark.parametrize("keys", [[], ["key"]])
def test_trailing_frame(rows, keys, size):
    copies, order = trailing(rows, keys, ["ts", "event_id"], 4, chunk_rows=size)
    got = drop_helpers(copies.withColumn("v", F.sum("kind").over(order.rowsBetween(-4, 0))))
    frame = Window.partitionBy(*keys).orderBy("ts", "event_id").rowsBetween(-4, 0)
    want = rows.withColumn("v", F.sum("kind").over(frame))
    assert as_set(got, "event_id", "v") == as_set(want, "event_id", "v")


@pytest.mark.parametrize("size", [5, 64, 10_000])
def test_next_value(rows, size):
    value = F.when(F.col("kind") == 0, F.col("event_id"))
    got = next_value(rows, ["key"], ["ts", "event_id"], value, "v", chunk_rows=size)
    ahead = Window.partitionBy("key").orderBy("ts", "event_id").rowsBetween(1, Window.unboundedFollowing)
    want = rows.withColumn("v", F.first(value, ignorenulls=True).over(ahead))
    key = lambda df: sorted((r[0], -1 if r[1] is None else r[1]) for r in df.select("event_id", "v").collect())
    assert key(got) == key(want)


def naive_sessions(rows, keys, gap):
    w = Window.partitionBy(*keys).orderBy("ts", "event_id")
    opened = F.when(F.col("s") - F.lag("s").over(w) <= gap, 0).otherwise(1)
    return rows.withColumn("_o", opened).withColumn("run", F.sum("_o").over(w))


@pytest.mark.parametrize("keys", [[], ["key"]])
@pytest.mark.parametrize("gap", [1, 60, 900])
def test_sessions(rows, keys, gap, monkeypatch):
    monkeypatch.setattr("tracehold.operators.sessions.BLOCK_CELLS", 3)
    kinds = {"kinds": Measure("set", F.col("kind")), "top": Measure("max", F.col("x"))}
    got = sessionize(rows, keys, gap, kinds)
    want = naive_sessions(rows, keys, gap).groupBy(*keys, "run").agg(
        F.min("ts").alias("session_start"),
        F.max("ts").alias("session_end"),
        F.count("*").alias("event_count"),
        F.array_sort(F.collect_set("kind")).alias("kinds"),
        F.max("x").alias("top"),
    )
    columns = [*keys, "session_start", "session_end", "event_count", "kinds", "top"]
    assert as_set(got, *columns) == as_set(want, *columns)
    members = session_members(rows, keys, gap, "event_id")
    starts = naive_sessions(rows, keys, gap)
    starts = starts.withColumn("session_start", F.min("ts").over(Window.partitionBy(*keys, "run")))
    assert as_set(members, "event_id", "session_start") == as_set(starts, "event_id", "session_start")


def test_first_of_bursts(rows, monkeypatch):
    monkeypatch.setattr("tracehold.operators.sessions.BLOCK_CELLS", 3)
    got = first_of_bursts(rows, ["key"], 600, "event_id")
    w = Window.partitionBy("key").orderBy("ts", "event_id")
    before = F.lag("s").over(w)
    want = rows.withColumn("_b", before).where("_b is null or s - _b > 600")
    assert as_set(got, "event_id", "x") == as_set(want, "event_id", "x")


@pytest.mark.parametrize("q", [0.0, 0.05, 0.5, 0.77, 1.0])
@pytest.mark.parametrize("final", [10, 500, 100_000])
def test_exact_quantile(rows, q, final):
    want = rows.select(F.percentile("x", q)).first()[0]
    assert exact_quantile(rows, "x", q, final) == pytest.approx(want)


def test_exact_quantile_with_ties(rows):
    for q in (0.0, 0.2, 0.5, 0.9):
        assert exact_quantile(rows, "kind", q, 3) == rows.select(F.percentile("kind", q)).first()[0]
