"""The stored indicators against a plain dictionary; what an update touches."""

import random
from datetime import datetime
from pathlib import Path

from pyspark.sql import functions as F

from tracehold.sources.indicator_store import read_store, store_version, upsert_store

SCHEMA = "type string, indicator string, is_malicious boolean, threat_type string, score double, source string"


def feed(seed, n):
    draw = random.Random(seed)
    return [(draw.choice(["ip", "domain"]), f"i{draw.randint(0, 60)}", draw.random() < 0.5, draw.choice(["a", None]), float(draw.randint(0, 9)), "s") for _ in range(n)]


def stamp(day):
    return F.lit(datetime(2024, 1, day)).cast("timestamp")


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path, "data").rglob("*.parquet")}


def test_updates_equal_a_dictionary(spark, tmp_path):
    path, want = str(tmp_path), {}
    assert store_version(spark, path) is None and read_store(spark, path).count() == 0
    for day in (2, 1, 3, 4):  # the second feed is older than the first
        rows = feed(day, 30)
        upsert_store(spark, path, spark.createDataFrame(rows, SCHEMA), stamp(day), buckets=16)
        for t, i, bad, threat, score, source in rows:
            low = lambda x: (x is not None, x or "")
            row = (datetime(2024, 1, day), score, bad, low(threat), source)
            want[t, i] = max(want.get((t, i), row), row)
        got = {(r.type, r.indicator): (r.last_updated, r.score, r.is_malicious, (r.threat_type is not None, r.threat_type or ""), r.source) for r in read_store(spark, path).collect()}
        assert got == want


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = str(tmp_path)
    upsert_store(spark, path, spark.createDataFrame(feed(5, 300), SCHEMA), stamp(1), buckets=16)
    first = files(path)
    one = spark.createDataFrame([("ip", "i1", True, "new", 9.0, "s")], SCHEMA)
    assert upsert_store(spark, path, one, stamp(2)) == 1
    second = files(path)
    assert first.items() <= second.items()
    assert {Path(p).parts[1] for p in second.keys() - first.keys()} == {Path(p).parts[1] for p in second if "version=1" in p} and len({Path(p).parts[1] for p in second.keys() - first.keys()}) == 1
    # Again, or older: nothing is written.
    assert upsert_store(spark, path, one, stamp(2)) == 1 and upsert_store(spark, path, one, stamp(1)) == 1
    assert files(path) == second
    assert read_store(spark, path, 0).where("threat_type = 'new'").count() == 0


def test_a_failed_update_is_not_seen(spark, tmp_path):
    path = str(tmp_path)
    rows = spark.createDataFrame(feed(6, 100), SCHEMA)
    upsert_store(spark, path, rows, stamp(1), buckets=4)
    before = sorted(map(repr, read_store(spark, path).collect()))
    upsert_store(spark, path, spark.createDataFrame(feed(7, 100), SCHEMA), stamp(2))
    after = sorted(map(repr, read_store(spark, path).collect()))
    (tmp_path / "pointer" / "1" / "_SUCCESS").unlink()  # as if the job had ended before its pointer
    assert store_version(spark, path) == 0 and sorted(map(repr, read_store(spark, path).collect())) == before
    assert upsert_store(spark, path, spark.createDataFrame(feed(7, 100), SCHEMA), stamp(2)) == 1
    assert sorted(map(repr, read_store(spark, path).collect())) == after != before
