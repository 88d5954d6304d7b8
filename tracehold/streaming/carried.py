"""Correlation on streams with state in tables.

A step takes a micro-batch and the tables that the batches before it left, and gives
finished rows and new tables.  It is the batch operator itself, on what is still open
and what has arrived, so a hot key is cut in the same way and rows come out as in one
run over all data.  Version ``n`` of the tables belongs to batch ``n``: a batch that is run
again after a failure reads version ``n - 1`` and writes over its own results, and a
stopped stream goes on from its checkpoint with whatever has arrived since.

Time is the newest event seen less the delay, the horizon.  Rows up to it are complete.
A row at or before the horizon of an earlier batch is late: it is written to ``late`` and
changes nothing else.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracehold.functions.times import micros
from tracehold.operators.alerts import DUPLICATE_KEYS
from tracehold.operators.chains import AttackPattern, match_patterns
from tracehold.operators.correlate import anchored, key_columns, present
from tracehold.operators.sessions import Measure, cell_rows, first_of_bursts, merge_cells, place_cells, sessions_of
from tracehold.operators.skew import join_unique
from tracehold.session import stage
from tracehold.streaming.jobs import for_each_change

#: Versions that stay: a failed batch needs the one before it.
KEPT_VERSIONS = 2


@dataclass
class Clock:
    """Horizons in microseconds before and with this batch; ``None`` before any event."""

    before: int | None
    now: int | None

    def late(self, ts: str = "ts") -> Column:
        return F.lit(False) if self.before is None else F.coalesce(micros(ts) <= self.before, F.lit(False))

    def complete(self, ts: str | Column = "ts", ahead: int = 0) -> Column:
        """Whether all rows up to ``ahead`` microseconds after ``ts`` have arrived."""
        return F.lit(False) if self.now is None else micros(ts) + ahead <= self.now


class Step:
    """``tables`` names the state; ``run`` gets rows that are not late."""

    tables: tuple[str, ...] = ()
    delay_seconds: float = 600

    def run(self, rows: DataFrame, state: dict[str, DataFrame], clock: Clock) -> tuple[DataFrame, dict[str, DataFrame]]:
        raise NotImplementedError


def _both(state: dict[str, DataFrame], name: str, rows: DataFrame) -> DataFrame:
    return rows.unionByName(state[name]) if name in state else rows


@dataclass
class Sessions(Step):
    """Gap sessions; open ones are kept as cells, one row however many events a cell has."""

    keys: list[str]
    gap_seconds: float = 300
    measures: dict[str, Measure] = field(default_factory=dict)
    delay_seconds: float = 600
    tables = ("cells",)

    def run(self, rows, state, clock):
        keys, measures = self.keys, self.measures
        cells = cell_rows(rows.where(present(keys)), keys, self.gap_seconds, measures)
        cells = place_cells(merge_cells(_both(state, "cells", cells), keys, measures), keys, self.gap_seconds)
        cells = stage(cells, "cells")
        found = sessions_of(cells, keys, measures)
        closed = clock.complete("session_end", int(self.gap_seconds * 1_000_000))
        going = found.where(~closed).select(*keys, "session_start")
        left = join_unique(cells, going, [*keys, "session_start"], F.col("_cell")).drop("session_start")
        return found.where(closed), {"cells": left}


@dataclass
class Suppress(Step):
    """Repeats dropped as in ``suppress_duplicates``: each repeat renews the window.

    Rows wait until the horizon has passed them; rows without a time pass at once.
    """

    window_seconds: float = 3600
    keys: list[str] = field(default_factory=lambda: list(DUPLICATE_KEYS))
    row_id: str = "event_id"
    delay_seconds: float = 600
    tables = ("waiting", "seen")

    def run(self, rows, state, clock):
        columns, window = rows.columns, int(self.window_seconds * 1_000_000)
        timeless = rows.where("ts is null")
        rows = _both(state, "waiting", rows.where("ts is not null"))
        done = rows.where(clock.complete())
        old = [c if c in self.keys or c == "ts" else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in columns]
        both = done.withColumn("_seen", F.lit(False))
        if "seen" in state:
            both = both.unionByName(state["seen"].select(*old).withColumn("_seen", F.lit(True)))
        kept = first_of_bursts(both, self.keys, self.window_seconds, self.row_id).where("not _seen").drop("_seen")
        seen = both.groupBy(*self.keys).agg(F.max("ts").alias("ts")).where(~clock.complete("ts", window))
        return kept.unionByName(timeless), {"waiting": rows.where(~clock.complete()), "seen": seen}


@dataclass
class Chain(Step):
    """Chains in time order as in ``match_patterns(ordered=True)``.

    A first alert is decided when all that could follow it has arrived.  Counts over the
    whole input are unknown on a stream, so every step must ask for one alert.
    """

    pattern: AttackPattern
    row_id: str = "event_id"
    delay_seconds: float = 600
    tables = ("open",)

    def run(self, rows, state, clock):
        if any(s.min_count != 1 for s in self.pattern.sequence):
            raise ValueError("a chain on a stream asks for one alert per step")
        keys = key_columns(self.pattern.conditions)
        span = int(self.pattern.max_gap * 1_000_000) * (len(self.pattern.sequence) - 1)
        some = "|".join(f"(?:{s.rule_pattern})" for s in self.pattern.sequence)
        needed = rows.where(F.col("ts").isNotNull() & present(keys) & anchored(F.col("RULE_ID"), some))
        needed = _both(state, "open", needed.select("ts", F.col(self.row_id), "RULE_ID", *keys))
        needed = stage(needed, "open")
        chains = match_patterns(needed, [self.pattern], self.row_id, ordered=True)
        return chains.where(clock.complete("start_time", span)), {"open": needed.where(~clock.complete("ts", span))}


@dataclass
class Groups(Step):
    """Groups of a key that stay open for ever; finished rows are the groups that a batch changed."""

    keys: list[str]
    measures: dict[str, Measure]
    delay_seconds: float = 600
    tables = ("groups",)

    def run(self, rows, state, clock):
        partial = rows.where(present(self.keys)).groupBy(*self.keys).agg(F.count("*").alias("event_count"), *[m.partial().alias(n) for n, m in self.measures.items()])
        partial = stage(partial, "partial")
        merged = _both(state, "groups", partial).groupBy(*self.keys).agg(F.sum("event_count").alias("event_count"), *[m.merge(n).alias(n) for n, m in self.measures.items()])
        return merged.join(partial.select(*self.keys), self.keys, "left_semi"), {"groups": merged}


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the state's versions below ``path``."""
    files, place = _folder(spark, f"{path}/state")
    if not files.exists(place):
        return []
    return sorted(int(s.getPath().getName()) for s in files.listStatus(place))


def state_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the newest version."""
    return spark.read.parquet(f"{path}/state/{versions(spark, path)[-1]}/{name}")


def results(spark: SparkSession, path: str, kind: str = "out") -> DataFrame:
    """All finished (``out``) or late (``late``) rows."""
    return spark.read.parquet(f"{path}/{kind}").drop("batch")


def merge_batch(step: Step, path: str):
    """The callback that runs ``step`` on each micro-batch."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = stage(batch, "batch")
        state = {}
        newest = rows.agg(F.max(micros("ts"))).first()[0]
        before = None
        if number > 0:
            state = {name: spark.read.parquet(f"{path}/state/{number - 1}/{name}") for name in step.tables}
            before = spark.read.parquet(f"{path}/state/{number - 1}/clock").first()[0]
        newest = max((x for x in (newest, before) if x is not None), default=None)
        delay = int(step.delay_seconds * 1_000_000)
        clock = Clock(None if before is None else before - delay, None if newest is None else newest - delay)
        out, after = step.run(rows.where(~clock.late()), state, clock)
        out.write.mode("overwrite").parquet(f"{path}/out/batch={number}")
        rows.where(clock.late()).write.mode("overwrite").parquet(f"{path}/late/batch={number}")
        for name in step.tables:
            after[name].write.mode("overwrite").parquet(f"{path}/state/{number}/{name}")
        spark.createDataFrame([(newest,)], "newest long").write.mode("overwrite").parquet(f"{path}/state/{number}/clock")
        for old in versions(spark, path):
            if old <= number - KEPT_VERSIONS:
                files, place = _folder(spark, f"{path}/state/{old}")
                files.delete(place, True)

    return merge


def carry(rows: DataFrame, step: Step, path: str, seconds: int | None = None) -> StreamingQuery:
    """Run ``step`` over a stream; results, state and checkpoint stand below ``path``."""
    return for_each_change(rows, merge_batch(step, path), f"{path}/checkpoint", seconds)
