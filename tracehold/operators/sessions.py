"""Gap sessions without sorting the events.

Two events in the same time cell of the gap's width are always in one session,
so events are first aggregated to (key, cell): a burst collapses to one row
before anything is shuffled.  Breaks are then found between consecutive
non-empty cells.  Cells are windowed in blocks, with one summary row per block,
so no task sees more than a block of cells however long the time span is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracehold.functions.times import micros
from tracehold.operators.skew import join_unique

BLOCK_CELLS = 100_000


@dataclass(frozen=True)
class Measure:
    """An aggregate that can be merged: ``kind`` is sum, min, max or set."""

    kind: str
    column: Column

    def partial(self) -> Column:
        return {"sum": F.sum, "min": F.min, "max": F.max, "set": F.collect_set}[self.kind](self.column)

    def merge(self, name: str) -> Column:
        if self.kind == "set":
            return F.array_sort(F.array_distinct(F.flatten(F.collect_set(name))))
        return {"sum": F.sum, "min": F.min, "max": F.max}[self.kind](name)


def cell_number(ts: str, gap_seconds: float) -> Column:
    """Cells are as wide as the gap, so two events of one cell are less than the gap apart."""
    return F.floor(micros(ts) / F.lit(max(int(gap_seconds * 1_000_000), 1)))


def cell_rows(df: DataFrame, keys: list[str], gap_seconds: float, measures: dict[str, Measure], ts: str = "ts") -> DataFrame:
    """Non-empty cells; rows of one key and cell can be merged again."""
    return (
        df.where(F.col(ts).isNotNull())
        .groupBy(*keys, cell_number(ts, gap_seconds).alias("_cell"))
        .agg(
            F.min(ts).alias("_first"),
            F.max(ts).alias("_last"),
            F.count("*").alias("_events"),
            *[m.partial().alias(n) for n, m in measures.items()],
        )
    )


def merge_cells(cells: DataFrame, keys: list[str], measures: dict[str, Measure]) -> DataFrame:
    """One row per key and cell of cells that were aggregated in parts."""
    return cells.groupBy(*keys, "_cell").agg(
        F.min("_first").alias("_first"),
        F.max("_last").alias("_last"),
        F.sum("_events").alias("_events"),
        *[m.merge(n).alias(n) for n, m in measures.items()],
    )


def place_cells(cells: DataFrame, keys: list[str], gap_seconds: float) -> DataFrame:
    """Cells with the start of the session each belongs to."""
    gap = int(gap_seconds * 1_000_000)
    cells = cells.withColumn("_block", F.floor(F.col("_cell") / BLOCK_CELLS))
    inside = Window.partitionBy(*keys, "_block").orderBy("_cell")
    across = Window.partitionBy(*keys).orderBy("_block")
    cells = cells.withColumn("_before", F.lag("_last").over(inside))
    tails = cells.groupBy(*keys, "_block").agg(F.max("_last").alias("_tail"))
    tails = tails.withColumn("_before_block", F.lag("_tail").over(across)).drop("_tail")
    cells = _null_safe_join(cells, tails, [*keys, "_block"])
    before = F.coalesce("_before", "_before_block")
    opens = before.isNull() | (micros("_first") - micros(before) > gap)
    cells = cells.withColumn("_opened", F.when(opens, F.col("_first")))
    heads = cells.groupBy(*keys, "_block").agg(F.max("_opened").alias("_newest"))
    heads = heads.withColumn(
        "_carried", F.last("_newest", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1))
    ).drop("_newest")
    cells = _null_safe_join(cells, heads, [*keys, "_block"])
    so_far = F.last("_opened", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return cells.withColumn("session_start", F.coalesce(so_far, F.col("_carried"))).drop(
        "_before", "_before_block", "_opened", "_carried", "_block"
    )


def sessions_of(cells: DataFrame, keys: list[str], measures: dict[str, Measure]) -> DataFrame:
    """One row per session of placed cells."""
    return cells.groupBy(*keys, "session_start").agg(
        F.max("_last").alias("session_end"),
        F.sum("_events").alias("event_count"),
        *[m.merge(n).alias(n) for n, m in measures.items()],
    )


def _null_safe_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, same).drop(*[f"_r_{k}" for k in keys])


def sessionize(
    df: DataFrame, keys: list[str], gap_seconds: float, measures: dict[str, Measure] | None = None, ts: str = "ts"
) -> DataFrame:
    """One row per session: keys, session_start, session_end, event_count and the measures.

    Consecutive events at most ``gap_seconds`` apart share a session; events
    without a time are left out.
    """
    measures = measures or {}
    return sessions_of(place_cells(cell_rows(df, keys, gap_seconds, measures, ts), keys, gap_seconds), keys, measures)


def session_members(df: DataFrame, keys: list[str], gap_seconds: float, row_id: str, ts: str = "ts") -> DataFrame:
    """The events with the ``session_start`` they belong to."""
    starts = place_cells(cell_rows(df, keys, gap_seconds, {}, ts), keys, gap_seconds).select(*keys, "_cell", "session_start")
    rows = df.where(F.col(ts).isNotNull()).withColumn("_cell", cell_number(ts, gap_seconds))
    return join_unique(rows, starts, [*keys, "_cell"], F.col(row_id)).drop("_cell")


def first_of_bursts(
    df: DataFrame, keys: list[str], window_seconds: float, row_id: str, ts: str = "ts"
) -> DataFrame:
    """Rows whose predecessor of the same key is missing or more than the window older.

    Only the earliest row of a cell can qualify; it is kept unless the key's
    previous non-empty cell ends within the window before it.
    """
    window = int(window_seconds * 1_000_000)
    payload = F.struct(F.col(ts), F.col(row_id), *[F.col(c) for c in df.columns if c not in (ts, row_id)])
    cells = (
        df.where(F.col(ts).isNotNull())
        .groupBy(*keys, cell_number(ts, window_seconds).alias("_cell"))
        .agg(F.min_by(payload, F.struct(ts, row_id)).alias("_row"), F.max(ts).alias("_last"))
        .withColumn("_block", F.floor(F.col("_cell") / BLOCK_CELLS))
    )
    inside = Window.partitionBy(*keys, "_block").orderBy("_cell")
    cells = cells.withColumn("_before", F.lag("_last").over(inside))
    tails = cells.groupBy(*keys, "_block").agg(F.max("_last").alias("_tail"))
    tails = tails.withColumn("_before_block", F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_block")))
    cells = _null_safe_join(cells, tails.drop("_tail"), [*keys, "_block"])
    before = F.coalesce("_before", "_before_block")
    fresh = before.isNull() | (micros(F.col(f"_row.{ts}")) - micros(before) > window)
    return cells.where(fresh).select("_row.*").select(*df.columns)
