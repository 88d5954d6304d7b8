"""Row order over data too large, or too skewed, for one window partition.

``lag``, trailing frames and row numbers need neighbours in a total order.  A
window partitioned by host or address would put a hot key into one task, so
rows get a global position first (range sort, which cuts hot keys anywhere) and
are then windowed in chunks of positions.  Rows near a chunk's edge are copied
to the next chunk, or a small per-chunk summary is carried over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracehold.session import stage

CHUNK_ROWS = 500_000
_LOCAL_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def with_position(df: DataFrame, order: list, name: str = "_pos") -> DataFrame:
    """Add the 0-based position of each row; ``order`` must be a total order.

    The sorted table is written once, since a second evaluation could cut the
    ranges elsewhere.  The per-partition offsets have one row per sort
    partition, which bounds the broadcast.
    """
    sorted_rows = df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id())
    rows = stage(sorted_rows, "sorted").withColumn("_part", F.shiftright("_mid", _LOCAL_BITS))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    offsets = sizes.select("_part", before.alias("_off"))
    local = F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    return rows.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_off") + local).drop("_part", "_mid", "_off")


def numbered(df: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    """``row_number()`` per key, 1-based, without gathering a key in one task."""
    placed = with_position(df, [*keys, *order])
    if not keys:
        return placed.withColumn(name, F.col("_pos") + 1).drop("_pos")
    first = placed.groupBy(*keys).agg(F.min("_pos").alias("_first"))
    same = [placed[k].eqNullSafe(first[k]) for k in keys]
    joined = placed.join(first, same, "left").select(placed["*"], first["_first"])
    return joined.withColumn(name, F.col("_pos") - F.col("_first") + 1).drop("_pos", "_first")


def trailing(df: DataFrame, keys: list[str], order: list, rows: int, chunk_rows: int = CHUNK_ROWS):
    """Rows with what a frame of the ``rows`` preceding rows needs.

    Returns ``(copies, window)``: evaluate functions over ``window`` (ordered,
    no frame set), then keep the rows where ``_native`` holds.
    """
    size = max(chunk_rows, rows, 1)
    placed = with_position(df, [*keys, *order])
    chunk = F.floor(F.col("_pos") / size)
    near_end = F.col("_pos") % size >= size - rows
    copies = placed.withColumn("_home", chunk).withColumn(
        "_chunk", F.explode(F.when(near_end, F.array(F.col("_home"), F.col("_home") + 1)).otherwise(F.array("_home")))
    )
    copies = copies.withColumn("_native", F.col("_chunk") == F.col("_home"))
    return copies, Window.partitionBy("_chunk", *keys).orderBy("_pos")


def drop_helpers(df: DataFrame) -> DataFrame:
    return df.where("_native").drop("_pos", "_home", "_chunk", "_native")


def next_value(
    df: DataFrame, keys: list[str], order: list, value: Column, name: str, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """The first non-null ``value`` among the later rows of the same key.

    Inside a chunk a window looks ahead; beyond it the first value of the later
    chunks is carried back from one row per key and chunk.
    """
    placed = with_position(df.withColumn("_value", value), [*keys, *order])
    placed = placed.withColumn("_chunk", F.floor(F.col("_pos") / chunk_rows))
    # Backwards, so that the frame grows by one row at a time instead of being read anew for each.
    ahead = Window.partitionBy(*keys, "_chunk").orderBy(F.desc("_pos")).rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_inside", F.last("_value", ignorenulls=True).over(ahead))
    heads = placed.groupBy(*keys, "_chunk").agg(
        F.min_by("_value", F.when(F.col("_value").isNotNull(), F.col("_pos"))).alias("_head")
    )
    later = Window.partitionBy(*keys).orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("_carried", F.last("_head", ignorenulls=True).over(later)).drop("_head")
    joined = placed.join(heads, [*keys, "_chunk"])
    return joined.withColumn(name, F.coalesce("_inside", "_carried")).drop(
        "_value", "_pos", "_chunk", "_inside", "_carried"
    )
