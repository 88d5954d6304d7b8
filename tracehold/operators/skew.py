"""Joins of a large, possibly skewed side with a side that is unique on the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16


def join_unique(
    rows: DataFrame,
    unique: DataFrame,
    keys: list[str],
    spread_by: Column,
    how: str = "inner",
    salts: int = SALTS,
    grows: bool = False,
) -> DataFrame:
    """Equi-join that spreads every key of ``rows`` over ``salts`` tasks.

    ``unique`` holds one row per key, so replicating it costs ``salts`` small
    copies while a key with a third of ``rows`` is cut into ``salts`` parts.
    Spark still broadcasts ``unique`` when its measured size allows.  That size is
    of the files before the copies are made, many times less than what the driver
    would hold, so a ``unique`` that ``grows`` with the rows is never broadcast.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    copies = unique.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    copies = copies.hint("merge") if grows else copies
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")
