"""The indicator store as a folder that feeds are put into in place.

Rows stand in buckets by the hash of their key.  A bucket's rows of one version are one
folder, ``data/bucket=B/version=V``, that is never written to again.  A pointer, ``pointer/N``,
names for version ``N`` of the store the version of each bucket.  An update reads the buckets
that its rows fall into, writes those in which a row changes as version ``N + 1``, and then the
pointer, whose success mark makes the new version the one that readers take.  Files of
other buckets stay as they are; an update that changes nothing writes nothing; one
that failed half way is done again under the same number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracehold.operators.intel import upsert_indicators
from tracehold.schema import INDICATOR_SCHEMA
from tracehold.session import stage

BUCKETS = 256
KEY = ["type", "indicator"]


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def store_version(spark: SparkSession, path: str) -> int | None:
    """The newest complete version; ``None`` without a store."""
    files, place = _files(spark, f"{path}/pointer")
    if not files.exists(place):
        return None
    numbers = [int(s.getPath().getName()) for s in files.listStatus(place)]
    done = [n for n in numbers if files.exists(_files(spark, f"{path}/pointer/{n}/_SUCCESS")[1])]
    return max(done, default=None)


def _pointer(spark: SparkSession, path: str, version: int | None) -> list[tuple[int, int]]:
    """(bucket, version) of the buckets that have rows; no more than there are buckets."""
    if version is None:
        return []
    return [(r["bucket"], r["version"]) for r in spark.read.parquet(f"{path}/pointer/{version}").collect()]


def _read(spark: SparkSession, path: str, parts: list[tuple[int, int]]) -> DataFrame:
    folders = [f"{path}/data/bucket={b}/version={v}" for b, v in parts]
    return spark.read.schema(INDICATOR_SCHEMA).parquet(*folders) if folders else spark.createDataFrame([], INDICATOR_SCHEMA)


def read_store(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of the newest, or of a given, version; empty without a store."""
    return _read(spark, path, _pointer(spark, path, store_version(spark, path) if version is None else version))


def _buckets(spark: SparkSession, path: str, buckets: int) -> int:
    """The store's own number of buckets, written with its first version."""
    files, place = _files(spark, f"{path}/layout/_SUCCESS")
    if files.exists(place):
        return spark.read.parquet(f"{path}/layout").first()[0]
    spark.createDataFrame([(buckets,)], "buckets int").write.mode("overwrite").parquet(f"{path}/layout")
    return buckets


def upsert_store(spark: SparkSession, path: str, new: DataFrame, stamp: Column, buckets: int = BUCKETS) -> int | None:
    """Put ``new`` into the store by (type, indicator) as in ``upsert_indicators``; gives the version that holds it."""
    buckets = _buckets(spark, path, buckets)
    bucket = F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int")
    columns = INDICATOR_SCHEMA.fieldNames()
    version = store_version(spark, path)
    parts = dict(_pointer(spark, path, version))
    new = stage(new.withColumn("last_updated", stamp).select(*columns), "feed")
    asked = [r[0] for r in new.select(bucket.alias("b")).distinct().collect()]
    old = _read(spark, path, [(b, parts[b]) for b in asked if b in parts])
    merged = stage(upsert_indicators(old, new.drop("last_updated"), stamp), "merged")
    changed = {r[0] for r in merged.exceptAll(old).select(bucket.alias("b")).distinct().collect()}
    if not changed:
        return version
    number = 0 if version is None else version + 1
    written = merged.withColumn("bucket", bucket).where(F.col("bucket").isin(*changed))
    # A failed try may have left files of this number.
    for b in changed:
        files, place = _files(spark, f"{path}/data/bucket={b}/version={number}")
        files.delete(place, True)
    written.repartition("bucket").withColumn("version", F.lit(number)).write.mode("append").partitionBy("bucket", "version").parquet(f"{path}/data")
    pointer = sorted((parts | dict.fromkeys(changed, number)).items())
    spark.createDataFrame(pointer, "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{path}/pointer/{number}")
    return number
