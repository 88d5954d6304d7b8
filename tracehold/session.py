"""Session settings and the shared staging area.

Long plans are cut by writing an intermediate table to the folder named by
``spark.checkpoint.dir`` and reading it back.  A written table survives the
loss of executors, keeps column pruning and gives later stages real sizes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join partition even where that costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Streaming sessions are merged inside each task before they are shuffled.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}

def build_session(app_name: str = "tracehold", master: str | None = None, **settings) -> SparkSession:
    """A session with the package's runtime settings; extra keywords use ``_`` for ``.``."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_SETTINGS, **settings}.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return tune(builder.getOrCreate())


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else started."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def staging_root(spark: SparkSession) -> str:
    """Folder for this application's staged tables, below ``spark.checkpoint.dir``.

    On a cluster that setting names a folder all executors share and is required.  A
    local session without it uses one below its warehouse.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    return f"{shared.rstrip('/')}/tracehold/{spark.sparkContext.applicationId}"


def staging_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the staging root."""
    return f"{staging_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once and continue from the written table."""
    spark = df.sparkSession
    path = staging_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
