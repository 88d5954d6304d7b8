"""File integrity: checksums of evidence and rule files."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce
from urllib.parse import unquote, urlsplit

import pandas as pd
import pyarrow.fs as stores
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files of more bytes are read in pieces of that many bytes instead of as one value.
LARGE, PIECE = 256 << 20, 8 << 20
#: Stores that tasks can read in pieces, by the scheme of Spark's paths, with the scheme the readers know.
STREAMED = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}


def _streamed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The checksum of each file, of which a task holds one piece at a time."""
    for files in batches:
        sums = []
        for path in files["path"]:
            scheme, host = urlsplit(path)[:2]
            inside = path.split(":", 1)[1].removeprefix("//" + host) if host else "/" + path.split(":", 1)[1].lstrip("/")
            if scheme == "file":
                store, place = stores.LocalFileSystem(), inside
            else:
                store, root = stores.FileSystem.from_uri(f"{STREAMED[scheme]}://{host}/")
                place = root.rstrip("/") + inside
            digest = hashlib.sha256()
            with store.open_input_stream(place, compression=None) as stream:  # the bytes as they are, also of packed files
                while piece := stream.read(PIECE):
                    digest.update(piece)
            sums.append(digest.hexdigest())
        yield files.assign(sha256=sums)


def evidence_manifest(spark: SparkSession, path: str, glob: str = "*", large: int = LARGE) -> DataFrame:
    """SHA-256 of every file below ``path`` as (name, size, sha256); the name is the path below it.

    Files up to ``large`` bytes are values of one row each.  Larger ones are listed by Spark and
    read piece by piece in the tasks, where their store is one of ``STREAMED`` (``hdfs`` asks for
    libhdfs there); elsewhere a file must fit a task and stay below 2 GB.  Names that begin with ``_`` or ``.`` are no
    files to Spark.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    top = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString().rstrip("/") + "/"
    name = F.when(F.startswith("path", F.lit(top)), F.substring("path", len(top) + 1, 1 << 30)).otherwise(F.col("path")).alias("name")
    listed = [(re.sub(r"^(\w+):///", r"\1:/", unquote(f)),) for f in files.inputFiles()]
    if all(f.split(":", 1)[0] not in STREAMED for (f,) in listed):
        large = 1 << 62
    # The limit is pushed down, so the content of larger files is not read; without the content Spark lists the files only.
    whole = files.where(F.col("length") <= large).select(name, F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    pieces = files.where(F.col("length") > large).select("path", "length").mapInPandas(_streamed, "path string, length long, sha256 string")
    # Spark's readers pass over empty files, but its listing, which the driver holds anyway, has them.
    empty = spark.createDataFrame(listed, "path string").join(files.select("path"), "path", "left_anti")
    parts = [whole, pieces.select(name, F.col("length").alias("size"), "sha256"), empty.select(name, F.lit(0).cast("long").alias("size"), F.sha2(F.lit(""), 256).alias("sha256"))]
    return reduce(DataFrame.unionByName, parts)


def verify_manifest(stored: DataFrame, current: DataFrame) -> DataFrame:
    """new, ok, changed or missing per file."""
    was = stored.select("name", F.col("sha256").alias("expected"))
    now = current.select("name", F.col("sha256").alias("actual"))
    status = (
        F.when(F.col("expected").isNull(), "new")
        .when(F.col("actual").isNull(), "missing")
        .when(F.col("expected") == F.col("actual"), "ok")
        .otherwise("changed")
    )
    return was.join(now, "name", "full").select("name", "expected", "actual", status.alias("status"))
