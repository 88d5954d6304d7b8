"""Reading and writing log lines, tables and results."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracehold.functions.times import parse_timestamp
from tracehold.functions.regexes import to_java
from tracehold.operators.parse import SourceConfig, parse_source
from tracehold.schema import ALERT_SCHEMA, LOG_FIELDS, LOG_SCHEMA

# Spark's default keeps milliseconds only.
TEXT_STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def keep_lines(lines: DataFrame, filter_regex: str = "", exclude_regex: str = "") -> DataFrame:
    """Lines matching the filter and not the exclusion; either may be empty."""
    if filter_regex:
        lines = lines.where(F.col("value").rlike(to_java(filter_regex)))
    if exclude_regex:
        lines = lines.where(~F.col("value").rlike(to_java(exclude_regex)))
    return lines


def read_log_lines(spark: SparkSession, paths, filter_regex: str = "", exclude_regex: str = "") -> DataFrame:
    """Lines of text files (globs, gz and bz2 included) as (value, file)."""
    lines = spark.read.text(list(paths) if not isinstance(paths, str) else paths)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"))
    return keep_lines(lines, filter_regex, exclude_regex)


def with_rotated(path: str) -> list[str]:
    """Globs for a log and its rotated, possibly compressed, predecessors."""
    # Suffixes rotation leaves behind.
    return [f"{path}{{,.[0-9]*,.old,.gz,.bz2}}"]


def existing_paths(spark: SparkSession, paths) -> list[str]:
    """The paths (or globs) that have files; a source may name logs that do not exist yet."""
    found = []
    for path in paths:
        try:
            spark.read.text(path)
            found.append(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    return found


def source_status(spark: SparkSession, sources: list[SourceConfig]) -> DataFrame:
    """Each source with its state: disabled, ok or failed (no file there)."""
    rows = [
        (s.source_type, "disabled" if not s.enabled else "ok" if existing_paths(spark, s.paths) else "failed")
        for s in sources
    ]
    return spark.createDataFrame(rows, "source_type string, status string")


def collect_all(spark: SparkSession, sources: list[SourceConfig], only: str | None = None) -> DataFrame:
    """Lines of every enabled source, or of the one named, tagged with the source type.

    Missing files are passed over; :func:`source_status` tells which.
    """
    chosen = sorted((s for s in sources if s.enabled and only in (None, s.source_type)), key=lambda s: s.priority)
    parts = []
    for s in chosen:
        paths = existing_paths(spark, s.paths)
        if paths:
            lines = read_log_lines(spark, paths, s.filter_regex, s.exclude_regex)
            parts.append(lines.withColumn("source_type", F.lit(s.source_type)))
    if not parts:
        raise ValueError("no enabled source has files")
    return reduce(DataFrame.unionByName, parts)


def write_collected(lines: DataFrame, path: str, run: str) -> None:
    """One folder per run and source type."""
    lines.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run", "source_type").parquet(path)


def collection_counts(lines: DataFrame) -> DataFrame:
    """Lines per source type and file."""
    return lines.groupBy("source_type", "file").agg(F.count("*").alias("lines"))


def parse_all(spark: SparkSession, sources: list[SourceConfig], default_year: int) -> DataFrame:
    """Normalized rows of every enabled source."""
    parts = []
    for s in sources:
        paths = existing_paths(spark, s.paths) if s.enabled else []
        if paths:
            lines = read_log_lines(spark, paths, s.filter_regex, s.exclude_regex)
            parts.append(parse_source(lines, s, default_year).select(*LOG_FIELDS, "ts"))
    if not parts:
        raise ValueError("no enabled source has files")
    return reduce(DataFrame.unionByName, parts)


def write_normalized(rows: DataFrame, path: str) -> None:
    """Tab-separated with header; tabs inside values are escaped by the parsers."""
    columns = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in LOG_FIELDS]
    rows.select(*columns).write.mode("overwrite").csv(path, sep="\t", header=True, quote="", emptyValue="")


def read_normalized(spark: SparkSession, path: str) -> DataFrame:
    """Normalized rows; short rows are padded, missing values read as the empty string."""
    rows = spark.read.schema(LOG_SCHEMA).csv(path, sep="\t", header=True, quote="", mode="PERMISSIVE", enforceSchema=True)
    return rows.na.fill("")


def read_alerts(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Alerts from .tsv, .csv or .json; empty addresses and users read as null.

    JSON is one object per line, or with the kind ``json_array`` one array per file.
    """
    kind = kind or path.rstrip("/").rsplit(".", 1)[-1]
    reader = spark.read.schema(ALERT_SCHEMA)
    if kind == "tsv":
        return reader.csv(path, sep="\t", header=True, quote="")
    if kind == "csv":
        return reader.csv(path, header=True)
    if kind in ("json", "json_array"):
        return reader.json(path, multiLine=kind == "json_array")
    raise ValueError(f"unsupported file format: {path}")


def write_alerts(alerts: DataFrame, path: str) -> None:
    """By suffix: .csv, .json, otherwise tab-separated."""
    if path.endswith(".csv"):
        alerts.write.mode("overwrite").csv(path, header=True, timestampFormat=TEXT_STAMP)
    elif path.endswith(".json"):
        alerts.write.mode("overwrite").json(path, timestampFormat=TEXT_STAMP)
    else:
        alerts.write.mode("overwrite").csv(path, sep="\t", header=True, quote="", timestampFormat=TEXT_STAMP)


def load_table(
    spark: SparkSession, path: str, kind: str = "csv", time_field: str = "timestamp", schema=None, default_year: int = 1970
) -> DataFrame:
    """A csv, tsv or json table; values of the time field that do not parse become null.

    ``json`` is one object per line, ``json_array`` one array per file.  A schema spares
    the extra pass that inference costs.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    infer = schema is None
    if kind == "csv":
        df = reader.csv(path, header=True, inferSchema=infer)
    elif kind == "tsv":
        df = reader.csv(path, header=True, sep="\t", inferSchema=infer)
    elif kind in ("json", "json_array"):
        df = reader.json(path, multiLine=kind == "json_array")
    else:
        raise ValueError(f"unsupported format: {kind}")
    if time_field in df.columns and df.schema[time_field].dataType.typeName() == "string":
        df = df.withColumn(time_field, parse_timestamp(F.col(time_field), default_year))
    return df


def write_results(results: DataFrame, path: str) -> None:
    """Results as JSON lines, nested columns kept."""
    results.write.mode("overwrite").json(path, ignoreNullFields=False, timestampFormat=TEXT_STAMP)


APP_LINE = r"^\[([^\]]+)\] \[([A-Z]+)\] \[([^\]]+)\] \[([0-9]+)\] (.*)$"
AUDIT_LINE = r"^\[([^\]]+)\] \[AUDIT\] \[user=([^\]]*)\] \[action=([^\]]*)\](?: \[details=(.*)\])?$"


def parse_app_log(lines: DataFrame) -> DataFrame:
    """The toolkit's own log and audit lines as rows; other lines are left out."""
    line = F.col("value")
    audit = line.rlike(AUDIT_LINE)

    def part(i: int, j: int):
        plain = F.regexp_extract(line, APP_LINE, i) if i else F.lit("")
        return F.when(audit, F.regexp_extract(line, AUDIT_LINE, j) if j else F.lit("")).otherwise(plain)

    return lines.where(audit | line.rlike(APP_LINE)).select(
        part(1, 1).alias("logged_at"),
        F.when(audit, "AUDIT").otherwise(F.regexp_extract(line, APP_LINE, 2)).alias("level"),
        part(3, 0).alias("component"),
        part(4, 0).alias("process_id"),
        part(0, 2).alias("user"),
        part(0, 3).alias("action"),
        part(5, 4).alias("message"),
    )
