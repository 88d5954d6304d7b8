"""Looking after rule packs: indexes, summaries, versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracehold.sources.rules import parse_rules, rule_file_metadata


def rules_by_tag(lines: DataFrame) -> DataFrame:
    """Rule ids per tag, from the file header and the rules themselves."""
    rules = parse_rules(lines).select("rule_file", "rule_id", "tags")
    headers = rule_file_metadata(lines).select("rule_file", F.col("tags").alias("file_tags"))
    listed = rules.join(headers, "rule_file").select(
        "rule_id",
        F.explode(F.array_union("tags", F.transform(F.split("file_tags", ","), lambda x: F.trim(x)))).alias("tag"),
    )
    return listed.where("tag <> ''").distinct()


def rules_by_category(lines: DataFrame) -> DataFrame:
    """Rule ids per category of their file."""
    rules = parse_rules(lines).select("rule_file", "rule_id")
    headers = rule_file_metadata(lines).select("rule_file", "category")
    return rules.join(headers, "rule_file").where("category <> ''").select("category", "rule_id").distinct()


def rule_summary(lines: DataFrame) -> DataFrame:
    """Version, category, date and number of rules of each file."""
    counts = parse_rules(lines).groupBy("rule_file").agg(F.count("*").alias("rules"))
    headers = rule_file_metadata(lines).select("rule_file", "version", "category", "last_updated")
    return headers.join(counts, "rule_file", "left").withColumn("rules", F.coalesce("rules", F.lit(0)))


def rule_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rules added, removed or changed between two versions, compared by id."""
    parts = ["description", "pattern", "severity", "fields", "tags", "negative_pattern"]

    def body(df: DataFrame, name: str) -> DataFrame:
        return df.select("rule_id", F.struct(*[c for c in parts if c in df.columns]).alias(name))

    both = body(old, "was").join(body(new, "now"), "rule_id", "full")
    change = (
        F.when(F.col("was").isNull(), "added")
        .when(F.col("now").isNull(), "removed")
        .when(F.col("was") != F.col("now"), "changed")
    )
    return both.withColumn("change", change).where("change is not null").select(
        "rule_id", "change", F.col("was.pattern").alias("old_pattern"), F.col("now.pattern").alias("new_pattern")
    )


def commit_rules(lines: DataFrame, path: str, version: str, message: str, committed_at: str) -> None:
    """Append a snapshot of rule lines to the history table."""
    rows = lines.withColumns(
        {"version": F.lit(version), "message": F.lit(message), "committed_at": F.lit(committed_at)}
    )
    rows.write.mode("append").partitionBy("rule_file", "committed_at").parquet(path)


def latest_rules(history: DataFrame) -> DataFrame:
    """The lines of each file's latest snapshot."""
    newest = history.groupBy("rule_file").agg(F.max(F.col("committed_at").cast("string")).alias("committed_at"))
    rows = history.withColumn("committed_at", F.col("committed_at").cast("string"))
    return rows.join(newest, ["rule_file", "committed_at"], "left_semi")
