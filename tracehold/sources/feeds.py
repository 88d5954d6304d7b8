"""Indicator feeds and the attack catalog, read from files already fetched."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Feed:
    """Layout of a feed: indicator type, file format, comment mark and where the value is."""

    feed_type: str
    file_format: str = "text"
    comment: str = "#"
    column: int = 0
    path: str = ""


# Known feeds and their layouts.
FEEDS = {
    "abuse_ch_feodo": Feed("ip"),
    "abuse_ch_ssl": Feed("ip"),
    "emerging_threats": Feed("ip"),
    "spamhaus_drop": Feed("ip", comment=";"),
    "malware_domains": Feed("domain"),
    "misp_warning_list": Feed("domain", "json", path="list"),
    "phishtank": Feed("url", "json", path="url"),
    "alienvault_otx": Feed("mixed", "json", path="results.indicators"),
    "threatfox": Feed("mixed", "json", path="data.iocs.ioc"),
    "urlhaus": Feed("url", "csv", column=2),
}

# Schemas of the JSON feeds and the expression that lists their values.
JSON_FEEDS = {
    "misp_warning_list": ("list array<string>", "list"),
    "phishtank": ("url string", "array(url)"),
    "alienvault_otx": (
        "results array<struct<indicators: map<string, array<string>>>>",
        "flatten(transform(results, r -> flatten(map_values(r.indicators))))",
    ),
    "threatfox": ("data struct<iocs: array<struct<ioc: string>>>", "transform(data.iocs, i -> i.ioc)"),
}


def feed_lines(lines: DataFrame, feed: Feed, source: str) -> DataFrame:
    """Values of a text or csv feed; blank and comment lines are skipped."""
    text = F.trim("value")
    kept = lines.where((text != "") & ~text.startswith(feed.comment))
    if feed.file_format == "csv":
        # Values may be quoted, with commas and doubled quotes inside.
        raw = F.regexp_extract_all(F.concat(F.lit(","), text), F.lit(r',("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
        parts = F.transform(raw, lambda p: F.when(p.startswith('"'), F.regexp_replace(F.regexp_replace(p, '^"|"$', ""), '""', '"')).otherwise(p))
        wanted = F.when(F.size(parts) > feed.column, F.get(parts, F.lit(feed.column))).otherwise(F.get(parts, F.lit(0)))
        kept = kept.where(F.size(parts) > 1)
        return kept.select(F.lit(source).alias("source"), wanted.alias("indicator"))
    return kept.select(F.lit(source).alias("source"), text.alias("indicator"))


def read_feed(spark: SparkSession, source: str, path: str) -> DataFrame:
    """``(source, indicator)`` rows of a known feed's file."""
    if source not in FEEDS:
        raise ValueError(f"unknown feed {source!r}")
    feed = FEEDS[source]
    if feed.file_format != "json":
        return feed_lines(spark.read.text(path), feed, source)
    schema, values = JSON_FEEDS[source]
    rows = spark.read.schema(schema).json(path, multiLine=True)
    return rows.select(F.lit(source).alias("source"), F.explode(F.expr(values)).alias("indicator")).where(
        "indicator is not null"
    )


BUNDLE_SCHEMA = """objects array<struct<type: string, name: string, description: string,
    external_references: array<struct<external_id: string>>,
    kill_chain_phases: array<struct<kill_chain_name: string, phase_name: string>>>>"""


def read_attack_catalog(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Techniques and tactics of a STIX bundle."""
    objects = spark.read.schema(BUNDLE_SCHEMA).json(path, multiLine=True).select(F.explode("objects").alias("o")).select("o.*")
    return catalog_techniques(objects), catalog_tactics(objects)


def catalog_techniques(objects: DataFrame) -> DataFrame:
    ref = F.get(F.col("external_references"), F.lit(0))["external_id"]
    phases = F.filter("kill_chain_phases", lambda p: p["kill_chain_name"] == "mitre-attack")
    return objects.where((F.col("type") == "attack-pattern") & ref.startswith("T")).select(
        ref.alias("technique_id"),
        F.coalesce("name", F.lit("")).alias("name"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce(F.transform(phases, lambda p: p["phase_name"]), F.array().cast("array<string>")).alias("tactics"),
    )


def catalog_tactics(objects: DataFrame) -> DataFrame:
    ref = F.get(F.col("external_references"), F.lit(0))["external_id"]
    return objects.where((F.col("type") == "x-mitre-tactic") & ref.startswith("TA")).select(
        ref.alias("tactic_id"),
        F.coalesce("name", F.lit("")).alias("name"),
        F.coalesce("description", F.lit("")).alias("description"),
    )
