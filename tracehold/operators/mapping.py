"""Mapping rules to attack techniques by shared keywords."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracehold.operators.automaton import SHARD_CHARS, characters, literals_in, shards
from tracehold.session import stage

TOP = 3
SHORTEST_KEYWORD = 4


def rule_keywords(rules: DataFrame) -> DataFrame:
    """Pattern alternatives and description words longer than three characters; ``n`` counts repeats."""
    words = F.concat(F.split(F.lower("pattern"), r"\|"), F.split(F.trim(F.lower("description")), r"\s+"))
    listed = rules.select("rule_id", F.explode(words).alias("keyword"))
    return (
        listed.where(F.length("keyword") >= SHORTEST_KEYWORD)
        .groupBy("rule_id", "keyword")
        .agg(F.count("*").alias("n"))
    )


def map_rules_to_techniques(rules: DataFrame, techniques: DataFrame, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """The best three techniques of a rule by keywords contained in their text, if more than one point.

    The distinct keywords are looked for in one pass over each technique's text, or in one
    pass per ``shard_chars`` characters of keywords, so containment needs no join of rules with techniques.
    """
    keywords = rule_keywords(rules)
    distinct = stage(keywords.select("keyword").distinct(), "keywords")
    text = F.lower(F.concat("name", F.lit(" "), F.coalesce("description", F.lit(""))))
    parts = []
    for own in shards(distinct, "keyword", characters(distinct, "keyword"), shard_chars):
        found = techniques.withColumn("keyword", F.explode_outer(literals_in(text, own, "keyword")))
        parts.append(found.where(F.col("keyword").isNotNull()).select("technique_id", "name", "tactics", "keyword"))
    found = reduce(DataFrame.unionByName, parts)
    scores = (
        found.join(keywords, "keyword")
        .groupBy("rule_id", "technique_id")
        .agg(F.sum("n").alias("score"), F.first("name").alias("name"), F.first("tactics").alias("tactics"))
    )
    rank = F.row_number().over(Window.partitionBy("rule_id").orderBy(F.desc("score"), "technique_id"))
    return scores.withColumn("rank", rank).where((F.col("rank") <= TOP) & (F.col("score") > 1)).select(
        "rule_id", "technique_id", "name", "tactics", "score", "rank"
    )
