"""Detection with a table of rules of any size.

Compiled plans suit packs of some hundred rules.  A rule made for every known
indicator is data, so here rules meet lines by a join: the literals that every match of
a rule contains (its guard) file it, lines look up the rules filed under what they
contain, and only such pairs are tested.  Rules without
such a literal are compiled in chunks.

While the literals fit one automaton (``SHARD_CHARS``), lines are read once and keep what
they hold; no line is joined back.  Larger tables file rules under short substrings of
their literals and lines look up all of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracehold.functions.regexes import literal_guard, to_java
from tracehold.operators.automaton import SHARD_CHARS, characters, literals_in
from tracehold.operators.detect import detect, whole_line
from tracehold.schema import LOG_FIELDS
from tracehold.session import stage
from tracehold.sources.rules import compile_rules

#: Lengths of the substrings rules are filed under, longest first, and rules of one compiled plan.
GRAMS = (10, 6, 3)
CHUNK = 500
#: Keys of a few dozen bytes each that are broadcast at most.
BROADCAST_KEYS = 500_000


def _filed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rules with the literals a matching line must hold one of, and the substrings those are filed under; empty where none is known."""
    for rules in batches:
        keys, guards = [], []
        for pattern in rules["pattern"]:
            guard = literal_guard(to_java(pattern)) or [""]
            size = next((g for g in GRAMS if min(map(len, guard)) >= g), 0)
            # Values end in what tells them apart, so the last characters are the key.
            keys.append(sorted({g[-size:] for g in guard}) if size else [])
            guards.append(sorted(set(guard)) if size else [])
        yield rules.assign(java=[to_java(p) for p in rules["pattern"]], java_negative=[to_java(p) for p in rules["negative_pattern"]], keys=keys, guards=guards)


def _grams(line: Column, sizes: list[int]) -> Column:
    """The substrings of a line of the given lengths, by a search that looks ahead at every character."""
    return F.concat(*[F.regexp_extract_all(line, F.lit(rf"(?=([\s\S]{{{n}}}))"), F.lit(1)) for n in sizes])


def _tested(pairs: DataFrame, field_base: int) -> DataFrame:
    """Of pairs of a rule and a line those that match; ``_values`` are the line's fields."""
    line, java, negative = F.col("_line"), F.col("java"), F.col("java_negative")

    def holds(i: Column) -> Column:
        value = F.coalesce(F.get("_values", i - field_base), F.lit(""))
        return (value != "") & F.rlike(value, java)

    hit = F.when(F.size("fields") > 0, F.exists("fields", holds)).otherwise(F.rlike(line, java))
    return pairs.where(hit & ((negative == "") | ~F.rlike(line, negative)))


def _by_automaton(logs: DataFrame, filed: DataFrame, literals: DataFrame, names: Column, field_base: int) -> DataFrame:
    """Lines with the literals they hold meet the rules of those; a rule is tested at the least of its literals."""
    lines = logs.select(F.struct(*[F.col(f"`{c}`") for c in logs.columns]).alias("_row"), names.alias("_values"), whole_line(logs).alias("_line"))
    held = lines.withColumn("_held", literals_in(F.col("_line"), literals, "_literal"))
    # The outer form: for a plain explode Spark infers a filter that reads every line a second time.
    held = held.withColumn("_literal", F.explode_outer("_held")).where(F.col("_literal").isNotNull())
    rules = filed.select(F.explode("guards").alias("_literal"), "guards", "rule_id", "severity", "description", "fields", "java", "java_negative")
    pairs = held.join(rules, "_literal")
    first = (F.size("guards") == 1) | (F.array_min(F.array_intersect("guards", "_held")) == F.col("_literal"))
    found = _tested(pairs.where(first), field_base)
    return found.select(F.col("rule_id").alias("RULE_ID"), F.col("severity").alias("SEVERITY"), F.col("description").alias("DESCRIPTION"), "_row.*")


def _by_substrings(logs: DataFrame, filed: DataFrame, names: Column, row_id: str, field_base: int) -> DataFrame:
    """Ids and substrings meet the rules first; a row with such a pair joins it back by ``row_id`` and is tested."""
    keyed = filed.select("_n", F.explode("keys").alias("_gram"))
    by_size = keyed.groupBy(F.length("_gram").alias("size")).agg(F.count("*").alias("n")).collect()  # of GRAMS, so three rows at most
    sizes = [r.size for r in by_size]
    if sum(r.n for r in by_size) <= BROADCAST_KEYS:
        keyed = F.broadcast(keyed)  # else both sides are shuffled by substring
    grams = logs.select(F.col(row_id).alias("_id"), F.explode(_grams(whole_line(logs), sizes or [1])).alias("_gram"))
    near = grams.join(keyed, "_gram").select("_id", "_n").distinct()
    lines = logs.select(F.col(row_id).alias("_id"), names.alias("_values"), whole_line(logs).alias("_line"))
    tests = filed.select("_n", "rule_id", "severity", "description", "fields", "java", "java_negative")
    found = _tested(near.join(tests, "_n").join(lines, "_id"), field_base)
    found = found.select("_n", "_id", F.col("rule_id").alias("RULE_ID"), F.col("severity").alias("SEVERITY"), F.col("description").alias("DESCRIPTION")).distinct()
    return found.join(logs.withColumn("_id", F.col(row_id)), "_id").select("RULE_ID", "SEVERITY", "DESCRIPTION", *logs.columns)


def detect_table(logs: DataFrame, rules: DataFrame, row_id: str = "event_id", field_base: int = 0, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """Alerts as :func:`detect` gives them, for ``rules`` as :func:`parse_rules` returns them.

    A table of rules whose literals have more than ``shard_chars`` characters needs a unique
    ``row_id`` in the logs.
    """
    schema = rules.schema.simpleString()[len("struct<") : -1] + ",java:string,java_negative:string,keys:array<string>,guards:array<string>"
    filed = stage(rules.mapInPandas(_filed, schema).withColumn("_n", F.monotonically_increasing_id()), "rules")
    names = F.array(*[F.coalesce(F.col(c), F.lit("")) if c in logs.columns else F.lit("") for c in LOG_FIELDS])
    literals = filed.select(F.explode("guards").alias("_literal")).distinct()
    if characters(literals, "_literal") <= shard_chars:
        parts = [_by_automaton(logs, filed, literals, names, field_base)]
    else:
        parts = [_by_substrings(logs, filed, names, row_id, field_base)]
    rest = filed.where(F.size("keys") == 0).drop("_n", "java", "java_negative", "keys", "guards")
    chunks = -(-rest.count() // CHUNK)
    for k in range(chunks):
        chunk = rest.where(F.pmod(F.xxhash64("rule_id", "pattern"), F.lit(chunks)) == k)
        parts += [detect(logs, part, field_base) for part in [compile_rules(chunk, limit=None)] if part]
    return reduce(DataFrame.unionByName, parts)
