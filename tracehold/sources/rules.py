"""Rule packs: reading, validating and compiling them.

A pack is a text file of ``ID;DESCRIPTION;PATTERN;SEVERITY;FIELDS;TAGS;NEGATIVE``
lines with an optional ``# Key: value`` header.  Packs become a DataFrame of
rules; a checked number of rows may be collected into :class:`Rule` objects,
which shape the detection plan.
"""

from __future__ import annotations

from dataclasses import dataclass
from importlib import resources

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracehold.functions.severity import SEVERITY_LEVELS, severity_level

# Header keys of a rule file and the columns they fill.
HEADER_KEYS = {
    "version": "Version",
    "category": "Category",
    "tags": "Tags",
    "last_updated": "Last updated",
    "author": "Author",
}


@dataclass(frozen=True)
class Rule:
    rule_id: str
    description: str
    pattern: str
    severity: str = "MEDIUM"
    fields: tuple[int, ...] = ()
    tags: tuple[str, ...] = ()
    negative_pattern: str = ""
    rule_file: str = ""


def read_rule_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the rule files below ``path`` as (rule_file, value)."""
    lines = spark.read.text(path, pathGlobFilter="*.rules")
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.rules$", 1)
    return lines.select(name.alias("rule_file"), "value")


def bundled_rule_lines(spark: SparkSession) -> DataFrame:
    """Lines of the packs shipped with the package (110 rules, nine files)."""
    rows = []
    for file in sorted(resources.files("tracehold.data").joinpath("rules").iterdir(), key=lambda f: f.name):
        if file.name.endswith(".rules"):
            rows += [(file.name.removesuffix(".rules"), line) for line in file.read_text().splitlines()]
    return spark.createDataFrame(rows, "rule_file string, value string")


def parse_rules(lines: DataFrame) -> DataFrame:
    """One row per valid rule; an empty or unknown severity becomes MEDIUM."""
    part = F.split(F.col("value"), ";", 7)

    def piece(i: int):
        return F.coalesce(F.try_element_at(part, F.lit(i + 1)), F.lit(""))

    rules = lines.where((F.trim("value") != "") & ~F.col("value").rlike(r"^\s*#")).select(
        "rule_file",
        piece(0).alias("rule_id"),
        piece(1).alias("description"),
        piece(2).alias("pattern"),
        F.when(piece(3).isin(list(SEVERITY_LEVELS)), piece(3)).otherwise("MEDIUM").alias("severity"),
        F.filter(
            F.transform(F.split(piece(4), ","), lambda x: x.try_cast("int")), lambda x: x.isNotNull()
        ).alias("fields"),
        F.filter(F.transform(F.split(piece(5), ","), lambda x: F.trim(x)), lambda x: x != "").alias("tags"),
        piece(6).alias("negative_pattern"),
    )
    return rules.where((F.col("rule_id") != "") & (F.col("pattern") != "")).withColumn(
        "severity_level", severity_level("severity")
    )


def rule_file_metadata(lines: DataFrame) -> DataFrame:
    """Header values per rule file; the empty string where a key is missing."""
    found = []
    for column, key in HEADER_KEYS.items():
        text = F.regexp_extract("value", rf"^# *{key}: *(.*)$", 1)
        found.append(F.coalesce(F.max(F.when(F.col("value").startswith("#"), F.trim(text))), F.lit("")).alias(column))
    return lines.groupBy("rule_file").agg(*found)


def compile_rules(rules: DataFrame, limit: int | None = 5_000) -> list[Rule]:
    """Collect a rule pack; ``detect_table`` takes tables of any size."""
    rows = (rules if limit is None else rules.limit(limit + 1)).collect()
    if limit is not None and len(rows) > limit:
        raise ValueError(f"more than {limit} rules: use rule_tables.detect_table")
    return [
        Rule(
            r.rule_id, r.description, r.pattern, r.severity, tuple(r.fields), tuple(r.tags), r.negative_pattern, r.rule_file
        )
        for r in sorted(rows, key=lambda r: (r.rule_file, r.rule_id))
    ]


def bundled_rules() -> list[Rule]:
    """The shipped packs without a Spark job, in file order."""
    rules = []
    for file in sorted(resources.files("tracehold.data").joinpath("rules").iterdir(), key=lambda f: f.name):
        if not file.name.endswith(".rules"):
            continue
        for line in file.read_text().splitlines():
            if line.strip() and not line.startswith("#"):
                rules.append(rule_from_line(line, file.name.removesuffix(".rules")))
    return rules


def rule_from_line(line: str, rule_file: str = "") -> Rule:
    parts = (line.split(";", 6) + [""] * 7)[:7]
    return Rule(
        parts[0],
        parts[1],
        parts[2],
        parts[3] if parts[3] in SEVERITY_LEVELS else "MEDIUM",
        tuple(int(f) for f in parts[4].split(",") if f.strip().isdigit()),
        tuple(t.strip() for t in parts[5].split(",") if t.strip()),
        parts[6],
        rule_file,
    )
