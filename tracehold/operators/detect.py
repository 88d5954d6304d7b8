"""Rule matching: one alert per (line, matching rule), in the scan stage.

The rules are compiled into one projection of literal-pattern ``rlike`` tests,
so matching needs no join and no shuffle.  A literal guard in front of a regex
lets most lines skip it.  The conditions are written as SQL text: a hundred
rules become one expression instead of thousands of calls into the JVM.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracehold.functions.regexes import literal_guard, to_java
from tracehold.functions.severity import SEVERITY_LEVELS, severity_level
from tracehold.schema import LOG_FIELDS
from tracehold.sources.rules import Rule


def quoted(text: str) -> str:
    """A Spark SQL string literal."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    return f"'{escaped}'"


def whole_line_sql(columns: list[str]) -> str:
    """The tab-separated line a normalized row stands for."""
    present = [c for c in LOG_FIELDS if c in columns]
    return "concat_ws('\\t', " + ", ".join(f"coalesce({c}, '')" for c in present) + ")"


def whole_line(df: DataFrame) -> Column:
    return F.expr(whole_line_sql(df.columns))


def _may_match_nothing(pattern: str) -> bool:
    try:
        return re.search(pattern, "") is not None
    except re.error:
        return True


def match_sql(text: str, pattern: str, ignore_case: bool = False, guard: bool = True) -> str:
    """Regex search of a SQL expression, with an optional literal guard in front."""
    pattern = to_java(pattern)
    if ignore_case:
        return f"{text} rlike {quoted('(?i)' + pattern)}"
    test = f"{text} rlike {quoted(pattern)}"
    literals = literal_guard(pattern) if guard else None
    if literals:
        return "(" + " or ".join(f"contains({text}, {quoted(part)})" for part in literals) + f") and {test}"
    return test


def condition_sql(
    columns: list[str], rule: Rule, field_base: int = 0, ignore_case: bool = False, guard: bool = True
) -> str:
    """Does a row match a rule?  Fields count from ``field_base`` in the log columns.

    Only non-empty fields are searched; without fields the whole line is.  The
    negative pattern always looks at the whole line.
    """
    if rule.fields:
        names = [LOG_FIELDS[i - field_base] for i in rule.fields if 0 <= i - field_base < len(LOG_FIELDS)]
        tests = []
        for name in names:
            test = f"({match_sql(name, rule.pattern, ignore_case, guard)})"
            tests.append(f"({name} <> '' and {test})" if _may_match_nothing(to_java(rule.pattern)) else test)
        hit = " or ".join(tests) or "false"
    else:
        hit = match_sql(whole_line_sql(columns), rule.pattern, ignore_case, guard)
    if rule.negative_pattern:
        hit = f"({hit}) and not {match_sql(whole_line_sql(columns), rule.negative_pattern, ignore_case, guard=False)}"
    return hit


def rule_struct(rules: list[Rule], number: Column) -> Column:
    """id, sev and text of the rule with a number."""
    rows = ", ".join(
        f"named_struct('id', {quoted(r.rule_id)}, 'sev', {quoted(r.severity)}, 'text', {quoted(r.description)})" for r in rules
    )
    return F.get(F.expr(f"array({rows})"), number)


def detect(
    logs: DataFrame, rules: list[Rule], field_base: int = 0, ignore_case: bool = False, guard: bool = True
) -> DataFrame:
    """Alerts: RULE_ID, SEVERITY, DESCRIPTION and the columns of the log row."""
    if not rules:
        raise ValueError("no rules")
    hits = [
        f"case when {condition_sql(logs.columns, rule, field_base, ignore_case, guard)} then {i} end"
        for i, rule in enumerate(rules)
    ]
    # Short arrays keep the generated methods small enough for the JVM to compile.
    parts = [f"array_compact(array({', '.join(hits[i : i + 10])}))" for i in range(0, len(hits), 10)]
    # The outer form: for a plain explode Spark infers a filter that runs every test a second time.
    numbers = logs.withColumn("_rule", F.expr(f"explode_outer(concat({', '.join(parts)}))"))
    matched = numbers.where(F.col("_rule").isNotNull())
    rule = rule_struct(rules, F.col("_rule"))
    return matched.select(
        rule["id"].alias("RULE_ID"), rule["sev"].alias("SEVERITY"), rule["text"].alias("DESCRIPTION"), *logs.columns
    )


def filter_by_severity(alerts: DataFrame, minimum: str) -> DataFrame:
    """Alerts at or above a severity."""
    if minimum not in SEVERITY_LEVELS:
        raise ValueError(f"unknown severity {minimum!r}")
    return alerts.where(severity_level("SEVERITY") >= SEVERITY_LEVELS[minimum])


def rule_id_parts(rule_id: Column) -> list[Column]:
    """category, subcategory and number of ``CATEGORY-SUBCATEGORY-NUMBER``."""
    form = r"^([A-Z0-9]+)-([A-Z0-9_]+)-([0-9]+)$"
    return [
        F.regexp_extract(rule_id, form, 1).alias("category"),
        F.regexp_extract(rule_id, form, 2).alias("subcategory"),
        F.regexp_extract(rule_id, form, 3).try_cast("int").alias("number"),
    ]


def rule_coverage(logs: DataFrame, rules: list[Rule], log_column: str, names: DataFrame | None = None) -> DataFrame:
    """Hits of every rule file on every log, zeros included.

    ``names`` lists the logs, one column of that name; logs without a row count zero there.

    Counting happens per log inside the scan: one row per log leaves the
    partial aggregation, and its counters are then turned into rows.
    """
    files = sorted({r.rule_file for r in rules})
    counters = []
    for i, name in enumerate(files):
        hits = [f"int(coalesce({condition_sql(logs.columns, r)}, false))" for r in rules if r.rule_file == name]
        counters.append(F.expr(f"sum({' + '.join(hits)})").alias(f"_n{i}"))
    per_log = logs.groupBy(log_column).agg(*counters)
    if names is not None:
        per_log = names.select(log_column).distinct().join(per_log, log_column, "left").fillna(0)
    cells = F.array(*[F.struct(F.lit(n).alias("rule_file"), F.col(f"_n{i}").alias("hits")) for i, n in enumerate(files)])
    return per_log.select(log_column, F.explode(cells).alias("cell")).select("cell.rule_file", log_column, "cell.hits")
