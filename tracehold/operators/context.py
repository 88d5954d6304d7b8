"""Rules that look at the last N lines instead of one.

The frame is the N rows ending at the current one, in time order over all logs
or per key.  Rows are windowed in chunks with N - 1 copied rows at the edges, so
one busy host is not one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracehold.functions.regexes import DOTTED_QUAD, to_java
from tracehold.operators.detect import rule_struct, whole_line
from tracehold.operators.ordered import drop_helpers, trailing
from tracehold.session import stage
from tracehold.sources.rules import Rule

# Thresholds of the built-in context kinds.
BRUTE_FORCE_FAILURES = 3
RECON_ADDRESSES = 5
USER_PATTERN = "user"
PRIVILEGE_PATTERN = "sudo|root"


def _signals(rule: Rule, line: Column) -> dict[str, Column]:
    """Per-row values a rule needs, computed once before windowing."""
    hit = line.rlike(to_java(rule.pattern))
    negative = line.rlike(to_java(rule.negative_pattern)) if rule.negative_pattern else F.lit(False)
    if "BRUTE_FORCE" in rule.rule_id:
        return {"fail": (hit & ~negative).cast("int")}
    if "RECON" in rule.rule_id:
        found = F.regexp_extract_all(line, F.lit(f"({DOTTED_QUAD})"), F.lit(1))
        none = F.array().cast("array<string>")
        return {"ips": found, "off": F.when(negative, found).otherwise(none)}
    if "PRIVILEGE_ESCALATION" in rule.rule_id:
        return {"user": line.rlike(USER_PATTERN), "root": line.rlike(PRIVILEGE_PATTERN), "neg": negative}
    return {"hit": hit, "neg": negative}


def _fires(rule: Rule, name, frame) -> Column:
    """Whether the frame triggers the rule; ``name`` gives the signal columns."""
    if "BRUTE_FORCE" in rule.rule_id:
        return F.sum(name("fail")).over(frame) >= BRUTE_FORCE_FAILURES
    if "RECON" in rule.rule_id:
        seen, excluded = [
            F.size(F.array_distinct(F.flatten(F.collect_list(name(s)).over(frame)))) for s in ("ips", "off")
        ]
        return seen - excluded >= RECON_ADDRESSES
    if "PRIVILEGE_ESCALATION" in rule.rule_id:
        return F.max(name("user")).over(frame) & F.max(name("root")).over(frame) & ~F.max(name("neg")).over(frame)
    return F.max(name("hit")).over(frame) & ~F.max(name("neg")).over(frame)


def detect_with_context(
    logs: DataFrame, rules: list[Rule], lines: int, keys: list[str] | None = None, row_id: str = "event_id", **chunking
) -> DataFrame:
    """One alert per rule and line whose trailing frame of ``lines`` rows triggers the rule.

    ``row_id`` must be unique.
    """
    line = whole_line(logs)
    signals = {
        f"_r{i}_{s}": column for i, rule in enumerate(rules) for s, column in _signals(rule, line).items()
    }
    # Only what the rules need is sorted; the rows come back by id for the lines that fire.
    narrow = logs.select(*dict.fromkeys([*(keys or []), "ts", row_id]), *[c.alias(n) for n, c in signals.items()])
    copies, order = trailing(narrow, keys or [], ["ts", row_id], lines - 1, **chunking)
    frame = order.rowsBetween(-(lines - 1), 0)
    fired = [
        F.when(_fires(rule, lambda s, i=i: F.col(f"_r{i}_{s}"), frame), F.lit(i)) for i, rule in enumerate(rules)
    ]
    copies = copies.withColumn("_rules", F.array_compact(F.array(*fired)))
    # Written out, so that a few hits are broadcast to the rows instead of shuffling all rows.
    hits = stage(drop_helpers(copies).where(F.size("_rules") > 0).select(row_id, "_rules"), "context")
    hit = logs.join(hits, row_id).withColumn("_rule", F.explode("_rules"))
    rule = rule_struct(rules, F.col("_rule"))
    return hit.select(
        rule["id"].alias("RULE_ID"), rule["sev"].alias("SEVERITY"), rule["text"].alias("DESCRIPTION"), *logs.columns
    )
