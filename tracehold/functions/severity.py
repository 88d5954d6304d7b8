"""Severity names and levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity names with the level used for filtering.
SEVERITY_LEVELS = {"INFO": 10, "LOW": 20, "MEDIUM": 30, "HIGH": 40, "CRITICAL": 50}


def severity_level(severity: Column | str) -> Column:
    """10 to 50 for a known name, 0 otherwise."""
    name = F.col(severity) if isinstance(severity, str) else severity
    level = F.lit(0)
    for known, value in SEVERITY_LEVELS.items():
        level = F.when(name == known, value).otherwise(level)
    return level


def severity_name(level: Column | str) -> Column:
    """Name of a level; a level below LOW (unknown names included) reads INFO."""
    value = F.col(level) if isinstance(level, str) else level
    return (
        F.when(value >= 50, "CRITICAL")
        .when(value >= 40, "HIGH")
        .when(value >= 30, "MEDIUM")
        .when(value >= 20, "LOW")
        .otherwise("INFO")
    )


def max_severity(severity: Column | str) -> Column:
    """Aggregate: the highest severity of a group, by name."""
    return severity_name(F.max(severity_level(severity)))
