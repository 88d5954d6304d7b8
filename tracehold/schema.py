"""Record shapes shared by every stage."""

from __future__ import annotations

from pyspark.sql import types as T

# The ten columns of a normalized log row, in file order.
LOG_FIELDS = [
    "timestamp",
    "source_type",
    "source_name",
    "log_level",
    "username",
    "hostname",
    "ip_address",
    "service",
    "process_id",
    "message",
]

# Columns an alert puts in front of the log row.
ALERT_FIELDS = ["RULE_ID", "SEVERITY", "DESCRIPTION"]

LOG_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in LOG_FIELDS])
ALERT_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in ALERT_FIELDS + LOG_FIELDS])

INDICATOR_SCHEMA = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("indicator", T.StringType()),
        T.StructField("is_malicious", T.BooleanType()),
        T.StructField("threat_type", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("source", T.StringType()),
        T.StructField("last_updated", T.TimestampType()),
    ]
)
