"""Queries: collecting, parsing and normalizing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracehold.operators import parse
from tracehold.operators.parse import SourceConfig
from tracehold.plans.registry import query
from tracehold.plans.views import (
    ALERTS_CTE,
    DEFAULT_YEAR,
    LOGS_CTE,
    SYSLOG_SQL,
    alerts,
    as_text,
    logs,
    sql_text,
    stamp_sql,
    syslog_lines,
    table,
)
from tracehold.schema import ALERT_FIELDS, LOG_FIELDS
from tracehold.session import staging_path
from tracehold.sources import logs as sources

# Filters of the shipped syslog source plus one of our own.
EXCLUDE = "(last message repeated [0-9]+ times)|session opened"
FILTER = "sshd|bash"

QUAD_SQL = sql_text("([0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3})")


def staged_lines(spark: SparkSession, folder: str, per_source: bool = False) -> str:
    """The raw syslog lines as text files below the staging folder."""
    rows = logs(spark, folder)
    path = staging_path(spark, "lines")
    lines = syslog_lines(rows)
    if per_source:
        lines.join(rows.select("event_id", "source_type"), "event_id").drop("event_id").write.partitionBy("source_type").text(path)
    else:
        lines.select("value").write.text(path)
    return path


@query(
    "read_log_lines",
    f"WITH {LOGS_CTE}, l AS (SELECT {SYSLOG_SQL} AS value FROM logs) "
    f"SELECT value FROM l WHERE regexp_matches(value, {sql_text(FILTER)}) AND NOT regexp_matches(value, {sql_text(EXCLUDE)})",
)
def read_log_lines(spark, folder):
    """A1: lines of text files, filtered, then cut by the exclusion."""
    return sources.read_log_lines(spark, staged_lines(spark, folder), FILTER, EXCLUDE).select("value")


def _sources(path: str) -> list[SourceConfig]:
    return [
        SourceConfig("auth", paths=(f"{path}/source_type=auth",), priority=10),
        SourceConfig("syslog", paths=(f"{path}/source_type=syslog",), priority=20, exclude_regex=EXCLUDE),
        SourceConfig("apache", paths=(f"{path}/source_type=apache",), priority=30),
        SourceConfig("firewall", paths=(f"{path}/source_type=firewall",), priority=40, enabled=False),
    ]


@query(
    "collect_all",
    f"WITH {LOGS_CTE}, l AS (SELECT source_type, {SYSLOG_SQL} AS value FROM logs WHERE source_type <> 'firewall') "
    f"SELECT source_type, count(*) AS lines FROM l WHERE source_type <> 'syslog' OR NOT regexp_matches(value, {sql_text(EXCLUDE)}) "
    "GROUP BY source_type",
)
def collect_all(spark, folder):
    """A2: all enabled sources, one output per source, counted."""
    path = staged_lines(spark, folder, per_source=True)
    out = staging_path(spark, "collected")
    sources.write_collected(sources.collect_all(spark, _sources(path)), out, "run1")
    collected = spark.read.parquet(out)
    return sources.collection_counts(collected).groupBy(F.col("source_type").cast("string").alias("source_type")).agg(
        F.sum("lines").alias("lines")
    )


@query("read_rotated_logs", f"WITH {LOGS_CTE} SELECT {SYSLOG_SQL} AS value FROM logs")
def read_rotated_logs(spark, folder):
    """A3: a log continued in rotated and compressed files."""
    lines = syslog_lines(logs(spark, folder)).select("value")
    path = staging_path(spark, "rotated")
    halves = lines.withColumn("_old", F.xxhash64("value") % 2 == 0)
    halves.where("_old").select("value").write.text(f"{path}/auth.log.1", compression="gzip")
    halves.where("not _old").select("value").write.text(f"{path}/auth.log")
    return sources.read_log_lines(spark, sources.with_rotated(f"{path}/auth.log")).select("value")


@query(
    "normalized_roundtrip",
    f"WITH {LOGS_CTE} SELECT {', '.join(LOG_FIELDS)} FROM logs",
)
def normalized_roundtrip(spark, folder):
    """A5: normalized rows written and read as tab-separated text."""
    path = staging_path(spark, "normalized")
    sources.write_normalized(logs(spark, folder), path)
    return sources.read_normalized(spark, path).select(*LOG_FIELDS)


@query(
    "parse_configured",
    f"""WITH {LOGS_CTE} SELECT event_id, strftime(ts, '%Y/%m/%d %H:%M:%S') AS timestamp, username, ip_address, service, hostname, message,
  {stamp_sql("date_trunc('second', ts)")} AS ts FROM logs WHERE strpos(message, ';') = 0""",
)
def parse_configured(spark, folder):
    """Pairs and stamps of a form that the source configures."""
    rows = logs(spark, folder).where(~F.col("message").contains(";"))
    pairs = [F.concat(F.lit(f"{k}:"), F.col(c)) for k, c in (("user", "username"), ("ip", "ip_address"), ("service", "service"), ("host", "hostname"), ("msg", "message"))]
    line = F.concat_ws(";", F.date_format("ts", "yyyy/MM/dd HH:mm:ss"), *pairs)
    config = SourceConfig("app", "structlog", stamp_regex=r"^([0-9/]+ [0-9:]+);", pair_regex=r"(?<=;)([a-z]+):([^;]*)")
    found = parse.parse_source(rows.select("event_id", line.alias("value")), config, DEFAULT_YEAR)
    return as_text(found.select("event_id", "timestamp", "username", "ip_address", "service", "hostname", "message", "ts"))


@query(
    "source_status",
    "SELECT r_name AS source_type, CASE WHEN r_regionkey = 4 THEN 'disabled' WHEN r_regionkey % 2 = 0 THEN 'ok' ELSE 'failed' END AS status FROM region",
)
def source_status_query(spark, folder):
    """A2: a source per region: with a file, without one, disabled."""
    region = table(spark, folder, "region").collect()
    path = staging_path(spark, "sources")
    table(spark, folder, "nation").select("n_name").write.text(path)
    paths = {r.r_name: path if r.r_regionkey % 2 == 0 else f"{path}-none" for r in region}
    return sources.source_status(spark, [SourceConfig(r.r_name, paths=(paths[r.r_name],), enabled=r.r_regionkey != 4) for r in region])


@query(
    "load_table",
    f"SELECT event_id, {stamp_sql('ts')} AS timestamp, round(value, 6) + 0.0 AS value FROM events "
    "WHERE event_type <> 'error' UNION ALL SELECT event_id, NULL, round(value, 6) + 0.0 FROM events WHERE event_type = 'error'",
)
def load_table(spark, folder):
    """A csv table whose unreadable times become null."""
    path = staging_path(spark, "table")
    rows = table(spark, folder, "events")
    stamp = F.when(F.col("event_type") == "error", "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    rows.select("event_id", stamp.alias("timestamp"), "value").write.csv(path, header=True)
    return as_text(sources.load_table(spark, path, "csv", schema="event_id long, timestamp string, value double"))


@query(
    "sanitize",
    "SELECT doc_id, regexp_replace(text, '[\\x00-\\x1F\\x7F]', '', 'g') AS clean FROM documents",
)
def sanitize(spark, folder):
    """B1: control bytes removed from whole texts."""
    return table(spark, folder, "documents").select("doc_id", parse.sanitize(F.col("text")).alias("clean"))


# The raw line is taken apart from the front, stage by stage, as the parser does.
PARSED_SYSLOG = f"""WITH {LOGS_CTE}, s0 AS (SELECT event_id, {SYSLOG_SQL} AS v FROM logs),
s1 AS (SELECT event_id, regexp_extract(v, '^([A-Za-z]+\\s+[0-9]+\\s+[0-9:]+)\\s+(.*)', 1) AS timestamp,
  regexp_extract(v, '^([A-Za-z]+\\s+[0-9]+\\s+[0-9:]+)\\s+(.*)', 2) AS r1 FROM s0),
s2 AS (SELECT *, regexp_extract(r1, '^([^\\s]+)\\s+(.*)', 1) AS hostname, regexp_extract(r1, '^([^\\s]+)\\s+(.*)', 2) AS r2 FROM s1),
s3 AS (SELECT *, regexp_extract(r2, '^([^:\\s]+?)(\\[([0-9]+)\\])?:\\s+(.*)', 1) AS service,
  regexp_extract(r2, '^([^:\\s]+?)(\\[([0-9]+)\\])?:\\s+(.*)', 3) AS process_id,
  regexp_extract(r2, '^([^:\\s]+?)(\\[([0-9]+)\\])?:\\s+(.*)', 4) AS message FROM s2)
SELECT event_id, timestamp, 'syslog' AS source_type, '' AS source_name, '' AS log_level,
  regexp_extract(message, 'user\\s*[=:]?\\s*([^\\s]+)', 1) AS username, hostname,
  regexp_extract(message, {QUAD_SQL}, 1) AS ip_address, service, process_id, message,
  strftime(strptime('{DEFAULT_YEAR} ' || timestamp, '%Y %b %-d %H:%M:%S'), '%Y-%m-%d %H:%M:%S.%f') AS ts FROM s3"""


@query("parse_syslog", PARSED_SYSLOG)
def parse_syslog(spark, folder):
    """Raw syslog lines to normalized rows with a time."""
    lines = syslog_lines(logs(spark, folder))
    rows = parse.parse_source(lines, SourceConfig("syslog"), DEFAULT_YEAR)
    return as_text(rows.select("event_id", *LOG_FIELDS, "ts"))


@query("parse_transformed", PARSED_SYSLOG)
def parse_transformed(spark, folder):
    """A source's own transform takes the priority off the lines before they are parsed."""
    lines = syslog_lines(logs(spark, folder)).withColumn("value", F.concat(F.lit("<34>"), "value"))
    own = SourceConfig("syslog", transform=lambda df: df.withColumn("value", F.regexp_replace("value", "^<[0-9]+>", "")))
    return as_text(parse.parse_source(lines, own, DEFAULT_YEAR).select("event_id", *LOG_FIELDS, "ts"))


def json_lines(rows: DataFrame) -> DataFrame:
    body = F.to_json(
        F.struct(
            "timestamp", F.col("log_level").alias("level"), "message", "service", F.struct(F.col("username").alias("name")).alias("user"),
        )
    )
    # Every tenth source row carries broken JSON with the fallback's own field names.
    broken = F.concat(F.lit('{"username":"'), F.col("username"), F.lit('","message":"'), F.col("message"), F.lit('",'))
    return rows.select("event_id", F.when(F.col("log_level") == "WARN", broken).otherwise(body).alias("value"))


@query(
    "parse_json",
    f"""WITH {LOGS_CTE} SELECT event_id,
  CASE WHEN log_level = 'WARN' THEN '' ELSE timestamp END AS timestamp, 'json' AS source_type, '' AS source_name,
  CASE WHEN log_level = 'WARN' THEN '' ELSE log_level END AS log_level, username, '' AS hostname,
  CASE WHEN log_level = 'WARN' THEN '' ELSE regexp_extract(message, {QUAD_SQL}, 1) END AS ip_address,
  CASE WHEN log_level = 'WARN' THEN '' ELSE service END AS service, '' AS process_id, message FROM logs""",
)
def parse_json(spark, folder):
    """JSON lines, with the pair search for lines that are no JSON."""
    fields = {"timestamp": "timestamp", "log_level": "level", "message": "message", "service": "service", "username": "user.name"}
    config = SourceConfig("json", "json", json_fields=fields)
    return parse.parse_source(json_lines(logs(spark, folder)), config).select("event_id", *LOG_FIELDS)


def kv_lines(rows: DataFrame) -> DataFrame:
    line = F.concat(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit(" user="), F.col("username"), F.lit(" level="), F.lower("log_level"),
        F.lit(" host="), F.col("hostname"), F.lit(" ip=0.0.0.0 client_ip="), F.col("ip_address"), F.lit(" pid="), F.col("process_id"),
        F.when(F.col("source_type") != "apache", F.concat(F.lit(' msg="'), F.col("message"), F.lit('"'))).otherwise(F.lit(" note=none")),
    )
    return rows.select("event_id", line.alias("value"))


_KV_SQL = (
    "strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z user=' || username || ' level=' || lower(log_level) || ' host=' || hostname || "
    "' ip=0.0.0.0 client_ip=' || ip_address || ' pid=' || process_id || "
    "CASE WHEN source_type <> 'apache' THEN ' msg=\"' || message || '\"' ELSE ' note=none' END"
)


@query(
    "parse_structlog",
    f"""WITH {LOGS_CTE}, l AS (SELECT *, {_KV_SQL} AS v FROM logs)
SELECT event_id, regexp_extract(v, '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9:]{{8}}.[0-9]{{3}}Z)', 1) AS timestamp,
  'structlog' AS source_type, '' AS source_name, lower(log_level) AS log_level,
  CASE WHEN source_type <> 'apache' AND message LIKE '%user=%' THEN username ELSE username END AS username, hostname, ip_address,
  '' AS service, process_id, CASE WHEN source_type <> 'apache' THEN message ELSE v END AS message FROM l""",
)
def parse_structlog(spark, folder):
    """key=value lines; repeated aliases resolve to the last one."""
    rows = parse.parse_source(kv_lines(logs(spark, folder)), SourceConfig("structlog", "structlog"))
    return rows.select("event_id", *LOG_FIELDS)


# The expressions of the shipped custom source.
CUSTOM_PATTERNS = {
    "timestamp": r"^([A-Za-z]{3}\s+\d{1,2}\s+\d{1,2}:\d{2}:\d{2})",
    "username": r"(?:user|account|login)[=: ]+([a-zA-Z0-9_\.\-@]+)",
    "ip_address": r"\b((?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?))\b",
    "service": r"([a-zA-Z][a-zA-Z0-9_\-\.]*)\[(\d+)\]",
}


def _custom(name: str) -> str:
    return f"regexp_extract(v, {sql_text(CUSTOM_PATTERNS[name])}, 1) AS {name}"


@query(
    "parse_custom",
    f"""WITH {LOGS_CTE}, l AS (SELECT event_id, {SYSLOG_SQL} AS v FROM logs)
SELECT event_id, {_custom('timestamp')}, 'auth' AS source_type, '' AS source_name, '' AS log_level, {_custom('username')},
  '' AS hostname, {_custom('ip_address')}, {_custom('service')}, '' AS process_id, v AS message FROM l""",
)
def parse_custom(spark, folder):
    """Optional expressions, group 1 each."""
    config = SourceConfig("auth", "custom", patterns=CUSTOM_PATTERNS)
    return parse.parse_source(syslog_lines(logs(spark, folder)), config).select("event_id", *LOG_FIELDS)


@query(
    "parse_unknown",
    f"""SELECT doc_id, '' AS timestamp, 'notes' AS source_type, '' AS source_name, '' AS log_level, '' AS username, '' AS hostname,
  '' AS ip_address, '' AS service, '' AS process_id, regexp_replace(text, '[\\x00-\\x1F\\x7F]', '', 'g') AS message
FROM documents WHERE text <> ''""",
)
def parse_unknown(spark, folder):
    """An unknown format keeps the whole line."""
    lines = table(spark, folder, "documents").select("doc_id", F.col("text").alias("value"))
    return parse.parse_source(lines, SourceConfig("notes", "mystery")).select("doc_id", *LOG_FIELDS)


@query(
    "filter_logs",
    f"WITH {LOGS_CTE} SELECT event_id, username, message FROM logs WHERE username = 'root'",
)
def filter_logs(spark, folder):
    """Rows whose column equals a value."""
    return parse.filter_logs(logs(spark, folder), "username", "root").select("event_id", "username", "message")


@query(
    "json_to_kv",
    f"""WITH {LOGS_CTE} SELECT event_id, CASE WHEN message LIKE '%=%=%' THEN '{{"message":"' || message || '","time":"' || timestamp || '","user":"' || username || '"}}'
  ELSE timestamp || ' message=' || CASE WHEN message LIKE '% %' THEN '"' || message || '"' ELSE message END
  || ' time="' || timestamp || '" user=' || username END AS value FROM logs""",
)
def json_to_kv(spark, folder):
    """JSON lines rewritten as key=value; lines that already hold pairs pass."""
    rows = logs(spark, folder)
    body = F.to_json(F.struct("message", F.col("timestamp").alias("time"), F.col("username").alias("user")))
    return parse.json_to_kv(rows.select("event_id", body.alias("value"))).select("event_id", "value")


@query(
    "log_severity",
    f"""WITH {LOGS_CTE}, l AS (SELECT event_id, CASE WHEN source_type = 'auth' THEN '[' || log_level || '] ' || message
  ELSE message || ' (' || log_level || ')' END AS v FROM logs),
x AS (SELECT event_id, regexp_extract(v, '\\[([a-zA-Z]{{4,10}})\\]|\\(([a-zA-Z]{{4,10}})\\)', 1) AS a,
  regexp_extract(v, '\\[([a-zA-Z]{{4,10}})\\]|\\(([a-zA-Z]{{4,10}})\\)', 2) AS b FROM l)
SELECT event_id, CASE WHEN a <> '' THEN a ELSE b END AS level FROM x""",
)
def log_severity(spark, folder):
    """The level word in brackets or parentheses."""
    line = F.when(
        F.col("source_type") == "auth", F.concat(F.lit("["), F.col("log_level"), F.lit("] "), F.col("message"))
    ).otherwise(F.concat(F.col("message"), F.lit(" ("), F.col("log_level"), F.lit(")")))
    return logs(spark, folder).select("event_id", parse.log_severity(line).alias("level"))


@query(
    "read_app_log",
    f"""WITH {LOGS_CTE} SELECT timestamp AS logged_at, CASE WHEN source_type = 'firewall' THEN 'AUDIT' ELSE log_level END AS level,
  CASE WHEN source_type = 'firewall' THEN '' ELSE service END AS component,
  CASE WHEN source_type = 'firewall' THEN '' ELSE process_id END AS process_id,
  CASE WHEN source_type = 'firewall' THEN username ELSE '' END AS "user",
  CASE WHEN source_type = 'firewall' THEN 'transfer' ELSE '' END AS action, message FROM logs""",
)
def read_app_log(spark, folder):
    """The toolkit's own log and audit lines."""
    plain = F.concat(
        F.lit("["), F.col("timestamp"), F.lit("] ["), F.col("log_level"), F.lit("] ["), F.col("service"), F.lit("] ["),
        F.col("process_id"), F.lit("] "), F.col("message"),
    )
    audit = F.concat(
        F.lit("["), F.col("timestamp"), F.lit("] [AUDIT] [user="), F.col("username"), F.lit("] [action=transfer] [details="),
        F.col("message"), F.lit("]"),
    )
    line = F.when(F.col("source_type") == "firewall", audit).otherwise(plain)
    return sources.parse_app_log(logs(spark, folder).select(line.alias("value")))


@query("alerts_roundtrip", f"WITH {ALERTS_CTE} SELECT {', '.join(ALERT_FIELDS + LOG_FIELDS)} FROM alerts")
def alerts_roundtrip(spark, folder):
    """Alerts written by suffix and read back."""
    path = staging_path(spark, "alerts") + ".json"
    sources.write_alerts(alerts(spark, folder).select(*ALERT_FIELDS, *LOG_FIELDS), path)
    return sources.read_alerts(spark, path)


@query(
    "evidence_manifest",
    """WITH f AS (SELECT o_orderkey // 1000 AS b, CAST(o_orderkey // 1000 AS VARCHAR) AS name, sha256(string_agg(o_orderkey || '|' || o_orderstatus || chr(10), '' ORDER BY o_orderkey)) AS sha FROM orders GROUP BY 1, 2)
SELECT name, CASE WHEN b % 4 = 0 THEN NULL WHEN b % 4 = 1 THEN 'other' ELSE sha END AS expected, sha AS actual, CASE b % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'changed' ELSE 'ok' END AS status FROM f
UNION ALL SELECT r_name, 'gone', NULL, 'missing' FROM region""",
)
def evidence_manifest(spark, folder):
    """Checksums of files of up to a thousand orders each, below folders, against a stored manifest."""
    from tracehold.sources.evidence import evidence_manifest as manifest
    from tracehold.sources.evidence import verify_manifest

    files, stored = staging_path(spark, "evidence"), staging_path(spark, "manifest")
    line = F.concat(F.col("o_orderkey").cast("string"), F.lit("|"), "o_orderstatus").alias("value")
    lines = table(spark, folder, "orders").select(F.floor(F.col("o_orderkey") / 1000).alias("part"), "o_orderkey", line)
    lines.repartition("part").sortWithinPartitions("part", "o_orderkey").select("part", "value").write.partitionBy("part").text(files)
    current = manifest(spark, files, "*.txt").withColumn("name", F.regexp_extract("name", "^part=([^/]+)/[^/]+$", 1))
    key = F.col("name").cast("long") % 4
    old = current.where(key != 0).select("name", F.when(key == 1, "other").otherwise(F.col("sha256")).alias("sha256"))
    old.union(table(spark, folder, "region").select("r_name", F.lit("gone"))).write.parquet(stored)
    return verify_manifest(spark.read.parquet(stored), current)
