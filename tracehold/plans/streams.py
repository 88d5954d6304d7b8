"""Queries: streams over the events, run until everything available is processed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracehold.functions.severity import severity_level, severity_name
from tracehold.functions.times import micros
from tracehold.operators.chains import AttackPattern, Step
from tracehold.operators.detect import detect
from tracehold.operators.parse import SourceConfig
from tracehold.operators.sessions import Measure
from tracehold.plans.detection import RULES
from tracehold.plans.ingest import EXCLUDE, FILTER, PARSED_SYSLOG, staged_lines
from tracehold.plans.registry import query
from tracehold.plans.views import (
    ALERTS_CTE,
    DEFAULT_YEAR,
    LOGS_CTE,
    SYSLOG_SQL,
    alerts_cte,
    as_text,
    level_name_sql,
    level_sql,
    security_rows,
    sql_text,
    staged_alerts,
    stamp_sql,
    table,
)
from tracehold.session import staging_path
from tracehold.streaming import carried, jobs


def event_stream(spark, folder) -> DataFrame:
    """The events as a stream."""
    rows = jobs.stream_table(spark, folder, table(spark, folder, "events").schema, "events.parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def alert_stream(spark, folder) -> DataFrame:
    return detect(security_rows(event_stream(spark, folder)), RULES)


def run_stream(df: DataFrame) -> DataFrame:
    """Process what is available and return the written table."""
    spark = df.sparkSession
    path = staging_path(spark, "stream")
    jobs.write_stream(df, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/out")


#: Runs of a stream that is stopped and started again, each with new files.
SLICES = 3


def run_in_slices(rows: DataFrame, path: str, start, slices: int = SLICES) -> None:
    """Write ``rows`` in slices of time; after each one ``start`` a query on what is new, and wait for its end."""
    spark = rows.sparkSession
    low, high = rows.agg(F.min(micros("ts")), F.max(micros("ts"))).first()
    at = F.floor((micros("ts") - F.lit(low or 0)) * slices / F.lit((high or 0) - (low or 0) + 1))
    for k in range(slices):
        rows.where(F.coalesce(at, F.lit(0)) == k).write.mode("append").parquet(path)
        start(jobs.stream_table(spark, path, rows.schema, "*.parquet", files_per_trigger=1_000_000)).awaitTermination()


def carried_alerts(spark, folder, step: carried.Step) -> str:
    """Run a step over all alerts, in slices; gives the folder of its results."""
    path = staging_path(spark, "carried")
    run_in_slices(staged_alerts(spark, folder), f"{path}/in", lambda rows: carried.carry(rows, step, path))
    return path


@query(
    "stream_log_lines",
    f"WITH {LOGS_CTE}, l AS (SELECT {SYSLOG_SQL} AS value FROM logs) "
    f"SELECT value FROM l WHERE regexp_matches(value, {sql_text(FILTER)}) AND NOT regexp_matches(value, {sql_text(EXCLUDE)})",
)
def stream_log_lines(spark, folder):
    """A4: lines of files arriving in a folder."""
    return run_stream(jobs.stream_log_lines(spark, staged_lines(spark, folder), FILTER, EXCLUDE))


@query("stream_detect", f"WITH {ALERTS_CTE} SELECT RULE_ID, SEVERITY, event_id FROM alerts")
def stream_detect(spark, folder):
    """L1: events to alerts, stateless."""
    return run_stream(alert_stream(spark, folder).select("RULE_ID", "SEVERITY", "event_id"))


@query(
    "stream_detect_lines",
    f"WITH l AS ({PARSED_SYSLOG}), {alerts_cte(RULES, 'l')} SELECT RULE_ID, SEVERITY, hostname, message FROM alerts",
)
def stream_detect_lines(spark, folder):
    """L1 from raw lines: tail, parse, detect."""
    lines = jobs.stream_log_lines(spark, staged_lines(spark, folder))
    found = jobs.stream_detect(lines, SourceConfig("syslog"), RULES, DEFAULT_YEAR)
    return run_stream(found.select("RULE_ID", "SEVERITY", "hostname", "message"))


@query("stream_dedup", f"WITH {ALERTS_CTE} SELECT DISTINCT RULE_ID, ip_address, username FROM alerts")
def stream_dedup(spark, folder):
    """L2: one alert of each kind until the window expires (one batch here, so one in all)."""
    return run_stream(jobs.stream_dedup(alert_stream(spark, folder)).select("RULE_ID", "ip_address", "username"))


# A window is final once the newest event is the delay past its end.
_CLOSED = "(SELECT max(epoch_us(ts)) - 600000000 FROM {0})"


@query(
    "stream_throttle",
    f"""WITH {ALERTS_CTE}, c AS (SELECT epoch_us(ts) // 300000000 AS w, RULE_ID, count(*) AS n FROM alerts GROUP BY 1, 2)
SELECT {stamp_sql('make_timestamp(w * 300000000)')} AS window_start, RULE_ID, least(n, 5) AS passed, greatest(n - 5, 0) AS held FROM c
WHERE (w + 1) * 300000000 <= {_CLOSED.format('alerts')}""",
)
def stream_throttle(spark, folder):
    """L2: alerts per rule and window that pass or are held back."""
    return as_text(run_stream(jobs.stream_throttle(alert_stream(spark, folder))))


@query(
    "stream_throttle_alerts",
    f"""WITH {ALERTS_CTE}, r AS (SELECT *, row_number() OVER (PARTITION BY RULE_ID, epoch_us(ts) // 21600000000 ORDER BY ts, event_id) AS n FROM alerts)
SELECT RULE_ID, event_id, {stamp_sql('ts')} AS ts FROM r WHERE n <= 5""",
)
def stream_throttle_alerts(spark, folder):
    """L2: the alerts that pass, five of each rule in six hours."""
    passed = jobs.stream_throttle_alerts(alert_stream(spark, folder), 5, 21_600)
    return as_text(run_stream(passed).select("RULE_ID", "event_id", "ts"))


@query(
    "stream_frequency",
    f"""WITH c AS (SELECT epoch_us(ts) // 3600000000 AS w, count(*) AS n FROM events GROUP BY 1)
SELECT {stamp_sql('make_timestamp(w * 3600000000)')} AS window_start, n AS event_count FROM c WHERE (w + 1) * 3600000000 <= {_CLOSED.format('events')}""",
)
def stream_frequency(spark, folder):
    """L4: events per closed hour."""
    return as_text(run_stream(jobs.stream_frequency(event_stream(spark, folder))))


@query(
    "stream_frequency_sliding",
    f"""WITH c AS (SELECT unnest([epoch_us(ts) // 1800000000, epoch_us(ts) // 1800000000 - 1]) AS w FROM events), n AS (SELECT w, count(*) AS n FROM c GROUP BY 1)
SELECT {stamp_sql('make_timestamp(w * 1800000000)')} AS window_start, n AS event_count FROM n WHERE w * 1800000000 + 3600000000 <= {_CLOSED.format('events')}""",
)
def stream_frequency_sliding(spark, folder):
    """L4: events per hour every half hour."""
    return as_text(run_stream(jobs.stream_frequency(event_stream(spark, folder), slide="30 minutes")))


_SESSIONS = """y AS (SELECT *, sum(o) OVER (PARTITION BY %(key)s ORDER BY ts, event_id, RULE_ID ROWS UNBOUNDED PRECEDING) AS run FROM
  (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY %(key)s ORDER BY ts, event_id, RULE_ID)) <= 300000000 THEN 0 ELSE 1 END AS o FROM alerts) q)"""


@query(
    "stream_sessions",
    f"""WITH {ALERTS_CTE}, {_SESSIONS % {'key': '1'}} SELECT {stamp_sql('min(ts)')} AS start_time, {stamp_sql('max(ts)')} AS end_time, count(*) AS event_count
FROM y GROUP BY run HAVING max(epoch_us(ts)) + 300000000 <= {_CLOSED.format('alerts')}""",
)
def stream_sessions(spark, folder):
    """L3: closed gap sessions over all alerts, carried over runs on new files."""
    path = carried_alerts(spark, folder, carried.Sessions([], 300))
    found = carried.results(spark, path).withColumnsRenamed({"session_start": "start_time", "session_end": "end_time"})
    return as_text(found.select("start_time", "end_time", "event_count"))


@query(
    "stream_correlate_ip",
    f"""WITH {ALERTS_CTE}, {_SESSIONS % {'key': 'ip_address'}} SELECT ip_address, {stamp_sql('min(ts)')} AS start_time, {stamp_sql('max(ts)')} AS end_time, count(*) AS event_count,
  {level_name_sql(f'max({level_sql()})')} AS severity FROM y GROUP BY ip_address, run HAVING count(*) > 1 AND max(epoch_us(ts)) + 300000000 <= {_CLOSED.format('alerts')}""",
)
def stream_correlate_ip(spark, folder):
    """L3: closed sessions of more than one alert per address."""
    return as_text(run_stream(jobs.stream_correlate_ip(alert_stream(spark, folder))))


STREAM_CHAIN = AttackPattern("failure_to_change", "Failure, then account change", (Step("BF-.*"), Step("PE-.*")), ("same_ip_address",), 3600, "HIGH")


@query(
    "stream_chain",
    f"""WITH {ALERTS_CTE}, p AS (SELECT a.event_id AS first_row, a.RULE_ID AS first_rule, a.ip_address, a.ts, b.event_id AS last_row, b.RULE_ID AS last_rule, b.ts AS last_ts,
  row_number() OVER (PARTITION BY a.event_id, a.RULE_ID ORDER BY b.ts, b.event_id, b.RULE_ID) AS n
  FROM alerts a JOIN alerts b ON a.ip_address = b.ip_address AND (b.ts, b.event_id, b.RULE_ID) > (a.ts, a.event_id, a.RULE_ID) AND epoch_us(b.ts) - epoch_us(a.ts) <= 3600000000
  WHERE a.RULE_ID LIKE 'BF-%' AND b.RULE_ID LIKE 'PE-%')
SELECT 'failure_to_change' AS pattern_id, ip_address, first_row, first_rule, last_row, last_rule, {stamp_sql('ts')} AS start_time, {stamp_sql('last_ts')} AS end_time, 'HIGH' AS severity
FROM p WHERE n = 1 AND epoch_us(ts) + 3600000000 <= {_CLOSED.format('alerts')}""",
)
def stream_chain(spark, folder):
    """Chains in event order, decided when all that could follow has arrived."""
    found = carried.results(spark, carried_alerts(spark, folder, carried.Chain(STREAM_CHAIN)))
    ends = {"first": F.element_at("chain", 1), "last": F.element_at("chain", -1)}
    rows = [e[f].alias(f"{n}_{t}") for n, e in ends.items() for f, t in (("row_id", "row"), ("rule_id", "rule"))]
    return as_text(found.select("pattern_id", "ip_address", *rows, "start_time", "end_time", "severity"))


@query(
    "stream_suppress",
    f"""WITH {ALERTS_CTE}, x AS (SELECT *, lag(ts) OVER (PARTITION BY RULE_ID, ip_address, username ORDER BY ts, event_id) AS before FROM alerts)
SELECT RULE_ID, ip_address, username, event_id, {stamp_sql('ts')} AS ts FROM x
WHERE (before IS NULL OR epoch_us(ts) - epoch_us(before) > 3600000000) AND epoch_us(ts) <= {_CLOSED.format('alerts')}""",
)
def stream_suppress(spark, folder):
    """L2: repeats dropped, each of which renews the window."""
    found = carried.results(spark, carried_alerts(spark, folder, carried.Suppress()))
    return as_text(found.select("RULE_ID", "ip_address", "username", "event_id", "ts"))


@query(
    "resume_correlation",
    f"""WITH {ALERTS_CTE} SELECT ip_address, count(*) AS event_count, {level_name_sql(f'max({level_sql()})')} AS severity, {stamp_sql('min(ts)')} AS start_time, {stamp_sql('max(ts)')} AS end_time
FROM alerts WHERE ip_address <> '' GROUP BY 1 HAVING count(*) > 1""",
)
def resume_correlation(spark, folder):
    """Address groups that stay open over restarts, each run with new files."""
    measures = {"level": Measure("max", severity_level("SEVERITY")), "start_time": Measure("min", F.col("ts")), "end_time": Measure("max", F.col("ts"))}
    path = carried_alerts(spark, folder, carried.Groups(["ip_address"], measures))
    groups = carried.state_table(spark, path, "groups").where("event_count > 1")
    return as_text(groups.select("ip_address", "event_count", severity_name("level").alias("severity"), "start_time", "end_time"))


@query("stream_resume", "SELECT event_id, event_type FROM events")
def stream_resume(spark, folder):
    """A stopped stream resumes from its checkpoint with the files that are new; each batch goes through a callback once."""
    path = staging_path(spark, "stream")

    def keep(batch, number):
        batch.select("event_id", "event_type").write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    events = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    run_in_slices(events, f"{path}/in", lambda rows: jobs.for_each_change(rows, keep, f"{path}/checkpoint"))
    return spark.read.parquet(f"{path}/out").select("event_id", "event_type")
