"""Queries: baselines and statistical anomalies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracehold.operators import anomaly, baseline, density, forest
from tracehold.plans.registry import query
from tracehold.plans.views import LOGS_CTE, as_text, events, logs, r6, table
from tracehold.session import stage, staging_path

# The profile is learnt on the first ten days and compared with the whole table.
LEARN_UNTIL = "2024-01-11"
_LEARN = f"l AS (SELECT * FROM logs WHERE ts < TIMESTAMP '{LEARN_UNTIL}')"


def training_logs(spark, folder):
    return logs(spark, folder).where(F.col("ts") < F.lit(LEARN_UNTIL).cast("timestamp"))


def _time_counts_sql(source: str) -> str:
    return f"""SELECT 'hourly' AS kind, '' AS entity, CAST(hour(ts) AS VARCHAR) AS bucket, count(*) AS n FROM {source} GROUP BY 3
UNION ALL SELECT 'dayofweek', '', CAST(isodow(ts) - 1 AS VARCHAR), count(*) FROM {source} GROUP BY 3
UNION ALL SELECT 'hour_dayofweek', '', (isodow(ts) - 1) || ' ' || hour(ts), count(*) FROM {source} GROUP BY 3"""


def _stats_sql(counts: str) -> str:
    """Statistics of counts in the profile shape, the weekday-by-hour matrix apart."""
    return f"""SELECT kind, entity, avg(n) AS mean, stddev_samp(n) AS std, min(n) AS lo, max(n) AS hi FROM {counts}
WHERE kind NOT IN ('hour_dayofweek', 'user_ips', 'user_total') GROUP BY kind, entity"""


@query("profile_time_counts", f"WITH {LOGS_CTE} {_time_counts_sql('logs')}")
def profile_time_counts(spark, folder):
    """Counts by hour, weekday and both."""
    return baseline.time_profile_counts(logs(spark, folder))


def _stats_rows(kind: str) -> str:
    return f"""WITH {LOGS_CTE}, c AS ({_time_counts_sql('logs')}), s AS ({_stats_sql('c')})
SELECT kind, {r6('mean')} AS mean, {r6('std')} AS std, lo AS min, hi AS max, {r6('mean - 2 * std')} AS low, {r6('mean + 2 * std')} AS high FROM s WHERE kind = '{kind}'"""


def _stats(spark, folder, kind):
    stats = baseline.profile_stats(baseline.time_profile_counts(logs(spark, folder)))
    return as_text(stats.where(F.col("kind") == kind).select("kind", "mean", "std", "min", "max", "low", "high"))


@query("profile_hourly", _stats_rows("hourly"))
def profile_hourly(spark, folder):
    """statistics over the hours of day."""
    return _stats(spark, folder, "hourly")


@query("profile_dayofweek", _stats_rows("dayofweek"))
def profile_dayofweek(spark, folder):
    """statistics over the weekdays."""
    return _stats(spark, folder, "dayofweek")


@query(
    "profile_hour_dayofweek",
    f"""WITH {LOGS_CTE}, c AS (SELECT isodow(ts) AS d, hour(ts) AS h, count(*) AS n FROM logs GROUP BY 1, 2),
g AS (SELECT d.d, h.h, coalesce(n, 0) AS n FROM (SELECT DISTINCT d FROM c) d CROSS JOIN (SELECT DISTINCT h FROM c) h LEFT JOIN c ON c.d = d.d AND c.h = h.h)
SELECT 'hour_dayofweek' AS kind, {r6('avg(n)')} AS mean, {r6('stddev_pop(n)')} AS std, min(n) AS min, max(n) AS max,
  {r6('avg(n) - 2 * stddev_pop(n)')} AS low, {r6('avg(n) + 2 * stddev_pop(n)')} AS high FROM g""",
)
def profile_hour_dayofweek(spark, folder):
    """statistics over the weekday-by-hour matrix, population deviation."""
    return _stats(spark, folder, "hour_dayofweek")


def _user_counts_sql(source: str) -> str:
    return f"""SELECT kind, entity, bucket, n FROM (
SELECT 'user_hours' AS kind, username AS entity, CAST(hour(ts) AS VARCHAR) AS bucket, count(*) AS n FROM {source} GROUP BY 2, 3
UNION ALL SELECT 'user_days', username, CAST(isodow(ts) - 1 AS VARCHAR), count(*) FROM {source} GROUP BY 2, 3
UNION ALL SELECT 'user_ips', username, ip_address, count(*) FROM {source} GROUP BY 2, 3
UNION ALL SELECT 'user_total', username, '', count(*) FROM {source} GROUP BY 2) q
WHERE entity IN (SELECT username FROM {source} GROUP BY username HAVING count(*) >= 10)"""


@query("profile_users", f"WITH {LOGS_CTE} {_user_counts_sql('logs')}")
def profile_users(spark, folder):
    """counts per user by hour, weekday and address."""
    return baseline.user_profile_counts(logs(spark, folder))


@query(
    "profile_user_stats",
    f"""WITH {LOGS_CTE}, c AS ({_user_counts_sql('logs')}), s AS ({_stats_sql('c')})
SELECT kind, entity, {r6('mean')} AS mean, {r6('std')} AS std, {r6('mean + 2 * std')} AS high FROM s""",
)
def profile_user_stats(spark, folder):
    """mean, deviation and upper limit per user."""
    stats = baseline.profile_stats(baseline.user_profile_counts(logs(spark, folder)))
    return as_text(stats.select("kind", "entity", "mean", "std", "high"))


_KNOWN = f"{LOGS_CTE}, {_LEARN}, known AS ({_time_counts_sql('l')}), ks AS ({_stats_sql('known')}), fresh AS ({_time_counts_sql('logs')})"
_DAYS = "['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday']"
_TIME_ANOMALIES = f"""SELECT f.kind || '_activity' AS type, CAST(f.bucket AS BIGINT) AS bucket,
  CASE WHEN f.kind = 'dayofweek' THEN list_extract({_DAYS}, CAST(f.bucket AS INT) + 1) END AS day_name, f.n AS event_count,
  {r6('mean + 2 * std')} AS expected_max, CASE WHEN f.n < hi * 2 THEN 'MEDIUM' ELSE 'HIGH' END AS severity
FROM fresh f JOIN known k USING (kind, entity, bucket) JOIN ks s USING (kind, entity) WHERE kind IN ('hourly', 'dayofweek') AND f.n > mean + 2 * std"""


def _profiles(spark, folder):
    known = stage(baseline.time_profile_counts(training_logs(spark, folder)), "profile")
    return baseline.time_profile_counts(logs(spark, folder)), known, baseline.profile_stats(known)


@query("detect_time_anomalies", f"WITH {_KNOWN} {_TIME_ANOMALIES}")
def detect_time_anomalies(spark, folder):
    """hours and weekdays busier than the profile allows."""
    return as_text(baseline.detect_time_anomalies(*_profiles(spark, folder)))


_USERS = f"{LOGS_CTE}, {_LEARN}, known AS ({_user_counts_sql('l')}), ks AS ({_stats_sql('known')})"
_USER_HOURS = f"""SELECT 'user_hourly_activity' AS type, username, CAST(h AS BIGINT) AS hour, n AS event_count, {r6('mean + 2 * std')} AS expected_max, 'MEDIUM' AS severity
FROM (SELECT username, hour(ts) AS h, count(*) AS n FROM logs GROUP BY 1, 2) f JOIN ks ON entity = username AND kind = 'user_hours'
WHERE n > mean + 2 * std AND mean + 2 * std <> 0"""


def _user_profile(spark, folder):
    known = stage(baseline.user_profile_counts(training_logs(spark, folder)), "profile")
    return known, baseline.profile_stats(known)


@query("detect_user_hour_anomalies", f"WITH {_USERS} {_USER_HOURS}")
def detect_user_hour_anomalies(spark, folder):
    """hours in which a known user exceeds the user's own limit."""
    known, stats = _user_profile(spark, folder)
    new = baseline.user_hour_counts(logs(spark, folder))
    return as_text(baseline.detect_user_hour_anomalies(new, known, stats))


_MOVING = "CASE WHEN event_type = 'error' THEN '172.16.0.' || (k % 8) ELSE ip_address END"


@query(
    "detect_unknown_ips",
    f"""WITH {LOGS_CTE}, m AS (SELECT ts, username, {_MOVING} AS ip_address FROM logs), l AS (SELECT * FROM m WHERE ts < TIMESTAMP '{LEARN_UNTIL}'),
known AS ({_user_counts_sql('l')}), top AS (SELECT entity, bucket, row_number() OVER (PARTITION BY entity ORDER BY n DESC, bucket) AS r FROM known WHERE kind = 'user_ips' AND bucket <> ''),
listed AS (SELECT entity, string_agg(bucket, ',' ORDER BY r) AS known_ips FROM top WHERE r <= 5 GROUP BY entity)
SELECT 'user_unknown_ip' AS type, username, ip_address, count(*) AS event_count, known_ips, 'HIGH' AS severity FROM m JOIN listed ON entity = username
WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.kind = 'user_ips' AND k.entity = m.username AND k.bucket = m.ip_address) GROUP BY username, ip_address, known_ips""",
)
def detect_unknown_ips(spark, folder):
    """addresses a known user has not used before (errors come from a moving network)."""
    moving = logs(spark, folder).withColumn("ip_address", F.expr(_MOVING))
    known = stage(baseline.user_profile_counts(moving.where(F.col("ts") < F.lit(LEARN_UNTIL).cast("timestamp"))), "profile")
    found = baseline.detect_unknown_ips(moving, known)
    return found.withColumn("known_ips", F.array_join("known_ips", ","))


@query(
    "detect_baseline_z",
    f"""WITH {_KNOWN}, m AS (SELECT split_part(bucket, ' ', 1) AS d, split_part(bucket, ' ', 2) AS h, n FROM known WHERE kind = 'hour_dayofweek'),
g AS (SELECT coalesce(n, 0) AS n FROM (SELECT DISTINCT d FROM m) d CROSS JOIN (SELECT DISTINCT h FROM m) h LEFT JOIN m ON m.d = d.d AND m.h = h.h),
st AS (SELECT kind, entity, mean, std FROM ks UNION ALL SELECT 'hour_dayofweek', '', avg(n), stddev_pop(n) FROM g),
z AS (SELECT kind, entity, bucket, f.n, mean, std, abs(f.n - mean) / std AS z, k.n / (k.n + 10.0) AS c
  FROM fresh f JOIN known k USING (kind, entity, bucket) JOIN st s USING (kind, entity) WHERE std > 0),
t AS (SELECT greatest(2.5, quantile_cont(z, 0.5)) AS cut FROM z)
SELECT kind, entity, bucket, n AS event_count, {r6('mean')} AS mean, {r6('std')} AS std, {r6('z')} AS z_score, {r6('c')} AS confidence FROM z, t WHERE z > cut AND c >= 0.8""",
)
def detect_baseline_z(spark, folder):
    """F8: buckets many deviations from the profile's mean."""
    found = baseline.detect_baseline_z(*_profiles(spark, folder), sensitivity="high", max_fp_rate=0.5)
    return as_text(found)


@query("update_profile", f"WITH {LOGS_CTE} {_time_counts_sql('logs')}")
def update_profile(spark, folder):
    """A saved profile loaded and updated with the later data."""
    path = staging_path(spark, "profile")
    baseline.save_profile(baseline.time_profile_counts(training_logs(spark, folder)), path)
    later = logs(spark, folder).where(F.col("ts") >= F.lit(LEARN_UNTIL).cast("timestamp"))
    return baseline.merge_profiles(baseline.load_profile(spark, path), baseline.time_profile_counts(later))


@query(
    "profile_bins",
    f"""WITH {LOGS_CTE}, b AS (SELECT hour(ts) // 4 AS h, (isodow(ts) - 1) // 2 AS d, CASE WHEN hour(ts) BETWEEN 9 AND 17 AND isodow(ts) <= 5 THEN 1 ELSE 0 END AS w FROM logs)
SELECT 'hourly' AS kind, CAST(h AS VARCHAR) AS bucket, count(*) AS n FROM b GROUP BY 2 UNION ALL SELECT 'dayofweek', CAST(d AS VARCHAR), count(*) FROM b GROUP BY 2
UNION ALL SELECT 'business_hours', CAST(w AS VARCHAR), count(*) FROM b GROUP BY 2 UNION ALL SELECT 'hour_dayofweek', d || ' ' || h, count(*) FROM b GROUP BY 2""",
)
def profile_bins(spark, folder):
    """coarser bins and business hours."""
    counts = baseline.time_profile_counts(logs(spark, folder), hours_per_bin=4, days_per_bin=2, business_hours=True)
    return counts.select("kind", "bucket", "n")


@query(
    "anomaly_breakdown",
    f"""WITH {_KNOWN}, a AS ({_TIME_ANOMALIES}) SELECT severity, count(*) AS event_count FROM a GROUP BY severity""",
)
def anomaly_breakdown(spark, folder):
    """anomalies per severity."""
    return baseline.anomaly_breakdown(baseline.detect_time_anomalies(*_profiles(spark, folder)))


# ------------------------------------------------------------ statistical anomalies


def _z_sql(source: str, row_id: str, fields: list[str]) -> str:
    parts = [
        f"""SELECT 'z_score' AS method, {row_id}, '{f}' AS field, {r6(f)} AS value, {r6(f'abs({f} - m) / d')} AS score
FROM {source}, (SELECT avg({f}) AS m, stddev_pop({f}) AS d FROM {source}) s WHERE d > 0 AND abs({f} - m) / d > 3"""
        for f in fields
    ]
    return " UNION ALL ".join(parts)


@query("zscore_anomalies", _z_sql("events", "event_id", ["value"]))
def zscore_anomalies(spark, folder):
    """G1 on the events' values."""
    return as_text(anomaly.zscore_anomalies(events(spark, folder), ["value"], "event_id"))


@query("zscore_anomalies_documents", _z_sql("documents", "doc_id", ["n_chars"]))
def zscore_anomalies_documents(spark, folder):
    """G1 on text lengths; text fields are passed over."""
    return as_text(anomaly.zscore_anomalies(table(spark, folder, "documents"), ["n_chars", "lang"], "doc_id"))


def _mad_sql(source: str, row_id: str, field: str, limit: float) -> str:
    return f"""SELECT 'median_absolute_deviation' AS method, {row_id}, '{field}' AS field, {r6(field)} AS value, {r6(f'0.6745 * abs({field} - med) / mad')} AS score,
  {r6('med')} AS median, {r6('mad')} AS mad FROM {source}, (SELECT median({field}) AS med FROM {source}) a,
  (SELECT median(abs({field} - (SELECT median({field}) FROM {source}))) AS mad FROM {source}) b WHERE 0.6745 * abs({field} - med) / mad > {limit}"""


@query("mad_anomalies", _mad_sql("events", "event_id", "value", 3.5))
def mad_anomalies(spark, folder):
    """G2 with exact medians."""
    return as_text(anomaly.mad_anomalies(events(spark, folder), ["value"], "event_id"))


# Values scaled like the clustered events: k and value in population deviations.
_SCALED = f"""WITH {LOGS_CTE}, s AS (SELECT avg(value) AS m, stddev_pop(value) AS d, avg(k) AS km, stddev_pop(k) AS kd FROM logs),
p AS (SELECT event_id, (value - m) / d AS x, (k - km) / kd AS y FROM logs, s)"""


def _dbscan_sql(eps: float, minimum: int) -> str:
    # Only points near each other in x are paired; the join is exact.
    return f"""{_SCALED}, b AS (SELECT *, CAST(floor(x / {eps}) AS BIGINT) AS c FROM p), nb AS (SELECT *, unnest([c - 1, c, c + 1]) AS cc FROM b),
n AS (SELECT a.event_id, o.event_id AS other FROM nb a JOIN b o ON a.cc = o.c WHERE (a.x - o.x) * (a.x - o.x) + (a.y - o.y) * (a.y - o.y) <= {eps * eps}),
core AS (SELECT event_id FROM n GROUP BY event_id HAVING count(*) >= {minimum})
SELECT 'dbscan' AS method, event_id FROM p WHERE event_id NOT IN (SELECT event_id FROM n WHERE other IN (SELECT event_id FROM core))"""


@query("dbscan_anomalies", _dbscan_sql(0.25, 10))
def dbscan_anomalies(spark, folder):
    """Noise points of value and k."""
    return density.dbscan_anomalies(logs(spark, folder), ["value", "k"], "event_id", 0.25, 10)


@query(
    "isolation_forest_summary",
    "SELECT 'isolation_forest' AS method, CAST(floor(0.05 * (count(*) - 1)) + 1 AS BIGINT) AS anomalies FROM events",
)
def isolation_forest_summary(spark, folder):
    """The share of rows the quantile cut lets through."""
    found = forest.isolation_forest_anomalies(logs(spark, folder), ["value", "k"], "event_id")
    return found.groupBy("method").agg(F.count("*").alias("anomalies"))


@query("isolation_forest_anomalies")
def isolation_forest_anomalies(spark, folder):
    """The five percent easiest to isolate."""
    return forest.isolation_forest_anomalies(logs(spark, folder), ["value", "k"], "event_id")


# The three methods without random draws, as (method, event_id, field, value, score).
_FINDINGS = f"""z AS ({_z_sql("logs", "event_id", ["value", "k"])}),
md AS ({_mad_sql("logs", "event_id", "value", 3.5)} UNION ALL {_mad_sql("logs", "event_id", "k", 3.5)}), db AS ({_dbscan_sql(0.5, 5)}),
f AS (SELECT method, event_id, field, value, score FROM z UNION ALL SELECT method, event_id, field, value, score FROM md
UNION ALL SELECT method, event_id, CAST(NULL AS VARCHAR), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM db)"""


@query("anomaly_findings", f"WITH {LOGS_CTE}, {_FINDINGS} SELECT * FROM f")
def anomaly_findings(spark, folder):
    """Findings of the methods without random draws, row by row."""
    rows = stage(logs(spark, folder).select("event_id", "value", "k"), "rows")
    fields = ["value", "k"]
    found = [
        anomaly.zscore_anomalies(rows, fields, "event_id"),
        anomaly.mad_anomalies(rows, fields, "event_id"),
        density.dbscan_anomalies(rows, fields, "event_id"),
    ]
    return as_text(anomaly.anomaly_all(found, "event_id"))


@query(
    "anomaly_all",
    f"""WITH {LOGS_CTE}, {_FINDINGS}, c AS (SELECT method, count(*) AS anomalies FROM f GROUP BY method
UNION ALL SELECT 'isolation_forest', CAST(floor(0.05 * (count(*) - 1)) + 1 AS BIGINT) FROM events)
SELECT method, anomalies FROM c UNION ALL SELECT 'all', CAST(sum(anomalies) AS BIGINT) FROM c""",
)
def anomaly_all(spark, folder):
    """Findings of the four methods, counted."""
    rows = stage(logs(spark, folder).select("event_id", "value", "k"), "rows")
    fields = ["value", "k"]
    found = [
        anomaly.zscore_anomalies(rows, fields, "event_id"),
        anomaly.mad_anomalies(rows, fields, "event_id"),
        forest.isolation_forest_anomalies(rows, fields, "event_id"),
        density.dbscan_anomalies(rows, fields, "event_id"),
    ]
    return anomaly.anomaly_summary(anomaly.anomaly_all(found, "event_id"))
