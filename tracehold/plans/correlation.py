"""Queries: correlation, chains, time series and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracehold.operators import chains, correlate, correlation_set, report, timeseries
from tracehold.operators.detect import detect
from tracehold.operators.parse import SourceConfig, parse_source
from tracehold.plans.detection import RUNS_CTE
from tracehold.plans.registry import query
from tracehold.plans.views import (
    ALERTS_CTE,
    DEFAULT_YEAR,
    LOGS_CTE,
    SYSLOG_SQL,
    alerts,
    alerts_cte,
    as_text,
    events,
    level_name_sql,
    level_sql,
    logs,
    r6,
    staged_alerts,
    stamp_sql,
    syslog_lines,
    table,
)
from tracehold.schema import LOG_FIELDS
from tracehold.session import stage, staging_path
from tracehold.sources.rules import bundled_rules

@query(
    "alert_pipeline",
    f"""WITH {LOGS_CTE}, raw AS (SELECT event_id, {SYSLOG_SQL} AS v FROM logs),
parsed AS (SELECT event_id, regexp_extract(v, '^[A-Za-z]+ [0-9]+ [0-9:]+ [^ ]+ [^:]+: (.*)', 1) AS message,
  {', '.join(f"'' AS {c}" for c in LOG_FIELDS if c not in ('message', 'service'))},
  regexp_extract(v, '^[A-Za-z]+ [0-9]+ [0-9:]+ [^ ]+ ([^ \\[]+)', 1) AS service FROM raw),
ips AS (SELECT * REPLACE (regexp_extract(message, '([0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}})', 1) AS ip_address) FROM parsed),
{alerts_cte(bundled_rules(), 'ips')}
SELECT ip_address, count(*) AS event_count, {level_name_sql(f'max({level_sql()})')} AS severity FROM alerts
WHERE ip_address <> '' GROUP BY ip_address HAVING count(*) > 1""",
)
def pipeline(spark, folder):
    """Raw lines to alert groups: parse, detect, correlate by address."""
    lines = syslog_lines(logs(spark, folder))
    rows = parse_source(lines, SourceConfig("syslog"), DEFAULT_YEAR)
    found = detect(rows, bundled_rules())
    # A test on the rule as well stays above the explode; one on the address alone would be pushed below the parser, which would run twice.
    found = found.withColumn("ip_address", F.when(F.col("RULE_ID") != "", F.col("ip_address")))
    return correlate.correlate_by_ip(found).select("ip_address", "event_count", "severity")


_IP_GROUPS = f"""SELECT ip_address, count(*) AS event_count, {level_name_sql(f'max({level_sql()})')} AS severity,
  {stamp_sql('min(ts)')} AS start_time, {stamp_sql('max(ts)')} AS end_time FROM alerts WHERE ip_address <> '' GROUP BY ip_address HAVING count(*) > 1"""


@query("correlate_by_ip", f"WITH {ALERTS_CTE} {_IP_GROUPS}")
def correlate_by_ip(spark, folder):
    """Addresses with more than one alert and their severity."""
    return as_text(correlate.correlate_by_ip(alerts(spark, folder)))


@query(
    "ip_group_members",
    f"""WITH {ALERTS_CTE}, g AS ({_IP_GROUPS}) SELECT ip_address, event_id, RULE_ID, event_count AS group_size FROM alerts JOIN g USING (ip_address)""",
)
def ip_group_members(spark, folder):
    """The alerts of each address group."""
    return correlate.ip_group_members(staged_alerts(spark, folder)).select("ip_address", "event_id", "RULE_ID", "group_size")


_RUN_ROWS = f"""SELECT {stamp_sql('s')} AS start_time, {stamp_sql('e')} AS end_time, n AS event_count, {level_name_sql('lv')} AS severity FROM runs WHERE n > 1"""


@query("correlate_by_time_window", f"WITH {RUNS_CTE} {_RUN_ROWS}")
def correlate_by_time_window(spark, folder):
    """Runs of alerts at most five minutes apart."""
    return as_text(correlate.correlate_by_time_window(alerts(spark, folder)))


@query(
    "time_window_members",
    f"""WITH {RUNS_CTE}, m AS (SELECT event_id, RULE_ID, min(ts) OVER (PARTITION BY run) AS s, count(*) OVER (PARTITION BY run) AS n FROM runs1)
SELECT event_id, RULE_ID, {stamp_sql('s')} AS session_start FROM m WHERE n > 1""",
)
def time_window_members(spark, folder):
    """The alerts of each run."""
    members = correlate.time_window_members(staged_alerts(spark, folder))
    return as_text(members.select("event_id", "RULE_ID", "session_start"))


def _chain_sql(pattern: chains.AttackPattern) -> str:
    """Two-step chain: the earliest second-step alert of the address, if not too late."""
    one, two = pattern.sequence
    return f"""SELECT '{pattern.pattern_id}' AS pattern_id, '{pattern.name}' AS pattern_name, a.ip_address,
  a.event_id AS first_row, a.RULE_ID AS first_rule, b.event_id AS last_row, b.RULE_ID AS last_rule, {stamp_sql('a.ts')} AS start_time,
  {stamp_sql('b.ts')} AS end_time, {r6('(epoch_us(b.ts) - epoch_us(a.ts)) / 1000000.0')} AS duration_seconds, '{pattern.severity}' AS severity
FROM alerts a JOIN (SELECT ip_address, ts, event_id, RULE_ID, row_number() OVER (PARTITION BY ip_address ORDER BY ts, event_id, RULE_ID) AS n
  FROM alerts WHERE regexp_matches(RULE_ID, '^(?:{two.rule_pattern})')) b ON a.ip_address = b.ip_address AND b.n = 1
WHERE regexp_matches(a.RULE_ID, '^(?:{one.rule_pattern})') AND a.ip_address <> '' AND epoch_us(b.ts) - epoch_us(a.ts) <= {int(pattern.max_gap * 1_000_000)}
  AND (SELECT count(*) FROM alerts WHERE regexp_matches(RULE_ID, '^(?:{one.rule_pattern})')) >= {one.min_count}
  AND (SELECT count(*) FROM alerts WHERE regexp_matches(RULE_ID, '^(?:{two.rule_pattern})')) >= {two.min_count}"""


def _chain_rows(found: DataFrame) -> DataFrame:
    return as_text(
        found.select(
            "pattern_id",
            "pattern_name",
            "ip_address",
            F.element_at("chain", 1)["row_id"].alias("first_row"),
            F.element_at("chain", 1)["rule_id"].alias("first_rule"),
            F.element_at("chain", -1)["row_id"].alias("last_row"),
            F.element_at("chain", -1)["rule_id"].alias("last_rule"),
            "start_time",
            "end_time",
            "duration_seconds",
            "severity",
        )
    )


@query("match_patterns", f"WITH {ALERTS_CTE} " + " UNION ALL ".join(_chain_sql(p) for p in chains.DEFAULT_CHAINS))
def match_patterns(spark, folder):
    """The two built-in chains."""
    return _chain_rows(chains.match_patterns(staged_alerts(spark, folder)))


THREE_STEPS = chains.AttackPattern(
    "access_to_exfiltration",
    "Access, then persistence, then exfiltration",
    (chains.Step("UA-.*"), chains.Step("MW-PERS-.*"), chains.Step("DE-.*")),
    ("same_ip_address", "same_username"),
    43_200,
    "CRITICAL",
)


@query(
    "match_patterns_ordered",
    f"""WITH {ALERTS_CTE}, d AS (SELECT * FROM alerts WHERE regexp_matches(RULE_ID, '^(?:DE-.*)')),
p0 AS (SELECT a.*, b.event_id AS next_row, b.ts AS next_ts, b.RULE_ID AS next_rule, row_number() OVER
  (PARTITION BY a.event_id, a.RULE_ID ORDER BY b.ts, b.event_id, b.RULE_ID) AS n FROM alerts a JOIN d b ON a.ip_address = b.ip_address AND a.username = b.username
  AND (b.ts, b.event_id, b.RULE_ID) > (a.ts, a.event_id, a.RULE_ID) WHERE regexp_matches(a.RULE_ID, '^(?:MW-PERS-.*)')),
p AS (SELECT * FROM p0 WHERE n = 1 AND epoch_us(next_ts) - epoch_us(ts) <= 43200000000),
u0 AS (SELECT a.event_id, a.RULE_ID, a.ts, a.ip_address, a.username, b.ts AS mid_ts, b.next_row, b.next_ts, b.next_rule, row_number() OVER
  (PARTITION BY a.event_id, a.RULE_ID ORDER BY b.ts, b.event_id, b.RULE_ID) AS m FROM alerts a JOIN p b ON a.ip_address = b.ip_address AND a.username = b.username
  AND (b.ts, b.event_id, b.RULE_ID) > (a.ts, a.event_id, a.RULE_ID) WHERE regexp_matches(a.RULE_ID, '^(?:UA-.*)'))
SELECT 'access_to_exfiltration' AS pattern_id, 'Access, then persistence, then exfiltration' AS pattern_name, ip_address, event_id AS first_row, RULE_ID AS first_rule,
  next_row AS last_row, next_rule AS last_rule, {stamp_sql('ts')} AS start_time, {stamp_sql('next_ts')} AS end_time,
  {r6('(epoch_us(next_ts) - epoch_us(ts)) / 1000000.0')} AS duration_seconds, 'CRITICAL' AS severity
FROM u0 WHERE m = 1 AND epoch_us(mid_ts) - epoch_us(ts) <= 43200000000""",
)
def match_patterns_ordered(spark, folder):
    """D3 with steps in time order: three steps, two conditions."""
    return _chain_rows(chains.match_patterns(staged_alerts(spark, folder), [THREE_STEPS], ordered=True))


def _staged_sql(pattern: correlate.StagedPattern, keys: list[str]) -> str:
    sums, where = [], []
    for i, stage in enumerate(pattern.stages):
        hits = " + ".join(f"CAST(regexp_matches(RULE_ID, '^(?:{r})') AS INT)" for r in stage.rules)
        sums.append(f"sum({hits}) AS n{i}, min(CASE WHEN ({hits}) > 0 THEN ts END) AS f{i}, max(CASE WHEN ({hits}) > 0 THEN ts END) AS l{i}")
        where.append(f"n{i} >= {stage.min_count}")
        if i:
            where.append(f"epoch_us(f{i}) - epoch_us(l{i - 1}) <= {int(pattern.max_time_gap * 1_000_000)}")
    user = "username" if "username" in keys else "CAST(NULL AS VARCHAR) AS username"
    used = [f"{a}{i}" for i in range(len(pattern.stages)) for a in ("f", "l")]
    return f"""SELECT '{pattern.name}' AS attack_pattern, ip_address, {user}, CAST({' + '.join(f'n{i}' for i in range(len(pattern.stages)))} AS BIGINT) AS event_count,
  {stamp_sql(f"least({', '.join(used)})")} AS start_time, {stamp_sql(f"greatest({', '.join(used)})")} AS end_time, '{pattern.severity}' AS severity
FROM (SELECT {', '.join(keys)}, {', '.join(sums)} FROM alerts WHERE {' AND '.join(f"{k} <> ''" for k in keys)} GROUP BY {', '.join(keys)}) g
WHERE {' AND '.join(where)}"""


@query(
    "multi_stage_attacks",
    f"WITH {ALERTS_CTE} "
    + " UNION ALL ".join(_staged_sql(p, correlate.key_columns(p.conditions)) for p in correlate.MULTI_STAGE_PATTERNS),
)
def multi_stage_attacks(spark, folder):
    """The two built-in multi-stage patterns."""
    found = correlate.multi_stage_attacks(staged_alerts(spark, folder))
    return as_text(found.select("attack_pattern", "ip_address", "username", "event_count", "start_time", "end_time", "severity"))


def _velocity_sql(ratio: float) -> str:
    return f"""WITH {ALERTS_CTE}, g AS (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts, event_id, RULE_ID))) / 1000000.0 AS gap FROM alerts),
c AS (SELECT regexp_extract(RULE_ID, '^([A-Z]{{2,3}})-', 1) AS category, count(*) AS event_count, avg(gap) AS m, stddev_samp(gap) AS s, min(gap) AS lo,
  min(ts) AS a, max(ts) AS b FROM g GROUP BY 1)
SELECT category, event_count, {r6('m')} AS mean_interval, {r6('s')} AS std_interval, {r6('lo')} AS min_interval, {stamp_sql('a')} AS start_time,
  {stamp_sql('b')} AS end_time, CASE WHEN lo < 1 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM c WHERE category <> '' AND s < m * {ratio} AND event_count > 10"""


@query("attack_velocity", _velocity_sql(2.0))
def attack_velocity(spark, folder):
    """D6 with a loose ratio: the test events are random, so the default finds nothing."""
    return as_text(correlate.attack_velocity(staged_alerts(spark, folder), ratio=2.0))


@query(
    "first_step_chain",
    f"""WITH {ALERTS_CTE}, f AS (SELECT min(CASE WHEN RULE_ID LIKE 'BF-%' THEN ts END) AS a, min(CASE WHEN RULE_ID LIKE 'PE-%' THEN ts END) AS b,
  min(CASE WHEN RULE_ID LIKE 'DE-%' THEN ts END) AS c FROM alerts)
SELECT 'legacy' AS pattern_name, {stamp_sql('a')} AS start_time, {stamp_sql('c')} AS end_time, {r6('(epoch_us(c) - epoch_us(a)) / 1000000.0')} AS duration_seconds,
  'HIGH' AS severity FROM f WHERE epoch_us(b) - epoch_us(a) <= 86400000000 AND epoch_us(c) - epoch_us(b) <= 86400000000""",
)
def first_step_chain(spark, folder):
    """The first alert of each prefix."""
    return as_text(correlate.first_step_chain(staged_alerts(spark, folder), "legacy", ["BF-", "PE-", "DE-"], 86_400))


@query(
    "correlate_all",
    f"""WITH {RUNS_CTE}, ip AS ({_IP_GROUPS}), tw AS ({_RUN_ROWS}), ch AS ({' UNION ALL '.join(_chain_sql(p) for p in chains.DEFAULT_CHAINS)}),
ms AS ({' UNION ALL '.join(_staged_sql(p, correlate.key_columns(p.conditions)) for p in correlate.MULTI_STAGE_PATTERNS)})
SELECT 'ip_address' AS correlation_type, ip_address AS value, event_count, start_time, end_time, severity FROM ip
UNION ALL SELECT 'time_window', NULL, event_count, start_time, end_time, severity FROM tw
UNION ALL SELECT 'attack_chain', pattern_name, 2, start_time, end_time, severity FROM ch
UNION ALL SELECT 'multi_stage_attack', attack_pattern, event_count, start_time, end_time, severity FROM ms""",
)
def correlate_all(spark, folder):
    """All correlation results in one shape."""
    return as_text(correlation_set.correlate_all(staged_alerts(spark, folder)))


# ------------------------------------------------------------ time series


def _bins_sql(step: str) -> str:
    return f"""c AS (SELECT time_bucket(INTERVAL '{step}', ts) AS b, count(*) AS n FROM events GROUP BY 1),
z AS (SELECT g.b, coalesce(c.n, 0) AS n FROM (SELECT unnest(generate_series((SELECT min(b) FROM c), (SELECT max(b) FROM c), INTERVAL '{step}')) AS b) g LEFT JOIN c USING (b))"""


@query("event_frequency", f"WITH {_bins_sql('1 hour')} SELECT {stamp_sql('b')} AS bin_start, n AS event_count FROM z")
def event_frequency(spark, folder):
    """Events per hour, empty hours included."""
    return as_text(timeseries.event_frequency(events(spark, folder), "1h"))


@query(
    "frequency_stats",
    f"""WITH {_bins_sql('1 hour')} SELECT CAST(sum(n) AS BIGINT) AS total_events, count(*) AS periods, {r6('avg(n)')} AS mean_events,
  {r6('stddev_samp(n)')} AS std_events, max(n) AS max_events, {stamp_sql('(SELECT min(b) FROM z WHERE n = (SELECT max(n) FROM z))')} AS max_events_start FROM z""",
)
def frequency_stats(spark, folder):
    """Total, mean, deviation, maximum and its first bin."""
    return as_text(timeseries.frequency_stats(events(spark, folder), "1h"))


@query(
    "activity_spikes",
    f"""WITH {_bins_sql('1 minute')}, s AS (SELECT avg(n) AS m, stddev_samp(n) AS d FROM z)
SELECT {stamp_sql('b')} AS bin_start, n AS event_count, {r6('(n - m) / d')} AS z_score, {r6('n - m')} AS deviation_from_mean FROM z, s WHERE (n - m) / d > 2.0""",
)
def activity_spikes(spark, folder):
    """Minutes more than two deviations above the mean."""
    return as_text(timeseries.activity_spikes(events(spark, folder)))


@query(
    "attack_sequences",
    f"""WITH {RUNS_CTE} SELECT {stamp_sql('s')} AS start_time, {stamp_sql('e')} AS end_time, {r6('(epoch_us(e) - epoch_us(s)) / 1000000.0')} AS duration_seconds,
  n AS num_events, array_to_string(kinds, ',') AS rule_types FROM runs WHERE n >= 3 AND len(kinds) >= 2""",
)
def attack_sequences(spark, folder):
    """Sessions with several rule types."""
    found = timeseries.attack_sequences(staged_alerts(spark, folder))
    return as_text(found.withColumn("rule_types", F.array_join("rule_types", ",")))


# ------------------------------------------------------------ report tables


@query(
    "timeline_data",
    f"""WITH {ALERTS_CTE}, f AS (SELECT source_type, min((ts, event_id)) AS t FROM alerts GROUP BY source_type),
l AS (SELECT source_type, row_number() OVER (ORDER BY t) - 1 AS lane FROM f)
SELECT event_id, {stamp_sql('ts')} AS ts, source_type, lane FROM alerts JOIN l USING (source_type)""",
)
def timeline_data(spark, folder):
    """K1: alerts with the lane of their category."""
    return as_text(report.timeline_data(alerts(spark, folder), "source_type"))


@query(
    "alert_heatmap",
    f"""WITH {ALERTS_CTE}, d(day_index, day) AS (VALUES (0, 'Monday'), (1, 'Tuesday'), (2, 'Wednesday'), (3, 'Thursday'), (4, 'Friday'), (5, 'Saturday'), (6, 'Sunday'))
SELECT CAST(day_index AS BIGINT) AS day_index, day, {', '.join(f"count(CASE WHEN hour(ts) = {h} THEN 1 END) AS h{h:02d}" for h in range(24))}
FROM d LEFT JOIN alerts ON isodow(ts) - 1 = day_index GROUP BY 1, 2""",
)
def alert_heatmap(spark, folder):
    """K2: alerts per weekday and hour."""
    return as_text(report.alert_heatmap(alerts(spark, folder)))


@query(
    "rule_distribution",
    f"""WITH {ALERTS_CTE}, p AS (SELECT RULE_ID, SEVERITY, count(*) AS n FROM alerts GROUP BY 1, 2),
q AS (SELECT RULE_ID, SEVERITY, n, sum(n) OVER (PARTITION BY RULE_ID) AS t, row_number() OVER (PARTITION BY RULE_ID ORDER BY n DESC, SEVERITY) AS k FROM p)
SELECT RULE_ID, CAST(t AS BIGINT) AS event_count, SEVERITY AS severity FROM q WHERE k = 1 ORDER BY t DESC, RULE_ID LIMIT 20""",
)
def rule_distribution(spark, folder):
    """K3: the twenty most frequent rules."""
    return report.rule_distribution(alerts(spark, folder))


_EDGES = f"""WITH {LOGS_CTE}, p AS (SELECT regexp_extract(message, 'src=([^ ]+)', 1) AS s, regexp_extract(message, 'dst=([^ ]+)', 1) AS d FROM logs
  WHERE regexp_matches(message, 'src=[^ ]+ .*dst=[^ ]+')), e AS (SELECT least(s, d) AS src, greatest(s, d) AS dst, count(*) AS weight FROM p GROUP BY 1, 2)"""


@query("communication_graph", f"{_EDGES} SELECT src, dst, weight FROM e")
def communication_graph(spark, folder):
    """K4: undirected edges between addresses named in messages."""
    return report.communication_edges(report.message_endpoints(logs(spark, folder)))


@query("node_degrees", f"{_EDGES} SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) q GROUP BY id")
def node_degrees(spark, folder):
    """K4: edges per node."""
    return report.node_degrees(report.communication_edges(report.message_endpoints(logs(spark, folder))))


@query(
    "trade_graph",
    """WITH p AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)
SELECT least(a, b) AS src, greatest(a, b) AS dst, count(*) AS weight FROM (SELECT sn.n_name AS a, cn.n_name AS b FROM p JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation sn ON s_nationkey = sn.n_nationkey) q GROUP BY 1, 2""",
)
def trade_graph(spark, folder):
    """K4 on another edge list, with loops: nations that trade with each other."""
    t = {n: table(spark, folder, n) for n in ("lineitem", "orders", "customer", "supplier", "nation")}
    nation = t["nation"].select("n_nationkey", "n_name")
    pairs = (
        t["lineitem"].select("l_orderkey", "l_suppkey").distinct()
        .join(t["orders"].select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t["customer"].select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t["supplier"].select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation.toDF("cn", "target_ip"), F.col("c_nationkey") == F.col("cn"))
        .join(nation.toDF("sn", "source_ip"), F.col("s_nationkey") == F.col("sn"))
    )
    return report.communication_edges(pairs)


@query("write_results", f"WITH {ALERTS_CTE} {_IP_GROUPS}")
def write_results(spark, folder):
    """Results written as JSON and read back."""
    from tracehold.sources.logs import write_results as write

    found = correlate.correlate_by_ip(alerts(spark, folder))
    path = staging_path(spark, "results")
    write(found, path)
    return as_text(spark.read.schema(found.schema).json(path))
