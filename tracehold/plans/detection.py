"""Queries: rules, detection and alert management."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracehold.operators import alerts as manage
from tracehold.operators import context, rule_admin
from tracehold.operators import detect as rules_ops
from tracehold.plans.registry import query
from tracehold.plans.views import (
    ALERTS_CTE,
    LOG_LINE_SQL,
    LOGS_CTE,
    alerts,
    alerts_cte,
    as_text,
    level_name_sql,
    level_sql,
    logs,
    rule_sql,
    sql_text,
    staged_alerts,
    stamp_sql,
    table,
)
from tracehold.schema import LOG_FIELDS
from tracehold.sources.rules import Rule, bundled_rules, parse_rules, rule_file_metadata

RULES = bundled_rules()
_ID = "RULE_ID, SEVERITY, DESCRIPTION, event_id"


@query("detect", f"WITH {ALERTS_CTE} SELECT {_ID}, {', '.join(LOG_FIELDS)} FROM alerts")
def detect(spark, folder):
    """Every line against all 110 rules."""
    return rules_ops.detect(logs(spark, folder), RULES).select(
        "RULE_ID", "SEVERITY", "DESCRIPTION", "event_id", *LOG_FIELDS
    )


# Rules with a negative pattern and a rule over the whole line.
NEGATIVE_RULES = [
    Rule("NG-AUTH-001", "Failed password, not root", "Failed password", "MEDIUM", (9,), (), "for root"),
    Rule("NG-WEB-001", "Web request without traversal", "GET /", "LOW", (9,), (), r"\.\./"),
    Rule("NG-LINE-001", "Root on a monitored host", r"root\shost[0-2]", "HIGH", (), (), "session opened"),
]


@query("detect_negative", f"WITH {LOGS_CTE}, {alerts_cte(NEGATIVE_RULES)} SELECT {_ID}, message FROM alerts")
def detect_negative(spark, folder):
    """A negative pattern on the whole line cancels a match."""
    return rules_ops.detect(logs(spark, folder), NEGATIVE_RULES).select(
        "RULE_ID", "SEVERITY", "DESCRIPTION", "event_id", "message"
    )


# Escapes, classes and brackets of many kinds.
ESCAPE_RULES = [
    Rule("ES-HEX-001", "Traversal in hex", r"\x2fetc\x2f(passwd|shadow)", "HIGH", (9,)),
    Rule("ES-CLASS-001", "Blank and digits", "port[[:blank:]][[:digit:]]+[[:space:]]ssh[[:alnum:]]", "LOW", (9,)),
    Rule("ES-BRACKET-001", "Closing bracket", r"[^\]]assword", "LOW", (9,)),
    Rule("ES-PUNCT-001", "Punctuation", r"user[0-9]+ from 10[[:punct:]]0\.[[:xdigit:]]", "MEDIUM", ()),
    Rule("ES-REPEAT-001", "Counted and optional parts", r"(GET|POST) /(\.\./){2}etc|x{0}publicke?y", "HIGH", (9,)),
    Rule("ES-GRAPH-001", "Printable classes", r"^[[:upper:]][[:lower:]]+ [[:graph:]]+ executed|curl[[:print:]]+\|", "LOW", (9,)),
]


@query("detect_escapes", f"WITH {LOGS_CTE}, {alerts_cte(ESCAPE_RULES)} SELECT {_ID} FROM alerts")
def detect_escapes(spark, folder):
    """C4: escapes, POSIX classes and quantifiers behind literal guards."""
    return rules_ops.detect(logs(spark, folder), ESCAPE_RULES).select("RULE_ID", "SEVERITY", "DESCRIPTION", "event_id")


_ANYCASE = [Rule(r.rule_id, r.description, "(?i)" + r.pattern, r.severity, r.fields, r.tags, r.negative_pattern, r.rule_file) for r in RULES]


@query(
    "detect_ignore_case",
    f"WITH {LOGS_CTE}, {alerts_cte(_ANYCASE)} SELECT RULE_ID, count(*) AS hits FROM alerts GROUP BY RULE_ID",
)
def detect_ignore_case(spark, folder):
    """C4 with case ignored, counted per rule."""
    found = rules_ops.detect(logs(spark, folder), RULES, ignore_case=True)
    return found.groupBy("RULE_ID").agg(F.count("*").alias("hits"))


@query(
    "detect_documents",
    f"WITH l AS (SELECT doc_id, {', '.join(f'{sql_text('')} AS {c}' for c in LOG_FIELDS[:-1])}, text AS message FROM documents), "
    f"{alerts_cte(RULES, 'l')} SELECT RULE_ID, SEVERITY, doc_id FROM alerts",
)
def detect_documents(spark, folder):
    """C6 over whole texts."""
    rows = table(spark, folder, "documents").withColumns(
        {**{c: F.lit("") for c in LOG_FIELDS[:-1]}, "message": F.col("text")}
    )
    # A text's lines end where '$' may match in Java but not in the SQL engine, so '$' means the end of the text.
    exact = [Rule(r.rule_id, r.description, r.pattern.replace("$", r"\z"), r.severity, r.fields) for r in RULES]
    return rules_ops.detect(rows, exact).select("RULE_ID", "SEVERITY", "doc_id")


@query(
    "filter_by_severity",
    f"WITH {ALERTS_CTE} SELECT RULE_ID, SEVERITY, CAST({level_sql()} AS BIGINT) AS level, event_id FROM alerts WHERE {level_sql()} >= 40",
)
def filter_by_severity(spark, folder):
    """Alerts from HIGH upwards with their level."""
    from tracehold.functions.severity import severity_level

    found = rules_ops.filter_by_severity(alerts(spark, folder), "HIGH")
    return as_text(found.select("RULE_ID", "SEVERITY", severity_level("SEVERITY").alias("level"), "event_id"))


def _context_rules() -> list[Rule]:
    return [
        Rule("CTX-BRUTE_FORCE-001", "Failures close together", "Failed password", "HIGH", (), (), "user1"),
        Rule("CTX-RECON-001", "Many addresses close together", "", "MEDIUM", (), (), "UNION"),
        Rule("CTX-PRIVILEGE_ESCALATION-001", "User then root", "", "HIGH", (), (), "UNION"),
        Rule("CTX-GENERIC-001", "Account changes", "useradd|sudoers", "LOW", (), (), "Failed password"),
    ]


CONTEXT_LINES = 10


def _context_sql(partition: str) -> str:
    frame = f"OVER ({partition} ORDER BY ts, event_id ROWS BETWEEN {CONTEXT_LINES - 1} PRECEDING AND CURRENT ROW)"
    ips = "regexp_extract_all(line, '([0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3})', 1)"
    return f"""WITH {LOGS_CTE}, l AS (SELECT *, {LOG_LINE_SQL} AS line FROM logs),
w AS (SELECT event_id,
  sum(CASE WHEN regexp_matches(line, 'Failed password') AND NOT regexp_matches(line, 'user1') THEN 1 ELSE 0 END) {frame} AS fails,
  list({ips}) {frame} AS ips, list(CASE WHEN regexp_matches(line, 'UNION') THEN {ips} ELSE CAST([] AS VARCHAR[]) END) {frame} AS off,
  max(CASE WHEN regexp_matches(line, 'user') THEN 1 ELSE 0 END) {frame} AS u,
  max(CASE WHEN regexp_matches(line, 'sudo|root') THEN 1 ELSE 0 END) {frame} AS r,
  max(CASE WHEN regexp_matches(line, 'UNION') THEN 1 ELSE 0 END) {frame} AS n,
  max(CASE WHEN regexp_matches(line, 'useradd|sudoers') THEN 1 ELSE 0 END) {frame} AS g,
  max(CASE WHEN regexp_matches(line, 'Failed password') THEN 1 ELSE 0 END) {frame} AS f FROM l)
SELECT 'CTX-BRUTE_FORCE-001' AS RULE_ID, 'HIGH' AS SEVERITY, event_id FROM w WHERE fails >= 3
UNION ALL SELECT 'CTX-RECON-001', 'MEDIUM', event_id FROM w WHERE len(list_distinct(flatten(ips))) - len(list_distinct(flatten(off))) >= 5
UNION ALL SELECT 'CTX-PRIVILEGE_ESCALATION-001', 'HIGH', event_id FROM w WHERE u = 1 AND r = 1 AND n = 0
UNION ALL SELECT 'CTX-GENERIC-001', 'LOW', event_id FROM w WHERE g = 1 AND f = 0"""


@query("detect_with_context", _context_sql(""))
def detect_with_context(spark, folder):
    """Four kinds of context rules over the last ten lines of all logs."""
    found = context.detect_with_context(logs(spark, folder), _context_rules(), CONTEXT_LINES)
    return found.select("RULE_ID", "SEVERITY", "event_id")


@query("detect_with_context_by_host", _context_sql("PARTITION BY hostname"))
def detect_with_context_by_host(spark, folder):
    """C11 per host; a busy host is cut into chunks."""
    found = context.detect_with_context(logs(spark, folder), _context_rules(), CONTEXT_LINES, ["hostname"])
    return found.select("RULE_ID", "SEVERITY", "event_id")


_FILES = sorted({r.rule_file for r in RULES})


@query(
    "rule_coverage",
    f"WITH {LOGS_CTE} SELECT f.rule_file, r_name AS source_type, 0 AS hits FROM region, (VALUES "
    + ", ".join(f"({sql_text(f)})" for f in _FILES)
    + ") f(rule_file) UNION ALL "
    + " UNION ALL ".join(
        f"SELECT {sql_text(f)} AS rule_file, source_type, CAST(sum("
        + " + ".join(f"CASE WHEN {rule_sql(r)} THEN 1 ELSE 0 END" for r in RULES if r.rule_file == f)
        + ") AS BIGINT) AS hits FROM logs GROUP BY source_type"
        for f in _FILES
    ),
)
def rule_coverage(spark, folder):
    """Hits of every rule file on every log, zeros included."""
    rows = logs(spark, folder)
    # The regions stand for logs in which nothing was written.
    names = rows.select("source_type").union(table(spark, folder, "region").select("r_name"))
    return rules_ops.rule_coverage(rows, RULES, "source_type", names)


@query(
    "rule_id_parts",
    f"""WITH {ALERTS_CTE} SELECT regexp_extract(RULE_ID, '^([A-Z0-9]+)-([A-Z0-9_]+)-([0-9]+)$', 1) AS category,
  regexp_extract(RULE_ID, '^([A-Z0-9]+)-([A-Z0-9_]+)-([0-9]+)$', 2) AS subcategory,
  CAST(regexp_extract(RULE_ID, '^([A-Z0-9]+)-([A-Z0-9_]+)-([0-9]+)$', 3) AS BIGINT) AS number, count(*) AS hits FROM alerts GROUP BY 1, 2, 3""",
)
def rule_id_parts(spark, folder):
    """C17: alerts grouped by the parts of their rule id."""
    found = alerts(spark, folder).select(*rules_ops.rule_id_parts(F.col("RULE_ID")))
    return as_text(found.groupBy("category", "subcategory", "number").agg(F.count("*").alias("hits")))


# ------------------------------------------------------------ rule tables derived from the data


def nation_rule_lines(spark, folder):
    """A rule file per nation, a rule per supplier: header lines and rule lines."""
    nation, supplier = table(spark, folder, "nation"), table(spark, folder, "supplier")
    header = nation.select(
        F.lower("n_name").alias("rule_file"),
        F.explode(
            F.array(
                F.concat(F.lit("# Version: 1."), F.col("n_nationkey")),
                F.concat(F.lit("# Category: region"), F.col("n_regionkey")),
                F.concat(F.lit("# Tags: nation,"), F.lower("n_name")),
                F.lit("# Last updated: 2024-01-01"),
                F.lit(""),
                F.lit(";no id;x;HIGH;9"),
            )
        ).alias("value"),
    )
    line = F.concat_ws(
        ";",
        F.concat(F.lit("SP-ACCT-"), F.col("s_suppkey")),
        F.col("s_name"),
        F.col("s_name"),
        F.when(F.col("s_acctbal") > 5000, "HIGH").when(F.col("s_acctbal") > 0, "").otherwise("WRONG"),
        F.lit("6,9"),
        F.when(F.col("s_acctbal") < 0, " debt , supplier").otherwise("supplier"),
    )
    rules = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select(
        F.lower("n_name").alias("rule_file"), line.alias("value")
    )
    return header.unionByName(rules)


_SUPPLIERS = """s AS (SELECT lower(n_name) AS rule_file, 'SP-ACCT-' || s_suppkey AS rule_id, s_name AS description, s_acctbal, n_regionkey, n_nationkey
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


@query(
    "parse_rules",
    f"""WITH {_SUPPLIERS} SELECT rule_file, rule_id, description, description AS pattern,
  CASE WHEN s_acctbal > 5000 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, CAST(CASE WHEN s_acctbal > 5000 THEN 40 ELSE 30 END AS BIGINT) AS severity_level,
  '6,9' AS fields, CASE WHEN s_acctbal < 0 THEN 'debt,supplier' ELSE 'supplier' END AS tags, '' AS negative_pattern FROM s""",
)
def parse_rules_query(spark, folder):
    """Rule lines split and validated."""
    rules = parse_rules(nation_rule_lines(spark, folder))
    return as_text(rules.withColumns({"fields": F.array_join(F.col("fields").cast("array<string>"), ","), "tags": F.array_join("tags", ",")}))


@query(
    "rule_file_metadata",
    """SELECT lower(n_name) AS rule_file, '1.' || n_nationkey AS version, 'region' || n_regionkey AS category,
  'nation,' || lower(n_name) AS tags, '2024-01-01' AS last_updated, '' AS author FROM nation""",
)
def rule_file_metadata_query(spark, folder):
    """Header values per rule file."""
    return rule_file_metadata(nation_rule_lines(spark, folder))


@query(
    "rules_by_tag",
    f"""WITH {_SUPPLIERS} SELECT 'nation' AS tag, rule_id FROM s UNION SELECT rule_file, rule_id FROM s
UNION SELECT 'supplier', rule_id FROM s UNION SELECT 'debt', rule_id FROM s WHERE s_acctbal < 0""",
)
def rules_by_tag(spark, folder):
    """Rule ids per tag."""
    return rule_admin.rules_by_tag(nation_rule_lines(spark, folder)).select("tag", "rule_id")


@query("rules_by_category", f"WITH {_SUPPLIERS} SELECT DISTINCT 'region' || n_regionkey AS category, rule_id FROM s")
def rules_by_category(spark, folder):
    """Rule ids per file category."""
    return rule_admin.rules_by_category(nation_rule_lines(spark, folder))


@query(
    "rule_summary",
    """SELECT lower(n_name) AS rule_file, '1.' || n_nationkey AS version, 'region' || n_regionkey AS category,
  '2024-01-01' AS last_updated, count(s_suppkey) AS rules FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey
GROUP BY n_name, n_nationkey, n_regionkey""",
)
def rule_summary(spark, folder):
    """C14: version, category, date and number of rules per file."""
    return rule_admin.rule_summary(nation_rule_lines(spark, folder))


def _old_and_new(spark, folder):
    """Rules from customers' accounts: the new version drops debtors and raises the big accounts."""
    customer = table(spark, folder, "customer")
    rules = customer.select(
        F.concat(F.lit("CU-ACCT-"), F.col("c_custkey")).alias("rule_id"),
        F.col("c_name").alias("description"),
        F.col("c_mktsegment").alias("pattern"),
        F.lit("LOW").alias("severity"),
        "c_acctbal",
    )
    old = rules.where("c_acctbal < 9000")
    new = rules.where("c_acctbal >= 0").withColumn(
        "pattern", F.when(F.col("c_acctbal") > 8000, F.concat("pattern", F.lit("|VIP"))).otherwise(F.col("pattern"))
    )
    return old, new


@query(
    "rule_diff",
    """WITH r AS (SELECT 'CU-ACCT-' || c_custkey AS rule_id, c_mktsegment AS pattern, c_acctbal FROM customer)
SELECT rule_id, CASE WHEN c_acctbal < 0 THEN 'removed' WHEN c_acctbal >= 9000 THEN 'added' ELSE 'changed' END AS change,
  CASE WHEN c_acctbal < 9000 THEN pattern END AS old_pattern,
  CASE WHEN c_acctbal >= 0 THEN pattern || '|VIP' END AS new_pattern FROM r WHERE c_acctbal < 0 OR c_acctbal > 8000""",
)
def rule_diff(spark, folder):
    """Added, removed and changed rules of two versions."""
    return rule_admin.rule_diff(*_old_and_new(spark, folder))


@query(
    "rule_history",
    """SELECT lower(n_name) AS rule_file, CASE WHEN count(*) FILTER (WHERE s_acctbal <= 0) > 0 THEN '1.1' ELSE '1.0' END AS version,
  6 + count(*) FILTER (WHERE s_acctbal > 0) AS lines FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name""",
)
def rule_history(spark, folder):
    """Whole files in a first snapshot, those with mended lines in a second, the latest read back."""
    from tracehold.session import staging_path

    path = staging_path(spark, "history")
    lines = nation_rule_lines(spark, folder)
    wrong = F.col("value").contains(";WRONG;")
    newer = lines.where(~wrong).join(lines.where(wrong).select("rule_file").distinct(), "rule_file", "left_semi")
    rule_admin.commit_rules(lines, path, "1.0", "first version", "2024-01-01T000000")
    rule_admin.commit_rules(newer, path, "1.1", "checked severities", "2024-02-01T000000")
    latest = rule_admin.latest_rules(spark.read.parquet(path))
    return latest.groupBy(F.col("rule_file").cast("string").alias("rule_file"), "version").agg(F.count("*").alias("lines"))


# ------------------------------------------------------------ alert management

_KEY = "RULE_ID, ip_address, username"


@query(
    "suppress_duplicates",
    f"""WITH {ALERTS_CTE}, x AS (SELECT *, lag(ts) OVER (PARTITION BY {_KEY} ORDER BY ts, event_id) AS before FROM alerts)
SELECT RULE_ID, ip_address, username, event_id, {stamp_sql('ts')} AS ts FROM x
WHERE before IS NULL OR epoch_us(ts) - epoch_us(before) > 3600000000""",
)
def suppress_duplicates(spark, folder):
    """M1: repeats within an hour dropped."""
    kept = manage.suppress_duplicates(staged_alerts(spark, folder))
    return as_text(kept.select("RULE_ID", "ip_address", "username", "event_id", "ts"))


@query(
    "throttle_alerts",
    f"""WITH {ALERTS_CTE}, x AS (SELECT RULE_ID, event_id, row_number() OVER
  (PARTITION BY RULE_ID, floor(epoch_us(ts) / 21600000000.0) ORDER BY ts, event_id) AS n FROM alerts)
SELECT RULE_ID, event_id FROM x WHERE n <= 5""",
)
def throttle_alerts(spark, folder):
    """M2: at most five alerts per rule in six hours (the test data is sparse)."""
    return manage.throttle_alerts(alerts(spark, folder), 5, 21_600).select("RULE_ID", "event_id")


@query(
    "response_candidates",
    f"""WITH {ALERTS_CTE} SELECT 'block-ip' AS action, 'BF-SSH-*' AS rule_pattern, ip_address AS target, count(*) AS event_count,
  {stamp_sql('max(ts)')} AS last_seen FROM alerts WHERE RULE_ID LIKE 'BF-SSH-%' AND ip_address NOT IN ('10.0.1.2', '10.0.2.3')
GROUP BY ip_address HAVING count(*) >= 5""",
)
def response_candidates(spark, folder):
    """M3: addresses over the threshold, without the whitelist."""
    found = manage.response_candidates(alerts(spark, folder), "BF-SSH-*", "block-ip", whitelist=("10.0.1.2", "10.0.2.3"))
    return as_text(found)


_CAT = "regexp_extract(RULE_ID, '^([A-Z0-9]+)-', 1)"


@query(
    "daily_report",
    f"""WITH {ALERTS_CTE}, a AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, SEVERITY AS severity, {_CAT} AS category FROM alerts)
SELECT coalesce(day, 'all') AS day, coalesce(severity, 'all') AS severity, coalesce(category, 'all') AS category, count(*) AS event_count
FROM a GROUP BY ROLLUP (day, severity, category)""",
)
def daily_report(spark, folder):
    """M4: counts by day, severity and category with subtotals."""
    return manage.daily_report(alerts(spark, folder))


@query(
    "format_alerts",
    f"WITH {ALERTS_CTE} SELECT RULE_ID, SEVERITY, DESCRIPTION, timestamp, source_type, source_name, hostname, substring(message, 1, 40) AS message FROM alerts",
)
def format_alerts(spark, folder):
    """M5: the columns of an alert message, the message cut."""
    return manage.format_alerts(alerts(spark, folder), max_message_length=40)


_RUNS = f"""runs1 AS (SELECT *, sum(opens) OVER (ORDER BY ts, event_id, RULE_ID ROWS UNBOUNDED PRECEDING) AS run FROM
  (SELECT ts, event_id, RULE_ID, SEVERITY, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts, event_id, RULE_ID)) <= 300000000 THEN 0 ELSE 1 END AS opens FROM alerts) q),
runs AS (SELECT min(ts) AS s, max(ts) AS e, count(*) AS n, max({level_sql()}) AS lv, list_sort(list_distinct(list(substring(RULE_ID, 1, 3)))) AS kinds
  FROM runs1 GROUP BY run)"""
RUNS_CTE = ALERTS_CTE + ", " + _RUNS


@query(
    "incidents",
    f"""WITH {RUNS_CTE} SELECT 'INC-' || strftime(s, '%Y%m%d') || '-' ||
  lpad(CAST(row_number() OVER (PARTITION BY strftime(s, '%Y%m%d') ORDER BY s) AS VARCHAR), 3, '0') AS incident_id,
  {stamp_sql('s')} AS start_time, {stamp_sql('e')} AS end_time, n AS event_count, {level_name_sql('lv')} AS severity FROM runs WHERE n > 1""",
)
def incidents(spark, folder):
    """M6: runs of alerts numbered per day."""
    return as_text(manage.incidents(alerts(spark, folder)))
