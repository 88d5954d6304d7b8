"""Queries: indicators, enrichment, technique mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracehold.functions.regexes import DOMAIN, URL
from tracehold.operators import intel, mapping
from tracehold.operators.rule_tables import detect_table
from tracehold.plans.registry import query
from tracehold.plans.views import ALERTS_CTE, LOGS_CTE, as_text, logs, r6, sql_text, staged_alerts, stamp_sql, table
from tracehold.session import staging_path
from tracehold.sources import feeds
from tracehold.sources import indicator_store as indicator_store_folder
from tracehold.sources.rules import bundled_rule_lines, bundled_rules, parse_rules

AS_OF = "2024-02-01 00:00:00"

# ------------------------------------------------------------ indicators found in the data

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = f"'^{_OCTET}(\\.{_OCTET}){{3}}$'"
_DOMAIN = f"'^{DOMAIN}$'"
_URL = sql_text(URL)


def candidates(spark, folder) -> DataFrame:
    """Possible indicators of the tables: page URLs and hosts, addresses, hashes of texts, names."""
    pages, docs = table(spark, folder, "pages"), table(spark, folder, "documents")
    parts = [
        pages.select(F.col("url").alias("indicator")),
        pages.select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("indicator")),
        pages.select(F.md5("html").alias("indicator")),
        docs.select(F.sha2("text", 256).alias("indicator")),
        docs.select(F.sha1("text").alias("indicator")),
        docs.select("source"),
        logs(spark, folder).select("ip_address"),
        logs(spark, folder).select(F.concat(F.lit("300.1.1."), F.col("k"))),
        logs(spark, folder).select(F.concat(F.lit("2001:db8::"), F.hex(F.col("k") % 16))),
        logs(spark, folder).select(F.concat(F.lit("2001:db8:::"), F.col("k"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


_CANDIDATES = f"""{LOGS_CTE}, cand AS (SELECT url AS indicator, 'url' AS kind FROM pages UNION SELECT regexp_extract(url, '^https?://([^/]+)', 1), 'host' FROM pages
UNION SELECT md5(html), 'md5' FROM pages UNION SELECT sha256(text), 'sha256' FROM documents UNION SELECT sha1(text), 'sha1' FROM documents
UNION SELECT source, 'name' FROM documents UNION SELECT ip_address, 'ipv4' FROM logs UNION SELECT '300.1.1.' || k, 'bad' FROM logs
UNION SELECT '2001:db8::' || printf('%X', k % 16), 'ipv6' FROM logs UNION SELECT '2001:db8:::' || k, 'bad' FROM logs)"""


@query(
    "indicator_type",
    f"""WITH {_CANDIDATES} SELECT indicator, CASE WHEN regexp_matches(indicator, {_V4}) THEN 'ipv4' WHEN kind = 'ipv6' THEN 'ipv6'
  WHEN regexp_matches(indicator, {_DOMAIN}) THEN 'domain' WHEN regexp_matches(indicator, {_URL}) THEN 'url'
  WHEN regexp_matches(indicator, '^[a-fA-F0-9]{{32}}$') THEN 'md5' WHEN regexp_matches(indicator, '^[a-fA-F0-9]{{40}}$') THEN 'sha1'
  WHEN regexp_matches(indicator, '^[a-fA-F0-9]{{64}}$') THEN 'sha256' ELSE 'unknown' END AS indicator_type FROM cand""",
)
def indicator_type(spark, folder):
    """What kind of indicator a text is."""
    return candidates(spark, folder).select("indicator", intel.indicator_type(F.col("indicator")).alias("indicator_type"))


def indicator_store(spark, folder) -> DataFrame:
    """A store from the data: addresses that failed logins, hosts of pages and of commands, hashes of pages.

    Verdicts on addresses are as old as the address's last failure.
    """
    rows = logs(spark, folder)
    ips = (
        rows.where("event_type = 'error'")
        .groupBy(F.col("ip_address").alias("indicator"))
        .agg(F.count("*").alias("n"), F.max("ts").alias("last_updated"))
        .select(
            F.lit("ip").alias("type"), "indicator", (F.col("n") > 50).alias("is_malicious"), F.lit("failures").alias("threat_type"),
            F.least(F.col("n"), F.lit(100)).cast("double").alias("score"), F.lit("logins").alias("source"), "last_updated",
        )
    )
    hosts = (
        rows.where("message like '%curl%'")
        .groupBy(F.regexp_extract("message", "http://([^/]+)", 1).alias("indicator"))
        .agg(F.max("k").alias("k"), F.max("ts").alias("last_updated"))
        .select(
            F.lit("domain").alias("type"), "indicator", (F.col("k") < 50).alias("is_malicious"), F.lit("download").alias("threat_type"),
            F.lit(80.0).alias("score"), F.lit("commands").alias("source"), "last_updated",
        )
    )
    hashes = table(spark, folder, "pages").groupBy(F.md5("html").alias("indicator")).agg(F.count("*").alias("n")).select(
        F.lit("hash").alias("type"), "indicator", (F.col("n") > 1).alias("is_malicious"), F.lit("copied page").alias("threat_type"),
        F.col("n").cast("double").alias("score"), F.lit("pages").alias("source"), F.lit("2024-01-31 00:00:00").cast("timestamp").alias("last_updated"),
    )
    return ips.unionByName(hosts).unionByName(hashes)


_STORE = f"""store AS (SELECT 'ip' AS type, ip_address AS indicator, count(*) > 50 AS is_malicious, 'failures' AS threat_type,
  CAST(least(count(*), 100) AS DOUBLE) AS score, 'logins' AS source, max(ts) AS last_updated FROM logs WHERE event_type = 'error' GROUP BY ip_address
UNION ALL SELECT 'domain', regexp_extract(message, 'http://([^/]+)', 1), max(k) < 50, 'download', 80.0, 'commands', max(ts) FROM logs WHERE message LIKE '%curl%' GROUP BY 2
UNION ALL SELECT 'hash', md5(html), count(*) > 1, 'copied page', CAST(count(*) AS DOUBLE), 'pages', TIMESTAMP '2024-01-31 00:00:00' FROM pages GROUP BY 2)"""


def _lookup_sql(items: str, kind: str) -> str:
    return f"""SELECT indicator, coalesce(valid AND is_malicious, FALSE) AS is_malicious, CASE WHEN valid THEN coalesce(threat_type, '') END AS threat_type,
  CASE WHEN valid THEN {r6('coalesce(score, 0)')} END AS score, CASE WHEN valid THEN coalesce(source, '{intel.UNNAMED_SOURCE}') END AS source, CASE WHEN NOT valid THEN '{intel.INVALID[kind]}' END AS error
FROM (SELECT DISTINCT {items}) i LEFT JOIN (SELECT indicator AS si, is_malicious, threat_type, score, source FROM store
  WHERE type = '{kind}' AND last_updated >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) s ON si = indicator"""


@query(
    "lookup_ips",
    f"""WITH {LOGS_CTE}, {_STORE}, items AS (SELECT ip_address AS indicator FROM logs UNION SELECT '10.0.0.' || (k + 200) FROM logs)
{_lookup_sql(f"indicator, regexp_matches(indicator, {_V4}) AS valid FROM items", 'ip')}""",
)
def lookup_ips(spark, folder):
    """Verdicts on addresses, invalid ones marked."""
    rows = logs(spark, folder)
    items = rows.select(F.col("ip_address").alias("indicator")).union(rows.select(F.concat(F.lit("10.0.0."), F.col("k") + 200)))
    return as_text(intel.lookup(items, indicator_store(spark, folder), "ip", AS_OF))


@query(
    "lookup_domains",
    f"""WITH {LOGS_CTE}, {_STORE}, items AS (SELECT regexp_extract(message, 'http://([^/]+)', 1) AS indicator FROM logs WHERE message LIKE '%curl%'
  UNION SELECT regexp_extract(url, '^https?://([^/]+)', 1) FROM pages UNION SELECT url FROM pages)
{_lookup_sql(f"indicator, regexp_matches(indicator, {_DOMAIN}) AS valid FROM items", 'domain')}""",
)
def lookup_domains(spark, folder):
    """Verdicts on domains."""
    pages = table(spark, folder, "pages")
    named = logs(spark, folder).where("message like '%curl%'").select(F.regexp_extract("message", "http://([^/]+)", 1).alias("indicator"))
    items = named.union(pages.select(F.regexp_extract("url", "^https?://([^/]+)", 1))).union(pages.select("url"))
    return as_text(intel.lookup(items, indicator_store(spark, folder), "domain", AS_OF))


@query(
    "lookup_hashes",
    f"""WITH {LOGS_CTE}, {_STORE}, items AS (SELECT md5(html) AS indicator FROM pages UNION SELECT sha256(text) FROM documents UNION SELECT source FROM documents)
{_lookup_sql("indicator, regexp_matches(indicator, '^([a-fA-F0-9]{32}|[a-fA-F0-9]{40}|[a-fA-F0-9]{64})$') AS valid FROM items", 'hash')}""",
)
def lookup_hashes(spark, folder):
    """Verdicts on file hashes."""
    docs = table(spark, folder, "documents")
    items = table(spark, folder, "pages").select(F.md5("html").alias("indicator")).union(docs.select(F.sha2("text", 256))).union(docs.select("source"))
    return as_text(intel.lookup(items, indicator_store(spark, folder), "hash", AS_OF))


@query(
    "score_reports",
    f"""WITH {LOGS_CTE}, r AS (SELECT ip_address AS indicator, CASE WHEN event_type = 'error' THEN 'abuse_ipdb' ELSE 'otx' END AS source, k AS abuse_score,
  CASE WHEN event_type = 'view' THEN k % 15 ELSE 0 END AS pulse_count FROM logs),
b AS (SELECT indicator, max(CASE WHEN source = 'abuse_ipdb' AND abuse_score >= 80 THEN abuse_score END) AS a,
  max(CASE WHEN source = 'otx' AND pulse_count > 0 THEN least(pulse_count * 10, 100) END) AS p FROM r GROUP BY indicator)
SELECT indicator, a IS NOT NULL OR p IS NOT NULL AS is_malicious, CASE WHEN a IS NOT NULL THEN 'Abuse Detection' WHEN p IS NOT NULL THEN 'OTX Detection' ELSE '' END AS threat_type,
  {r6('coalesce(a, p, 0)')} AS score, CASE WHEN a IS NOT NULL THEN 'abuse_ipdb' WHEN p IS NOT NULL THEN 'otx' ELSE 'multiple' END AS source FROM b""",
)
def score_reports(spark, folder):
    """Verdicts from abuse scores and pulse counts."""
    reports = logs(spark, folder).select(
        F.col("ip_address").alias("indicator"),
        F.when(F.col("event_type") == "error", "abuse_ipdb").otherwise("otx").alias("source"),
        F.col("k").alias("abuse_score"),
        F.when(F.col("event_type") == "view", F.col("k") % 15).otherwise(0).alias("pulse_count"),
    )
    return as_text(intel.score_reports(reports))


@query(
    "enrich_alerts",
    f"""WITH {ALERTS_CTE}, {_STORE}, fresh AS (SELECT * FROM store WHERE is_malicious AND last_updated >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY),
d AS (SELECT event_id, RULE_ID, unnest(regexp_extract_all(message, '({DOMAIN})', 1)) AS domain, generate_subscripts(regexp_extract_all(message, '({DOMAIN})', 1), 1) AS pos FROM alerts),
dm AS (SELECT event_id, RULE_ID, source, score, threat_type, row_number() OVER (PARTITION BY event_id, RULE_ID ORDER BY pos) AS n FROM d JOIN fresh ON type = 'domain' AND indicator = domain)
SELECT a.event_id, a.RULE_ID, i.indicator IS NOT NULL OR m.event_id IS NOT NULL AS threat_intel_result, coalesce(i.source, m.source, '') AS threat_intel_source,
  {r6('coalesce(i.score, m.score, 0)')} AS threat_intel_score, coalesce(i.threat_type, m.threat_type, '') AS threat_intel_type
FROM alerts a LEFT JOIN fresh i ON i.type = 'ip' AND i.indicator = a.ip_address LEFT JOIN dm m ON m.n = 1 AND m.event_id = a.event_id AND m.RULE_ID = a.RULE_ID""",
)
def enrich_alerts(spark, folder):
    """I4: alerts with the verdict on their address or the first malicious domain."""
    found = intel.enrich_alerts(staged_alerts(spark, folder), indicator_store(spark, folder), AS_OF)
    return as_text(found.select("event_id", "RULE_ID", *[c for c in found.columns if c.startswith("threat_intel")]))


# ------------------------------------------------------------ feeds


def url_feed(spark, folder) -> DataFrame:
    """A downloaded csv feed made of the page table: comment, blank and value lines."""
    pages = table(spark, folder, "pages")
    quoted = F.concat(F.lit('"'), F.regexp_replace("url", '"', '""'), F.lit('"'))
    row = F.concat(F.lit('id,2024-01-01,'), quoted, F.lit(",online"))
    lines = pages.select(F.explode(F.array(row, F.concat(F.lit("# page "), F.col("page_id")), F.lit(""))).alias("value"))
    path = staging_path(spark, "feed")
    lines.write.text(path)
    return feeds.read_feed(spark, "urlhaus", path)


@query("read_feed", "SELECT 'urlhaus' AS source, url AS indicator FROM pages")
def read_feed(spark, folder):
    """A csv feed of URLs, comments and blanks skipped."""
    return url_feed(spark, folder)


@query(
    "read_json_feed",
    f"WITH {LOGS_CTE} SELECT DISTINCT 'threatfox' AS source, ip_address AS indicator FROM logs",
)
def read_json_feed(spark, folder):
    """A nested JSON feed, one document per address network."""
    network = F.substring_index("ip_address", ".", 3).alias("network")
    addresses = logs(spark, folder).select(network, F.struct(F.col("ip_address").alias("ioc")).alias("i")).distinct()
    # One document, so one file, for each of the eight networks.
    body = addresses.groupBy("network").agg(F.struct(F.collect_list("i").alias("iocs")).alias("data"))
    path = staging_path(spark, "feed")
    body.repartition("network").write.partitionBy("network").json(path)
    return feeds.read_feed(spark, "threatfox", path)


@query(
    "classify_feed",
    """SELECT 'domain' AS type, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS indicator, TRUE AS is_malicious, 'urlhaus feed' AS threat_type, CAST(80 AS DOUBLE) AS score, 'urlhaus' AS source FROM pages""",
)
def classify_feed(spark, folder):
    """Feed rows as store rows, URLs by host."""
    return as_text(intel.classify_feed(url_feed(spark, folder), "url"))


@query(
    "upsert_indicators",
    f"""WITH {LOGS_CTE}, {_STORE}, n AS (SELECT DISTINCT 'domain' AS type, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS indicator, TRUE AS is_malicious, 'urlhaus feed' AS threat_type,
  80.0 AS score, 'urlhaus' AS source, TIMESTAMP '{AS_OF}' AS last_updated FROM pages), u AS (SELECT * FROM store UNION ALL SELECT * FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY type, indicator ORDER BY last_updated DESC) AS k FROM u)
SELECT type, indicator, is_malicious, threat_type, {r6('score')} AS score, source, {stamp_sql('last_updated')} AS last_updated FROM r WHERE k = 1""",
)
def upsert_indicators(spark, folder):
    """A10: a feed put into the store."""
    new = intel.classify_feed(url_feed(spark, folder), "url")
    return as_text(intel.upsert_indicators(indicator_store(spark, folder), new, F.lit(AS_OF).cast("timestamp")))


@query(
    "upsert_store",
    f"""WITH {LOGS_CTE}, {_STORE}, n AS (SELECT DISTINCT 'domain' AS type, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS indicator, TRUE AS is_malicious, 'urlhaus feed' AS threat_type,
  80.0 AS score, 'urlhaus' AS source, TIMESTAMP '{AS_OF}' AS last_updated FROM pages),
u AS (SELECT type, indicator, is_malicious, threat_type, score, source, TIMESTAMP '2000-01-01 00:00:00' AS last_updated FROM store UNION ALL SELECT * FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY type, indicator ORDER BY last_updated DESC, score DESC, is_malicious DESC, threat_type DESC NULLS LAST, source DESC NULLS LAST) AS k FROM u)
SELECT type, indicator, is_malicious, threat_type, {r6('score')} AS score, source, {stamp_sql('last_updated')} AS last_updated FROM r WHERE k = 1""",
)
def upsert_store(spark, folder):
    """A10: a store kept in a folder, a feed put into it in place, twice."""
    path = staging_path(spark, "store")
    indicator_store_folder.upsert_store(spark, path, indicator_store(spark, folder).drop("last_updated"), F.lit("2000-01-01").cast("timestamp"))
    feed = intel.classify_feed(url_feed(spark, folder), "url")
    for _ in range(2):  # the second time changes nothing
        indicator_store_folder.upsert_store(spark, path, feed, F.lit(AS_OF).cast("timestamp"))
    return as_text(indicator_store_folder.read_store(spark, path))


@query(
    "rules_from_indicators",
    f"""WITH {LOGS_CTE}, {_STORE}, b AS (SELECT DISTINCT type, indicator FROM store WHERE is_malicious AND type IN ('ip', 'domain')),
r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY indicator) AS n FROM b)
SELECT CASE WHEN type = 'ip' THEN 'TI-IP-' ELSE 'TI-DOM-' END || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS rule_id,
  CASE WHEN type = 'ip' THEN 'Known Malicious IP: ' ELSE 'Known Malicious Domain: ' END || indicator AS description,
  replace(indicator, '.', '\\.') AS pattern, 'HIGH' AS severity, CASE WHEN type = 'ip' THEN '6,9' ELSE '9' END AS fields FROM r""",
)
def rules_from_indicators(spark, folder):
    """Detection rules for malicious addresses and domains."""
    return intel.rules_from_indicators(indicator_store(spark, folder))


_INDICATOR_RULES = f"""b AS (SELECT DISTINCT type, indicator FROM store WHERE is_malicious AND type IN ('ip', 'domain')),
r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY indicator) AS n, replace(indicator, '.', '\\.') AS pattern FROM b),
ti AS (SELECT CASE WHEN type = 'ip' THEN 'TI-IP-' ELSE 'TI-DOM-' END || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS RULE_ID, type, pattern FROM r)"""


@query(
    "detect_indicators",
    f"""WITH {LOGS_CTE}, {_STORE}, {_INDICATOR_RULES} SELECT RULE_ID, 'HIGH' AS SEVERITY, event_id FROM logs, ti
WHERE (message <> '' AND regexp_matches(message, pattern)) OR (type = 'ip' AND ip_address <> '' AND regexp_matches(ip_address, pattern))""",
)
def detect_indicators(spark, folder):
    """Every line against the table of rules made from the indicators."""
    rules = intel.rules_from_indicators(indicator_store(spark, folder))
    table_of_rules = parse_rules(intel.rule_lines(rules).withColumn("rule_file", F.lit("indicators")))
    return detect_table(logs(spark, folder), table_of_rules).select("RULE_ID", "SEVERITY", "event_id")


@query(
    "feed_update_summary",
    f"""WITH {LOGS_CTE}, f AS (SELECT 'urlhaus' AS source, url AS indicator FROM pages UNION ALL SELECT 'phishtank', NULL),
s AS (SELECT count(DISTINCT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS n FROM pages)
SELECT f.source, count(f.indicator) AS fetched, CASE WHEN f.source = 'urlhaus' THEN (SELECT n FROM s) ELSE 0 END AS stored,
  CASE WHEN count(f.indicator) > 0 THEN 'updated' ELSE 'failed' END AS status FROM f GROUP BY f.source""",
)
def feed_update_summary(spark, folder):
    """Fetched and stored indicators per feed; a feed without rows failed."""
    found = url_feed(spark, folder)
    failed = spark.createDataFrame([("phishtank", None)], "source string, indicator string")
    new = intel.classify_feed(found, "url").withColumn("last_updated", F.lit(AS_OF).cast("timestamp"))
    store = intel.upsert_indicators(indicator_store(spark, folder), new.drop("last_updated"), F.lit(AS_OF).cast("timestamp"))
    return intel.feed_update_summary(found.unionByName(failed), store)


# ------------------------------------------------------------ techniques


def document_catalog(spark, folder) -> DataFrame:
    """A technique bundle made of the documents: sources are the kill-chain phases."""
    docs = table(spark, folder, "documents")
    ref = F.array(F.struct(F.concat(F.when(F.col("lang") == "en", "T").otherwise("X"), F.col("doc_id")).alias("external_id")))
    phases = F.array(
        F.struct(F.lit("mitre-attack").alias("kill_chain_name"), F.col("source").alias("phase_name")),
        F.struct(F.lit("other").alias("kill_chain_name"), F.col("lang").alias("phase_name")),
    )
    objects = docs.select(
        F.struct(
            F.lit("attack-pattern").alias("type"),
            F.concat(F.lit("Document "), F.col("doc_id")).alias("name"),
            F.col("text").alias("description"),
            ref.alias("external_references"),
            phases.alias("kill_chain_phases"),
        ).alias("o")
    )
    path = staging_path(spark, "bundle")
    objects.select(F.array("o").alias("objects")).write.json(path)
    techniques = spark.read.schema(feeds.BUNDLE_SCHEMA).json(path).select(F.explode("objects").alias("o")).select("o.*")
    return feeds.catalog_techniques(techniques)


@query(
    "read_attack_catalog",
    "SELECT 'T' || doc_id AS technique_id, 'Document ' || doc_id AS name, text AS description, source AS tactics FROM documents WHERE lang = 'en'",
)
def read_attack_catalog(spark, folder):
    """Techniques with the tactics of one kill chain."""
    found = document_catalog(spark, folder)
    return found.withColumn("tactics", F.array_join("tactics", ","))


@query(
    "read_attack_tactics",
    "SELECT 'TA' || n_nationkey AS tactic_id, n_name AS name, lower(n_name) AS description FROM nation",
)
def read_attack_tactics(spark, folder):
    """Tactics of bundles, one document and file per region."""
    nation = table(spark, folder, "nation")
    ref = F.array(F.struct(F.concat(F.lit("TA"), F.col("n_nationkey")).alias("external_id")))
    tactic = F.struct(
        F.lit("x-mitre-tactic").alias("type"), F.col("n_name").alias("name"), F.lower("n_name").alias("description"), ref.alias("external_references")
    )
    bundles = nation.groupBy("n_regionkey").agg(F.collect_list(tactic).alias("objects"))
    path = staging_path(spark, "bundles")
    bundles.repartition("n_regionkey").write.partitionBy("n_regionkey").json(path)
    return feeds.read_attack_catalog(spark, path)[1]


_KEYWORDS = ", ".join(
    f"({sql_text(r.rule_id)}, {sql_text(w)})"
    for r in bundled_rules()
    for w in r.pattern.lower().split("|") + r.description.lower().split()
    if len(w) > 3
)


@query(
    "map_rules_to_techniques",
    f"""WITH {LOGS_CTE}, kw(rule_id, keyword) AS (VALUES {_KEYWORDS}), t AS (SELECT 'T' || event_id AS technique_id, service AS name, source_type AS tactics,
  lower(service || ' ' || message) AS body FROM logs),
d AS (SELECT keyword, technique_id, name, tactics FROM (SELECT DISTINCT keyword FROM kw) k JOIN t ON contains(body, keyword)),
s AS (SELECT rule_id, technique_id, name, tactics, count(*) AS score FROM kw JOIN d USING (keyword) GROUP BY 1, 2, 3, 4),
r AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY score DESC, technique_id) AS rank FROM s)
SELECT rule_id, technique_id, name, tactics, score, rank FROM r WHERE rank <= 3 AND score > 1""",
)
def map_rules_to_techniques(spark, folder):
    """The rules' keywords looked for in technique texts, here the log messages."""
    rules = parse_rules(bundled_rule_lines(spark))
    techniques = logs(spark, folder).select(
        F.concat(F.lit("T"), F.col("event_id")).alias("technique_id"),
        F.col("service").alias("name"),
        F.col("message").alias("description"),
        F.array("source_type").alias("tactics"),
    )
    found = mapping.map_rules_to_techniques(rules, techniques)
    return as_text(found.withColumn("tactics", F.array_join("tactics", ",")))
