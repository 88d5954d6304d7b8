"""Threat indicators: classification, verdicts, enrichment, rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracehold.functions.regexes import DOMAIN, URL
from tracehold.operators.ordered import numbered
from tracehold.operators.skew import join_unique
from tracehold.schema import INDICATOR_SCHEMA
from tracehold.session import stage

# How long a verdict holds, feed score, limits of the report scores.
VERDICT_DAYS = 7
FEED_SCORE = 80.0
ABUSE_LIMIT = 80
PULSE_POINTS = 10
HASH_LENGTHS = {"md5": 32, "sha1": 40, "sha256": 64}
# What is said of items that are no such indicator, and the source of an unnamed verdict.
INVALID = {"ip": "Invalid IP format", "domain": "Invalid domain format", "hash": "Invalid hash format"}
UNNAMED_SOURCE = "multiple"

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"^{_OCTET}(\.{_OCTET}){{3}}$"
_GROUPS = r"[0-9A-Fa-f]{1,4}(:[0-9A-Fa-f]{1,4})*"
_TAIL = r"^(.*:)([0-9.]+)$"


def is_ipv4(text: Column) -> Column:
    return text.rlike(_IPV4)


def is_ipv6(text: Column) -> Column:
    """Eight groups, or fewer around one ``::``; a dotted-quad tail and a zone are allowed."""
    bare = F.regexp_replace(text, r"%[^%]+$", "")
    tail = F.regexp_extract(bare, _TAIL, 2)
    body = F.when(tail.rlike(_IPV4), F.concat(F.regexp_extract(bare, _TAIL, 1), F.lit("0:0"))).otherwise(bare)
    groups = F.size(F.regexp_extract_all(body, F.lit("([0-9A-Fa-f]+)"), F.lit(1)))
    full = body.rlike(rf"^{_GROUPS}$") & (groups == 8)
    short = body.rlike(rf"^({_GROUPS})?::({_GROUPS})?$") & (groups <= 7)
    return full | short


def is_ip(text: Column) -> Column:
    return is_ipv4(text) | is_ipv6(text)


def is_domain(text: Column) -> Column:
    return text.rlike(f"^{DOMAIN}$")


def is_url(text: Column) -> Column:
    return text.rlike(URL)


def hash_type(text: Column) -> Column:
    """md5, sha1 or sha256 by length; null for anything else."""
    kind = F.lit(None).cast("string")
    for name, length in HASH_LENGTHS.items():
        kind = F.when(text.rlike(f"^[a-fA-F0-9]{{{length}}}$"), name).otherwise(kind)
    return kind


def indicator_type(text: Column) -> Column:
    """ipv4, ipv6, domain, url, md5, sha1, sha256 or unknown."""
    return (
        F.when(is_ipv4(text), "ipv4")
        .when(is_ipv6(text), "ipv6")
        .when(is_domain(text), "domain")
        .when(is_url(text), "url")
        .otherwise(F.coalesce(hash_type(text), F.lit("unknown")))
    )


_VALID = {"ip": is_ip, "domain": is_domain, "hash": lambda text: hash_type(text).isNotNull()}


def _fresh(store: DataFrame, kind: str, as_of: str) -> DataFrame:
    """Verdicts of a type that are not older than the limit at ``as_of``."""
    oldest = F.lit(as_of).cast("timestamp") - F.expr(f"interval {VERDICT_DAYS} days")
    return store.where((F.col("type") == kind) & (F.col("last_updated") >= oldest))


def lookup(items: DataFrame, store: DataFrame, kind: str, as_of: str, column: str = "indicator") -> DataFrame:
    """Verdict per distinct item; invalid items carry an error, unknown ones score 0."""
    wanted = items.select(F.col(column).alias("indicator")).where("indicator is not null").distinct()
    known = _fresh(store, kind, as_of).select("indicator", "is_malicious", "threat_type", "score", "source")
    found = wanted.withColumn("valid", _VALID[kind](F.col("indicator"))).join(known, "indicator", "left")
    ok = F.col("valid")
    return found.select(
        "indicator",
        F.coalesce(ok & F.col("is_malicious"), F.lit(False)).alias("is_malicious"),
        F.when(ok, F.coalesce("threat_type", F.lit(""))).alias("threat_type"),
        F.when(ok, F.coalesce("score", F.lit(0.0))).alias("score"),
        F.when(ok, F.coalesce("source", F.lit(UNNAMED_SOURCE))).alias("source"),
        F.when(~ok, INVALID[kind]).alias("error"),
    )


def score_reports(reports: DataFrame) -> DataFrame:
    """Verdicts from source reports ``(indicator, source, abuse_score, pulse_count)``.

    An abuse score from 80, or any pulse, is malicious; the abuse report comes
    first when both say so.
    """
    abuse = F.coalesce("abuse_score", F.lit(0)) >= ABUSE_LIMIT
    pulses = F.coalesce("pulse_count", F.lit(0))
    best = reports.groupBy("indicator").agg(
        F.max(F.when((F.col("source") == "abuse_ipdb") & abuse, F.col("abuse_score"))).alias("abuse"),
        F.max(F.when((F.col("source") == "otx") & (pulses > 0), F.least(pulses * PULSE_POINTS, F.lit(100)))).alias("pulse"),
    )
    return best.select(
        "indicator",
        (F.col("abuse").isNotNull() | F.col("pulse").isNotNull()).alias("is_malicious"),
        F.when(F.col("abuse").isNotNull(), "Abuse Detection").when(F.col("pulse").isNotNull(), "OTX Detection").otherwise("").alias("threat_type"),
        F.coalesce(F.col("abuse").cast("double"), F.col("pulse").cast("double"), F.lit(0.0)).alias("score"),
        F.when(F.col("abuse").isNotNull(), "abuse_ipdb").when(F.col("pulse").isNotNull(), "otx").otherwise("multiple").alias("source"),
    )


def upsert_indicators(store: DataFrame, new: DataFrame, stamp: Column) -> DataFrame:
    """The store with ``new`` put in by (type, indicator), stamped; the latest row of a key stays."""
    columns = INDICATOR_SCHEMA.fieldNames()
    rows = store.select(*columns).unionByName(new.withColumn("last_updated", stamp).select(*columns))
    body = [c for c in columns if c not in ("type", "indicator")]
    # Equal stamps: the larger row, so that a rerun gives the same store.
    newest = F.max(F.struct("last_updated", "score", "is_malicious", "threat_type", "source")).alias("r")
    return rows.groupBy("type", "indicator").agg(newest).select(
        "type", "indicator", *[F.col(f"r.{c}").alias(c) for c in body]
    ).select(*columns)


def url_host(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def classify_feed(rows: DataFrame, feed_type: str) -> DataFrame:
    """Feed rows ``(source, indicator)`` as store rows; URLs are kept by host."""
    text = F.col("indicator")
    ip = is_ip(text) if feed_type == "mixed" else F.lit(feed_type == "ip")
    domain = is_domain(text) if feed_type == "mixed" else F.lit(feed_type == "domain")
    url = is_url(text) if feed_type == "mixed" else F.lit(feed_type == "url")
    typed = rows.select(
        "source",
        F.when(ip, "ip").when(domain | url, "domain").alias("type"),
        F.when(ip | domain, text).when(url, url_host(text)).alias("indicator"),
    )
    return typed.where("type is not null and indicator is not null and indicator <> ''").select(
        "type",
        "indicator",
        F.lit(True).alias("is_malicious"),
        F.concat("source", F.lit(" feed")).alias("threat_type"),
        F.lit(FEED_SCORE).alias("score"),
        "source",
    )


def enrich_alerts(
    alerts: DataFrame, store: DataFrame, as_of: str, row_keys: list[str] | None = None
) -> DataFrame:
    """Alerts with ``threat_intel_result``, ``_source``, ``_score`` and ``_type``.

    The address decides; otherwise the first malicious domain of the message.
    Only malicious verdicts matter, so the store is cut to those first, and
    distinct addresses and domains are looked up, not alerts.
    """
    keys = row_keys or ["event_id", "RULE_ID"]
    verdict = F.struct("source", "score", "threat_type")
    bad_ips = _fresh(store, "ip", as_of).where("is_malicious").select(F.col("indicator").alias("ip_address"), verdict.alias("_ip"))
    bad_domains = _fresh(store, "domain", as_of).where("is_malicious").select(F.col("indicator").alias("domain"), verdict.alias("_dom"))
    seen = alerts.select("ip_address").where("ip_address <> ''").distinct()
    hits = bad_ips.join(seen.where(is_ip(F.col("ip_address"))), "ip_address", "left_semi")
    step = join_unique(alerts, hits, ["ip_address"], F.struct(*keys), "left")
    found = F.regexp_extract_all("message", F.lit(f"({DOMAIN})"), F.lit(1))
    named = step.where(F.col("_ip").isNull() & F.col("message").rlike(DOMAIN)).select(
        *keys, F.posexplode(found).alias("_pos", "domain")
    )
    first = (
        join_unique(named, bad_domains, ["domain"], F.struct(*keys))
        .groupBy(*keys)
        .agg(F.min_by("_dom", "_pos").alias("_dom"))
    )
    # Written out: usually few alerts name a malicious domain, and then the rest is not shuffled for them.
    joined = step.join(stage(first, "domain_verdicts"), keys, "left")
    hit = F.coalesce("_ip", "_dom")
    return joined.select(
        *alerts.columns,
        hit.isNotNull().alias("threat_intel_result"),
        F.coalesce(hit["source"], F.lit("")).alias("threat_intel_source"),
        F.coalesce(hit["score"], F.lit(0.0)).alias("threat_intel_score"),
        F.coalesce(hit["threat_type"], F.lit("")).alias("threat_intel_type"),
    )


def rules_from_indicators(store: DataFrame) -> DataFrame:
    """Detection rules for the malicious addresses and domains, numbered in indicator order."""
    bad = store.where("is_malicious and type in ('ip', 'domain')").select("type", "indicator").distinct()
    placed = numbered(bad, ["type"], ["indicator"], "number")
    is_ip_row = F.col("type") == "ip"
    return placed.select(
        F.concat(F.when(is_ip_row, "TI-IP-").otherwise("TI-DOM-"), F.format_string("%03d", "number")).alias("rule_id"),
        F.concat(F.when(is_ip_row, "Known Malicious IP: ").otherwise("Known Malicious Domain: "), "indicator").alias("description"),
        F.replace("indicator", F.lit("."), F.lit("\\.")).alias("pattern"),
        F.lit("HIGH").alias("severity"),
        F.when(is_ip_row, "6,9").otherwise("9").alias("fields"),
    )


def rule_lines(rules: DataFrame) -> DataFrame:
    """Rules as lines of a rule file."""
    return rules.select(F.concat_ws(";", "rule_id", "description", "pattern", "severity", "fields").alias("value"))


def feed_update_summary(feeds: DataFrame, store: DataFrame) -> DataFrame:
    """Rows and stored indicators per feed; a feed without rows failed."""
    stored = store.where("is_malicious").groupBy("source").agg(F.count("*").alias("stored"))
    return (
        feeds.groupBy("source")
        .agg(F.count("indicator").alias("fetched"))
        .join(stored, "source", "left")
        .select(
            "source",
            "fetched",
            F.coalesce("stored", F.lit(0)).alias("stored"),
            F.when(F.col("fetched") > 0, "updated").otherwise("failed").alias("status"),
        )
    )
