"""Raw lines to normalized log rows, as chained column expressions.

Every parser takes a DataFrame with a ``value`` column and adds the ten log
columns as strings, the empty string standing for a missing value.  Nothing
here shuffles and nothing fails on a bad line.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracehold.functions.regexes import DOTTED_QUAD, to_java
from tracehold.functions.times import parse_timestamp
from tracehold.schema import LOG_FIELDS

# Patterns of the syslog stages.
SYSLOG_STAMP = r"^([A-Za-z]+\s+[0-9]+\s+[0-9:]+)\s+(.*)"
SYSLOG_HOST = r"^([^\s]+)\s+(.*)"
SYSLOG_SERVICE = r"^([^:\s]+?)(\[([0-9]+)\])?:\s+(.*)"
BRACKETED_PID = r"\[([0-9]+)\]"
USER_WORD = r"user\s*[=:]?\s*([^\s]+)"
USER_BEFORE_FROM = r"for (?:invalid user )?([^\s]+) from"
LEVEL_TOKEN = r"\[([a-zA-Z]{4,10})\]|\(([a-zA-Z]{4,10})\)"

# Structured-log keys and the log column each one fills.
KEY_ALIASES = {
    "username": ["user", "username"],
    "hostname": ["host", "hostname"],
    "service": ["service"],
    "log_level": ["level", "severity"],
    "message": ["message", "msg"],
    "ip_address": ["ip", "client_ip", "remote_ip"],
    "process_id": ["pid", "process_id"],
}
KEY_VALUE = r'([a-zA-Z0-9_]+)=(?:"([^"]*)"|([^ ]*))'
STRUCT_STAMP = r"^([0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}.[0-9]{3}Z)"

# Keys searched, in order, for the stamp of a JSON line.
JSON_STAMP_KEYS = ["timestamp", "time", "ts", "@timestamp"]


@dataclass(frozen=True)
class SourceConfig:
    """How the lines of one source are collected and read."""

    source_type: str
    log_format: str = "syslog"
    paths: tuple[str, ...] = ()
    enabled: bool = True
    priority: int = 100
    filter_regex: str = ""
    exclude_regex: str = ""
    json_fields: dict = field(
        default_factory=lambda: {
            "timestamp": "timestamp",
            "log_level": "level",
            "message": "message",
            "service": "service",
            "username": "user",
        }
    )
    patterns: dict = field(default_factory=dict)
    ip_regex: str = DOTTED_QUAD
    stamp_regex: str = STRUCT_STAMP
    pair_regex: str = KEY_VALUE
    transform: object = None
    extended_user: bool = False


def sanitize(text: Column) -> Column:
    """Drop control bytes, tabs and DEL included."""
    return F.regexp_replace(text, r"[\x00-\x1F\x7F]", "")


def assemble(df: DataFrame, source_type: str, **found: Column) -> DataFrame:
    """Add the ten log columns; missing ones are empty, tabs become ``\\t``."""
    found.setdefault("source_type", F.lit(source_type))
    columns = {
        name: F.replace(F.coalesce(found.get(name, F.lit("")), F.lit("")), F.lit("\t"), F.lit("\\t")) for name in LOG_FIELDS
    }
    return df.withColumns(columns)


def parse_syslog(df: DataFrame, source_type: str = "syslog", extended_user: bool = False) -> DataFrame:
    """Stamp, host and service are taken off the front one after the other.

    A stage that does not match leaves the rest of the line alone.  The process
    id is the bracketed number of the service, else the first one in the rest.
    """
    line = sanitize(F.col("value"))
    dated = line.rlike(SYSLOG_STAMP)
    step = df.withColumns(
        {
            "_stamp": F.regexp_extract(line, SYSLOG_STAMP, 1),
            "_rest1": F.when(dated, F.regexp_extract(line, SYSLOG_STAMP, 2)).otherwise(line),
        }
    )
    step = step.withColumns(
        {
            "_host": F.regexp_extract("_rest1", SYSLOG_HOST, 1),
            "_rest2": F.when(
                F.col("_rest1").rlike(SYSLOG_HOST), F.regexp_extract("_rest1", SYSLOG_HOST, 2)
            ).otherwise(F.col("_rest1")),
        }
    )
    step = step.withColumns(
        {
            "_service": F.regexp_extract("_rest2", SYSLOG_SERVICE, 1),
            "_pid": F.regexp_extract("_rest2", SYSLOG_SERVICE, 3),
            "_rest3": F.when(
                F.col("_rest2").rlike(SYSLOG_SERVICE), F.regexp_extract("_rest2", SYSLOG_SERVICE, 4)
            ).otherwise(F.col("_rest2")),
        }
    )
    rest = F.col("_rest3")
    user = F.regexp_extract(rest, USER_WORD, 1)
    if extended_user:
        before_from = F.regexp_extract(rest, USER_BEFORE_FROM, 1)
        user = F.when(before_from != "", before_from).otherwise(user)
    parsed = assemble(
        step,
        source_type,
        timestamp=F.col("_stamp"),
        hostname=F.col("_host"),
        service=F.col("_service"),
        process_id=F.when(F.col("_pid") != "", F.col("_pid")).otherwise(F.regexp_extract(rest, BRACKETED_PID, 1)),
        ip_address=F.regexp_extract(rest, f"({DOTTED_QUAD})", 1),
        username=user,
        message=rest,
    )
    return parsed.drop("_stamp", "_rest1", "_host", "_rest2", "_service", "_pid", "_rest3")


def log_severity(text: Column) -> Column:
    """The bracketed or parenthesised level word of a syslog line."""
    square = F.regexp_extract(text, LEVEL_TOKEN, 1)
    return F.when(square != "", square).otherwise(F.regexp_extract(text, LEVEL_TOKEN, 2))


def parse_json(
    df: DataFrame, source_type: str = "json", json_fields: dict | None = None, ip_regex: str = DOTTED_QUAD
) -> DataFrame:
    """Configured (dotted) paths of a JSON line; the address is the first match of ``ip_regex``.

    Where a line is no valid JSON object, ``"column":"value"`` pairs named like
    the log columns are searched instead.
    """
    paths = json_fields or SourceConfig("json").json_fields
    tops = dict.fromkeys(path.split(".")[0] for path in paths.values())
    fields = [T.StructField(top, T.StringType()) for top in tops]
    schema = T.StructType([*fields, T.StructField("_broken", T.StringType())])
    # One parse per line; a nested object arrives as its JSON text.
    step = df.withColumn("_line", sanitize(F.col("value")))
    step = step.withColumn("_json", F.from_json("_line", schema, {"columnNameOfCorruptRecord": "_broken"}))
    line = F.col("_line")
    valid = F.col("_json").isNotNull() & F.col("_json._broken").isNull() & line.rlike(r"^\s*\{")
    found = {}
    for name in LOG_FIELDS:
        if name == "source_type":
            continue
        if name == "ip_address":
            inside = F.regexp_extract(line, to_java(ip_regex), 0)
        elif name in paths:
            top, _, rest = paths[name].partition(".")
            value = F.col("_json")[top]
            inside = F.coalesce(F.get_json_object(value, f"$.{rest}") if rest else value, F.lit(""))
        else:
            inside = F.lit("")
        found[name] = F.when(valid, inside).otherwise(F.regexp_extract(line, rf'"{name}":"([^"]+)"', 1))
    return assemble(step, source_type, **found).drop("_line", "_json")


def parse_structlog(
    df: DataFrame, source_type: str = "structlog", stamp_regex: str = STRUCT_STAMP, pair_regex: str = KEY_VALUE
) -> DataFrame:
    """Leading stamp plus ``key=value`` pairs; the last of a column's aliases wins.

    Group 1 of ``stamp_regex`` is the stamp; groups 1 and 2 (or 3) of ``pair_regex`` are a
    key and its value.  The message falls back to the line.
    """
    if pair_regex != KEY_VALUE:
        return _parse_pairs(df, source_type, stamp_regex, to_java(pair_regex))
    step = df.withColumn("_line", sanitize(F.col("value")))
    # Last pair first, so that the first position found is the one that counts.
    step = step.withColumn("_pairs", F.reverse(F.regexp_extract_all("_line", F.lit(f"({KEY_VALUE})"), F.lit(1))))
    step = step.withColumn("_keys", F.transform("_pairs", lambda pair: F.substring_index(pair, "=", 1)))
    found = {"timestamp": F.regexp_extract("_line", to_java(stamp_regex), 1)}
    for name, keys in KEY_ALIASES.items():
        places = [F.nullif(F.array_position("_keys", key), F.lit(0)) for key in keys]
        pair = F.get("_pairs", (F.least(*places) if len(places) > 1 else places[0]) - 1)
        raw = pair.substr(F.instr(pair, "=") + 1, F.length(pair))
        quoted = raw.startswith('"') & raw.endswith('"') & (F.length(raw) > 1)
        value = F.when(quoted, raw.substr(F.lit(2), F.length(raw) - 2)).otherwise(raw)
        found[name] = F.coalesce(value, F.lit(""))
    found["message"] = F.when(found["message"] == "", F.col("_line")).otherwise(found["message"])
    return assemble(step, source_type, **found).drop("_line", "_pairs", "_keys")


def _parse_pairs(df: DataFrame, source_type: str, stamp_regex: str, pair_regex: str) -> DataFrame:
    """Pairs of any configured form, by the groups of their regex."""
    groups = min(re.compile(pair_regex).groups, 3)
    if groups < 2:
        raise ValueError("a pair regex needs a group for the key and one for the value")
    step = df.withColumn("_line", sanitize(F.col("value")))
    for g in range(1, groups + 1):
        step = step.withColumn(f"_g{g}", F.reverse(F.regexp_extract_all("_line", F.lit(pair_regex), F.lit(g))))
    found = {"timestamp": F.regexp_extract("_line", to_java(stamp_regex), 1)}
    for name, keys in KEY_ALIASES.items():
        places = [F.nullif(F.array_position("_g1", key), F.lit(0)) for key in keys]
        at = (F.least(*places) if len(places) > 1 else places[0]) - 1
        values = [F.nullif(F.get(f"_g{g}", at), F.lit("")) for g in range(2, groups + 1)]
        found[name] = F.coalesce(*values, F.lit(""))
    found["message"] = F.when(found["message"] == "", F.col("_line")).otherwise(found["message"])
    return assemble(step, source_type, **found).drop("_line", "_g1", "_g2", "_g3")


def parse_custom(df: DataFrame, source_type: str, patterns: dict[str, str]) -> DataFrame:
    """Group 1 of each configured regex; the message is the line."""
    line = sanitize(F.col("value"))
    allowed = ("timestamp", "username", "ip_address", "hostname", "service")
    found = {name: F.regexp_extract(line, to_java(p), 1) for name, p in patterns.items() if name in allowed and p}
    return assemble(df, source_type, message=line, **found)


def parse_unknown(df: DataFrame, source_type: str) -> DataFrame:
    return assemble(df, source_type, message=sanitize(F.col("value")))


def parse_source(df: DataFrame, config: SourceConfig, default_year: int | None = None) -> DataFrame:
    """Parse the non-empty lines of a source; unknown formats keep the line as message."""
    lines = df.where(F.col("value") != "")
    if config.transform is not None:
        lines = lines.transform(config.transform)
    if config.log_format == "syslog":
        rows = parse_syslog(lines, config.source_type, config.extended_user)
    elif config.log_format == "json":
        rows = parse_json(lines, config.source_type, config.json_fields, config.ip_regex)
    elif config.log_format == "structlog":
        rows = parse_structlog(lines, config.source_type, config.stamp_regex, config.pair_regex)
    elif config.log_format == "custom":
        rows = parse_custom(lines, config.source_type, config.patterns)
    else:
        rows = parse_unknown(lines, config.source_type)
    if default_year is not None:
        rows = rows.withColumn("ts", parse_timestamp(F.col("timestamp"), default_year))
    return rows


def filter_logs(df: DataFrame, name: str, value: str) -> DataFrame:
    """Rows whose log column equals ``value``."""
    if name not in LOG_FIELDS:
        raise ValueError(f"unknown log field {name!r}")
    return df.where(F.col(name) == value)


def json_to_kv(df: DataFrame, default_stamp: str = "") -> DataFrame:
    """Rewrite JSON lines as ``stamp key=value ...``; other lines pass unchanged.

    Keys come in order; a value with white space is quoted.  ``default_stamp``
    stands in where the object has no stamp.
    """
    line = F.col("value")
    already = line.rlike(r"[a-zA-Z0-9_]+=.*[a-zA-Z0-9_]+=")
    as_json = line.rlike(r"^\s*\{") & line.rlike(r"\}\s*$")
    step = df.withColumn("_map", F.when(~already & as_json, F.from_json(line, "map<string,string>")))
    stamp = reduce(
        lambda a, b: F.coalesce(a, b), [F.try_element_at("_map", F.lit(k)) for k in JSON_STAMP_KEYS]
    )
    parts = F.transform(
        F.array_sort(F.map_keys("_map")),
        lambda key: F.concat(
            key,
            F.lit("="),
            F.when(
                F.coalesce(F.element_at("_map", key), F.lit("null")).rlike(r"\s"),
                F.concat(F.lit('"'), F.element_at("_map", key), F.lit('"')),
            ).otherwise(F.coalesce(F.element_at("_map", key), F.lit("null"))),
        ),
    )
    text = F.concat(F.coalesce(stamp, F.lit(default_stamp)), F.lit(" "), F.array_join(parts, " "))
    return step.withColumn("value", F.when(F.col("_map").isNotNull(), text).otherwise(line)).drop("_map")
