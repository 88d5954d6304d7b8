"""Parsing and rule matching on hand-written lines."""

import re

import pytest
from pyspark.sql import functions as F

from tracehold.functions.regexes import literal_guard, to_java
from tracehold.functions.times import parse_timestamp
from tracehold.operators import detect as d
from tracehold.operators.parse import SourceConfig, json_to_kv, parse_source
from tracehold.schema import LOG_FIELDS
from tracehold.sources.logs import collect_all, parse_all, parse_app_log, read_alerts, read_normalized, source_status, with_rotated, write_alerts
from tracehold.sources.rules import Rule, bundled_rule_lines, bundled_rules, compile_rules, parse_rules, rule_file_metadata


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def one(spark, line, config=SourceConfig("syslog"), year=2024):
    (row,) = parse_source(lines(spark, line), config, year).collect()
    return row


def test_syslog_line(spark):
    row = one(spark, "May  2 10:15:30 server1 sshd[1234]: Failed password for user admin from 192.168.1.100 port 22 ssh2")
    assert (row.timestamp, row.hostname, row.service, row.process_id) == ("May  2 10:15:30", "server1", "sshd", "1234")
    assert (row.username, row.ip_address) == ("admin", "192.168.1.100")
    assert row.message == "Failed password for user admin from 192.168.1.100 port 22 ssh2"
    assert f"{row.ts:%Y-%m-%d %H:%M:%S}" == "2024-05-02 10:15:30"


def test_user_before_from(spark):
    row = one(spark, "May 20 10:15:30 h sshd[1]: Failed password for admin from 10.0.0.1", SourceConfig("a", extended_user=True))
    assert row.username == "admin"
    assert one(spark, "May 20 10:15:30 h sshd[1]: Failed password for admin from 10.0.0.1").username == ""


def test_malformed_lines_survive(spark):
    values = ["", "   ", "May 20 10:15:30 h ssh", "May 20 10:15:30 h sshd[", "a\x00b\x1fc", "x" * 10_000, "€ ☃ 😀", "This is not a valid syslog entry"]
    for kind in ("syslog", "json", "structlog", "custom", "other"):
        rows = parse_source(lines(spark, *values), SourceConfig("s", kind), 2024).collect()
        assert len(rows) == len(values) - 1
        assert all(getattr(r, f) is not None for r in rows for f in LOG_FIELDS)
    assert one(spark, "a\x00b\x1fc", SourceConfig("s", "other")).message == "abc"


def test_structlog_line(spark):
    row = one(spark, '2024-01-01T00:00:00.000Z user=bob level=warn msg="login failed" client_ip=10.0.0.1 pid=7', SourceConfig("s", "structlog"))
    assert (row.timestamp, row.username, row.log_level, row.message, row.ip_address, row.process_id) == (
        "2024-01-01T00:00:00.000Z", "bob", "warn", "login failed", "10.0.0.1", "7")
    assert f"{row.ts:%Y-%m-%d}" == "2024-01-01"


def test_json_line_and_fallback(spark):
    row = one(spark, '{"timestamp":"2023-01-01 08:15:00","level":"INFO","message":"hi 10.1.1.1","service":"api","user":"u"}', SourceConfig("j", "json"))
    assert (row.log_level, row.message, row.service, row.username, row.ip_address) == ("INFO", "hi 10.1.1.1", "api", "u", "10.1.1.1")
    assert one(spark, 'broken "username":"bob","message":"m"', SourceConfig("j", "json")).username == "bob"


def test_json_to_kv(spark):
    rows = json_to_kv(lines(spark, '{"b":"x y","ts":"T1","a":{"z":1}}', "a=1 b=2", "plain")).collect()
    assert [r.value for r in rows] == ['T1 a={"z":1} b="x y" ts=T1', "a=1 b=2", "plain"]


@pytest.mark.parametrize(
    "text,expected",
    [("May 20 10:15:30", "2023-05-20 10:15:30"), ("2023-01-01 08:15:00", "2023-01-01 08:15:00"), ("2024-01-01T00:00:00.250Z", "2024-01-01 00:00:00"), ("nonsense", None)],
)
def test_timestamps(spark, text, expected):
    ts = spark.range(1).select(parse_timestamp(F.lit(text), 2023)).first()[0]
    assert (f"{ts:%Y-%m-%d %H:%M:%S}" if ts else None) == expected


def logs(spark, *messages):
    rows = [(i, *([""] * 4), "root" if i else "admin", *([""] * 4), m) for i, m in enumerate(messages)]
    return spark.createDataFrame(rows, "event_id long, " + ", ".join(f"{c} string" for c in LOG_FIELDS))


def test_two_rules_two_rows(spark):
    rules = [Rule("TEST-001", "Failed SSH Login", "Failed password", "MEDIUM", (9,)), Rule("TEST-002", "Root Login Attempt", "root", "HIGH", (4, 9))]
    got = d.detect(logs(spark, "Failed password for admin", "Failed password for root"), rules)
    assert sorted((r.RULE_ID, r.event_id) for r in got.collect()) == [("TEST-001", 0), ("TEST-001", 1), ("TEST-002", 1)]
    literal = d.detect(logs(spark, "x", "y"), [Rule("R", "", "root", "LOW", (5,))], field_base=1)
    assert literal.count() == 1


def test_guard_changes_nothing_on_bundled_rules(spark):
    df = logs(spark, *[m for r in bundled_rules() for m in (r.pattern, r.pattern.replace("\\", "").replace(".*", " "), r.description)])
    pair = [sorted((r.RULE_ID, r.event_id) for r in d.detect(df, bundled_rules(), guard=g).collect()) for g in (True, False)]
    assert pair[0] == pair[1] and pair[0]


@pytest.mark.parametrize(
    "pattern,guard",
    [("Failed password", ["Failed password"]), ("abcd?e", ["abc"]), ("abc{0,3}", ["ab"]), ("(x|y)foo.*barbar", ["barbar"]), ("foo|b.r", ["foo", "b"]), ("(tar|7z)", ["tar", "7z"]), ("(a|bc)?", None), ("(a|.)", None), (r"x\(ab\)c", ["x(ab)c"]), (r"\.php|\.jsp", [".php", ".jsp"]), ("(?i)foo", None), ("[abc]def+g", ["def"])],
)
def test_literal_guard(pattern, guard):
    assert literal_guard(pattern) == guard


GUARD_CASES = [
    (r"\x90\x90", ["\x90\x90"]), (r"\x2fetc\u002fpasswd", ["/etc/passwd"]), (r"[^\]]abc", ["abc"]), (r"[[a]b]cde", None),
    (r"[]a]bc", None), (r"\Qa.b\E", None), (r"\p{L}abc", None), (r"ab+c", ["ab"]), (r"a(b|c)d", ["abd", "acd"]), (r"(ab){2}cd", ["ab"]),
    (r"x{0}abc", ["abc"]), (r"abc|", None), (r"a{2", None), (r"(abc", None), (r"abc)", None), (r"a\101", None), ("a[[:blank:]]bcd", ["bcd"]),
]


@pytest.mark.parametrize("pattern,guard", GUARD_CASES)
def test_literal_guard_reads_escapes(pattern, guard):
    assert literal_guard(to_java(pattern)) == guard


def test_guard_changes_nothing(spark):
    """Generated patterns over generated lines: the same alerts with the guard on and off."""
    import random

    from tracehold.operators.detect import detect

    draw = random.Random(11)
    atoms = ["a", "b", "ab", "/", r"\.", ".", r"\x61", r"\u0062", "[ab]", r"[^\]a]", r"\d", r"\s", "[[:blank:]]", "[[:punct:]]", "^", "$", "9", r"\/", r"\b"]

    def pattern(depth=0):
        parts = []
        for _ in range(draw.randint(1, 4)):
            atom = f"({pattern(depth + 1)})" if depth < 2 and draw.random() < 0.25 else draw.choice(atoms)
            parts.append(atom + (draw.choice(["", "", "", "?", "+", "{1,2}", "{0}", "*?"]) if atom[-1] not in "^$b" or atom in ("ab", "b") else ""))
        return "".join(parts) + ("|" + pattern(depth + 1) if draw.random() < 0.2 else "")

    rules = [Rule(f"G-{i}", "", pattern()) for i in range(150)]
    lines = spark.createDataFrame([(i, "".join(draw.choices("ab/. ]9\t", k=draw.randint(0, 9)))) for i in range(400)], "event_id long, message string")
    found = [{(r.RULE_ID, r.event_id) for r in detect(lines, rules, guard=g).collect()} for g in (True, False)]
    assert found[0] == found[1] and len(found[0]) > 1000


def test_all_posix_classes(spark):
    text = "".join(chr(c) for c in range(1, 127))
    want = {"alnum": 62, "alpha": 52, "blank": 2, "cntrl": 31, "digit": 10, "graph": 94, "lower": 26, "print": 95, "punct": 32, "space": 6, "upper": 26, "xdigit": 22}
    row = spark.range(1).select(*[F.length(F.regexp_replace(F.lit(text), to_java(f"[^[:{n}:]]"), "")).alias(n) for n in want]).first()
    assert row.asDict() == want


def test_stamps_of_many_forms(spark):
    cases = {
        "2024-01-01T00:00:00+02:00": "2023-12-31 22:00:00.000000", "2024-01-01T00:00:00.123456789Z": "2024-01-01 00:00:00.123456",
        "20/May/2023:10:15:30 +0000": "2023-05-20 10:15:30.000000", "20/May/2023:10:15:30 -0130": "2023-05-20 11:45:30.000000",
        "2024/02/03 04:05:06,7": "2024-02-03 04:05:06.700000", "2024-02-03 04:05:06 +0100": "2024-02-03 03:05:06.000000",
        "May  2 03:04:05": "2024-05-02 03:04:05.000000", "2024-02-03T04:05:06.1-03": "2024-02-03 07:05:06.100000",
        "2024-13-01 00:00:00": None, "yesterday": None, "": None, "2024-02-03": None,
    }
    rows = spark.createDataFrame([(c,) for c in cases], "t string")
    got = {r.t: r.ts for r in rows.select("t", F.date_format(parse_timestamp(F.col("t"), 2024), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts")).collect()}
    assert got == cases


def test_alerts_without_a_time_or_day(spark):
    from tracehold.operators.alerts import daily_report, response_candidates, suppress_duplicates, throttle_alerts

    rows = [("BF-SSH-1", "HIGH", "2024-01-01 00:00:00", "u", "1.1.1.1")] * 3 + [("BF-SSH-1", "HIGH", None, "u", "1.1.1.1"), ("XX-BF-SSH-9", None, None, "u", "2.2.2.2")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "event_id long, RULE_ID string, SEVERITY string, ts string, username string, ip_address string")
    df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    assert {r.event_id for r in suppress_duplicates(df).collect()} == {0, 3, 4}
    assert {r.event_id for r in throttle_alerts(df, 2).collect()} == {0, 1, 3, 4}
    assert [r.target for r in response_candidates(df, "BF-SSH-*", "block", threshold=1).collect()] == ["1.1.1.1"]
    report = {(r.day, r.severity, r.category): r.event_count for r in daily_report(df).collect()}
    assert report[("all", "all", "all")] == 5 and report[("none", "all", "all")] == 2 and report[("none", "none", "all")] == 1 and len(report) == 9


def test_missing_numbers_are_skipped(spark):
    from tracehold.operators.anomaly import fill_with_mean, mad_anomalies, zscore_anomalies

    values = [float(i % 3) for i in range(40)] + [100.0, float("nan"), None]
    df = spark.createDataFrame(list(enumerate(values)), "id long, x double")
    assert [r.id for r in zscore_anomalies(df, ["x"], "id").collect()] == [40]
    assert [r.id for r in mad_anomalies(df, ["x"], "id").collect()] == [40]
    filled = [r.x for r in fill_with_mean(df, ["x"]).orderBy("id").collect()]
    assert filled[41] == filled[42] == sum(values[:41]) / 41


@pytest.mark.parametrize("final", [1, 3, 50])
def test_quantiles_by_rounds(spark, final):
    import random

    import numpy as np

    from tracehold.operators.quantiles import exact_quantile

    draw = random.Random(3)
    for values in ([draw.gauss(0, 1) for _ in range(500)], [1.0] * 300 + [2.0] * 300, [draw.choice([0.0, 1e300, -1e300, 5.0]) for _ in range(200)], [float(i) for i in range(101)]):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        for q in (0.0, 0.25, 0.5, 1.0):
            assert exact_quantile(df, "x", q, final) == pytest.approx(float(np.quantile(values, q)))



def test_posix_classes(spark):
    assert to_java("/tmp/[^[:space:]]+") == r"/tmp/[^\s]+"
    assert d.detect(logs(spark, "run /tmp/space"), [Rule("R", "", "/tmp/[^[:space:]]+", "LOW", (9,))]).count() == 1


def test_rule_packs(spark):
    rules = bundled_rules()
    assert len(rules) == 110 and len({r.rule_file for r in rules}) == 9
    parsed = parse_rules(bundled_rule_lines(spark))
    assert sorted(compile_rules(parsed), key=lambda r: r.rule_id) == sorted(rules, key=lambda r: r.rule_id)
    with pytest.raises(ValueError):
        compile_rules(parsed, limit=10)
    meta = {r.rule_file: r for r in rule_file_metadata(bundled_rule_lines(spark)).collect()}
    assert meta["brute-force"].category == "Authentication" and meta["malware"].version == ""
    for rule in rules:
        re.compile(to_java(rule.pattern))


def test_files(spark, tmp_path):
    import bz2
    import gzip

    (tmp_path / "auth.log").write_text("May 20 10:00:00 h sshd[1]: a\nlast message repeated 3 times\n")
    (tmp_path / "auth.log.1").write_text("May 19 10:00:00 h sshd[1]: b\n")
    gzip.open(tmp_path / "auth.log.2.gz", "wt").write("May 18 10:00:00 h sshd[1]: c\n")
    bz2.open(tmp_path / "auth.log.3.bz2", "wt").write("May 17 10:00:00 h sshd[1]: d\n")
    (tmp_path / "other.log").write_text("x\n")
    config = SourceConfig("auth", paths=tuple(with_rotated(str(tmp_path / "auth.log"))), exclude_regex="(last message repeated [0-9]+ times)")
    off = SourceConfig("other", paths=(str(tmp_path / "other.log"),), enabled=False)
    gone = SourceConfig("gone", paths=(str(tmp_path / "gone*.log"),))
    assert collect_all(spark, [config, off, gone]).count() == 4
    assert {r.source_type: r.status for r in source_status(spark, [config, off, gone]).collect()} == {"auth": "ok", "other": "disabled", "gone": "failed"}
    rows = parse_all(spark, [config, off, gone], 2024).orderBy("ts").collect()
    assert [(r.message, f"{r.ts:%m%d}") for r in rows] == [("d", "0517"), ("c", "0518"), ("b", "0519"), ("a", "0520")]
    with pytest.raises(ValueError):
        collect_all(spark, [off])


def test_ragged_rows_and_alert_files(spark, tmp_path, sample_alerts):
    header = "\t".join(LOG_FIELDS)
    (tmp_path / "web.log").write_text(header + "\n" + "\t".join("abcdefghij") + "\n" + "\t".join("abcdefghi") + "\n")
    rows = read_normalized(spark, str(tmp_path / "web.log")).collect()
    assert [r.message for r in rows] == ["j", ""]
    alerts = sample_alerts.withColumns({c: F.lit("v") for c in ["DESCRIPTION", *LOG_FIELDS] if c not in sample_alerts.columns})
    for kind in ("tsv", "csv", "json"):
        path = str(tmp_path / f"alerts.{kind}")
        write_alerts(alerts.select("RULE_ID", "SEVERITY", "DESCRIPTION", *LOG_FIELDS), path)
        assert read_alerts(spark, path).count() == 8


def test_app_log(spark):
    rows = parse_app_log(
        lines(spark, "[2025-03-25 17:06:17] [ERROR] [core] [3017] Failed to load", "[2025-03-25 17:06:17.123] [AUDIT] [user=root] [action=start] [details=x [y]]", "junk")
    ).collect()
    assert [(r.level, r.component, r.user, r.message) for r in rows] == [("ERROR", "core", "", "Failed to load"), ("AUDIT", "", "root", "x [y]")]


def test_tabs_in_values(spark):
    from tracehold.operators.parse import assemble

    (row,) = assemble(lines(spark, "x"), "s", message=F.lit("a\tb")).collect()
    assert row.message == "a\\tb"


@pytest.mark.parametrize("chars", [2_000_000, 0])
def test_rule_tables_equal_compiled_rules(spark, chars):
    """Thousands of rules of all kinds, by the automaton and by substrings, give what the compiled plan gives."""
    from tracehold.operators.detect import detect
    from tracehold.operators.rule_tables import detect_table

    lines = [f"T-{i};d;203\\.0\\.{i % 256}\\.{i // 256};HIGH;6,9;" for i in range(6000)]
    lines += ["R-1;any digit;[0-9]$;LOW;9;", "R-2;short;ab;LOW;9;", "R-3;either;foo(bar|baz)+qux|x.z;LOW;;;", "R-4;not root;Failed password;LOW;9;;for root", "R-5;none;;LOW;9", "R-2;short;ab;LOW;9;"]
    rules = parse_rules(spark.createDataFrame([("f", x) for x in lines], "rule_file string, value string"))
    texts = ["203.0.7.3 seen", "1203.0.255.22", "Failed password for root", "Failed password for joe 7", "xx foobazqux", "ab", "", "x-z", None]
    logs = spark.createDataFrame([(i, t, "203.0.9.1" if i % 2 else "") for i, t in enumerate(texts)], "event_id long, message string, ip_address string")
    got = sorted((r.RULE_ID, r.event_id) for r in detect_table(logs, rules, shard_chars=chars).collect())
    few = [r for r in compile_rules(rules, limit=None) if not r.rule_id.startswith("T-") or r.pattern.endswith((".7\\.3", ".255\\.2", ".255\\.22", ".9\\.1", ".0\\.1"))]
    assert got == sorted((r.RULE_ID, r.event_id) for r in detect(logs, few).collect()) and len(got) >= 10
    assert detect_table(logs, rules, shard_chars=chars).columns == detect(logs, few).columns


def test_configured_regexes(spark):
    config = SourceConfig("j", "json", ip_regex=r"fe80::[[:xdigit:]:]+")
    assert one(spark, '{"message": "from fe80::1:2a to 10.0.0.1"}', config).ip_address == "fe80::1:2a"
    pairs = SourceConfig("p", "structlog", stamp_regex=r"^<([^>]+)>", pair_regex=r"(\w+):(?:'([^']*)'|([^ ]*))")
    row = one(spark, "<2024/02/03 04:05:06> user:bob user:'al ice' ip:1.2.3.4 msg:''", pairs)
    assert (row.timestamp, row.username, row.ip_address) == ("2024/02/03 04:05:06", "al ice", "1.2.3.4") and row.message.startswith("<2024")
    assert str(row.ts) == "2024-02-03 04:05:06"
    with pytest.raises(ValueError):
        one(spark, "x", SourceConfig("p", "structlog", pair_regex=r"(\w+)=x"))


def test_json_arrays(spark, tmp_path):
    from tracehold.sources.logs import load_table

    (tmp_path / "a.json").write_text('[{"RULE_ID": "A-B-1", "SEVERITY": "LOW"},\n {"RULE_ID": "A-B-2", "ip_address": "1.1.1.1"}]')
    assert [r.RULE_ID for r in read_alerts(spark, str(tmp_path / "a.json"), "json_array").orderBy("RULE_ID").collect()] == ["A-B-1", "A-B-2"]
    (tmp_path / "t.json").write_text('[{"timestamp": "2024-01-01T00:00:00.5+01:00", "n": 1}, {"timestamp": "never", "n": 2}]')
    rows = load_table(spark, str(tmp_path / "t.json"), "json_array").orderBy("n").collect()
    assert str(rows[0].timestamp) == "2023-12-31 23:00:00.500000" and rows[1].timestamp is None


@pytest.mark.parametrize("chars", [2_000_000, 40])
def test_mapping_in_shards(spark, chars):
    from tracehold.operators.mapping import map_rules_to_techniques

    rules = spark.createDataFrame([("R-1", "Brute force login", "password|login failure"), ("R-2", "tiny", "x")], "rule_id string, description string, pattern string")
    techniques = spark.createDataFrame([("T1", "Brute Force", "guess the password at login", ["a"]), ("T2", "login", None, ["b"]), ("T3", "other", "none", [])], "technique_id string, name string, description string, tactics array<string>")
    got = [(r.rule_id, r.technique_id, r.score, r["rank"]) for r in map_rules_to_techniques(rules, techniques, chars).collect()]
    assert got == [("R-1", "T1", 4, 1)]
    assert map_rules_to_techniques(rules.limit(0), techniques).count() == 0


def test_literals_in_texts_equal_contains(spark):
    import random

    from tracehold.operators.automaton import characters, literals_in

    rng = random.Random(5)
    words = ["".join(rng.choices("abé\U0001f600 ", k=rng.randrange(1, 5))) for _ in range(60)] + ["aa", "a", "", None, "a"]
    texts = ["".join(rng.choices("abé\U0001f600 ", k=rng.randrange(0, 30))) for _ in range(200)] + ["", None, "a" * 100_000]
    table = spark.createDataFrame([(w,) for w in words], "w string")
    assert characters(table, "w") >= sum(len(w) for w in words if w)
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {r.i: r.f for r in rows.withColumn("f", literals_in(F.col("t"), table, "w")).collect()}
    assert got == {i: sorted({w for w in words if w and w in (t or "")}) for i, t in enumerate(texts)}
    assert [r.f for r in rows.limit(3).withColumn("f", literals_in(F.col("t"), table.limit(0), "w")).collect()] == [[], [], []]


def test_rule_tables_need_no_unique_ids(spark):
    """Equal rows, rules with several literals in one line and columns of a user's own."""
    from tracehold.operators.detect import detect
    from tracehold.operators.rule_tables import detect_table

    rules = parse_rules(spark.createDataFrame([("f", x) for x in ["R-1;a;foo|foobar|barfoo;LOW;9;", "R-2;b;foobar;LOW;;", "R-2;b;foobar;LOW;;"]], "rule_file string, value string"))
    logs = spark.createDataFrame([(1, "foobarfoo", "x"), (1, "foobarfoo", "x"), (None, "barfoo", None), (2, "fo", "y")], "event_id long, message string, severity string")
    key = lambda df: sorted(map(str, df.collect()))
    got = detect_table(logs, rules)
    want = detect(logs, compile_rules(rules))
    assert key(got) == key(want) and got.columns == want.columns and got.count() == 7
    assert detect_table(logs, rules.limit(0)).count() == 0 and detect_table(logs.limit(0), rules).count() == 0
