"""URL filtering: fixed host rules first, then association rules mined from labels.

``FPGrowth`` finds the combinations of URL tokens that often go with a bad label; rules
with fewer than ``ROWS`` bad rows, at every size of the table, or below the least confidence
or lift are pruned.  Tokens of too few bad rows are in no such rule and go before.  Different token sets are matched, not
rows: each rule is filed under its rarest token, a set looks up the rules of its tokens
and a rule holds when the set has all of its tokens.  Tokens leave numbers out, so there
are far fewer sets than rows.

Cases: null urls and those without ``://`` have an empty host, path and token set and
are allowed; a null id has no label; repeated rows each get a result; of several labels of
one id any bad one counts; without labels no rule is mined; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from tracehold.operators.skew import join_unique
from tracehold.session import stage

#: Least number of bad rows, least share of the labelled rows (none), least confidence, least gain over the share of bad rows.
ROWS, SUPPORT, CONFIDENCE, LIFT = 20, 0.0, 0.5, 1.5
BAD = "label=bad"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str | Column) -> tuple[Column, Column]:
    """The host, A-Z lowered, and the path of a url; both empty without ``://``."""
    u = F.col(url) if isinstance(url, str) else url
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, CAPITALS, SMALL), path


def fixed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest of (``host/path``, verdict) rules that fits, and its verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, decision in sorted(rules, key=lambda r: len(r[0])):  # a longer rule is put over the shorter ones
        domain, _, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, decision).otherwise(verdict)
    return name, verdict


def url_tokens(url: str) -> Column:
    """Distinct tokens: the host, its words, path segments, file endings and query names; no numbers."""
    host, path = host_and_path(url)
    after = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"\?([^#]*)", 1)

    def named(kind: str, parts: Column) -> Column:
        plain = F.filter(parts, lambda p: (p != "") & ~p.rlike("^[0-9]+$"))
        return F.transform(plain, lambda p: F.concat(F.lit(kind + ":"), p))

    ending = F.regexp_extract(path, r"\.([A-Za-z]+)$", 1)
    segments = F.transform(F.split(path, "/"), lambda s: F.regexp_replace(s, r"\.[A-Za-z]+$", ""))
    names = F.transform(F.split(after, "&"), lambda p: F.regexp_extract(p, "^[^=]*", 0))
    words = F.split(host, r"[.-]")
    parts = [named("host", F.array(host)), named("word", words), named("path", segments), named("end", F.array(ending)), named("query", names)]
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def mine_rules(transactions: DataFrame, support: float, confidence: float, lift: float) -> DataFrame:
    """(rule, tokens, key, confidence, support) of rules ``tokens -> bad``; ``key`` is the rarest token.

    ``transactions`` has ``tokens`` (array) and ``bad`` (boolean).
    """
    marked = stage(transactions.select(F.monotonically_increasing_id().alias("row"), "tokens", "bad"), "labelled")
    each = marked.select("row", "bad", F.explode("tokens").alias("token"))
    often = each.where("bad").groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= ROWS).select("token")
    left = join_unique(each, often, ["token"], F.col("row")).groupBy("row").agg(F.collect_set("token").alias("left"))
    tokens = F.coalesce("left", F.array().cast("array<string>"))
    items = F.when(F.col("bad"), F.array_append(tokens, F.lit(BAD))).otherwise(tokens)
    rows = stage(marked.select("row", "bad").join(left, "row", "left").select(items.alias("items")), "transactions")
    empty = rows.sparkSession.createDataFrame([], "rule long, tokens array<string>, key string, confidence double, support double")
    n = rows.count()
    if n < ROWS:
        return empty
    model = FPGrowth(itemsCol="items", minSupport=max(support, ROWS / n), minConfidence=confidence).fit(rows)
    found = stage(model.associationRules, "rules").where((F.col("consequent") == F.array(F.lit(BAD))) & (F.col("lift") >= lift))
    counts = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    found = found.select(F.monotonically_increasing_id().alias("rule"), F.col("antecedent").alias("tokens"), "confidence", "support")
    rarest = found.select("rule", F.explode("tokens").alias("token")).join(counts, "token").groupBy("rule").agg(F.min(F.struct("freq", "token"))["token"].alias("key"))
    return stage(found.join(rarest, "rule").select("rule", "tokens", "key", "confidence", "support"), "rules")


def match_rules(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, mined_rule, confidence): the surest rule that holds for each token set with one."""
    named = rules.select(F.col("tokens").alias("needed"), "key", "confidence")
    asked = sets.select("tokens", F.explode("tokens").alias("key")).join(named, "key")
    hit = asked.where(F.size(F.array_except("needed", "tokens")) == 0)
    best = hit.groupBy("tokens").agg(F.max(F.struct("confidence", F.array_join(F.array_sort("needed"), " ").alias("name"))).alias("best"))
    return best.select("tokens", F.col("best.name").alias("mined_rule"), F.col("best.confidence").alias("confidence"))


def judge_urls(
    pages: DataFrame,
    labels: DataFrame,
    rules: Sequence[tuple[str, str]],
    bad: Column,
    page_id: str = "page_id",
    url: str = "url",
    label_id: str = "doc_id",
    support: float = SUPPORT,
    confidence: float = CONFIDENCE,
    lift: float = LIFT,
) -> DataFrame:
    """One row per page: ``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``mined_rule``, ``confidence``.

    A fixed rule decides; else a mined rule blocks; else the url is allowed.  ``bad`` is a
    condition on ``labels``.
    """
    host, path = host_and_path("url")
    work = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    work = work.select("page_id", host.alias("host"), path.alias("path"), url_tokens("url").alias("tokens"))
    marked = labels.where(F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("page_id")).agg(F.max(F.coalesce(bad, F.lit(False))).alias("bad"))
    mined = mine_rules(work.join(marked, "page_id").where(F.size("tokens") > 0), support, confidence, lift)
    blocked = match_rules(work.select("tokens").where(F.size("tokens") > 0).distinct(), mined)
    name, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    out = work.join(blocked, "tokens", "left")
    mined_verdict = F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")
    return out.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, mined_verdict).alias("verdict"), "mined_rule", "confidence")
