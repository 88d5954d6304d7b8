"""Not-modified revisits of web archives: the response each of them stands for.

Records are ordered by canonical URL and time.  A revisit takes the latest earlier full
response of its URL, if its validators agree with it, and the response's headers with
those of its own that a not-modified answer may change.

The order comes from one range partitioning, which cuts a hot URL like any other.  Inside a
partition the latest response is carried along; between partitions only the last response
of URLs that go on in a later one, at most one row for each partition and URL cut.

Cases: a null or empty URL has no earlier response; a null time comes before all others; of
records at one time responses come first, then the order of ids decides; null headers are
none; repeated records each get a result; only full responses (status 200) are resolved to;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tracehold.session import stage

# Headers that a not-modified answer does not change, and tracking parameters.
KEPT_HEADERS = (
    "connection content-encoding content-length content-location content-md5 content-range content-type keep-alive proxy-authenticate "
    "proxy-connection te trailer transfer-encoding upgrade"
).split()
TRACKING = "^(utm_[a-z]+|fbclid|gclid|sessionid|phpsessid)(=|$)"


def canonical_url(url: str) -> Column:
    """Without scheme, ``www.``, default port, fragment and tracking parameters; parameters sorted, no last slash."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(F.col(url)), "(?s)#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    host = F.lower(F.regexp_extract(rest, "^[^/?]*", 0))
    host = F.regexp_replace(F.regexp_replace(host, r"^www[0-9]*\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&")
    query = F.array_join(F.array_sort(F.filter(query, lambda p: (p != "") & ~F.lower(p).rlike(TRACKING))), "&")
    return F.concat(host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def merged_headers(base: Column, update: Column) -> Column:
    """``base`` with the permitted entries of ``update``; names in lower case."""
    allowed = F.map_filter(update, lambda k, v: ~k.isin(KEPT_HEADERS) & v.isNotNull())
    rest = F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(allowed), k))
    return F.map_concat(rest, allowed)


def _plain(headers: Column) -> Column:
    """Lower-case names, the last of equal ones; null is no header."""
    return _last_of_each(F.coalesce(F.map_entries(headers), F.array().cast("array<struct<key:string,value:string>>")))


def _last_of_each(entries: Column) -> Column:
    """A map of (key, value) structs in which the last of equal lower-case keys counts."""
    names = F.transform(entries, lambda e: F.lower(e["key"]))
    placed = F.transform(entries, lambda e, i: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"), i.alias("i")))
    last = F.filter(placed, lambda e: ~F.array_contains(F.slice(names, e["i"] + 2, F.greatest(F.size(names), F.lit(1))), e["key"]))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"])))


def _header_map(block: Column) -> Column:
    """``name: value`` lines as a map; other lines are passed over."""
    lines = F.filter(F.split(block, "\r?\n"), lambda x: x.rlike("^[^:\\s]+:"))
    return _last_of_each(
        F.transform(lines, lambda x: F.struct(F.substring_index(x, ":", 1).alias("key"), F.trim(x.substr(F.instr(x, ":") + 1, F.length(x))).alias("value")))
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files, plain or gzip, in the shape :func:`resolve_revisits` takes, with ``date`` and ``body``.

    A file is cut at version lines behind an empty line, so plain files are split among tasks.  Bodies are
    read as text.  Records without a type are passed over; ``at`` is null where the
    date does not parse.
    """
    raw = spark.read.text(path, lineSep="\r\n\r\nWARC/1.").where(F.trim("value") != "")
    # Behind the version's last digit: the record's headers, then the HTTP headers, then the body.
    parts = F.split(F.regexp_replace("value", r"^(WARC/1\.)?[0-9]\r?\n", ""), "\r?\n\r?\n", 3)
    rows = raw.select(_header_map(F.get(parts, F.lit(0))).alias("w"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("http"), F.get(parts, F.lit(2)).alias("body"))
    return rows.where(F.col("w")["warc-type"].isNotNull()).select(
        F.col("w")["warc-record-id"].alias("record_id"),
        F.regexp_replace(F.col("w")["warc-target-uri"], "^<|>$", "").alias("url"),
        F.unix_micros(F.col("w")["warc-date"].try_cast("timestamp")).alias("at"),
        F.col("w")["warc-type"].alias("kind"),
        F.regexp_extract("http", r"^HTTP/\S+ ([0-9]{3})", 1).try_cast("int").alias("status"),
        F.col("w")["warc-payload-digest"].alias("digest"),
        _header_map(F.col("http")).alias("headers"),
        F.col("w")["warc-date"].alias("date"),
        F.regexp_replace("body", r"(\r?\n){2}$", "").alias("body"),
    )


def _tag(headers: Column) -> Column:
    return F.regexp_replace(headers["etag"], "^W/", "")


def resolve_revisits(
    records: DataFrame,
    record_id: str = "record_id",
    url: str = "url",
    at: str = "at",
    kind: str = "kind",
    status: str = "status",
    digest: str = "digest",
    headers: str = "headers",
) -> DataFrame:
    """One row per revisit: ``record_id``, ``canonical_url``, ``response_id``, ``outcome``, ``headers``.

    ``kind`` is ``response`` or ``revisit``.  ``outcome``: ``resolved``; ``changed``, a validator
    differs; ``unverified``, no validator on both sides; ``missing``, no earlier full response.
    ETags are compared weakly, else Last-Modified, else payload digests.  ``response_id`` and
    ``headers`` are null where nothing was resolved.
    """
    rows = records.select(
        canonical_url(url).alias("u"),
        F.col(at).alias("at"),
        F.when(F.col(kind) == "response", 0).otherwise(1).alias("later"),
        F.col(record_id).alias("id"),
        ((F.col(kind) == "response") & (F.col(status) == 200)).alias("full"),
        (F.col(kind) == "revisit").alias("revisit"),
        F.col(digest).alias("digest"),
        _plain(F.col(headers)).alias("headers"),
    ).where("full or revisit")
    order = ["u", "at", "later", "id"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stage(rows.withColumn("part", F.spark_partition_id()), "records")
    response = F.when(F.col("full") & (F.col("u") != ""), F.struct("id", "digest", "headers"))
    inside = Window.partitionBy("part", "u").orderBy("at", "later", "id").rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumn("own", F.last(response, ignorenulls=True).over(inside)).where("revisit")
    # What a partition hands on: the last response of each URL that a later one goes on with.
    spans = rows.groupBy("u").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("u")
    last = rows.join(spans, "u").groupBy("u", "part").agg(F.max_by(response, F.when(response.isNotNull(), F.struct("at", "later", "id"))).alias("last"))
    before = F.last("last", ignorenulls=True).over(Window.partitionBy("u").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    carried = last.select("u", "part", before.alias("carried"))
    found = seen.join(carried, ["u", "part"], "left").withColumn("r", F.coalesce("own", "carried"))

    base, mine = F.col("r.headers"), F.col("headers")
    same = F.coalesce(_tag(mine) == _tag(base), mine["last-modified"] == base["last-modified"], F.col("digest") == F.col("r.digest"))
    outcome = F.when(F.col("r").isNull(), "missing").when(same.isNull(), "unverified").when(same, "resolved").otherwise("changed")
    out = found.select(F.col("id").alias("record_id"), F.col("u").alias("canonical_url"), "r", outcome.alias("outcome"), mine.alias("mine"))
    done = F.col("outcome") == "resolved"
    return out.select(
        "record_id",
        "canonical_url",
        F.when(done, F.col("r.id")).alias("response_id"),
        "outcome",
        F.when(done, merged_headers(F.col("r.headers"), F.col("mine"))).alias("headers"),
    )


def captures_of(pages: DataFrame) -> DataFrame:
    """Archive records of the ``pages`` table: a response of each page, and a later, or in one case of seven earlier, revisit.

    The revisit writes the URL its own way and holds the page's ETag, a weak one, a stale one,
    none but the date, or none at all, by the URL's md5.
    """
    n = F.conv(F.substring(F.md5(F.coalesce("url", F.lit("")).cast("binary")), 1, 4), 16, 10).cast("int")
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit("")).cast("binary")), F.lit('"'))
    changed = F.concat(F.lit("day "), (F.col("page_id") % 365).cast("string"))
    length = F.length(F.coalesce("html", F.lit(""))).cast("string")
    case = n % 5

    def headers(**values) -> Column:
        pairs = [x for k, v in values.items() for x in (F.lit(k.replace("_", "-")), v if isinstance(v, Column) else F.lit(v))]
        return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())

    first = pages.select(
        (2 * F.col("page_id")).alias("record_id"),
        "url",
        (F.col("page_id") * 60).alias("at"),
        F.lit("response").alias("kind"),
        F.lit(200).alias("status"),
        F.md5(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"),
        headers(Content_Type="text/html", Content_Length=length, ETag=tag, Last_Modified=changed, Server="archive").alias("headers"),
    )
    own_tag = F.when(case == 0, tag).when(case == 1, F.concat(F.lit("W/"), tag)).when(case == 2, F.lit('"stale"'))
    again = pages.select(
        (2 * F.col("page_id") + 1).alias("record_id"),
        F.when(n % 2 == 0, F.concat("url", F.lit("#again"))).otherwise(F.col("url")).alias("url"),
        (F.col("page_id") * 60 + F.when(n % 7 == 0, -30).otherwise(86_400)).alias("at"),
        F.lit("revisit").alias("kind"),
        F.lit(304).alias("status"),
        F.lit(None).cast("string").alias("digest"),
        headers(Date=F.col("page_id").cast("string"), ETag=own_tag, Last_Modified=F.when(case == 3, changed), Content_Length="0").alias("headers"),
    )
    return first.union(again)
