"""Behavioural baselines: tidy profile tables and comparisons against them.

A profile is two small tables.  ``profile_counts(kind, entity, bucket, n)`` has
the number of events per bucket; ``profile_stats(kind, entity, ...)`` the
statistics over the buckets.  Kinds: ``hourly``, ``dayofweek``,
``hour_dayofweek`` (entity empty), ``user_hours``, ``user_days`` and
``user_ips`` (entity = user).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracehold.functions.times import day_name
from tracehold.operators.quantiles import exact_quantile

# Z-score limits of the sensitivity names.
SENSITIVITY = {"low": 4.0, "medium": 3.0, "high": 2.5}

MIN_USER_EVENTS = 10


def time_buckets(ts: Column, hours_per_bin: int = 1, days_per_bin: int = 1) -> dict[str, Column]:
    """Hour and weekday buckets (Monday = 0), optionally coarser, and business hours."""
    hour, day = F.hour(ts), F.weekday(ts)
    return {
        "hour": F.floor(hour / hours_per_bin).cast("int"),
        "day": F.floor(day / days_per_bin).cast("int"),
        "business_hours": ((hour >= 9) & (hour <= 17) & (day < 5)).cast("int"),
    }


def _counted(events: DataFrame, kind: str, entity: Column, bucket: Column) -> DataFrame:
    return (
        events.groupBy(entity.alias("entity"), bucket.cast("string").alias("bucket"))
        .agg(F.count("*").alias("n"))
        .select(F.lit(kind).alias("kind"), "entity", "bucket", "n")
    )


def time_profile_counts(
    events: DataFrame, ts: str = "ts", hours_per_bin: int = 1, days_per_bin: int = 1, business_hours: bool = False
) -> DataFrame:
    """Hourly, weekday and weekday-by-hour counts, plus business hours on request.

    One pass: the events are grouped once by weekday and hour and the coarser
    counts are sums of that (at most 168 rows).
    """
    timed = events.where(F.col(ts).isNotNull())
    buckets = time_buckets(F.col(ts), hours_per_bin, days_per_bin)
    base = timed.groupBy(*[c.alias(n) for n, c in buckets.items()]).agg(F.count("*").alias("n"))
    kinds = [("hourly", F.col("hour")), ("dayofweek", F.col("day"))]
    if business_hours:
        kinds.append(("business_hours", F.col("business_hours")))
    both = F.concat_ws(" ", F.col("day"), F.col("hour"))
    kinds.append(("hour_dayofweek", both))
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), b.cast("string").alias("bucket")) for k, b in kinds]))
    flat = base.select(rows.alias("r"), "n").select("r.kind", F.lit("").alias("entity"), "r.bucket", "n")
    sums = flat.groupBy("kind", "entity", "bucket").agg(F.sum("n").alias("n"))
    return sums


def user_profile_counts(events: DataFrame, ts: str = "ts", user: str = "username", ip: str = "ip_address") -> DataFrame:
    """Per user with at least ten events: counts by hour, weekday and source address.

    The events are grouped once by (user, hour, day, address); the rest works on
    those counts.
    """
    base = (
        events.where(F.col(user).isNotNull() & (F.col(user) != "") & F.col(ts).isNotNull())
        .groupBy(F.col(user).alias("entity"), F.hour(ts).alias("hour"), F.weekday(ts).alias("day"), F.col(ip).alias("ip"))
        .agg(F.count("*").alias("n"))
    )
    kinds = F.explode(
        F.array(
            F.struct(F.lit("user_hours").alias("kind"), F.col("hour").cast("string").alias("bucket")),
            F.struct(F.lit("user_days").alias("kind"), F.col("day").cast("string").alias("bucket")),
            F.struct(F.lit("user_ips").alias("kind"), F.col("ip").alias("bucket")),
            F.struct(F.lit("user_total").alias("kind"), F.lit("").alias("bucket")),
        )
    )
    flat = base.select(kinds.alias("r"), "entity", "n").select("r.kind", "entity", "r.bucket", "n")
    counts = flat.where("bucket is not null").groupBy("kind", "entity", "bucket").agg(F.sum("n").alias("n"))
    eligible = counts.where((F.col("kind") == "user_total") & (F.col("n") >= MIN_USER_EVENTS)).select("entity")
    return counts.join(eligible, "entity", "left_semi").select("kind", "entity", "bucket", "n")


def profile_stats(counts: DataFrame) -> DataFrame:
    """Statistics over the buckets of each profile.

    Sample deviation, except for ``hour_dayofweek``: there every observed day is
    crossed with every observed hour, missing cells count zero, and the
    deviation is that of the population.
    """
    simple = (
        counts.where(~F.col("kind").isin("hour_dayofweek", "user_ips", "user_total"))
        .groupBy("kind", "entity")
        .agg(
            F.avg("n").alias("mean"),
            F.stddev_samp("n").alias("std"),
            F.min("n").alias("min"),
            F.max("n").alias("max"),
        )
    )
    part = F.split("bucket", " ")
    cells = counts.where("kind = 'hour_dayofweek'").select(
        "kind", "entity", F.get(part, F.lit(0)).alias("day"), F.get(part, F.lit(1)).alias("hour"), "n"
    )
    grid = F.count_distinct("day") * F.count_distinct("hour")
    sums = cells.groupBy("kind", "entity").agg(
        grid.alias("cells"),
        F.avg("n").alias("m"),
        F.var_pop("n").alias("v"),
        F.count("*").alias("filled"),
        F.min("n").alias("lo"),
        F.max("n").alias("max"),
    )
    # Empty cells pull the mean down and add their distance to the spread.
    share = F.col("filled") / F.col("cells")
    matrix = sums.select(
        "kind",
        "entity",
        (F.col("m") * share).alias("mean"),
        F.sqrt(share * F.col("v") + share * (1 - share) * F.col("m") * F.col("m")).alias("std"),
        F.when(F.col("filled") < F.col("cells"), 0).otherwise(F.col("lo")).cast("long").alias("min"),
        "max",
    )
    return simple.unionByName(matrix).withColumns(
        {"low": F.col("mean") - 2 * F.col("std"), "high": F.col("mean") + 2 * F.col("std")}
    )


def merge_profiles(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Fold new counts into stored ones."""
    return stored.unionByName(new).groupBy("kind", "entity", "bucket").agg(F.sum("n").alias("n"))


def _over_limit(new: DataFrame, known: DataFrame, stats: DataFrame, kind: str) -> DataFrame:
    """New counts of buckets the profile knows, with the profile's limits."""
    of = F.col("kind") == kind
    seen = known.where(of).select("entity", "bucket")
    limits = stats.where(of).select("entity", "high", "max")
    return new.where(of).join(seen, ["entity", "bucket"], "left_semi").join(limits, "entity").where("n > high")


def detect_time_anomalies(new: DataFrame, known: DataFrame, stats: DataFrame) -> DataFrame:
    """Hours and weekdays busier than the profile's upper limit."""
    found = []
    for kind in ("hourly", "dayofweek"):
        rows = _over_limit(new, known, stats, kind)
        bucket = F.col("bucket").cast("int")
        found.append(
            rows.select(
                F.lit(f"{kind}_activity").alias("type"),
                bucket.alias("bucket"),
                (day_name(bucket) if kind == "dayofweek" else F.lit(None).cast("string")).alias("day_name"),
                F.col("n").alias("event_count"),
                F.col("high").alias("expected_max"),
                F.when(F.col("n") < F.col("max") * 2, "MEDIUM").otherwise("HIGH").alias("severity"),
            )
        )
    return found[0].unionByName(found[1])


def detect_user_hour_anomalies(new: DataFrame, known: DataFrame, stats: DataFrame) -> DataFrame:
    """Hours in which a known user is busier than the user's own limit.

    The user must be known, not the hour; a missing or zero limit is skipped.
    """
    limits = stats.where("kind = 'user_hours' and high <> 0").select("entity", "high")
    rows = new.where("kind = 'user_hours'").join(limits, "entity").where("n > high")
    return rows.select(
        F.lit("user_hourly_activity").alias("type"),
        F.col("entity").alias("username"),
        F.col("bucket").cast("int").alias("hour"),
        F.col("n").alias("event_count"),
        F.col("high").alias("expected_max"),
        F.lit("MEDIUM").alias("severity"),
    )


def user_hour_counts(events: DataFrame, ts: str = "ts", user: str = "username") -> DataFrame:
    """Counts by user and hour of new data, every user included."""
    named = events.where(F.col(user).isNotNull() & (F.col(user) != "") & F.col(ts).isNotNull())
    return _counted(named, "user_hours", F.col(user), F.hour(ts))


def detect_unknown_ips(events: DataFrame, known: DataFrame, user: str = "username", ip: str = "ip_address") -> DataFrame:
    """Addresses a known user has not used before, with the user's five most frequent known ones."""
    pairs = (
        events.where(F.col(ip).isNotNull() & (F.col(ip) != ""))
        .groupBy(F.col(user).alias("entity"), F.col(ip).alias("bucket"))
        .agg(F.count("*").alias("event_count"))
    )
    users = known.where("kind = 'user_total'").select("entity")
    addresses = known.where("kind = 'user_ips'").select("entity", "bucket", "n")
    unknown = pairs.join(users, "entity", "left_semi").join(addresses, ["entity", "bucket"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("n"), "bucket"))
    listed = (
        addresses.where("bucket <> ''")
        .withColumn("_rank", rank)
        .where("_rank <= 5")
        .groupBy("entity")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "bucket"))), lambda x: x["bucket"]).alias("known_ips"))
    )
    return unknown.join(listed, "entity", "left").select(
        F.lit("user_unknown_ip").alias("type"),
        F.col("entity").alias("username"),
        F.col("bucket").alias("ip_address"),
        "event_count",
        "known_ips",
        F.lit("HIGH").alias("severity"),
    )


def detect_baseline_z(
    new: DataFrame,
    known: DataFrame,
    stats: DataFrame,
    sensitivity: str = "medium",
    adaptive: bool = True,
    min_confidence: float = 0.8,
    max_fp_rate: float = 0.05,
) -> DataFrame:
    """Buckets whose new count is too many deviations from the profile's mean.

    ``confidence`` is n / (n + 10) of the bucket's events in the profile.  With
    ``adaptive`` the limit is raised to the (1 - max_fp_rate) quantile of all
    scores when that is higher.
    """
    if sensitivity not in SENSITIVITY:
        raise ValueError(f"unknown sensitivity {sensitivity!r}")
    seen = known.select("kind", "entity", "bucket", F.col("n").alias("known_n"))
    scored = (
        new.join(seen, ["kind", "entity", "bucket"])
        .join(stats.select("kind", "entity", "mean", "std"), ["kind", "entity"])
        .where("std > 0")
        .withColumn("z_score", F.abs(F.col("n") - F.col("mean")) / F.col("std"))
        .withColumn("confidence", F.col("known_n") / (F.col("known_n") + 10))
    )
    limit = SENSITIVITY[sensitivity]
    if adaptive:
        cut = exact_quantile(scored, "z_score", 1 - max_fp_rate)
        limit = max(limit, cut) if cut is not None else limit
    keep = (F.col("z_score") > limit) & (F.col("confidence") >= min_confidence)
    return scored.where(keep).select(
        "kind", "entity", "bucket", F.col("n").alias("event_count"), "mean", "std", "z_score", "confidence"
    )


def anomaly_breakdown(anomalies: DataFrame) -> DataFrame:
    """Number of anomalies per severity."""
    return anomalies.groupBy("severity").agg(F.count("*").alias("event_count"))


def save_profile(counts: DataFrame, path: str) -> None:
    counts.write.mode("overwrite").parquet(path)


def load_profile(spark, path: str) -> DataFrame:
    return spark.read.schema("kind string, entity string, bucket string, n long").parquet(path)
