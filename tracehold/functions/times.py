"""Timestamps: parsing the log formats and calendar columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Monday first, as weekday() numbers them.
DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def parse_timestamp(text: Column, default_year: int) -> Column:
    """Null where no known form fits; stamps without a year get ``default_year``.

    Forms: ``May 20 10:15:30``, ``20/May/2023:10:15:30 +0000``, and dates written
    ``2023-05-20`` or ``2023/05/20`` with a time behind ``T`` or a space, up to nine
    digits of a second and an offset.  Microseconds are kept, further digits cut off;
    a stamp without an offset is in the session's zone.
    """
    squeezed = F.regexp_replace(F.trim(text), r"\s+", " ")
    with_year = F.concat(F.lit(f"{default_year} "), squeezed)
    plain = F.regexp_replace(squeezed, r"^([0-9]{4})/([0-9]{2})/([0-9]{2})", "$1-$2-$3")
    plain = F.regexp_replace(plain, r"(:[0-9]{2})[.,]([0-9]{1,6})[0-9]*", "$1.$2")
    plain = F.regexp_replace(plain, r"(:[0-9]{2}(?:\.[0-9]+)?) ?([+-][0-9]{2}):?([0-9]{2})?$", "$1$2:$3")
    plain = F.regexp_replace(plain, r"([+-][0-9]{2}):$", "$1:00")
    iso = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})? ?(Z|[+-][0-9]{2}:[0-9]{2})?$"
    # The shape picks the one form to try: a failed attempt costs an exception.
    return (
        F.when(squeezed.rlike("^[A-Za-z]"), F.try_to_timestamp(with_year, F.lit("yyyy MMM d HH:mm:ss")))
        .when(squeezed.rlike("^[0-9]{1,2}/[A-Za-z]{3}/[0-9]{4}:"), F.try_to_timestamp(squeezed, F.lit("d/MMM/yyyy:HH:mm:ss[ Z]")))
        .when(plain.rlike(iso), plain.try_cast("timestamp"))
    )


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch: exact arithmetic on gaps."""
    return F.unix_micros(F.col(ts) if isinstance(ts, str) else ts)


def seconds_between(later: Column | str, earlier: Column | str) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(1_000_000.0)


def day_name(weekday: Column) -> Column:
    return F.element_at(F.array(*[F.lit(d) for d in DAY_NAMES]), weekday + 1)
