"""Calendar-date parsing of post timestamps without going through the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two accepted wire formats of ``createdAt``.
#   'Sat Dec 21 10:39:33 +0000 2024'  (weekday month day time offset year)
#   '2024-12-21T10:39:33Z' / '2021-03-05T01:30:00+03:00' / '2021-03-05' (ISO-8601)
RFC_PATTERN = r"^[A-Za-z]{3} [A-Za-z]{3} [0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2} [+-][0-9]{4} [0-9]{4}$"
ISO_PATTERN = (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
               r"([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?)?(Z|[+-][0-9]{2}(:?[0-9]{2})?)?$")


def parse_created_at(c: Column) -> Column:
    """Wall-clock date of the post in its own offset (not UTC); null when neither format parses."""
    s = F.trim(c)
    rfc = F.when(s.rlike(RFC_PATTERN),
                 F.try_to_date(F.concat(F.substring(s, 5, 6), F.lit(" "), F.substring(s, -4, 4)),
                               "MMM dd yyyy"))
    iso = F.when(s.rlike(ISO_PATTERN), F.try_to_date(F.substring(s, 1, 10), "yyyy-MM-dd"))
    return F.coalesce(rfc, iso)


def parse_bound(value: str | None):
    """Parse a ``YYYY-MM-DD`` bound on the driver; abort on a malformed value (fail fast)."""
    import datetime as _dt
    if value is None or value == "":
        return None
    return _dt.datetime.strptime(value, "%Y-%m-%d").date()


def in_date_range(d: Column, since: str | None = None, until: str | None = None) -> Column:
    """Half-open ``since <= d < until``; either bound optional."""
    s, u = parse_bound(since), parse_bound(until)
    cond = d.isNotNull()
    if s is not None:
        cond = cond & (d >= F.lit(s))
    if u is not None:
        cond = cond & (d < F.lit(u))
    return cond


def filter_dates_with_quarantine(df, created_col: str = "createdAt", since: str | None = None,
                                 until: str | None = None):
    """Split a post table into rows inside ``[since, until)`` and rows whose date does not parse.

    Returns ``(kept, quarantine)``; out-of-range rows are in neither (they are filtered, not bad).
    """
    d = df.withColumn("created_date", parse_created_at(F.col(created_col)))
    kept = d.where(in_date_range(F.col("created_date"), since, until))
    quarantine = d.where(F.col("created_date").isNull())
    return kept, quarantine
