"""Dates and clocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_sunday(d: Column | str) -> Column:
    """First Sunday on or after a date."""
    return F.next_day(F.date_sub(_col(d), 1), "SUN")


def is_us_dst(d: Column | str) -> Column:
    """Whether a date lies in US daylight saving time: from the second Sunday of March to before the first of November, in any year."""
    d, year = _col(d), F.year(_col(d))
    return (d >= first_sunday(F.make_date(year, F.lit(3), F.lit(8)))) & (d < first_sunday(F.make_date(year, F.lit(11), F.lit(1))))


def to_new_york(ts: Column | str, tz: str | None = None) -> Column:
    """UTC to New York wall-clock time without a zone.

    By the rule above, tested on the date in winter time; or by the time-zone database if tz names a zone. The two differ
    only around the hour of a change on its Sunday, and before 2007.
    """
    ts = _col(ts)
    if tz:
        return F.from_utc_timestamp(ts, tz).cast("timestamp_ntz")
    winter = ts - F.expr("INTERVAL 5 HOURS")
    return F.when(is_us_dst(F.to_date(winter)), ts - F.expr("INTERVAL 4 HOURS")).otherwise(winter).cast("timestamp_ntz")


def minute_of_day(ts: Column | str) -> Column:
    return (F.hour(_col(ts)) * 60 + F.minute(_col(ts))).cast("int")


def bucket(ts: Column | str, minutes: int) -> Column:
    """Beginning of the bucket of so many minutes that a time lies in."""
    return F.window(_col(ts), f"{minutes} minutes")["start"].cast("timestamp_ntz")


def minute_of_text(text: Column | str) -> Column:
    """'HH:MM' as minute of day."""
    parts = F.split(_col(text), ":")
    return (F.get(parts, F.lit(0)).cast("int") * 60 + F.get(parts, F.lit(1)).cast("int")).cast("int")


def month_key(d: Column | str) -> Column:
    return F.date_format(_col(d), "yyyy-MM")


def from_day_number(n: Column | str) -> Column:
    """Date of a day number counted from 2000-01-01."""
    return F.date_add(F.lit("2000-01-01").cast("date"), _col(n))
