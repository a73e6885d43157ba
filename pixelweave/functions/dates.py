"""Dates and times as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

YEAR_DAYS = 365.25


def days_since_1900(d: Column) -> Column:
    return F.datediff(d, F.lit("1900-01-01").cast("date"))


def years_since(d: Column, reference: Column) -> Column:
    return F.datediff(d, reference) / YEAR_DAYS


def decimal_year(d: Column) -> Column:
    return F.year(d) + (F.dayofyear(d) - 1) / YEAR_DAYS


def parse_datetime(s: Column) -> Column:
    """A date, or a date and time with or without microseconds; null for other texts."""
    return F.coalesce(
        F.try_to_timestamp(s, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS")),
        F.try_to_timestamp(s, F.lit("yyyy-MM-dd'T'HH:mm:ss")),
        F.try_to_timestamp(s, F.lit("yyyy-MM-dd")),
        F.try_to_timestamp(s, F.lit("yyyyMMdd")),
    )


def format_datetime(t: Column, pattern: str = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") -> Column:
    return F.date_format(t, pattern)


def seconds_of_day(t: Column) -> Column:
    return F.hour(t) * 3600 + F.minute(t) * 60 + F.extract(F.lit("SECOND"), t).cast("double")


def hours_of_day(t: Column) -> Column:
    return seconds_of_day(t) / 3600.0


def day_of_year(t: Column) -> Column:
    """With the fraction of the day."""
    return F.dayofyear(t) + seconds_of_day(t) / 86400.0


def linspace(start: Column, stop: Column, n: int) -> Column:
    """An array of n times, both ends among them."""
    a, b = F.unix_micros(start), F.unix_micros(stop)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.timestamp_micros((a + (b - a) * i / max(n - 1, 1)).cast("long")))
