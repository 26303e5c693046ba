"""Dates, zones, windows and delays as column expressions; no function reads the clock."""

from __future__ import annotations

from datetime import datetime, time, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_date(ts: Column, zone: str) -> Column:
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), ts))


def parsed_date(text: Column) -> Column:
    """struct(at, precision) of three shapes: date and time with a zone, without, date alone; else nulls."""
    shapes = (
        (r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2})?(Z|[+-]\d{2}:?\d{2})$", "instant", F.try_to_timestamp(text).cast("timestamp_ntz")),
        (r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2})?$", "local", F.try_to_timestamp(text).cast("timestamp_ntz")),
        (r"^\d{4}-\d{2}-\d{2}$", "day", F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("timestamp_ntz")),
    )
    at = F.coalesce(*[F.when(text.rlike(p), value) for p, _, value in shapes])
    kind = F.coalesce(*[F.when(text.rlike(p) & value.isNotNull(), name) for p, name, value in shapes])
    return F.struct(at.alias("at"), kind.alias("precision"))


def minute_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm")


def checked_end(start: Column, end: Column, all_day: Column) -> Column:
    """An end before its start is none; a whole day ends a day later."""
    return F.when(all_day, start + F.expr("interval 1 day")).when(end >= start, end)


def backoff_seconds(attempts: Column, base: int = 5, cap: int = 300) -> Column:
    """base x 2^(attempts - 1), the cap at most."""
    return F.least(F.lit(float(cap)), base * F.pow(F.lit(2.0), F.greatest(attempts - 1, F.lit(0)))).cast("int")


#: Errors that need a change of the catalogue, and errors that pass.
LASTING = r"(?i)direct_http_(?:401|403|404|410)\b|direct_off_domain_url|direct_response_too_large|invalid peer certificate|failed to lookup address information"
PASSING = r"(?i)direct_timeout|direct_http_(?:429|5\d\d)\b|error sending request"


def retry_minutes(error: Column, weekly: Column) -> Column:
    """Delay after a failure of a source, longer for sources that are read weekly: a day or a week, two hours or a day, else half an hour or six hours."""
    by_cadence = lambda other, week: F.when(F.coalesce(weekly, F.lit(False)), week * 60).otherwise(other)
    return F.when(error.rlike(LASTING), by_cadence(24 * 60, 7 * 24)).when(error.rlike(PASSING), by_cadence(2 * 60, 24)).otherwise(by_cadence(30, 6))


def week_number(day: Column) -> Column:
    return F.floor(F.unix_date(day) / 7)


def quick_range(name: str, asof: datetime) -> tuple[datetime, datetime]:
    """Start and end of the ranges that users pick by name.

    A night runs from 18:00 to 6:00, and until 6:00 it is still the last one. The weekend is that
    of the next Friday (today, if it is one) from 18:00 to Sunday 23:59.
    """
    day, one = datetime.combine(asof.date(), time()), timedelta(days=1)
    evening, morning = day + timedelta(hours=18), timedelta(hours=6)
    friday = evening + one * ((4 - day.weekday()) % 7)
    ranges = {
        "now": (asof, asof + timedelta(hours=2)),
        "today": (asof, day + one),
        "tonight": (evening - one if asof.hour < 6 else max(asof, evening), day + one + morning),
        "tomorrow": (day + one, day + 2 * one),
        "weekend": (friday, friday + 2 * one + timedelta(hours=5, minutes=59)),
        "week": (asof, asof + 7 * one),
        "month": (asof, asof + 30 * one),
        "year": (asof, asof + 365 * one),
    }
    if name not in ranges:
        raise ValueError(f"no range {name!r}")
    return ranges[name]
