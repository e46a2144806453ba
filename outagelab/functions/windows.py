"""Time-window helpers for epoch and date columns."""

from __future__ import annotations

from datetime import date, datetime
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F


def zone_bounds(first: str, last: str, zone: str = "UTC") -> tuple[int, int]:
    """Epoch seconds of local midnight of both days in ``zone``."""
    def at(day: str) -> int:
        return int(datetime.fromisoformat(day).replace(tzinfo=ZoneInfo(zone)).timestamp())
    return at(first), at(last)


def epoch_range(seconds: Column, first: str, last: str, zone: str = "UTC") -> Column:
    """Half-open ``[first, last)`` test on epoch seconds with day bounds read in ``zone``.

    Both bounds are plain integer literals, so the test reaches the parquet scan.
    """
    lo, hi = zone_bounds(first, last, zone)
    return (seconds >= F.lit(lo)) & (seconds < F.lit(hi))


def ms_to_s(ms: Column) -> Column:
    return F.floor(ms / 1000)


def epoch_range_ms(ms: Column, first: str, last: str, zone: str = "UTC") -> Column:
    """Same as :func:`epoch_range` on a raw millisecond column (keeps the filter pushable)."""
    lo, hi = zone_bounds(first, last, zone)
    return (ms >= F.lit(lo * 1000)) & (ms < F.lit(hi * 1000))


def epoch_day(seconds: Column) -> Column:
    """UTC calendar day of epoch seconds, independent of the session zone."""
    return F.date_from_unix_date(F.floor(seconds / 86400).cast("int"))


def case_date_filter(c: Column, first: str, last: str, end_inclusive_day: bool = True) -> Column:
    """Window test on a date or timestamp column.

    With ``end_inclusive_day=False`` a timestamp after midnight of the last day is outside,
    as a plain ``<= date`` comparison of a timestamp would have it.
    """
    lo = F.lit(date.fromisoformat(first))
    hi = F.lit(date.fromisoformat(last))
    if end_inclusive_day:
        return (c >= lo) & (c < F.date_add(hi, 1))
    return (c >= lo) & (c <= hi)
