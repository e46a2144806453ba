"""Ratios that are safe under ANSI arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def rate(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def percent(part: Column, whole: Column) -> Column:
    return rate(part, whole) * 100


def rounded(c: Column, places: int = 6) -> Column:
    """Round and turn negative zero into zero."""
    return F.round(c, places) + F.lit(0.0)


def importance_share(weight: Column, *within: str) -> Column:
    """``|w|`` as a share of 100 over a table with one row per model feature."""
    return percent(F.abs(weight), F.sum(F.abs(weight)).over(Window.partitionBy(*within)))
