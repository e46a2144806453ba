"""Power-off duration expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Divisor for each reading of the duration column.
SECONDS_PER_DAY = 86400
MINUTES_PER_DAY = 1440


def first_integer(text: Column) -> Column:
    """First run of digits as an integer; null when there is none or it overflows."""
    return F.regexp_substr(text, F.lit("[0-9]+")).try_cast("int")


def whole_days(amount: Column, unit: str = "seconds") -> Column:
    """Whole days in a duration. The default reads the column as seconds, as the study did."""
    divisor = MINUTES_PER_DAY if unit == "minutes" else SECONDS_PER_DAY
    return (amount / F.lit(divisor)).cast("int")


def reconcile_days(from_amount: Column, from_text: Column) -> Column:
    """Prefer the measured days, fall back to the message; null if they contradict."""
    return (
        F.when(from_amount.isNull(), from_text)
        .when(from_amount >= from_text, from_amount)
        .when(from_amount == 0, F.lit(0))
    )
