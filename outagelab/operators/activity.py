"""Activity operators: two-level averages, month pivots, gap days, event frequency."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def two_level_avg(df: DataFrame, outer: Sequence[str], period: Sequence[str],
                  inner: Mapping[str, Column], names: Mapping[str, str] | None = None) -> DataFrame:
    """Aggregate per (outer, period), then average those totals per outer key.

    Both levels combine partially before their shuffle, so a key that owns many rows costs one
    row per period and task.
    """
    names = names or {}
    per_period = df.groupBy(*outer, *period).agg(*[c.alias(n) for n, c in inner.items()])
    return per_period.groupBy(*outer).agg(*[F.avg(n).alias(names.get(n, f"avg_{n}")) for n in inner])


def month_pivot(df: DataFrame, key: str, month: str, values: Mapping[str, Mapping[int, str]],
                fill: float | None = 0.0) -> DataFrame:
    """One row per key with a column per (measure, month); months are given, not discovered.

    ``values`` maps a measure column to ``{month: output name}``. Input has one row per
    (key, month), so each cell is a plain conditional sum in a single aggregate.
    """
    cells = []
    for measure, months in values.items():
        for number, name in months.items():
            cell = F.sum(F.when(F.col(month) == number, F.col(measure)))
            cells.append((F.coalesce(cell, F.lit(fill)) if fill is not None else cell).alias(name))
    return df.groupBy(key).agg(*cells)


def month_rows(df: DataFrame, month: str, values: Mapping[str, Mapping[int, str]],
               otherwise: float | None = 0.0) -> dict[str, Column]:
    """Sparse form of the same columns: a value in its own month, ``otherwise`` elsewhere."""
    out = {}
    for measure, months in values.items():
        for number, name in months.items():
            cell = F.when(F.col(month) == number, F.col(measure))
            out[name] = cell.otherwise(otherwise) if otherwise is not None else cell
    return out


def month_type_pivot(df: DataFrame, key: str, month: str, kind: str, value: str,
                     names: Mapping[tuple[int, str], str], fill: float | None = 0.0) -> DataFrame:
    """One row per key with a column per (month, type), for the given pairs only."""
    cells = []
    for (number, type_), name in names.items():
        cell = F.sum(F.when((F.col(month) == number) & (F.col(kind) == type_), F.col(value)))
        cells.append((F.coalesce(cell, F.lit(fill)) if fill is not None else cell).alias(name))
    return df.groupBy(key).agg(*cells)


def gap_days(df: DataFrame, key: str, export_day: Column, seen_day: Column) -> DataFrame:
    """Per key and month: days exported, days seen, and their difference."""
    days = df.select(F.col(key), export_day.alias("_e"), seen_day.alias("_s")).withColumn(
        "month", F.month("_e").cast("bigint")
    )
    return days.groupBy(key, "month").agg(
        F.count_distinct("_e").alias("export_days"), F.count_distinct("_s").alias("ntw_days"),
    ).withColumn("gap_days", F.col("export_days") - F.col("ntw_days"))


def event_frequency(df: DataFrame, key: str, start: str, amount: Column, times: str = "avg_times",
                    mean: str = "avg_days") -> DataFrame:
    """Distinct event starts per key and the mean of the positive amounts."""
    return df.withColumn("_amount", amount).groupBy(key).agg(
        F.count_distinct(F.col(start)).alias(times),
        F.avg(F.when(F.col("_amount") > 0, F.col("_amount"))).alias(mean),
    )


def any_flag(df: DataFrame, key: str, item: str, out: str) -> DataFrame:
    """1 for a key with at least one non-null item, else 0."""
    return df.groupBy(key).agg(F.max(F.col(item).isNotNull().cast("int")).alias(out))


def months_with_issues(df: DataFrame, key: str, month: Column, event_id: str) -> DataFrame:
    """Months in which a key had events, and the mean number of distinct events in those months."""
    monthly = df.groupBy(key, month.alias("_month")).agg(F.count_distinct(F.col(event_id)).alias("_n"))
    return monthly.groupBy(key).agg(
        F.count("_month").alias("months_withissues"), F.avg("_n").alias("avg_network_issues")
    )


def min_per_type(df: DataFrame, kind: Column, value: str, out: str, kind_name: str = "device_type") -> DataFrame:
    """Smallest positive value per type."""
    return df.filter(F.col(value) > 0).groupBy(kind.alias(kind_name)).agg(F.min(value).alias(out))
