"""Profile tables of the prepared data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.profiles import numeric_profile, prevalence, prevalence_drop_list
from .prepare import Wide


def category_profile(splits: Wide) -> DataFrame:
    """Prevalence of every flag on train and test."""
    rows = splits.df.filter(F.col("split").isin("train", "test"))
    return prevalence(rows, splits.flags, splits.key, one_row_per_key=True)


def flags_to_drop(profile: DataFrame, min_pct: float = 80.0, max_devices: int = 200) -> DataFrame:
    return prevalence_drop_list(profile, min_pct=min_pct, max_devices=max_devices)


def numeric_table(splits: Wide, raw: Wide) -> DataFrame:
    """Numeric profile on values before normalisation, for the rows of the sample."""
    rows = splits.df.filter(F.col("split").isin("train", "test")).select(splits.key, "split", splits.label)
    values = raw.df.select(raw.key, *raw.numerics)
    return numeric_profile(rows.join(values, raw.key, "left"), raw.numerics)
