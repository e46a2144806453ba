"""Profile tables: prevalence, drop lists, numeric profiles, label correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import percent
from .features import per_column, quoted, unpivot
from .ordering import exact_quantiles


def prevalence(df: DataFrame, flags: Sequence[str], key: str, split: str = "split",
               label: str = "y_flag", one_row_per_key: bool = False) -> DataFrame:
    """Devices with flag = 1 per variable, split and label, and their share within the split.

    One pass for all flags. Only set flags are unpivoted and the total is taken on the small
    result table. With ``one_row_per_key`` rows are counted directly, which needs no shuffle of
    the keys.
    """
    set_flags = unpivot(df, [key, split, label], flags, where=lambda v: v == 1)
    devices = F.count(F.lit(1)) if one_row_per_key else F.count_distinct(key)
    counts = set_flags.groupBy("variable", split, label).agg(devices.alias("devices"))
    whole = Window.partitionBy("variable", split)
    return counts.withColumn("total", F.sum("devices").over(whole)).withColumn(
        "pct", percent(F.col("devices"), F.col("total"))
    )


def prevalence_drop_list(table: DataFrame, split: str = "split", min_pct: float = 80.0,
                         max_devices: int = 200, train: str = "train", test: str = "test") -> DataFrame:
    """Variables nearly all in one class: rare ones on train, any on test."""
    heavy = F.col("pct") >= min_pct
    rule = ((F.col(split) == train) & heavy & (F.col("devices") < max_devices)) | (
        (F.col(split) == test) & heavy
    )
    return table.filter(rule).select("variable").distinct()


def numeric_profile(df: DataFrame, cols: Sequence[str], split: str = "split", label: str = "y_flag") -> DataFrame:
    """Mean, median, min and max of every column by label, one row per (variable, split).

    The median is exact and computed over slices, so no group is gathered in one task.
    """
    by = ["variable", split, label]
    stats = per_column(df, cols, {"mean": F.avg, "min": F.min, "max": F.max}, [split, label])
    long = unpivot(df, [split, label], cols)
    medians = exact_quantiles(long, "value", [0.5], by).select(*by, F.col("quantile").alias("median"))
    joined = stats.join(medians, by, "left")
    cells = [
        F.max(F.when(F.col(label) == flag, F.col(stat))).alias(f"{stat}_{flag}")
        for stat in ("mean", "median", "min", "max") for flag in (0, 1)
    ]
    return joined.groupBy("variable", split).agg(*cells)


def label_correlation(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """Pearson correlation of every column with the label, long form."""
    y = F.col(label).cast("double")
    return per_column(df, cols, {"corr": lambda c: F.corr(c, y)})


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Full Pearson matrix in long form, from one pass over feature vectors; no nulls allowed.

    Only the matrix itself, one number per pair of columns, leaves the executors.
    """
    alias = {c: f"_c{i}" for i, c in enumerate(cols)}
    rows = df.select(*[quoted(c).cast("double").alias(a) for c, a in alias.items()])
    vectors = VectorAssembler(inputCols=list(alias.values()), outputCol="v").transform(rows).select("v")
    matrix = Correlation.corr(vectors, "v").first()[0].toArray()
    cells = [(a, b, float(matrix[i][j])) for i, a in enumerate(cols) for j, b in enumerate(cols)]
    return df.sparkSession.createDataFrame(cells, "a STRING, b STRING, corr DOUBLE")


def null_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Number of nulls per column."""
    return per_column(df, cols, {"nulls": lambda c: F.count_if(c.isNull())})
