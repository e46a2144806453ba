"""Cohort operators: caps, coverage checks, balanced samples, labels and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import hash_of, hash_rank, top_n_per_group


def cap_per_type(df: DataFrame, type_col: str, order_col: str, cap: int) -> DataFrame:
    """At most ``cap`` distinct rows per device type, in key order; null types are left out."""
    rows = df.filter(F.col(type_col).isNotNull()).distinct()
    tie = [F.col(order_col), *[F.col(c) for c in df.columns if c not in (order_col, type_col)]]
    return top_n_per_group(rows, [type_col], tie, cap, spread_on=df.columns)


def coverage(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys present on both sides (set intersection of single-column frames)."""
    return a.intersect(b)


def label_frame(cases: DataFrame, controls: DataFrame, case_key: str, control_key: str | None = None,
                key: str = "asset_id", label: str = "y_flag") -> DataFrame:
    """Distinct keys of both cohorts; case = 1, control = 0."""
    return (
        cases.select(F.col(case_key).alias(key)).distinct().withColumn(label, F.lit(1))
        .unionByName(
            controls.select(F.col(control_key or case_key).alias(key)).distinct().withColumn(label, F.lit(0))
        )
    )


def sample_exact(df: DataFrame, key: str, n: int | Column, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (or all, if fewer) without replacement, reproducible by key.

    ``n`` may be a scalar subquery, so nothing is counted on the driver.
    """
    return hash_rank(df, key, seed, "_rank").filter(F.col("_rank") <= n).drop("_rank")


def balance_down(cases: DataFrame, controls: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Cases plus as many sampled controls."""
    n_cases = cases.select(F.count(F.lit(1))).scalar()
    return cases.unionByName(sample_exact(controls, key, n_cases, seed))


def sample_up(df: DataFrame, key: str, n: int | Column, seed: int = 42) -> DataFrame:
    """``n`` rows by repeating rows evenly: every row ``n div size`` times, the first ones once more."""
    size = df.select(F.count(F.lit(1))).scalar()
    ranked = hash_rank(df, key, seed, "_rank").withColumn("_size", size).withColumn("_n", F.lit(n).cast("bigint"))
    copies = F.floor(F.col("_n") / F.col("_size")) + (F.col("_rank") <= F.col("_n") % F.col("_size")).cast("bigint")
    return (
        ranked.withColumn("_copies", copies).filter(F.col("_copies") > 0)
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies"))))
        .drop("_rank", "_size", "_n", "_copies")
    )


def split_exact(df: DataFrame, key: str, shares: Sequence[tuple[str, float]], seed: int = 42,
                out: str = "split") -> DataFrame:
    """Split of exact sizes: the first 60% of the hash order, the next 20%, and so on."""
    size = df.select(F.count(F.lit(1))).scalar()
    ranked = hash_rank(df, key, seed, "_rank").withColumn("_size", size)
    done, choice = 0.0, None
    for name, share in shares[:-1]:
        done += share
        inside = F.col("_rank") <= F.floor(F.col("_size") * F.lit(round(done, 10)))
        choice = choice.when(inside, name) if choice is not None else F.when(inside, name)
    return ranked.withColumn(out, choice.otherwise(shares[-1][0])).drop("_rank", "_size")


def split_by_hash(df: DataFrame, key: str, shares: Sequence[tuple[str, float]], seed: int = 42,
                  out: str = "split") -> DataFrame:
    """Split by hash value: no shuffle at all, sizes right only on average.

    A key keeps its split when rows are added, which the rank-based split does not promise.
    """
    point = F.conv(F.substring(hash_of(key, seed), 1, 8), 16, 10).cast("double") / F.lit(float(16 ** 8))
    done, choice = 0.0, None
    for name, share in shares[:-1]:
        done += share
        below = point < round(done, 10)
        choice = choice.when(below, name) if choice is not None else F.when(below, name)
    return df.withColumn(out, choice.otherwise(shares[-1][0]))


def fold_by_rank(df: DataFrame, key: str, k: int, seed: int = 42, out: str = "fold") -> DataFrame:
    """Contiguous folds 0..k-1 of (nearly) equal size over the hash order."""
    size = df.select(F.count(F.lit(1))).scalar()
    ranked = hash_rank(df, key, seed, "_rank").withColumn("_size", size)
    return ranked.withColumn(
        out, F.floor((F.col("_rank") - 1) * k / F.col("_size")).cast("int")
    ).drop("_rank", "_size")


def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Balanced weights ``n / (k * n_class)``; the class table has one row per class."""
    from .joins import attach_small

    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    classes = counts.agg(F.count(F.lit(1))).scalar()
    weights = counts.select(label, (total / (classes * F.col("_n"))).alias(out))
    return attach_small(df, weights, [label], "inner")
