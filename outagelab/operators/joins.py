"""Join operators: interval and as-of lookups, cohort set joins, star assembly."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import last_before, month_slice, previous_value


def semi_join_keys(df: DataFrame, key: str, keys: DataFrame, keys_col: str | None = None) -> DataFrame:
    """``key in (select ...)``. Null keys never match."""
    right = keys.select(F.col(keys_col or key).alias(key)).filter(F.col(key).isNotNull()).distinct()
    return df.join(right, key, "left_semi")


def anti_join_keys(df: DataFrame, key: str, keys: DataFrame, keys_col: str | None = None,
                   fold_case: bool = False) -> DataFrame:
    """``key not in (select ...)`` over the non-null keys of the other side.

    A raw NOT IN returns nothing as soon as the list holds a null, and runs only as a broadcast
    of the whole list. Rows whose own key is null stay out, as in SQL.
    """
    fold = F.upper if fold_case else (lambda c: c)
    right = (
        keys.select(fold(F.col(keys_col or key)).alias("_excluded"))
        .filter(F.col("_excluded").isNotNull()).distinct()
    )
    left = df.filter(F.col(key).isNotNull())
    return left.join(right, fold(left[key]) == right["_excluded"], "left_anti")


def next_day_folded_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                         left_day: str, right_day: str) -> DataFrame:
    """Left join on a case-folded key where the right row lies one day after the left row.

    Both conditions are equalities of expressions, so the join hashes or sorts on them.
    """
    return left.join(
        right,
        (F.upper(left[left_key]) == F.upper(right[right_key]))
        & (F.to_date(left[left_day]) == F.date_sub(F.to_date(right[right_day]), 1)),
        "left",
    )


def case_intervals(cases: DataFrame, keys: Sequence[str], opened: str, closed: str,
                   order: Sequence[str] | None = None, default_days: int = 7,
                   slice_of=month_slice) -> DataFrame:
    """Add ``start_date`` and ``end_date``: from the previous close to this open.

    Without a previous close the interval starts ``default_days`` before the open.
    """
    order = list(order or [opened, closed])
    with_prev = previous_value(cases, keys, order, closed, "_prev_closed", slice_of(opened))
    fallback = F.col(opened) - F.expr(f"INTERVAL {int(default_days)} DAYS")
    return (
        with_prev
        .withColumn("start_date", F.coalesce(F.col("_prev_closed"), fallback))
        .withColumn("end_date", F.col(opened))
        .drop("_prev_closed")
    )


def interval_join(left: DataFrame, right: DataFrame, key: str, start: str, end: str, time: str,
                  slice_days: int = 30, how: str = "left") -> DataFrame:
    """All right rows with the same key and ``start <= time <= end``.

    The interval is laid out over fixed slices and joined on (key, slice): a hot key meets only
    the rows of its own slice. Time columns are dates or timestamps.
    """
    epoch = F.lit("1970-01-01").cast("date")

    def slice_no(c: Column) -> Column:
        return F.floor(F.datediff(F.to_date(c), epoch) / F.lit(slice_days))

    spread = left.filter(F.col(start) <= F.col(end)).withColumn(
        "_slice", F.explode(F.sequence(slice_no(F.col(start)), slice_no(F.col(end))))
    )
    matched = spread.join(
        right.withColumn("_slice", slice_no(F.col(time))), [key, "_slice"]
    ).filter(F.col(time).between(F.col(start), F.col(end))).drop("_slice")
    if how == "inner":
        return matched
    found = matched.select(
        F.col(key).alias("_k"), F.col(start).alias("_s"), F.col(end).alias("_e")
    ).distinct()
    missing = left.join(
        found,
        (left[key] == found["_k"]) & (left[start] == found["_s"]) & (left[end] == found["_e"]),
        "left_anti",
    )
    return matched.unionByName(missing, allowMissingColumns=True)


def latest_in_interval(cases: DataFrame, history: DataFrame, keys: Sequence[str], start: str, end: str,
                       time: str, payload: Sequence[str], slice_of=month_slice) -> DataFrame:
    """Left join each interval with its latest history row in ``[start, end]``.

    The latest row not after ``end`` is the answer if it is not before ``start``; that turns the
    interval join into an as-of join. The answer depends on key and end alone, so only their distinct
    pairs are looked up (at most one per key and moment, however many cases share them) and the answers
    are joined back, which adaptive execution can split. History of keys without a case is dropped
    before its shuffle. Cases with a null key have no history and stay out of the lookup.
    """
    keys = list(keys)
    wanted = cases.select(*keys, end).where(" and ".join(f"`{c}` is not null" for c in [*keys, end])).distinct()
    history = history.join(wanted.select(*keys).distinct(), keys, "left_semi")
    found = last_before(wanted, history, keys, end, time, payload, "_snap", slice_of)
    inside = F.col(f"_snap.`{time}`") >= F.col(start)
    return cases.join(found, [*keys, end], "left").select(
        *cases.columns,
        *[F.when(inside, F.col(f"_snap.`{c}`")).alias(c) for c in [time, *payload]],
    )


def latest_per_key(df: DataFrame, keys: Sequence[str], time: str, payload: Sequence[str]) -> DataFrame:
    """Latest row per key as an aggregate: partial results are combined before the shuffle."""
    best = F.max(F.struct(F.col(time), *[F.col(c) for c in payload])).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*")


def attach_small(df: DataFrame, small: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join a low-cardinality aggregate or dimension; its size at run time decides the form of the join."""
    return df.join(small, list(on), how)


def cast_key_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                  how: str = "inner") -> DataFrame:
    """Equi join of keys stored with different types: both sides are compared as text."""
    return left.join(
        right, left[left_key].cast("string") == right[right_key].cast("string"), how
    )


def assert_unique(df: DataFrame, key: str, name: str) -> DataFrame:
    """Raise at run time if a key occurs twice; the check rides on the job that uses the frame."""
    guarded = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"), *[F.first(f"`{c}`").alias(c) for c in df.columns if c != key]
    )
    message = F.lit(f"{name}: more than one row for a {key}")
    return guarded.filter(F.when(F.col("_n") == 1, True).otherwise(F.raise_error(message).cast("boolean"))).drop("_n")


def star_join(anchor: DataFrame, blocks: Sequence[DataFrame], key: str) -> DataFrame:
    """Left join one-row-per-key blocks onto the anchor."""
    return reduce(lambda acc, block: acc.join(block, key, "left"), blocks, anchor)
