"""Positions and running totals within groups of any size, over one sorted table.

The table is sorted into ranges of (group, order) and written; a row number that grows through the ranges comes along. A
group may lie in one range or span many: counts and sums per (range, group) carry over from range to range, so no task
ever holds a group, only its range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.sinks import stage

ROW, RANGE, SHIFT = "__row", "__range", "__shift"
RANGE_BITS = 33     # monotonically_increasing_id keeps the number of the partition above these bits


def in_order(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``df`` stored in order of (group, order), nulls first, with ``__row`` growing along it. ``df`` is read twice."""
    keys = [*group, *order]
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return stage(rows.withColumn(ROW, F.monotonically_increasing_id()), name)


def _carried(rows: DataFrame, group: Sequence[str], totals: dict[str, Column]) -> DataFrame:
    """Per (range, group): the totals of the group in earlier ranges (``before_``) and in all of them (``all_``)."""
    spans = rows.groupBy(F.shiftright(ROW, RANGE_BITS).alias(RANGE), *group).agg(
        F.min(ROW).alias(SHIFT), *[v.alias(f"sum_{k}") for k, v in totals.items()])
    earlier = W.partitionBy(*group).orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*group)
    return spans.select(RANGE, *group, SHIFT, *[
        c for k in totals for c in (F.coalesce(F.sum(f"sum_{k}").over(earlier), F.lit(0)).alias(f"before_{k}"),
                                    F.sum(f"sum_{k}").over(whole).alias(f"all_{k}"))])


def positions(rows: DataFrame, group: Sequence[str], pos: str = "pos", size: str = "size") -> DataFrame:
    """Rows of :func:`in_order` with their place in the group, from 0, and the rows of the group. Groups are not null."""
    spans = _carried(rows, group, {"n": F.count(F.lit(1))})
    found = rows.withColumn(RANGE, F.shiftright(ROW, RANGE_BITS)).join(spans, [RANGE, *group])
    return found.withColumns({pos: F.col(ROW) - F.col(SHIFT) + F.col("before_n"), size: F.col("all_n")}).drop(
        RANGE, SHIFT, ROW, "before_n", "all_n")


def running(rows: DataFrame, group: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Rows of :func:`in_order` with every column of ``sums`` replaced by its running total within the group."""
    spans = _carried(rows, group, {c: F.sum(c) for c in sums})
    here = W.partitionBy(RANGE, *group).orderBy(ROW).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = rows.withColumn(RANGE, F.shiftright(ROW, RANGE_BITS)).withColumns({c: F.sum(c).over(here) for c in sums})
    found = local.join(spans, [RANGE, *group]).withColumns({c: F.col(c) + F.col(f"before_{c}") for c in sums})
    return found.drop(RANGE, SHIFT, ROW, *[f"{p}_{c}" for p in ("before", "all") for c in sums])
