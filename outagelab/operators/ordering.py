"""Ordered computations that do not put one group, or one order, into a single task.

A window over a key sends every row of that key to one task. The operators here cut the order
into slices, work inside each slice, and carry one summary row per slice across. The result is
exact; only the summary rows of a key (one per slice) ever meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Parts a global order is cut into, at quantiles and then evenly; each part is sorted by one task.
SLICES = 64
SUBSLICES = 16


def day_slice(t: str) -> Column:
    return F.to_date(F.col(t))


def month_slice(t: str) -> Column:
    return F.trunc(F.col(t), "month")


def previous_value(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str,
                   out: str, slice_of: Column) -> DataFrame:
    """``lag(value) over (partition by keys order by order)``, sliced.

    ``slice_of`` must be non-decreasing in the order (for example the month of a date).
    """
    order_struct = F.struct(*order)
    sliced = df.withColumn("_slice", slice_of)
    in_slice = Window.partitionBy(*keys, "_slice").orderBy(*order)
    wrapped = F.struct(F.col(value).alias("v"))
    marked = sliced.withColumn("_prev", F.lag(wrapped).over(in_slice))
    tails = sliced.groupBy(*keys, "_slice").agg(F.max_by(wrapped, order_struct).alias("_tail"))
    across = Window.partitionBy(*keys).orderBy("_slice")
    carry = tails.select(*keys, "_slice", F.lag("_tail").over(across).alias("_carry"))
    return (
        marked.join(carry, [*keys, "_slice"], "left")
        .withColumn(out, F.coalesce("_prev", "_carry")["v"])
        .drop("_slice", "_prev", "_carry")
    )


def last_before(points: DataFrame, history: DataFrame, keys: Sequence[str], at: str, time: str,
                payload: Sequence[str], out: str, slice_of=month_slice, reduce: bool | None = None) -> DataFrame:
    """Attach to every point the latest history row with ``time <= at`` (an as-of join).

    Both sides are merged into one ordered stream per key, so no pair of rows is ever formed.
    Of rows that share key and time the greatest payload counts. ``out`` is a struct of time and
    payload, null when there is no earlier row.

    ``reduce`` first keeps one row per key and time; partial results are combined before the
    shuffle, so a key with many rows per day shrinks to its days. It is the default for dates. For
    timestamps, where nothing would shrink, it would only add a shuffle.
    """
    if reduce is None:
        reduce = history.schema[time].dataType.simpleString() == "date"
    snap = F.struct(F.col(time), *[F.col(c) for c in payload])
    rows = history.filter(F.col(time).isNotNull()).withColumn("_t", F.col(time))
    if reduce:
        rows = rows.groupBy(*keys, "_t").agg(F.max(snap).alias("_snap"))
    else:
        rows = rows.select(*keys, "_t", snap.alias("_snap"))
    moment, snap_type = rows.schema["_t"].dataType, rows.schema["_snap"].dataType
    asked = points.select(
        *keys, F.col(at).cast(moment).alias("_t"), F.lit(None).cast(snap_type).alias("_snap"),
        F.struct(*points.columns).alias("_point"),
    )
    stream = rows.withColumn("_point", F.lit(None).cast(asked.schema["_point"].dataType)).unionByName(asked)
    running = (
        Window.partitionBy(*keys, "_slice").orderBy("_t", F.col("_snap").isNull(), "_snap")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    seen = stream.withColumn("_slice", slice_of("_t")).withColumn(
        "_seen", F.last("_snap", ignorenulls=True).over(running))
    if reduce:
        # From the reduced history, so that both uses share one scan and one shuffle of it.
        ends = rows.select(*keys, slice_of("_t").alias("_slice"), "_snap").unionByName(
            asked.select(*keys, slice_of("_t").alias("_slice")), allowMissingColumns=True)
        tails = ends.groupBy(*keys, "_slice").agg(F.max("_snap").alias("_tail"))
    else:
        # Counting the points keeps all columns, and with them the one shuffle of the stream.
        tails = seen.groupBy(*keys, "_slice").agg(F.max("_seen").alias("_tail"), F.count("_point").alias("_n"))
    earlier = (
        Window.partitionBy(*keys).orderBy("_slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = tails.withColumn("_carry", F.last("_tail", ignorenulls=True).over(earlier))
    if not reduce:
        carry = carry.filter(F.col("_n") > 0)
    return (
        seen.filter(F.col("_point").isNotNull())
        .join(carry.select(*keys, "_slice", "_carry"), [*keys, "_slice"], "left")
        .select("_point.*", F.coalesce("_seen", "_carry").alias(out))
    )


def top_n_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
                    spread_on: Sequence[str], spread: int = 64, rank_name: str = "rn") -> DataFrame:
    """Exact first ``n`` rows of each group; a group is ranked in ``spread`` parts first.

    Few large groups (a handful of device types) would otherwise be sorted by a handful of
    tasks. At most ``spread * n`` rows of a group reach the final ranking.
    """
    salt = F.pmod(F.xxhash64(*spread_on), F.lit(spread))
    part = Window.partitionBy(*keys, "_salt").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_salt", salt)
        .withColumn("_part_rn", F.row_number().over(part))
        .filter(F.col("_part_rn") <= n)
        .drop("_salt", "_part_rn")
        .withColumn(rank_name, F.row_number().over(final))
        .filter(F.col(rank_name) <= n)
        .withColumn(rank_name, F.col(rank_name).cast("bigint"))
    )


def hash_of(key: str, seed: int) -> Column:
    """Stable hash text of a key: the same on every engine and for every partitioning."""
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))


def hash_rank(df: DataFrame, key: str, seed: int, out: str, within: Sequence[str] = ()) -> DataFrame:
    """Rank 1..n of unique keys in hash order, globally or within a few groups.

    Rows are ranked inside 4,096 hash slices; the slice sizes give each slice its offset.
    """
    hashed = df.withColumn("_hash", hash_of(key, seed)).withColumn("_slice", F.substring("_hash", 1, 3))
    sizes = hashed.groupBy(*within, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*within).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *within, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    local = Window.partitionBy(*within, "_slice").orderBy("_hash", key)
    return (
        hashed.withColumn("_local", F.row_number().over(local))
        .join(offsets, [*within, "_slice"])
        .withColumn(out, F.col("_offset") + F.col("_local"))
        .drop("_hash", "_slice", "_offset", "_local")
    )


def value_slices(counts: DataFrame, value: str, sums: Sequence[str], group: Sequence[str],
                 slices: int) -> DataFrame:
    """Give each distinct value its slice number, and each row its group totals ``<name>_all``.

    Cut points and totals come from one aggregate with one row per group. Between two cut points
    the range is divided evenly into ``SUBSLICES`` more slices, which keeps the array of cuts that
    travels with a row short.
    """
    steps = (slices - 1).bit_length()
    slices = 1 << steps
    # As text: one literal array instead of many column objects.
    probabilities = ", ".join(f"{i / slices!r}D" for i in range(1, slices))
    cuts = F.expr(f"percentile_approx(`{value}`, array({probabilities}), {max(10_000, 10 * slices)})")
    per_group = counts.groupBy(*group).agg(cuts.alias("_cuts"), *[F.sum(s).alias(f"{s}_all") for s in sums])
    if group:
        joined = counts.join(per_group, list(group))
    else:
        whole = per_group.select(F.struct("*")).scalar()
        joined = counts.withColumn("_whole", whole).select(
            *counts.columns, *[f"_whole.{c}" for c in per_group.columns]
        )
    # Number of cuts below the value by binary search, one projection per step: unlike a
    # higher-order function over the array this is compiled.
    joined = joined.withColumn("_block", F.lit(0))
    for step in (1 << i for i in reversed(range(steps))):
        joined = joined.withColumn(
            "_block", F.expr(f"_block + if(get(_cuts, _block + {step - 1}) < `{value}`, {step}, 0)"))
    lo, hi = F.get("_cuts", F.col("_block") - 1), F.get("_cuts", F.col("_block"))
    width = hi - lo
    finite = (width > 0) & (width < F.lit(float("inf")))
    sub = F.when(finite, F.least(F.floor((F.col(value) - lo) / width * SUBSLICES), F.lit(SUBSLICES - 1))).otherwise(0)
    return joined.withColumn("_slice", F.col("_block") * SUBSLICES + sub).drop("_cuts", "_block")


def running_totals(counts: DataFrame, value: str, sums: Sequence[str], group: Sequence[str] = (),
                   descending: bool = False, slices: int = SLICES) -> DataFrame:
    """Inclusive running totals ``<name>_to`` and totals ``<name>_all`` in value order.

    ``counts`` is pre-aggregated: one row per (group, value). The cut points need not be exact:
    they decide only which task does the work, never the result.
    """
    sliced = value_slices(counts, value, sums, group, slices)
    sort = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    totals = sliced.groupBy(*group, "_slice").agg(*[F.sum(s).alias(s) for s in sums])
    before = Window.partitionBy(*group).orderBy(sort("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *group, "_slice", *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"_{s}_off") for s in sums]
    )
    local = Window.partitionBy(*group, "_slice").orderBy(sort(value)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    out = sliced.withColumns({f"{s}_to": F.sum(s).over(local) for s in sums}).join(
        offsets, [*group, "_slice"]
    )
    return out.withColumns({f"{s}_to": F.col(f"{s}_to") + F.col(f"_{s}_off") for s in sums}).drop(
        "_slice", *[f"_{s}_off" for s in sums]
    )


def exact_quantiles(df: DataFrame, value: str, probabilities: Sequence[float],
                    group: Sequence[str] = (), slices: int = SLICES) -> DataFrame:
    """Exact linearly interpolated quantiles, one row per (group, probability).

    The built-in exact ``percentile`` gathers all values of a group in one task. Here values are
    counted first, cumulated in slices, and only the two order statistics next to each
    probability are kept.
    """
    group = list(group)
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*group, F.col(value).cast("double").alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
    )
    ranked = running_totals(counts, "_x", ["_c"], group, slices=slices)

    def holds(r: Column) -> Column:
        return (r >= F.col("_c_to") - F.col("_c")) & (r < F.col("_c_to"))

    def wanted(p: Column) -> Column:
        place = p * (F.col("_c_all") - 1)
        return holds(F.floor(place)) | holds(F.ceil(place))

    # Only the probabilities whose order statistics a value holds become rows.
    asked = F.filter(F.array(*[F.lit(float(p)) for p in probabilities]), wanted)
    want = ranked.select(
        *group, "_x", "_c", "_c_to", "_c_all", F.explode(asked).alias("probability"),
    ).withColumn("_pos", F.col("probability") * (F.col("_c_all") - 1))
    lo, hi = F.floor("_pos"), F.ceil("_pos")
    picked = want.groupBy(*group, "probability").agg(
        F.max("_pos").alias("_pos"),
        F.max(F.when(holds(lo), F.col("_x"))).alias("_lo"),
        F.max(F.when(holds(hi), F.col("_x"))).alias("_hi"),
    )
    step = F.col("_pos") - F.floor("_pos")
    return picked.select(
        *group, "probability", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * step).alias("quantile")
    )
