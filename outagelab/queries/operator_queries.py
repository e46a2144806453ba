"""One query per operator, straight on the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import (
    case_date_filter, clean_sentinels, epoch_day, epoch_range, fill_unknown, first_integer, importance_share,
    null_if_unknown, percent, reconcile_days, rounded,
)
from ..modeling import evaluation as ev
from ..operators import activity as act
from ..operators import cohort as co
from ..operators import features as fe
from ..operators import joins as jo
from ..operators import ordering as od
from ..operators import profiles as pr
from ..sources import read_csv, stage, write_csv
from ..sources.sinks import stage_root
from .binding import source
from .registry import query

SEED = 42
W1, W2 = "1998-06-01", "1998-11-30"


def _r(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: rounded(F.col(f"`{c}`"), places) for c in cols})


def _month(c: str):
    return F.month(F.col(c)).cast("bigint")


# Snapshots and interval joins --------------------------------------------------------------

@query("latest_in_interval", """
with c as (select user_id, event_id, ts, coalesce(lag(ts) over (partition by user_id order by ts, event_id),
                  ts - interval 7 day) as from_ts from events where event_type = 'error')
select c.user_id, c.event_id, h.event_id as snap_id, h.event_type as snap_type, h.value as snap_value
from c left join events h on h.user_id = c.user_id and h.event_type <> 'error' and h.ts between c.from_ts and c.ts
qualify row_number() over (partition by c.event_id order by h.ts desc nulls last, h.event_id desc nulls last) = 1""")
def latest_in_interval(spark, d):
    """For every error event, the user's last other event since the previous error."""
    events = source(spark, d, "events")
    cases = events.filter(F.col("event_type") == "error").select("user_id", "event_id", "ts",
                                                                 F.col("ts").alias("closed"))
    spans = jo.case_intervals(cases, ["user_id"], "ts", "closed", order=["ts", "event_id"], slice_of=od.day_slice)
    history = events.filter(F.col("event_type") != "error").select(
        "user_id", F.col("ts").alias("snap_ts"), F.col("event_id").alias("snap_id"),
        F.col("event_type").alias("snap_type"), F.col("value").alias("snap_value"))
    found = jo.latest_in_interval(spans, history, ["user_id"], "start_date", "end_date", "snap_ts",
                                  ["snap_id", "snap_type", "snap_value"], slice_of=od.day_slice)
    return found.select("user_id", "event_id", "snap_id", "snap_type", "snap_value")


@query("case_intervals", """
select o_custkey as custkey, o_orderkey as orderkey, cast(coalesce(lag(cast(o_orderdate as date) + cast(o_orderkey % 40 as int))
         over (partition by o_custkey order by o_orderdate, o_orderkey), cast(o_orderdate as date) - 7) as string) as start_day,
       cast(cast(o_orderdate as date) as string) as end_day
from orders where o_orderpriority = '1-URGENT'""")
def case_intervals(spark, d):
    cases = source(spark, d, "orders").filter(F.col("o_orderpriority") == "1-URGENT").select(
        F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"),
        F.to_date("o_orderdate").alias("opened"),
        F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 40).cast("int")).alias("closed"))
    spans = jo.case_intervals(cases, ["custkey"], "opened", "closed", order=["opened", "orderkey"])
    return spans.select("custkey", "orderkey", F.col("start_date").cast("string").alias("start_day"),
                        F.col("end_date").cast("string").alias("end_day"))


@query("interval_join", """
select o_orderkey as orderkey, count(l_orderkey) as n, cast(max(l_shipdate) as date)::string as last_day
from orders left join (select l.*, o.o_custkey as owner from lineitem l join orders o on o.o_orderkey = l.l_orderkey) l
  on l.owner = o_custkey and cast(l_shipdate as date) between cast(o_orderdate as date) - 30 and cast(o_orderdate as date)
where o_orderpriority = '1-URGENT' group by o_orderkey""")
def interval_join(spark, d):
    """Items shipped to a customer in the 30 days up to each urgent order."""
    orders = source(spark, d, "orders")
    cases = orders.filter(F.col("o_orderpriority") == "1-URGENT").select(
        F.col("o_orderkey").alias("orderkey"), F.col("o_custkey").alias("custkey"),
        F.to_date("o_orderdate").alias("end"), F.date_sub(F.to_date("o_orderdate"), 30).alias("start"))
    shipped = source(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("custkey"), F.to_date("l_shipdate").alias("day"))
    return jo.interval_join(cases, shipped, "custkey", "start", "end", "day").groupBy("orderkey").agg(
        F.count("day").alias("n"), F.max("day").cast("string").alias("last_day"))


@query("latest_per_key", """
select user_id, event_id, event_type, value from events
where ts >= timestamp '2024-01-08' and ts < timestamp '2024-01-22'
qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1""")
def latest_per_key(spark, d):
    window = source(spark, d, "events").filter(
        (F.col("ts") >= F.lit("2024-01-08").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-22").cast("timestamp_ntz")))
    return jo.latest_per_key(window, ["user_id"], "ts", ["event_id", "event_type", "value"]).drop("ts")


@query("case_next_day_left_join", """
select o_orderkey as orderkey, count(l_orderkey) as n_next_day, min(l_linenumber) as first_line
from orders left join lineitem on upper('k' || cast(l_orderkey as string)) = upper('K' || cast(o_orderkey as string))
  and cast(o_orderdate as date) = cast(l_shipdate as date) - 1 group by o_orderkey""")
def case_next_day_left_join(spark, d):
    orders = source(spark, d, "orders").withColumn("tag", F.concat(F.lit("K"), F.col("o_orderkey").cast("string")))
    items = source(spark, d, "lineitem").withColumn("asset", F.concat(F.lit("k"), F.col("l_orderkey").cast("string")))
    return jo.next_day_folded_join(orders, items, "tag", "asset", "o_orderdate", "l_shipdate").groupBy(
        F.col("o_orderkey").alias("orderkey")).agg(F.count("l_orderkey").alias("n_next_day"),
                                                   F.min("l_linenumber").alias("first_line"))


# Cohorts -----------------------------------------------------------------------------------

@query("anti_join_cohort", """
select distinct o_custkey as custkey from orders o where o_orderdate >= timestamp '1998-06-01'
  and o_orderdate < timestamp '1998-12-01'
  and not exists (from orders u where u.o_custkey = o.o_custkey and u.o_orderpriority = '1-URGENT')""")
def anti_join_cohort(spark, d):
    """Customers with an order in the window that never had an urgent one."""
    orders = source(spark, d, "orders")
    inside = orders.filter(case_date_filter(F.col("o_orderdate"), W1, W2)).select(
        F.col("o_custkey").alias("custkey")).distinct()
    return jo.anti_join_keys(inside, "custkey", orders.filter(F.col("o_orderpriority") == "1-URGENT"), "o_custkey")


@query("segment_cap", """
select c_mktsegment as segment, c_custkey as custkey, row_number() over (partition by c_mktsegment order by c_custkey) as rn
from customer qualify rn <= 20""")
def segment_cap(spark, d):
    rows = source(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("custkey"))
    return co.cap_per_type(rows, "segment", "custkey", 20)


@query("type_counts", """
select case when p_type in ('ECONOMY', 'SMALL') then 'BASIC' when p_type like '%ROMO%' then 'OFFER' else upper(p_type) end as kind,
       count(distinct p_brand) as brands, count(*) as parts from part group by 1""")
def type_counts(spark, d):
    kind = F.when(F.col("p_type").isin("ECONOMY", "SMALL"), "BASIC").when(F.col("p_type").like("%ROMO%"), "OFFER")
    return source(spark, d, "part").groupBy(kind.otherwise(F.upper("p_type")).alias("kind")).agg(
        F.count_distinct("p_brand").alias("brands"), F.count(F.lit(1)).alias("parts"))


@query("top_n_per_group", """
select o_custkey as custkey, o_orderkey as orderkey, year,
       row_number() over (partition by o_custkey, year order by o_totalprice desc, o_orderkey) as rn
from (select *, year(o_orderdate) as year from orders) qualify rn <= 3""")
def top_n_per_group(spark, d):
    """Three largest orders per customer and year; the year is derived before it partitions."""
    rows = source(spark, d, "orders").select(
        F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"), "o_totalprice",
        F.year("o_orderdate").cast("bigint").alias("year"))
    return od.top_n_per_group(rows, ["custkey", "year"], [F.col("o_totalprice").desc(), F.col("orderkey")], 3,
                              spread_on=["orderkey"], spread=4).drop("o_totalprice")


# Scalars and filters -----------------------------------------------------------------------

@query("like_filters", """
select p_partkey as partkey, upper(p_name) as name_up, p_name like '%ring%' as has_ring from part
where upper(p_type) in ('SMALL', 'LARGE', 'PROMO') and p_name ilike '%R%i%g%'
  and p_brand is not null and p_brand not like '%#1%'""")
def like_filters(spark, d):
    return source(spark, d, "part").filter(
        F.upper("p_type").isin("SMALL", "LARGE", "PROMO") & F.col("p_name").ilike("%R%i%g%")
        & F.col("p_brand").isNotNull() & ~F.col("p_brand").like("%#1%")
    ).select(F.col("p_partkey").alias("partkey"), F.upper("p_name").alias("name_up"),
             F.col("p_name").like("%ring%").alias("has_ring"))


@query("sentinel_normalise", """
select doc_id, case when lang in ('fr', 'de') then 'unknown' else lang end as lang,
       case when source in ('src0', 'src1') then null else source end as source_known,
       coalesce(cast(quality as string), 'unknown') as quality
from documents left join labels using (doc_id)""")
def sentinel_normalise(spark, d):
    docs = source(spark, d, "documents").select("doc_id", "lang", "source")
    rows = docs.join(source(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return fill_unknown(rows, ["quality"]).select(
        "doc_id", clean_sentinels("lang", ("fr", "de")).alias("lang"),
        null_if_unknown(clean_sentinels("source", ("src0", "src1"))).alias("source_known"), "quality")


@query("flags_and_guards", """
select c_custkey as custkey, cast(c_acctbal = m.low as int) as is_min,
       case when c.c_mktsegment = m.c_mktsegment then m.low end as segment_min,
       case when c_acctbal between 0 and 5000 then c_acctbal end as mid_balance
from customer c left join (select c_mktsegment, min(c_acctbal) as low from customer where c_acctbal > 0 group by 1) m
  using (c_mktsegment)""")
def flags_and_guards(spark, d):
    c = source(spark, d, "customer")
    low = act.min_per_type(c, F.col("c_mktsegment"), "c_acctbal", "low", "segment")
    joined = jo.attach_small(c.withColumn("segment", F.col("c_mktsegment")), low, ["segment"])
    bal = F.col("c_acctbal")
    return joined.select(
        F.col("c_custkey").alias("custkey"), F.when(bal == F.col("low"), 1).otherwise(0).alias("is_min"),
        F.when(F.col("c_mktsegment") == F.col("segment"), F.col("low")).alias("segment_min"),
        F.when(bal.between(0, 5000), bal).alias("mid_balance"))


@query("date_scalars", """
select o_orderkey as orderkey, month(o_orderdate) as month, cast(cast(o_orderdate as date) - 1 as string) as day_before,
       strftime(o_orderdate, '%Y-%m-%d') as day_text, cast(o_custkey as string) || '-' || nullif(o_orderstatus, 'P') as tag,
       round(o_totalprice / nullif(floor(o_totalprice / 100000), 0) * 100, 2) as pct
from orders""")
def date_scalars(spark, d):
    price = F.col("o_totalprice")
    return source(spark, d, "orders").select(
        F.col("o_orderkey").alias("orderkey"), _month("o_orderdate").alias("month"),
        F.date_sub(F.to_date("o_orderdate"), 1).cast("string").alias("day_before"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day_text"),
        F.concat(F.col("o_custkey").cast("string"), F.lit("-"), F.nullif("o_orderstatus", F.lit("P"))).alias("tag"),
        rounded(percent(price, F.floor(price / 100000)), 2).alias("pct"))


@query("zone_window_filter", """
select event_id, cast(cast(ts as date) as string) as day from events
where epoch_ms(ts) >= epoch_ms(timestamp '2024-01-05 06:00:00') and epoch_ms(ts) < epoch_ms(timestamp '2024-01-20 06:00:00')""")
def zone_window_filter(spark, d):
    """Events between two US/Central midnights, with their UTC day."""
    seconds = F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 1000)
    rows = source(spark, d, "events").select("event_id", seconds.alias("s"))
    return rows.filter(epoch_range(F.col("s"), "2024-01-05", "2024-01-20", "US/Central")).select(
        "event_id", epoch_day(F.col("s")).cast("string").alias("day"))


# Activity ----------------------------------------------------------------------------------

@query("duration_summary", """
select user_id, count(distinct ts) as times, round(avg(n) filter (where n > 0), 6) as mean_amount from (
  select user_id, ts, case when m is null then t when m >= t then m when m = 0 then 0 end as n from (
    select user_id, ts, cast(trunc(case when event_type <> 'click' then value * 1440 end / 1440) as int) as m,
           try_cast(nullif(regexp_extract(props, '[0-9]+'), '') as integer) as t from events)) group by user_id""")
def duration_summary(spark, d):
    """Amounts reconciled with the first number of a text, per user."""
    from ..functions import whole_days
    events = source(spark, d, "events")
    minutes = F.when(F.col("event_type") != "click", F.col("value") * 1440)
    amount = reconcile_days(whole_days(minutes, "minutes"), first_integer(F.col("props")))
    return _r(act.event_frequency(events, "user_id", "ts", amount, "times", "mean_amount"), "mean_amount")


@query("conditional_frequency", """
select user_id, count(distinct ts) as starts, round(avg(value) filter (where value > 20), 6) as mean_high
from events where event_type = 'error' group by user_id""")
def conditional_frequency(spark, d):
    errors = source(spark, d, "events").filter(F.col("event_type") == "error")
    return _r(act.event_frequency(errors, "user_id", "ts", F.when(F.col("value") > 20, F.col("value")),
                                  "starts", "mean_high"), "mean_high")


@query("ratio_to_min", """
select event_id, round(low / nullif(value, 0) * 100, 6) as pct from events
join (select event_type, min(value) as low from events where value > 0 group by 1) using (event_type)""")
def ratio_to_min(spark, d):
    events = source(spark, d, "events").select("event_id", "event_type", "value")
    low = act.min_per_type(events, F.col("event_type"), "value", "low", "event_type")
    return jo.attach_small(events, low, ["event_type"], "inner").select(
        "event_id", rounded(percent(F.col("low"), F.col("value"))).alias("pct"))


@query("gap_days", """
select l_suppkey as suppkey, month(l_shipdate) as month, count(distinct cast(l_shipdate as date)) as export_days,
       count(distinct cast(l_shipdate as date)) filter (where l_returnflag = 'R') as ntw_days,
       count(distinct cast(l_shipdate as date)) - count(distinct cast(l_shipdate as date)) filter (where l_returnflag = 'R') as gap_days
from lineitem where l_shipdate >= timestamp '1998-06-01' and l_shipdate < timestamp '1998-12-01' group by 1, 2""")
def gap_days(spark, d):
    day = F.to_date("l_shipdate")
    rows = source(spark, d, "lineitem").filter(case_date_filter(F.col("l_shipdate"), W1, W2)).withColumn(
        "suppkey", F.col("l_suppkey"))
    return act.gap_days(rows, "suppkey", day, F.when(F.col("l_returnflag") == "R", day))


@query("months_with_issues", """
select l_suppkey as suppkey, count(*) as months_withissues, round(avg(n), 6) as avg_network_issues from (
  select l_suppkey, month(l_shipdate) as m, count(distinct l_orderkey) as n from lineitem
  where l_returnflag = 'R' and l_shipdate >= timestamp '1998-06-01' and l_shipdate < timestamp '1998-12-01' group by 1, 2)
group by 1""")
def months_with_issues(spark, d):
    rows = source(spark, d, "lineitem").filter(
        case_date_filter(F.col("l_shipdate"), W1, W2) & (F.col("l_returnflag") == "R")
    ).withColumn("suppkey", F.col("l_suppkey"))
    return _r(act.months_with_issues(rows, "suppkey", F.month("l_shipdate"), "l_orderkey"), "avg_network_issues")


def _in_year(spark, d):
    return source(spark, d, "lineitem").filter(
        case_date_filter(F.col("l_shipdate"), W1, W2)).withColumn("suppkey", F.col("l_suppkey"))


_TWO_LEVEL = """select l_suppkey as suppkey, m as month, avg(r) as avg_returned, avg(a) as avg_accepted from (
  select l_suppkey, month(l_shipdate) as m, cast(l_shipdate as date) as day, sum(l_quantity) filter (where l_returnflag = 'R') as r,
         sum(l_quantity) filter (where l_returnflag = 'A') as a
  from lineitem where l_shipdate >= timestamp '1998-06-01' and l_shipdate < timestamp '1998-12-01' group by 1, 2, 3) group by 1, 2"""


def _two_level(spark, d):
    rows = _in_year(spark, d).withColumn("month", _month("l_shipdate")).withColumn("day", F.to_date("l_shipdate"))

    def total(flag):
        return F.sum(F.when(F.col("l_returnflag") == flag, F.col("l_quantity")))
    return act.two_level_avg(rows, ["suppkey", "month"], ["day"], {"returned": total("R"), "accepted": total("A")})


@query("two_level_daily_monthly",
       f"select suppkey, month, round(avg_returned, 6) as avg_returned, round(avg_accepted, 6) as avg_accepted from ({_TWO_LEVEL})")
def two_level_daily_monthly(spark, d):
    return _r(_two_level(spark, d), "avg_returned", "avg_accepted")


_DISTINCT_AVG = """select l_suppkey as suppkey, avg(n) as avg_parts from (
  select l_suppkey, month(l_shipdate) as m, count(distinct l_partkey) as n
  from lineitem where l_shipdate >= timestamp '1998-06-01' and l_shipdate < timestamp '1998-12-01' group by 1, 2) group by 1"""


def _distinct_avg(spark, d):
    rows = _in_year(spark, d).withColumn("month", _month("l_shipdate"))
    return act.two_level_avg(rows, ["suppkey"], ["month"], {"parts": F.count_distinct("l_partkey")})


@query("monthly_distinct_avg", f"select suppkey, round(avg_parts, 6) as avg_parts from ({_DISTINCT_AVG})")
def monthly_distinct_avg(spark, d):
    return _r(_distinct_avg(spark, d), "avg_parts")


@query("monthly_join_daily", f"""select suppkey, round(avg_parts, 6) as avg_parts, month, round(avg_returned, 6) as avg_returned
from ({_DISTINCT_AVG}) left join ({_TWO_LEVEL}) using (suppkey)""")
def monthly_join_daily(spark, d):
    joined = _distinct_avg(spark, d).join(_two_level(spark, d).drop("avg_accepted"), "suppkey", "left")
    return _r(joined, "avg_parts", "avg_returned")


_MONTH_NAMES = {m: f"returned_{m:02d}" for m in range(6, 12)}


@query("month_pivot", "select suppkey, " + ", ".join(
    f"round(coalesce(sum(avg_returned) filter (where month = {m}), 0), 6) as {n}" for m, n in _MONTH_NAMES.items())
    + f" from ({_TWO_LEVEL}) group by suppkey")
def month_pivot(spark, d):
    out = act.month_pivot(_two_level(spark, d), "suppkey", "month", {"avg_returned": _MONTH_NAMES})
    return _r(out, *_MONTH_NAMES.values())


_WEEKS, _KINDS = (1, 2, 3, 4, 5), ("view", "click", "purchase", "signup", "error")
_WEEK_NAMES = {(w, k): f"week{w}_{k}" for w in _WEEKS for k in _KINDS}


@query("session_type_pivot", "select user_id, " + ", ".join(
    f"round(coalesce(sum(n) filter (where w = {w} and event_type = '{k}'), 0), 6) as {name}"
    for (w, k), name in _WEEK_NAMES.items()) + """ from (
  select user_id, w, event_type, avg(n) as n from (
    select user_id, (day(ts) - 1) // 7 + 1 as w, day(ts) as dd, event_type,
           count(distinct cast(user_id as string) || '-' || props) as n from events group by 1, 2, 3, 4)
  group by 1, 2, 3) group by user_id""")
def session_type_pivot(spark, d):
    day = F.dayofmonth("ts")
    rows = source(spark, d, "events").withColumn("day", day).withColumn(
        "week", (F.floor((day - 1) / 7) + 1).cast("int"))
    weekly = act.two_level_avg(rows, ["user_id", "week", "event_type"], ["day"],
                               {"n": F.count_distinct("user_id", "props")})
    out = act.month_type_pivot(weekly, "user_id", "week", "event_type", "avg_n", _WEEK_NAMES)
    return _r(out, *_WEEK_NAMES.values())


@query("touch_pivot", "select user_id, " + ", ".join(
    f"round(coalesce(avg(n) filter (where event_type = '{k}'), 0), 6) as touch_{k}" for k in _KINDS) + """
from (select user_id, event_type, cast(ts as date) as day, count(distinct ts) as n from events group by 1, 2, 3) group by user_id""")
def touch_pivot(spark, d):
    rows = source(spark, d, "events").withColumn("day", F.to_date("ts"))
    means = act.two_level_avg(rows, ["user_id", "event_type"], ["day"], {"touches": F.count_distinct("ts")})
    cells = means.groupBy("user_id").pivot("event_type", list(_KINDS)).agg(F.avg("avg_touches")).na.fill(0.0)
    return _r(cells.select("user_id", *[F.col(k).alias(f"touch_{k}") for k in _KINDS]),
              *[f"touch_{k}" for k in _KINDS])


@query("brand_lookup", """
select distinct l_suppkey as suppkey, p_brand as brand from lineitem
join (select distinct s_suppkey from supplier) on cast(s_suppkey as string) = cast(l_suppkey as string)
left join part on cast(p_partkey as string) = cast(l_partkey as string)""")
def brand_lookup(spark, d):
    items = source(spark, d, "lineitem").select("l_suppkey", "l_partkey")
    suppliers = source(spark, d, "supplier").select("s_suppkey").distinct()
    pairs = jo.cast_key_join(items, suppliers, "l_suppkey", "s_suppkey").select(
        F.col("l_suppkey").alias("suppkey"), "l_partkey").distinct()
    parts = source(spark, d, "part").select("p_partkey", F.col("p_brand").alias("brand"))
    return jo.cast_key_join(pairs, parts, "l_partkey", "p_partkey", "left").select("suppkey", "brand").distinct()


# Features ----------------------------------------------------------------------------------

_LABEL_SQL = """select distinct o_custkey as custkey, 1 as y_flag from orders where o_orderpriority = '1-URGENT'
union all select distinct o_custkey, 0 from orders o
where not exists (from orders u where u.o_custkey = o.o_custkey and u.o_orderpriority = '1-URGENT')"""


def labels(spark, d) -> DataFrame:
    """Customers with an urgent order (1) and without (0)."""
    orders = source(spark, d, "orders").select(F.col("o_custkey").alias("custkey"), "o_orderpriority")
    urgent = orders.filter(F.col("o_orderpriority") == "1-URGENT")
    never = jo.anti_join_keys(orders, "custkey", urgent)
    return co.label_frame(urgent, never, "custkey", key="custkey")


@query("label_frame", _LABEL_SQL)
def label_frame(spark, d):
    return labels(spark, d)


@query("label_counts", f"select y_flag, count(*) as devices from ({_LABEL_SQL}) group by y_flag")
def label_counts(spark, d):
    return labels(spark, d).groupBy("y_flag").agg(F.count(F.lit(1)).alias("devices"))


_PRIORITIES = {"1-URGENT": "p1", "2-HIGH": "p2", "3-MEDIUM": "p3", "4-NOT SPECIFIED": "p4"}
_STATUSES = {"F": "sF", "O": "sO"}


@query("multi_hot", """
select o_custkey as custkey, """ + ", ".join(
    f"max(cast({c} = '{v}' as int)) as {c}_{fe.safe_name(v)}"
    for c, vs in (("o_orderpriority", _PRIORITIES), ("o_orderstatus", _STATUSES)) for v in vs) + """
from orders group by o_custkey""")
def multi_hot(spark, d):
    """Priorities and statuses of each customer's orders; the last level of both has no column."""
    long = fe.long_attributes(source(spark, d, "orders").withColumn("custkey", F.col("o_custkey")), "custkey",
                              ["o_orderpriority", "o_orderstatus"])
    return fe.multi_hot(long, "custkey", fe.vocabulary(long))


@query("multi_hot_wide", """
select o_custkey as custkey, cast(sum(1) as bigint) as n_types from (
  select distinct o_custkey, p_brand from orders join lineitem on l_orderkey = o_orderkey
  join part on p_partkey = l_partkey
  union all select distinct o_custkey, cast(p_size as string) from orders join lineitem on l_orderkey = o_orderkey
  join part on p_partkey = l_partkey) group by 1""")
def multi_hot_wide(spark, d):
    """Row sums of a block with more than sixty columns (brands and sizes bought)."""
    bought = source(spark, d, "orders").join(source(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).join(
        source(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).select(
        F.col("o_custkey").alias("custkey"), "p_brand", "p_size")
    long = fe.long_attributes(bought, "custkey", ["p_brand", "p_size"])
    vocab = fe.vocabulary(long, drop_reference=False)
    hot = fe.multi_hot(long, "custkey", vocab)
    names = list(fe.column_names(vocab).values())
    total = F.aggregate(F.array(*[F.col(n) for n in names]), F.lit(0), lambda a, b: a + b)
    return hot.select("custkey", total.cast("bigint").alias("n_types"))


def _cohort_pivots(spark, d):
    """Quantities by part type for two cohorts whose type sets differ."""
    sold = source(spark, d, "lineitem").join(
        source(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).select("l_suppkey", "l_returnflag",
                                                                                   "p_type", "l_quantity")

    def pivot(flag, types):
        return sold.filter(F.col("l_returnflag") == flag).groupBy(F.col("l_suppkey").alias("suppkey")).pivot(
            "p_type", types).agg(F.sum("l_quantity")).na.fill(0.0)
    return pivot("R", ["ECONOMY", "LARGE", "MEDIUM", "PROMO"]), pivot("A", ["LARGE", "MEDIUM", "SMALL", "STANDARD"])


def _pivot_sql(flag: str, types: list[str], extra: str = "") -> str:
    cells = ", ".join(f"coalesce(sum(l_quantity) filter (where p_type = '{t}'), 0) as \"{t}\"" for t in types)
    return (f"select l_suppkey as suppkey, {cells}{extra} from lineitem join part on p_partkey = l_partkey "
            f"where l_returnflag = '{flag}' group by 1")


@query("align_columns", _pivot_sql("R", ["LARGE", "MEDIUM"], ", 1 as cohort") + " union all "
       + _pivot_sql("A", ["LARGE", "MEDIUM"], ", 0"))
def align_columns(spark, d):
    """Two cohorts on their common columns."""
    a, b = fe.align(*_cohort_pivots(spark, d))
    return a.withColumn("cohort", F.lit(1)).unionByName(b.withColumn("cohort", F.lit(0)))


@query("union_missing_columns", "select suppkey, cohort, \"ECONOMY\", \"LARGE\" from ("
       + _pivot_sql("R", ["ECONOMY", "LARGE", "MEDIUM", "PROMO"], ", 1 as cohort")
       + ") union all by name select suppkey, cohort, \"LARGE\", \"SMALL\" from ("
       + _pivot_sql("A", ["LARGE", "MEDIUM", "SMALL", "STANDARD"], ", 0 as cohort") + ")")
def union_missing_columns(spark, d):
    """Two cohorts on all columns; a column the cohort lacks is null."""
    a, b = _cohort_pivots(spark, d)
    both = a.withColumn("cohort", F.lit(1)).unionByName(b.withColumn("cohort", F.lit(0)), allowMissingColumns=True)
    return both.select("suppkey", "cohort", "ECONOMY", "LARGE", "SMALL")


@query("column_sets", """
select c_custkey as key, c_acctbal as "balance", cast(c_mktsegment = 'BUILDING' as int) as segment_BUILDING,
       cast(c_nationkey = 3 as int) as y_flag from customer""")
def column_sets(spark, d):
    """Names made safe, columns dropped by list and by name part, label last."""
    raw = source(spark, d, "customer").select(
        F.col("c_custkey").alias("key"), F.when(F.col("c_nationkey") == 3, 1).otherwise(0).alias("y_flag"),
        F.col("c_acctbal").alias("balance"), F.col("c_name").alias("leak"), F.lit("4.9.16").alias("software_4.9.16"),
        F.when(F.col("c_mktsegment") == "BUILDING", 1).otherwise(0).alias("segment/BUILDING"))
    kept = fe.drop_columns(raw, names=["leak"], containing=["software_"])
    renamed = kept.toDF(*[fe.safe_name(c) for c in kept.columns])
    return fe.label_last(renamed, "key", "y_flag")


@query("distinct_profile", """
select 'returnflag' as variable, l_returnflag as value, count(*) as n from lineitem group by 2
union all select 'linestatus', l_linestatus, count(*) from lineitem group by 2
union all select 'discount', cast(l_discount as string), count(*) from lineitem group by 2""")
def distinct_profile(spark, d):
    """Distinct values of several columns in one pass."""
    pairs = F.array(*[F.struct(F.lit(n).alias("variable"), F.col(c).cast("string").alias("value"))
                      for n, c in (("returnflag", "l_returnflag"), ("linestatus", "l_linestatus"),
                                   ("discount", "l_discount"))])
    return source(spark, d, "lineitem").select(F.inline(pairs)).groupBy("variable", "value").agg(
        F.count(F.lit(1)).alias("n"))


@query("top_n_preview", "select o_orderkey as orderkey, o_totalprice as price from orders order by price desc, orderkey limit 25")
def top_n_preview(spark, d):
    return source(spark, d, "orders").select(F.col("o_orderkey").alias("orderkey"), F.col("o_totalprice").alias("price")
                                             ).orderBy(F.desc("price"), "orderkey").limit(25)


@query("deciles", """
with e as (select unnest(range(0, 11)) as i, unnest(quantile_cont(value, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1])) as q from events),
b as (select value, coalesce((select min(i) from e where i > 0 and value <= q + 1e-9), 10) as bin from events)
select bin, count(*) as n, round(any_value(l.q), 6) as left_edge, round(any_value(r.q), 6) as right_edge
from b join e l on l.i = bin - 1 join e r on r.i = bin group by bin""")
def deciles(spark, d):
    """Rows and edges of the right-closed decile bins of the event value."""
    events = source(spark, d, "events").select("value")
    edges = fe.decile_edges(events, "value")
    counts = events.groupBy(fe.bin_number(F.col("value"), edges).cast("bigint").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))
    lits = F.array(*[F.lit(e) for e in edges])
    return counts.select("bin", "n", rounded(F.element_at(lits, F.col("bin").cast("int"))).alias("left_edge"),
                         rounded(F.element_at(lits, F.col("bin").cast("int") + 1)).alias("right_edge"))


@query("exact_quantiles", """
select event_type, p as probability, round(case p when 0.25 then quantile_cont(value, 0.25) when 0.5 then quantile_cont(value, 0.5)
       else quantile_cont(value, 0.9) end, 6) as quantile
from events, (select unnest([0.25, 0.5, 0.9])::double as p) group by event_type, p""")
def exact_quantiles(spark, d):
    return _r(od.exact_quantiles(source(spark, d, "events"), "value", [0.25, 0.5, 0.9], ["event_type"]), "quantile")


_NUM = ("qty", "price", "disc")


def _supplier_means(spark, d):
    return source(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("suppkey")).agg(
        F.avg("l_quantity").alias("qty"), F.avg("l_extendedprice").alias("price"), F.avg("l_discount").alias("disc"))


_MEANS = "select l_suppkey as suppkey, avg(l_quantity) as qty, avg(l_extendedprice) as price, avg(l_discount) as disc from lineitem group by 1"


@query("zscore", "select suppkey, " + ", ".join(
    f"round(({c} - avg({c}) over ()) / stddev_samp({c}) over (), 5) + 0.0 as {c}" for c in _NUM) + f" from ({_MEANS})")
def zscore(spark, d):
    means = stage(_supplier_means(spark, d), "means")
    return _r(fe.ZScore.fit(means, _NUM).apply(means), *_NUM, places=5)


@query("variance_filter", " union all ".join(
    f"select '{c}' as variable, round(var_pop({e}), 4) as variance, var_pop({e}) > 0.09 as kept from lineitem"
    for c, e in (("l_quantity", "l_quantity"), ("l_discount", "l_discount"), ("l_tax", "l_tax"),
                 ("is_r", "cast(l_returnflag = 'R' as int)"), ("is_last", "cast(l_linenumber = 7 as int)"))))
def variance_filter(spark, d):
    rows = source(spark, d, "lineitem").select(
        "l_quantity", "l_discount", "l_tax", (F.col("l_returnflag") == "R").cast("int").alias("is_r"),
        (F.col("l_linenumber") == 7).cast("int").alias("is_last"))
    table = fe.column_variances(rows, rows.columns)
    return table.select("variable", rounded(F.col("variance"), 4).alias("variance"),
                        (F.col("variance") > 0.09).alias("kept"))


# Samples and splits ------------------------------------------------------------------------

@query("balanced_sample", f"""
with l as ({_LABEL_SQL}), r as (select *, row_number() over (partition by y_flag order by md5(custkey || '|{SEED}'), custkey) as r from l)
select custkey, y_flag from r where y_flag = 0 or r <= (select count(*) from l where y_flag = 0)""")
def balanced_sample(spark, d):
    """The larger class (urgent) cut down to the size of the smaller one."""
    rows = stage(labels(spark, d), "labels")
    return co.balance_down(rows.filter("y_flag = 0"), rows.filter("y_flag = 1"), "custkey", SEED)


@query("up_sample", f"""
with l as ({_LABEL_SQL}), n as (select count(*) filter (where y_flag = 1) as big, count(*) filter (where y_flag = 0) as small from l),
r as (select custkey, row_number() over (order by md5(custkey || '|{SEED}'), custkey) as r from l where y_flag = 0)
select custkey, copy from r, n, unnest(range(1, 1000)) as u(copy) where copy <= big // small + cast(r <= big % small as int)""")
def up_sample(spark, d):
    """The smaller class repeated evenly up to the size of the larger one."""
    rows = stage(labels(spark, d), "labels")
    n = rows.filter("y_flag = 1").select(F.count(F.lit(1))).scalar()
    return co.sample_up(rows.filter("y_flag = 0"), "custkey", n, SEED).select("custkey", "copy")


_SPLIT_SQL = f"""select custkey, case when r <= floor(n * 0.6) then 'train' when r <= floor(n * 0.8) then 'test' else 'valid' end as split
from (select c_custkey as custkey, row_number() over (order by md5(c_custkey || '|{SEED}'), c_custkey) as r, count(*) over () as n
      from customer)"""
_SHARES = (("train", 0.6), ("test", 0.2), ("valid", 0.2))


@query("split_60_20_20", _SPLIT_SQL)
def split_60_20_20(spark, d):
    rows = source(spark, d, "customer").select(F.col("c_custkey").alias("custkey"))
    return co.split_exact(rows, "custkey", _SHARES, SEED)


@query("split_by_hash", f"""
select custkey, case when p < 0.6 then 'train' when p < 0.8 then 'test' else 'valid' end as split from (
  select c_custkey as custkey, cast('0x' || md5(c_custkey || '|{SEED}')[1:8] as bigint) / 4294967296 as p from customer)""")
def split_by_hash(spark, d):
    rows = source(spark, d, "customer").select(F.col("c_custkey").alias("custkey"))
    return co.split_by_hash(rows, "custkey", _SHARES, SEED)


# Wide table and profiles -------------------------------------------------------------------

_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD")
FLAGS = [*(f"segment_{s}" for s in _SEGMENTS), "status_F", "status_O", "returned"]
NUMERICS = ["balance", "n_orders", "avg_price", "max_price"]

_WIDE_SQL = f"""
select l.custkey, {", ".join(f"cast(c_mktsegment = '{s}' as int) as segment_{s}" for s in _SEGMENTS)},
       coalesce(status_F, 0) as status_F, coalesce(status_O, 0) as status_O, coalesce(returned, 0) as returned,
       c_acctbal as balance, cast(n_orders as double) as n_orders, avg_price, max_price, l.y_flag, s.split
from ({_LABEL_SQL}) l join customer on c_custkey = l.custkey join ({_SPLIT_SQL}) s on s.custkey = l.custkey
left join (select o_custkey, max(cast(o_orderstatus = 'F' as int)) as status_F, max(cast(o_orderstatus = 'O' as int)) as status_O,
                  count(*) as n_orders, avg(o_totalprice) as avg_price, max(o_totalprice) as max_price
           from orders group by 1) o on o.o_custkey = l.custkey
left join (select o_custkey, 1 as returned from orders join lineitem on l_orderkey = o_orderkey
           where l_returnflag = 'R' and l_quantity > 49 group by 1) b on b.o_custkey = l.custkey"""


def customer_wide(spark, d) -> DataFrame:
    """One row per customer: flags, numerics, label and split, left joined onto the label frame."""
    customer, orders = source(spark, d, "customer"), source(spark, d, "orders")
    segments = fe.multi_hot(
        fe.long_attributes(customer.select(F.col("c_custkey").alias("custkey"), F.col("c_mktsegment").alias("segment")),
                           "custkey", ["segment"]), "custkey", {"segment": list(_SEGMENTS)})
    own = orders.withColumn("custkey", F.col("o_custkey"))
    statuses = fe.multi_hot(fe.long_attributes(own.withColumn("status", F.col("o_orderstatus")), "custkey", ["status"]),
                            "custkey", {"status": ["F", "O"]})
    money = own.groupBy("custkey").agg(F.count(F.lit(1)).cast("double").alias("n_orders"),
                                       F.avg("o_totalprice").alias("avg_price"), F.max("o_totalprice").alias("max_price"))
    big_returns = source(spark, d, "lineitem").filter((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 49)).select(
        F.col("l_orderkey").alias("o_orderkey"))
    returned = own.join(big_returns, "o_orderkey", "left_semi").select("custkey").distinct().withColumn("returned", F.lit(1))
    balance = customer.select(F.col("c_custkey").alias("custkey"), F.col("c_acctbal").alias("balance"))
    joined = jo.star_join(labels(spark, d).join(split_60_20_20(spark, d), "custkey"),
                          [segments, statuses, money, returned, balance], "custkey")
    return joined.select("custkey", *[F.coalesce(c, F.lit(0)).alias(c) for c in FLAGS], *NUMERICS, "y_flag", "split")


@query("assemble_wide", f"select * replace (round(avg_price, 6) as avg_price) from ({_WIDE_SQL})")
def assemble_wide(spark, d):
    return _r(customer_wide(spark, d), "avg_price")


def _long_flags() -> str:
    return " union all ".join(f"select custkey, split, y_flag, '{f}' as variable, {f} as v from w" for f in FLAGS)


_PREV_SQL = f"""with w as ({_WIDE_SQL}), f as ({_long_flags()}),
p as (select variable, split, y_flag, count(distinct custkey) as devices from f where v = 1 and split <> 'valid' group by 1, 2, 3),
t as (select *, cast(sum(devices) over (partition by variable, split) as bigint) as total from p)
select variable, split, y_flag, devices, total, devices / total * 100 as pct from t"""


def _prevalence(spark, d):
    rows = customer_wide(spark, d).filter(F.col("split") != "valid")
    return pr.prevalence(rows, FLAGS, "custkey")


@query("prevalence", f"select variable, split, y_flag, devices, total, round(pct, 6) as pct from ({_PREV_SQL})")
def prevalence(spark, d):
    return _r(_prevalence(spark, d), "pct")


@query("prevalence_drop_list", f"select distinct variable from ({_PREV_SQL}) "
       "where pct >= 80 and (split = 'test' or (split = 'train' and devices < 200))")
def prevalence_drop_list(spark, d):
    return pr.prevalence_drop_list(_prevalence(spark, d))


@query("drop_list", f"select distinct variable from ({_PREV_SQL}) where pct >= 85 and devices >= 10")
def drop_list(spark, d):
    return _prevalence(spark, d).filter((F.col("pct") >= 85) & (F.col("devices") >= 10)).select("variable").distinct()


@query("numeric_profile", f"with w as ({_WIDE_SQL}), n as (" + " union all ".join(
    f"select split, y_flag, '{n}' as variable, {n} as v from w" for n in NUMERICS) + ") select variable, split, " + ", ".join(
    f"round({f}(v) filter (where y_flag = {y}), 4) as {n}_{y}"
    for f, n in (("avg", "mean"), ("median", "median"), ("min", "min"), ("max", "max")) for y in (0, 1)) + " from n group by 1, 2")
def numeric_profile(spark, d):
    out = pr.numeric_profile(stage(customer_wide(spark, d), "wide"), NUMERICS)
    return _r(out, *[c for c in out.columns if c not in ("variable", "split")], places=4)


_CORR_SQL = f"with w as ({_WIDE_SQL}) " + " union all ".join(
    f"select '{c}' as variable, corr({c}, y_flag) as corr from w" for c in [*FLAGS, *NUMERICS])


@query("label_correlation", f"select variable, round(corr, 6) + 0.0 as corr from ({_CORR_SQL})")
def label_correlation(spark, d):
    return _r(pr.label_correlation(customer_wide(spark, d), [*FLAGS, *NUMERICS], "y_flag"), "corr")


@query("positive_correlation", f"select variable from ({_CORR_SQL}) where corr > 0")
def positive_correlation(spark, d):
    return pr.label_correlation(customer_wide(spark, d), [*FLAGS, *NUMERICS], "y_flag").filter("corr > 0").select("variable")


_QCOLS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("correlation_matrix", " union all ".join(
    f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) + 0.0 as corr from lineitem" for a in _QCOLS for b in _QCOLS))
def correlation_matrix(spark, d):
    return _r(pr.correlation_matrix(source(spark, d, "lineitem"), _QCOLS), "corr")


@query("null_columns", " union all ".join(
    f"select '{c}' as variable, count(*) - count({c}) as nulls from documents left join labels using (doc_id)"
    for c in ("lang", "source", "quality", "toxic")))
def null_columns(spark, d):
    rows = source(spark, d, "documents").select("doc_id", "lang", "source").join(source(spark, d, "labels"), "doc_id", "left")
    flags = rows.select(*[F.when(F.col(c).isNotNull(), F.lit(1)).alias(c) for c in ("lang", "source", "quality", "toxic")])
    return pr.null_columns(flags, flags.columns)


@query("nonzero_profile", f"with w as ({_WIDE_SQL}) select custkey, variable, cast(v as double) as value from ("
       + _long_flags().replace(" split, y_flag,", "") + ") where v <> 0")
def nonzero_profile(spark, d):
    return fe.nonzero_profile(customer_wide(spark, d), "custkey", FLAGS)


@query("devices_per_value", """
select o_orderpriority as value, count(distinct o_custkey) as devices from orders group by 1""")
def devices_per_value(spark, d):
    return source(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("value")).agg(
        F.count_distinct("o_custkey").alias("devices"))


@query("csv_round_trip", """
select o_orderkey as orderkey, o_orderpriority as priority, o_totalprice as price, cast(cast(o_orderdate as date) as string) as day,
       case when o_orderkey % 5 = 0 then null else 'a "quoted", text' end as note from orders""")
def csv_round_trip(spark, d):
    """A stage written as parquet, then as CSV, and read back with a schema."""
    rows = source(spark, d, "orders").select(
        F.col("o_orderkey").alias("orderkey"), F.col("o_orderpriority").alias("priority"),
        F.col("o_totalprice").alias("price"), F.to_date("o_orderdate").cast("string").alias("day"),
        F.when(F.col("o_orderkey") % 5 != 0, F.lit('a "quoted", text')).alias("note"))
    staged = stage(rows, "orders")
    path = f"{stage_root(rows.sparkSession)}/csv-{staged.inputFiles()[0].split('/')[-2].split('-', 1)[1]}"
    write_csv(staged, path)
    return read_csv(spark, path, "orderkey BIGINT, priority STRING, price DOUBLE, day STRING, note STRING")


# Evaluation --------------------------------------------------------------------------------

_RULE = "select doc_id, quality as label, cast(n_chars > 600 as int) as prediction, n_chars as score from labels join documents using (doc_id)"


def rule(spark, d) -> DataFrame:
    """Document quality predicted by a length rule; the length is the score."""
    docs = source(spark, d, "documents").select("doc_id", "n_chars")
    return source(spark, d, "labels").select("doc_id", F.col("quality").alias("label")).join(docs, "doc_id").select(
        "doc_id", "label", (F.col("n_chars") > 600).cast("int").alias("prediction"), F.col("n_chars").alias("score"))


_CONF = """count(*) filter (where label = 0 and prediction = 0) as tn, count(*) filter (where label = 0 and prediction = 1) as fp,
count(*) filter (where label = 1 and prediction = 0) as fn, count(*) filter (where label = 1 and prediction = 1) as tp"""


@query("confusion_fpr", f"select tn, fp, fn, tp, round(fp / (fp + tn), 6) as fpr from (select {_CONF} from ({_RULE}))")
def confusion_fpr(spark, d):
    return _r(ev.rate_set(ev.confusion(rule(spark, d))).select("tn", "fp", "fn", "tp", "fpr"), "fpr")


@query("rate_set", f"""select round(tp / (tp + fn), 6) as tpr, round(tn / (tn + fp), 6) as tnr, round(tp / (tp + fp), 6) as ppv,
round(tn / (tn + fn), 6) as npv, round(fp / (fp + tn), 6) as fpr, round(fn / (tp + fn), 6) as fnr, round(fp / (tp + fp), 6) as fdr,
round((tp + tn) / (tp + fp + fn + tn), 6) as acc from (select {_CONF} from ({_RULE}))""")
def rate_set(spark, d):
    names = ("tpr", "tnr", "ppv", "npv", "fpr", "fnr", "fdr", "acc")
    return _r(ev.rate_set(ev.confusion(rule(spark, d))).select(*names), *names)


@query("accuracy", f"select round(avg(cast(label = prediction as int)), 6) as accuracy from ({_RULE})")
def accuracy(spark, d):
    return _r(ev.accuracy(rule(spark, d)), "accuracy")


@query("report", f"""with r as ({_RULE}), c as (
  select cls, count(*) filter (where label = cls and prediction = cls) as hit, count(*) filter (where prediction = cls) as pred,
         count(*) filter (where label = cls) as support from r, (select unnest([0, 1]) as cls) group by cls),
p as (select cast(cls as string) as class, coalesce(hit / nullif(pred, 0), 0) as precision, coalesce(hit / nullif(support, 0), 0) as recall,
             coalesce(2 * hit / nullif(pred + support, 0), 0) as f1, support, hit from c)
select class, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support from p
union all select 'accuracy', round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6),
  cast(sum(support) as bigint) from p
union all select 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), cast(sum(support) as bigint) from p
union all select 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
  round(sum(f1 * support) / sum(support), 6), cast(sum(support) as bigint) from p""")
def report(spark, d):
    return _r(ev.classification_report(rule(spark, d)), "precision", "recall", "f1")


@query("roc_points", f"""select cast(score as double) as threshold, pos, neg,
  round(sum(neg) over (order by score desc) / sum(neg) over (), 6) as fpr, round(sum(pos) over (order by score desc) / sum(pos) over (), 6) as tpr
from (select score, count(*) filter (where label = 1) as pos, count(*) filter (where label = 0) as neg from ({_RULE}) group by 1)""")
def roc_points(spark, d):
    return _r(ev.roc_points(rule(spark, d)), "fpr", "tpr")


@query("roc_curve", f"""with k as (select score, count(*) filter (where label = 1) as pos, count(*) filter (where label = 0) as neg
  from ({_RULE}) group by 1)
select cast(score as double) as threshold, pos, neg,
  round(sum(neg) over (order by score desc) / sum(neg) over (), 6) as fpr, round(sum(pos) over (order by score desc) / sum(pos) over (), 6) as tpr
from k
union all select cast(null as double), 0, 0, 0.0, 0.0 where exists (select 1 from k)""")
def roc_curve(spark, d):
    return _r(ev.roc_points(rule(spark, d), start=True), "fpr", "tpr")


@query("auc", f"""with r as ({_RULE}), k as (select label, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2 as rk from r)
select round((sum(rk) filter (where label = 1) - n1 * (n1 + 1) / 2) / (n1 * n0), 6) as auc
from k, (select count(*) filter (where label = 1) as n1, count(*) filter (where label = 0) as n0 from r) group by n1, n0""")
def auc(spark, d):
    return _r(ev.auc(rule(spark, d)), "auc")


_FOLD_SQL = f"""select *, cast(floor((row_number() over (order by md5(doc_id || '|{SEED}'), doc_id) - 1) * 5 / count(*) over ()) as int) as fold from ({_RULE})"""


def _fold_rates(spark, d):
    folds = co.fold_by_rank(rule(spark, d), "doc_id", 5, SEED)
    return ev.rate_set(ev.confusion(folds, by=["fold"]))


@query("kfold_rule", f"""select fold, tn, fp, fn, tp, round((tp + tn) / (tp + fp + fn + tn), 6) as acc, round(fp / (fp + tn), 6) as fpr
from (select fold, {_CONF} from ({_FOLD_SQL}) group by fold)""")
def kfold_rule(spark, d):
    return _r(_fold_rates(spark, d).select("fold", "tn", "fp", "fn", "tp", "acc", "fpr"), "acc", "fpr")


@query("score_summary", f"""with s as (select (tp + tn) / (tp + fp + fn + tn) as acc, fp / (fp + tn) as fpr
  from (select fold, {_CONF} from ({_FOLD_SQL}) group by fold))
select 'acc' as metric, round(avg(acc), 6) as mean, round(stddev_pop(acc), 6) as std from s
union all select 'fpr', round(avg(fpr), 6), round(stddev_pop(fpr), 6) from s""")
def score_summary(spark, d):
    return _r(ev.score_summary(_fold_rates(spark, d), ["acc", "fpr"]), "mean", "std")


@query("class_weights", f"""select custkey, y_flag, round(count(*) over () / (2 * count(*) over (partition by y_flag)), 6) as weight
from ({_LABEL_SQL})""")
def class_weights(spark, d):
    return _r(co.class_weights(labels(spark, d), "y_flag").select("custkey", "y_flag", "weight"), "weight")


@query("importance_share", f"select variable as feature, round(abs(corr) * 100 / sum(abs(corr)) over (), 5) as importance from ({_CORR_SQL})")
def importance_share_(spark, d):
    table = pr.label_correlation(customer_wide(spark, d), [*FLAGS, *NUMERICS], "y_flag")
    return _r(table.select(F.col("variable").alias("feature"), importance_share(F.col("corr")).alias("importance")),
              "importance", places=5)


@query("importance_compare", f"""with c as ({_CORR_SQL}),
a as (select variable, abs(corr) * 100 / sum(abs(corr)) over () as i from c),
b as (select variable, abs(corr) * 100 / sum(abs(corr)) over () as i from c where variable not like 'segment_%'),
ra as (select variable, i, row_number() over (order by i desc nulls last, variable) as r from a),
rb as (select variable, i, row_number() over (order by i desc nulls last, variable) as r from b)
select coalesce(ra.variable, rb.variable) as feature, round(ra.i, 5) as importance_all, ra.r as rank_all,
       round(rb.i, 5) as importance_less, rb.r as rank_less, rb.r - ra.r as rank_delta
from ra full join rb on ra.variable = rb.variable""")
def importance_compare(spark, d):
    """Weights with all features and without one feature family, side by side."""
    table = stage(pr.label_correlation(customer_wide(spark, d), [*FLAGS, *NUMERICS], "y_flag"), "corr").select(
        F.col("variable").alias("feature"), F.col("corr").alias("weight"))
    runs = {"all": ev.weight_importances(table),
            "less": ev.weight_importances(table.filter(~F.col("feature").startswith("segment_")))}
    return _r(ev.compare_importances(runs), "importance_all", "importance_less", places=5)


