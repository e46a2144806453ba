import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from outagelab.operators import ordering as od
from outagelab.operators.joins import case_intervals, interval_join, latest_in_interval, latest_per_key

DAY0 = dt.date(2020, 1, 1)


def skewed_rows(n=300, seed=3):
    """A third of all rows belongs to one key."""
    rng = random.Random(seed)
    return [("hot" if i % 3 == 0 else f"k{rng.randrange(12)}", DAY0 + dt.timedelta(days=rng.randrange(200)), i)
            for i in range(n)]


@pytest.mark.parametrize("slice_of", [od.month_slice, od.day_slice])
def test_previous_value_equals_lag(spark, slice_of):
    rows = skewed_rows()
    df = spark.createDataFrame(rows, "k STRING, d DATE, i INT")
    got = {r.i: r.p for r in od.previous_value(df, ["k"], ["d", "i"], "i", "p", slice_of("d")).collect()}
    pdf = pd.DataFrame(rows, columns=["k", "d", "i"]).sort_values(["d", "i"])
    want = pdf.groupby("k")["i"].shift()
    assert len(got) == len(rows)
    assert all((got[i] is None) == pd.isna(w) and (got[i] is None or got[i] == w) for i, w in zip(pdf["i"], want))


def test_previous_value_keeps_a_null_value(spark):
    df = spark.createDataFrame([("a", dt.date(2020, 1, 5), None), ("a", dt.date(2020, 3, 1), dt.date(2020, 3, 2)),
                                ("a", dt.date(2020, 3, 9), None)], "k STRING, o DATE, c DATE")
    got = case_intervals(df, ["k"], "o", "c").orderBy("o").collect()
    assert [r.start_date for r in got] == [dt.date(2019, 12, 29), dt.date(2020, 2, 23), dt.date(2020, 3, 2)]


def brute_latest(cases, history):
    out = {}
    for k, s, e, i in cases:
        hits = [(d, v) for hk, d, v in history if hk == k and s <= d <= e]
        out[i] = max(hits) if hits else (None, None)
    return out


def test_latest_in_interval_equals_brute_force(spark):
    history = skewed_rows(400, 5)
    rng = random.Random(8)
    cases = []
    for i in range(150):
        end = DAY0 + dt.timedelta(days=rng.randrange(-5, 215))
        cases.append(("hot" if i % 3 == 0 else f"k{rng.randrange(14)}", end - dt.timedelta(days=rng.randrange(-3, 40)), end, i))
    c = spark.createDataFrame(cases, "k STRING, s DATE, e DATE, i INT")
    h = spark.createDataFrame(history, "k STRING, d DATE, v INT")
    got = latest_in_interval(c, h, ["k"], "s", "e", "d", ["v"]).collect()
    assert len(got) == len(cases)
    assert {r.i: (r.d, r.v) for r in got} == brute_latest(cases, history)


def test_interval_edges_are_inclusive(spark):
    c = spark.createDataFrame([("a", DAY0, DAY0 + dt.timedelta(days=40))], "k STRING, s DATE, e DATE")
    for offset, hit in ((0, True), (40, True), (-1, False), (41, False)):
        h = spark.createDataFrame([("a", DAY0 + dt.timedelta(days=offset), 1)], "k STRING, d DATE, v INT")
        assert (latest_in_interval(c, h, ["k"], "s", "e", "d", ["v"]).first().v == 1) is hit


@pytest.mark.parametrize("how", ["left", "inner"])
def test_interval_join_equals_brute_force(spark, how):
    history = skewed_rows(200, 9)
    rng = random.Random(1)
    cases = [("hot" if i % 3 == 0 else f"k{rng.randrange(14)}", DAY0 + dt.timedelta(days=rng.randrange(180)), i)
             for i in range(60)]
    cases = [(k, s, s + dt.timedelta(days=rng.randrange(-2, 50)), i) for k, s, i in cases]
    c = spark.createDataFrame(cases, "k STRING, s DATE, e DATE, i INT")
    h = spark.createDataFrame(history, "k STRING, d DATE, v INT")
    got = sorted((r.i, r.v if r.v is not None else -1) for r in interval_join(c, h, "k", "s", "e", "d", 13, how).collect())
    want = []
    for k, s, e, i in cases:
        hits = [v for hk, d, v in history if hk == k and s <= d <= e]
        want += [(i, v) for v in hits] or ([(i, -1)] if how == "left" else [])
    assert got == sorted(want)


def test_latest_per_key_breaks_ties_by_payload(spark):
    df = spark.createDataFrame([("a", DAY0, 1), ("a", DAY0, 7), ("b", DAY0, None)], "k STRING, d DATE, v INT")
    assert {r.k: r.v for r in latest_per_key(df, ["k"], "d", ["v"]).collect()} == {"a": 7, "b": None}


def test_top_n_is_exact_for_any_spread(spark):
    rows = skewed_rows(500)
    df = spark.createDataFrame(rows, "k STRING, d DATE, i INT")
    want = pd.DataFrame(rows, columns=["k", "d", "i"]).sort_values("i").groupby("k").head(20)
    for spread in (1, 7):
        got = od.top_n_per_group(df, ["k"], [F.col("i")], 20, ["i"], spread)
        assert sorted(r.i for r in got.collect()) == sorted(want["i"])
        assert got.filter("rn < 1 or rn > 20").count() == 0


def test_hash_rank_is_dense_and_stable_under_repartitioning(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a = {r.k: r.r for r in od.hash_rank(df, "k", 42, "r").collect()}
    b = {r.k: r.r for r in od.hash_rank(df.repartition(7, "k"), "k", 42, "r").collect()}
    assert a == b and sorted(a.values()) == list(range(1, 1001))
    assert a != {r.k: r.r for r in od.hash_rank(df, "k", 43, "r").collect()}


@pytest.mark.parametrize("slices", [3, 16, 1024])
@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_equal_cumsum(spark, slices, descending):
    rng = random.Random(2)
    counts = [(g, float(v), rng.randrange(1, 9)) for g in "ab" for v in rng.sample(range(500), 120)]
    df = spark.createDataFrame(counts, "g STRING, x DOUBLE, c BIGINT")
    got = {(r.g, r.x): (r.c_to, r.c_all) for r in od.running_totals(df, "x", ["c"], ["g"], descending, slices).collect()}
    pdf = pd.DataFrame(counts, columns=["g", "x", "c"]).sort_values("x", ascending=not descending)
    pdf["to"], pdf["all"] = pdf.groupby("g")["c"].cumsum(), pdf.groupby("g")["c"].transform("sum")
    assert got == {(r.g, r.x): (r.to, r["all"]) for _, r in pdf.iterrows()}


def test_exact_quantiles_with_one_value_holding_a_third(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([np.full(100, 5.0), rng.normal(5, 3, 200)])
    probs = [0, 0.1, 0.33, 0.5, 0.95, 1]
    df = spark.createDataFrame([(float(v),) for v in x], "x DOUBLE")
    got = {r.probability: r.quantile for r in od.exact_quantiles(df, "x", probs, slices=9).collect()}
    for p in probs:
        assert got[p] == pytest.approx(np.quantile(x, p), abs=1e-9)


def test_lookup_has_one_plan_and_one_row_per_point(spark):
    """The plan does not depend on the number of keys, and cases that share key and moment are looked up once."""
    h = spark.range(200).selectExpr("cast(id as string) as k", "date '2020-01-01' as d", "1 as v")
    plans = []
    for n in (50, 150_000):
        c = spark.range(n).selectExpr("cast(id % 100 as string) as k", "date '2019-12-01' as s", "date '2020-02-01' as e")
        found = latest_in_interval(c, h, ["k"], "s", "e", "d", ["v"])
        plans.append(found._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi"))
        assert found.filter("v = 1").count() == n
    assert plans[0] == plans[1] > 0
    mostly = spark.createDataFrame([(None, 1)] * 30 + [("a", 2)] * 30, "k STRING, i INT").selectExpr(
        "k", "date '2019-12-01' as s", "date '2020-02-01' as e", "i")
    known = spark.createDataFrame([("a", DAY0, 7), (None, DAY0, 9)], "k STRING, d DATE, v INT")
    got = latest_in_interval(mostly, known, ["k"], "s", "e", "d", ["v"]).groupBy("k", "v").count().collect()
    assert {(r.k, r.v, r["count"]) for r in got} <= {(None, None, 30), ("a", 7, 30), ("a", None, 30)} and len(got) == 2
