import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from outagelab.operators import activity as act
from outagelab.operators import cohort as co
from outagelab.operators import features as fe
from outagelab.operators import joins as jo
from outagelab.operators import profiles as pr


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# Joins

def test_anti_join_survives_a_null_in_the_list(spark):
    left = spark.createDataFrame([("a",), ("b",), (None,)], "k STRING")
    listed = spark.createDataFrame([("A",), ("b",), (None,)], "x STRING")
    assert rows(jo.anti_join_keys(left, "k", listed, "x")) == [("a",)]
    assert rows(jo.anti_join_keys(left, "k", listed, "x", fold_case=True)) == []


def test_semi_join_never_multiplies(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2)], "k STRING, v INT")
    listed = spark.createDataFrame([("a",), ("a",), (None,)], "x STRING")
    assert rows(jo.semi_join_keys(left, "k", listed, "x")) == [("a", 1)]


def test_next_day_folded_join(spark):
    left = spark.createDataFrame([("w1", dt.datetime(2020, 6, 1, 22)), ("w2", dt.datetime(2020, 6, 1, 1))], "a STRING, t TIMESTAMP")
    right = spark.createDataFrame([("W1", dt.date(2020, 6, 2), "x"), ("W1", dt.date(2020, 6, 1), "y")], "b STRING, d DATE, s STRING")
    got = jo.next_day_folded_join(left, right, "a", "b", "t", "d").select("a", "s")
    assert rows(got) == [("w1", "x"), ("w2", None)]


def test_cast_key_join(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id BIGINT, v STRING")
    b = spark.createDataFrame([("1", "p")], "key STRING, w STRING")
    assert rows(jo.cast_key_join(a, b, "id", "key", "left").select("v", "w")) == [("x", "p"), ("y", None)]


def test_star_join_and_uniqueness_guard(spark):
    anchor = spark.createDataFrame([(1,), (2,)], "k INT")
    a = spark.createDataFrame([(1, "x")], "k INT, a STRING")
    twice = spark.createDataFrame([(1, "x"), (1, "y")], "k INT, b STRING")
    assert rows(jo.star_join(anchor, [jo.assert_unique(a, "k", "a")], "k")) == [(1, "x"), (2, None)]
    with pytest.raises(Exception, match="more than one row"):
        jo.star_join(anchor, [jo.assert_unique(twice, "k", "b")], "k").collect()


# Cohorts

def test_cap_drops_null_types_and_duplicates(spark):
    df = spark.createDataFrame([("a", "T"), ("a", "T"), ("b", "T"), ("c", "T"), ("d", None)], "tag STRING, type STRING")
    got = co.cap_per_type(df, "type", "tag", 2)
    assert rows(got.select("tag", "rn")) == [("a", 1), ("b", 2)]


def test_labels_case_is_one(spark):
    a = spark.createDataFrame([("x",), ("x",)], "k STRING")
    b = spark.createDataFrame([("y",)], "k STRING")
    assert rows(co.label_frame(a, b, "k")) == [("x", 1), ("y", 0)]


def test_samples_have_exact_sizes(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    sample = co.sample_exact(df, "k", 123)
    assert sample.count() == 123 == sample.distinct().count()
    assert rows(sample) == rows(co.sample_exact(df.repartition(5), "k", 123))
    cases = spark.range(1000, 1040).withColumnRenamed("id", "k")
    assert co.balance_down(cases, df, "k").count() == 80
    up = co.sample_up(cases, "k", 130)
    assert up.count() == 130
    assert up.groupBy("k").count().agg(F.min("count"), F.max("count")).first() == (3, 4)


def test_split_is_a_partition_of_exact_sizes(spark):
    df = spark.range(203).withColumnRenamed("id", "k")
    shares = [("train", 0.6), ("test", 0.2), ("valid", 0.2)]
    got = co.split_exact(df, "k", shares)
    assert {r["split"]: r["count"] for r in got.groupBy("split").count().collect()} == {"train": 121, "test": 41, "valid": 41}
    assert got.select("k").distinct().count() == 203
    loose = co.split_by_hash(df, "k", shares)
    again = {r.k: r.split for r in co.split_by_hash(spark.range(400).withColumnRenamed("id", "k"), "k", shares).collect()}
    assert all(again[r.k] == r.split for r in loose.collect())


def test_folds_and_class_weights(spark):
    df = spark.range(103).withColumn("y", (F.col("id") % 4 == 0).cast("int"))
    sizes = [r["count"] for r in co.fold_by_rank(df, "id", 5).groupBy("fold").count().collect()]
    assert sum(sizes) == 103 and max(sizes) - min(sizes) <= 1
    weights = co.class_weights(df, "y").groupBy("y").agg(F.first("weight").alias("w"), F.count("*").alias("n")).collect()
    assert {r.y: r.w for r in weights} == pytest.approx({r.y: 103 / (2 * r.n) for r in weights})


# Activity

def test_two_level_average_weights_days_equally(spark):
    df = spark.createDataFrame([("a", 1, 10.0), ("a", 1, 10.0), ("a", 2, 2.0)], "k STRING, d INT, v DOUBLE")
    assert rows(act.two_level_avg(df, ["k"], ["d"], {"v": F.sum("v")})) == [("a", 11.0)]


def test_month_pivot_equals_folded_sparse_rows(spark):
    df = spark.createDataFrame([("a", 6, 1.5), ("a", 7, None), ("b", 8, 2.0)], "k STRING, m INT, v DOUBLE")
    names = {"v": {6: "jun", 7: "jul"}}
    assert rows(act.month_pivot(df, "k", "m", names)) == [("a", 1.5, 0.0), ("b", 0.0, 0.0)]
    sparse = df.select("k", *[c.alias(n) for n, c in act.month_rows(df, "m", names).items()])
    assert rows(sparse) == [("a", 0.0, None), ("a", 1.5, 0.0), ("b", 0.0, 0.0)]


def test_gap_days(spark):
    day = dt.date(2020, 6, 1)
    df = spark.createDataFrame([("a", day, day), ("a", day, None), ("a", dt.date(2020, 6, 2), day)], "k STRING, e DATE, s DATE")
    assert rows(act.gap_days(df, "k", F.col("e"), F.col("s"))) == [("a", 6, 2, 1, 1)]


def test_any_flag_and_min_per_type(spark):
    df = spark.createDataFrame([("a", None, 0.0), ("b", "x", 3.0), ("b", None, 2.0)], "k STRING, i STRING, v DOUBLE")
    assert rows(act.any_flag(df, "k", "i", "f")) == [("a", 0), ("b", 1)]
    assert rows(act.min_per_type(df, F.col("k"), "v", "low")) == [("b", 2.0)]


# Features

def test_multi_hot_is_per_key_not_per_row(spark):
    df = spark.createDataFrame([("a", "x", True), ("a", "y", True), ("b", None, None)], "k STRING, v STRING, f BOOLEAN")
    long = fe.long_attributes(df, "k", ["v", "f"])
    vocab = fe.vocabulary(long)
    assert vocab == {"f": ["True"], "v": ["unknown", "x"]}
    hot = fe.multi_hot(long, "k", vocab)
    assert hot.columns == ["k", "f_True", "v_unknown", "v_x"]
    assert rows(hot) == [("a", 1, 0, 1), ("b", 0, 1, 0)]


def test_wide_and_narrow_multi_hot_agree(spark):
    pairs = [(i % 17, f"v.{i % 90:02d}'\\") for i in range(400)]
    long = fe.long_attributes(spark.createDataFrame(pairs, "k INT, v STRING"), "k", ["v"])
    names = fe.vocabulary(long, drop_reference=False)["v"]
    few = fe.multi_hot(long, "k", {"v": names[:50]}, naming=lambda n: n)
    many = fe.multi_hot(long, "k", {"v": names}, naming=lambda n: n)
    assert rows(few) == rows(many.select("k", *[F.col(f"`{c}`") for c in few.columns[1:]]))


def test_vocabulary_keeps_shared_values_and_drops_one_reference(spark):
    a = spark.createDataFrame([("v", "p"), ("v", "q"), ("v", "z")], "variable STRING, value STRING")
    b = spark.createDataFrame([("v", "q"), ("v", "r"), ("v", "z")], "variable STRING, value STRING")
    assert fe.vocabulary(a, b) == {"v": ["q"]}


def test_safe_names_stay_unique():
    names = fe.column_names({"v": ["4.9", "4/9", "4 9"]})
    assert len(set(names.values())) == 3 and all("." not in n for n in names.values())


def test_deciles_match_qcut(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.gamma(2, 10, 333), 2)
    df = spark.createDataFrame([(float(v),) for v in x], "x DOUBLE")
    edges = fe.decile_edges(df, "x")
    codes, want = pd.qcut(x, 10, retbins=True, labels=False)
    assert edges == pytest.approx(list(want))
    got = sorted((r.x, r.b) for r in df.select("x", fe.bin_number(F.col("x"), edges).alias("b")).collect())
    assert got == sorted(zip(x, (int(c) + 1 for c in codes)))
    assert fe.bin_label([0.123456, 1.5], 1) == "0.1235_1.5"
    label = df.select(fe.bin_labels(F.col("x"), edges).alias("l")).distinct().count()
    assert label == 10


def test_zscore_constant_column_is_zero(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (6.0, 5.0)], "`a.b` DOUBLE, c DOUBLE")
    got = fe.ZScore.fit(df, ["a.b", "c"]).apply(df).toPandas()
    want = (pd.Series([1.0, 2.0, 6.0]) - 3) / pd.Series([1.0, 2.0, 6.0]).std()
    assert sorted(got["a.b"]) == pytest.approx(sorted(want)) and set(got["c"]) == {0.0}


def test_variance_threshold_is_population_and_strict(spark):
    df = spark.createDataFrame([(i, int(i == 0), 1) for i in range(10)], "a INT, tenth INT, one INT")
    # var_pop of one in ten is exactly 0.09: not above the threshold.
    assert fe.variance_filter(df, ["a", "tenth", "one"], threshold=0.0900001) == ["a"]
    assert fe.variance_filter(df, ["tenth"], threshold=0.0899) == ["tenth"]


def test_column_sets(spark):
    a = spark.createDataFrame([(1, 2, 3)], "k INT, x INT, p INT")
    b = spark.createDataFrame([(1, 2, 3)], "k INT, q INT, x INT")
    assert fe.common_columns(a, b) == ["k", "x"] and fe.one_sided_columns(a.columns, b.columns) == ["p", "q"]
    assert [f.columns for f in fe.align(a, b)] == [["k", "x"], ["k", "x"]]
    assert fe.drop_columns(a, ["x"], ["p"]).columns == ["k"]
    assert fe.label_last(a, "k", "x").columns == ["k", "p", "x"]


# Profiles

def wide(spark):
    data = [(i, "train" if i % 3 else "test", int(i % 5 == 0), int(i % 2 == 0), int(i % 10 == 0), float(i)) for i in range(60)]
    return spark.createDataFrame(data, "k INT, split STRING, y_flag INT, even INT, ten INT, v DOUBLE")


def test_prevalence_counts_and_shares(spark):
    table = pr.prevalence(wide(spark), ["even", "ten"], "k")
    assert rows(table) == rows(pr.prevalence(wide(spark), ["even", "ten"], "k", one_row_per_key=True))
    pdf = table.toPandas()
    assert pdf.groupby(["variable", "split"])["pct"].sum().tolist() == pytest.approx([100.0] * 4)
    ten = pdf[(pdf.variable == "ten") & (pdf.split == "train")]
    assert list(ten.y_flag) == [1] and list(ten.devices) == [4]
    # "even" is 80% one class: kept by the device limit on train, dropped by the test rule.
    assert rows(pr.prevalence_drop_list(table, max_devices=5)) == [("even",), ("ten",)]
    assert rows(pr.prevalence_drop_list(table.filter("split = 'train'"), max_devices=5)) == [("ten",)]
    assert rows(pr.prevalence_drop_list(table.filter("split = 'train'"), max_devices=4)) == []


def test_numeric_profile_matches_pandas(spark):
    got = pr.numeric_profile(wide(spark), ["v"]).toPandas().set_index("split")
    pdf = wide(spark).toPandas()
    for split in ("train", "test"):
        for y in (0, 1):
            v = pdf[(pdf.split == split) & (pdf.y_flag == y)]["v"]
            r = got.loc[split]
            assert (r[f"mean_{y}"], r[f"median_{y}"], r[f"min_{y}"], r[f"max_{y}"]) == pytest.approx(
                (v.mean(), v.median(), v.min(), v.max()))


def test_correlations_match_pandas(spark):
    df = wide(spark)
    pdf = df.toPandas()
    got = {r.variable: r["corr"] for r in pr.label_correlation(df, ["even", "ten", "v"], "y_flag").collect()}
    assert got == pytest.approx(pdf[["even", "ten", "v"]].corrwith(pdf["y_flag"]).to_dict())
    matrix = {(r.a, r.b): r["corr"] for r in pr.correlation_matrix(df, ["even", "v"]).collect()}
    assert matrix[("even", "v")] == matrix[("v", "even")] == pytest.approx(pdf["even"].corr(pdf["v"]))


def test_nonzero_profile_and_null_columns(spark):
    df = spark.createDataFrame([(1, 0, 2), (2, None, 0)], "k INT, a INT, b INT")
    assert rows(fe.nonzero_profile(df, "k", ["a", "b"])) == [(1, "b", 2.0)]
    assert rows(pr.null_columns(df, ["a", "b"])) == [("a", 1), ("b", 0)]


def test_vocabulary_limit_counts_columns_only(spark):
    """Values that one cohort holds alone become no columns, so they do not count against the limit."""
    own = spark.range(50).selectExpr("'v' as variable", "concat('x', id) as value", "1 as src")
    both = spark.createDataFrame([("v", c, s) for c in ("a", "b", "z") for s in (1, 2)], "variable STRING, value STRING, src INT")
    rows = own.unionByName(both)
    assert fe.vocabulary_by_source(rows, "src", max_columns=2) == {"v": ["a", "b"]}
    with pytest.raises(ValueError):
        fe.vocabulary_by_source(rows, "src", max_columns=1)


def test_vocabulary_rows_are_the_vocabulary_and_stay_in_spark(spark, monkeypatch):
    a = spark.createDataFrame([(1, "x", "p"), (1, "x", "q"), (2, "x", "r"), (2, "y", "k")], "id INT, variable STRING, value STRING")
    b = spark.createDataFrame([(3, "x", "p"), (3, "x", "q"), (3, "y", "k"), (4, "x", "r"), (4, "z", "m")], "id INT, variable STRING, value STRING")
    want = {(k, v) for k, values in fe.vocabulary(a, b).items() for v in values}
    monkeypatch.setattr(type(a), "collect", lambda self: pytest.fail("rows travel to the driver"))
    rows = fe.vocabulary_rows(a, b)
    monkeypatch.undo()
    assert {tuple(r) for r in rows.collect()} == want == {("x", "p"), ("x", "q")}
    assert fe.vocabulary_rows(a.limit(0), b).collect() == []
