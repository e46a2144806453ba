import numpy as np
import pytest
from pyspark.sql import functions as F

from outagelab.functions import importance_share
from outagelab.modeling import evaluation as ev


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 200)
    score = np.round(rng.normal(y, 1.0), 1)
    return spark.createDataFrame([(int(a), int(s > 0.5), float(s)) for a, s in zip(y, score)],
                                 "label INT, prediction INT, score DOUBLE")


def test_confusion_and_rates(scored):
    pdf = scored.toPandas()
    row = ev.rate_set(ev.confusion(scored)).first()
    tn = ((pdf.label == 0) & (pdf.prediction == 0)).sum()
    fp = ((pdf.label == 0) & (pdf.prediction == 1)).sum()
    assert (row.tn, row.fp, row.tn + row.fp + row.fn + row.tp) == (tn, fp, 200)
    assert row.fpr == pytest.approx(fp / (fp + tn)) and row.tpr + row.fnr == pytest.approx(1)
    assert row.acc == pytest.approx((pdf.label == pdf.prediction).mean()) == ev.accuracy(scored).first()[0]


def test_rates_without_a_class_are_null(spark):
    df = spark.createDataFrame([(1, 1)], "label INT, prediction INT")
    assert ev.rate_set(ev.confusion(df)).first().fpr is None


def test_report(scored):
    got = {r["class"]: r for r in ev.classification_report(scored).collect()}
    pdf = scored.toPandas()
    hit = ((pdf.label == 1) & (pdf.prediction == 1)).sum()
    p, r = hit / (pdf.prediction == 1).sum(), hit / (pdf.label == 1).sum()
    assert (got["1"].precision, got["1"].recall, got["1"].f1) == pytest.approx((p, r, 2 * p * r / (p + r)))
    assert got["macro avg"].f1 == pytest.approx((got["0"].f1 + got["1"].f1) / 2)
    assert got["weighted avg"].support == 200


def test_report_of_a_class_never_predicted_is_zero(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "label INT, prediction INT")
    row = {r["class"]: r for r in ev.classification_report(df).collect()}["1"]
    assert (row.precision, row.recall, row.f1) == (0.0, 0.0, 0.0)


def test_auc_equals_rank_statistic_and_curve_area(scored):
    pdf = scored.toPandas()
    pos, neg = pdf[pdf.label == 1].score.to_numpy(), pdf[pdf.label == 0].score.to_numpy()
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert ev.auc(scored, slices=9).first().auc == pytest.approx(want)
    pts = sorted((r.fpr, r.tpr) for r in ev.roc_points(scored, slices=9).collect())
    x, y = np.array([(0.0, 0.0), *pts]).T
    assert np.trapezoid(y, x) == pytest.approx(want) and pts[-1] == (1.0, 1.0)


def test_curve_start(scored):
    both = scored.withColumn("g", F.lit("a")).unionByName(scored.withColumn("g", F.lit("b")))
    begun, plain = ev.roc_points(both, by=["g"], start=True), ev.roc_points(both, by=["g"])
    added = [tuple(r) for r in begun.exceptAll(plain).collect()]
    assert sorted(added) == [("a", None, 0, 0, 0.0, 0.0), ("b", None, 0, 0, 0.0, 0.0)]
    assert plain.exceptAll(begun).count() == 0 and begun.schema == plain.schema
    assert ev.roc_points(scored.limit(0), start=True).count() == 0


def test_auc_by_group(scored):
    both = scored.withColumn("g", F.lit("a")).unionByName(scored.withColumn("g", F.lit("b")).withColumn("score", -F.col("score")))
    got = {r.g: r.auc for r in ev.auc(both, by=["g"]).collect()}
    assert got["a"] + got["b"] == pytest.approx(1)


def test_score_summary_uses_population_deviation(spark):
    df = spark.createDataFrame([(0.5,), (0.7,), (0.9,)], "acc DOUBLE")
    row = ev.score_summary(df, ["acc"]).first()
    assert (row["mean"], row["std"]) == pytest.approx((0.7, np.std([0.5, 0.7, 0.9])))


def test_importances(spark):
    w = spark.createDataFrame([("a", -3.0), ("b", 1.0), ("c", 0.0)], "feature STRING, weight DOUBLE")
    table = ev.weight_importances(w)
    assert [(r.feature, r.importance) for r in table.collect()] == [("a", 75.0), ("b", 25.0), ("c", 0.0)]
    assert sum(r[0] for r in w.select(importance_share(F.col("weight"))).collect()) == pytest.approx(100)
    runs = {"x": table, "y": ev.weight_importances(w.filter("feature <> 'a'"))}
    got = {r.feature: (r.rank_x, r.rank_y, r.rank_delta) for r in ev.compare_importances(runs).collect()}
    assert got == {"a": (1, None, None), "b": (2, 1, -1), "c": (3, 2, -1)}
