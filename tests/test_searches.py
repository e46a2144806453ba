"""Searches that share fits or passes, against one fit per setting."""

import numpy as np
import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from outagelab.modeling import estimators as est
from outagelab.modeling import forest, kernel, linear, nested


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(240):
        x = [float(v) for v in rng.normal(size=3)] + [float(rng.random() < 0.4), 1.0]
        label = float(rng.random() < 1 / (1 + np.exp(-(1.5 * x[0] - x[1] + x[3]))))
        rows.append((i, label, x, i % 4, 1.0 + label))
    df = spark.createDataFrame(rows, "id INT, label DOUBLE, x ARRAY<DOUBLE>, fold INT, weight DOUBLE")
    out = df.withColumn("features", array_to_vector("x")).drop("x").coalesce(1).persist()
    yield out
    out.unpersist()


def scores(model, rows, metric="accuracy"):
    return MulticlassClassificationEvaluator(metricName=metric).evaluate(model.transform(rows))


def test_part_sizes():
    assert forest.part_sizes([300, 500], 500) == [300, 200]
    assert forest.part_sizes([3, 5], 2) == [2, 1, 2] and forest.part_sizes([4], 4) == [4]


def test_first_parts_are_a_smaller_forest(data):
    grown = forest.grow(data, 12, 5, 2, weight_col="weight", part=4)
    assert grown.trees == 12 and grown.first(8).trees == 8
    with pytest.raises(ValueError):
        grown.first(6)
    votes = grown.transform(data).select(vector_to_array("rawPrediction").alias("v"), "prediction", vector_to_array("probability").alias("p"))
    parts = [m.transform(data).select(vector_to_array("rawPrediction").alias("v")).collect() for m in grown.parts]
    for k, row in enumerate(votes.collect()):
        total = np.sum([part[k].v for part in parts], axis=0)
        assert row.v == pytest.approx(total) and sum(row.v) == pytest.approx(12) and row.p == pytest.approx(total / 12)
        assert row.prediction == float(np.argmax(total))
    alone = forest.GrownForest(grown.parts[:1])
    assert alone.featureImportances.toArray() == pytest.approx(grown.parts[0].featureImportances.toArray())
    assert grown.featureImportances.toArray().sum() == pytest.approx(1)


def test_forest_search_scores_every_size_from_one_growth(data):
    settings = [(4, 4, 1), (6, 4, 1), (4, 4, 9)]
    found = forest.search(data, settings, 4, weight_col="weight")
    assert list(found.scores) == settings and found.bestModel.trees == found.best[0]
    for trees, depth, leaf in settings:
        direct = []
        for i in range(4):
            sizes = [4, 2] if leaf == 1 else [4]
            parts = [forest._fit(data.where(F.col("fold") != i), n, k, depth, leaf, 42, "weight") for k, n in enumerate(sizes)]
            model = forest.GrownForest(tuple(parts)).first(trees)
            direct.append(scores(model, data.where(F.col("fold") == i), "f1"))
        assert found.scores[trees, depth, leaf] == pytest.approx(np.mean(direct))


def test_cuts_of_one_tree_equal_trees_fitted_alone(data, spark):
    found = nested.search(data, 4, ("gini", "entropy"), (1, 2, 5), (1, 6), (1, 30))
    assert len(found.rows) == 24 and found.small_splits == 0
    for row in found.rows:
        if row["min_split"] == 1 and (row["impurity"], row["max_depth"], row["min_leaf"]) in {("gini", 2, 6), ("entropy", 5, 1)}:
            direct = [est.decision_tree(row["impurity"], row["max_depth"], row["min_leaf"]).fit(data.where(F.col("fold") != i))
                      for i in range(4)]
            assert row["test_acc"] == pytest.approx(np.mean([scores(m, data.where(F.col("fold") == i)) for i, m in enumerate(direct)]))
            assert row["train_acc"] == pytest.approx(np.mean([scores(m, data.where(F.col("fold") != i)) for i, m in enumerate(direct)]))
    assert scores(found.bestModel, data) >= 0.5


def test_minimum_split_turns_small_nodes_into_leaves(data, spark):
    model = est.decision_tree("gini", 5, 1).fit(data)
    ways = nested.ways_of(model, spark)
    assert len(ways.ways) == model.numNodes - len(ways.splits) and {w[0].count for w in ways.ways} == {240}
    for least in (1, 30, 100, 241):
        cut = nested.CutTree(model, ways, 5, least)
        ends = ways.ends(5, least)
        assert all(end is way[-1] or end.count < least for end, way in zip(ends, ways.ways))
        assert all(step.count >= least for end, way in zip(ends, ways.ways) for step in way[:way.index(end)])
        rows = cut.transform(data).select("prediction", vector_to_array("probability").alias("p")).collect()
        assert all(r.prediction == float(np.argmax(r.p)) for r in rows if r.p[0] != r.p[1])
    assert {r.prediction for r in rows} == {ways.ways[0][0].prediction}


def test_shared_logistic_fits_are_at_their_solution(data):
    found = linear.search(data, (0.01, 1.0, 100.0), ("l1", "l2"), 4)
    assert found.residual.max() < 1e-5 and len(found.settings) == 30 and set(found.scores) == {
        (c, p) for c in (0.01, 1.0, 100.0) for p in ("l1", "l2")}
    for cost, penalty in ((1.0, "l2"), (1.0, "l1")):
        left = data.where("fold <> 2")
        direct = est.logistic(cost, left.count(), penalty, maxIter=1000, tol=1e-10).fit(left)
        own = found.weights[:, found.settings.index(linear.Setting(cost, penalty, 2))]
        assert direct.coefficients.toArray() == pytest.approx(own[1:], abs=2e-3) and direct.intercept == pytest.approx(own[0], abs=2e-3)
    strong = found.weights[:, found.settings.index(linear.Setting(0.01, "l1", None))]
    assert np.all(strong[1:] == 0)
    rows = found.bestModel.transform(data).select("prediction", vector_to_array("probability").alias("p"))
    assert rows.where("prediction <> cast(p[1] > 0.5 as double)").count() == 0
    assert found.scores[found.best] > 0.65


def test_hinge_is_close_to_the_linear_machine(data):
    found = linear.search(data, (0.1,), k=4, loss="hinge", tol=1e-5)
    machine = est.linear_svm(0.1, data.count(), maxIter=500, tol=1e-9).fit(data)
    same = found.bestModel.transform(data).select("id", F.col("prediction").alias("a")).join(
        machine.transform(data).select("id", F.col("prediction").alias("b")), "id")
    assert same.where("a = b").count() >= 0.95 * data.count()


def test_kernel_search_finds_a_ring(spark):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(400, 2)) * 1.2
    rows = [(float(x * x + y * y < 1.4), [float(x), float(y)], k % 4) for k, (x, y) in enumerate(points)]
    ring = spark.createDataFrame(rows, "label DOUBLE, x ARRAY<DOUBLE>, fold INT").withColumn("features", array_to_vector("x")).persist()
    straight = linear.search(ring, (0.1, 10.0), k=4, loss="hinge", max_iter=30)
    found = kernel.rbf_search(ring, (0.1, 10.0), (1.0, 0.0001), 4, width=64, max_iter=30)
    assert set(found.scores) == {(g, c) for g in (1.0, 0.0001) for c in (0.1, 10.0)} and found.best[0] == 1.0
    assert found.scores[found.best] > 0.85 > max(straight.scores.values()) + 0.1
    out = found.bestModel.transform(ring)
    assert scores(found.bestModel, ring) > 0.85 and len(out.first()["features"]) == 2
    ring.unpersist()


def test_fourier_features_approximate_the_kernel():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(2, 200, 3))
    for gamma in (1.0, 0.1):
        features = kernel.FourierFeatures(gamma, 3, 4096)
        got = (features.map(x) * features.map(y)).sum(1)
        assert np.sqrt(np.mean((got - np.exp(-gamma * ((x - y) ** 2).sum(1))) ** 2)) < 0.03


def test_probabilities_of_a_machine(data):
    machine = kernel.calibrate(lambda rows: est.linear_svm(0.1, rows.count()).fit(rows), data, 4)
    assert machine.slope > 0
    held = kernel.held_out_margins(lambda rows: est.linear_svm(0.1, rows.count()).fit(rows), data, 4)
    mean, share, n = held.agg(F.avg(1 / (1 + F.exp(-(F.col("margin") * machine.slope + machine.offset)))), F.avg("label"), F.count("*")).first()
    assert n == 240 and mean == pytest.approx(share, abs=1e-5)
    rows = est.scored(machine, data).select("score").collect()
    assert all(0 < r.score < 1 for r in rows)


def test_calibration_runs_in_no_more_tasks_than_the_data(data, monkeypatch):
    seen = []

    class Watched(linear.SharedFit):
        def __init__(self, rows, *args):
            seen.append(rows.rdd.getNumPartitions())
            super().__init__(rows, *args)

    monkeypatch.setattr(kernel, "SharedFit", Watched)
    kernel.calibrate(lambda rows: est.linear_svm(0.1, rows.count(), maxIter=5).fit(rows), data, 4)
    assert seen == [1]


def test_kernel_of_neighbours(spark, monkeypatch):
    """Rows without a key are left out, pairs follow the key, and the keys never meet in one row."""
    from outagelab.plans.prepare import Wide
    from outagelab.queries import model_checks

    rng = np.random.default_rng(2)
    keys = [9000, 5, 4100, 70, None, 8200]
    x = rng.normal(size=(len(keys), 2))
    rows = [(k, float(a), float(b), i % 2, "train") for i, (k, (a, b)) in enumerate(zip(keys, x))]
    splits = Wide(spark.createDataFrame(rows, "asset_id BIGINT, a DOUBLE, b DOUBLE, y_flag INT, split STRING"), [], ["a", "b"])
    monkeypatch.setattr(model_checks, "prepared", lambda spark, d: splits)
    monkeypatch.setattr(model_checks, "FEATURES", ["a", "b"])
    found = model_checks.kernel_error(spark, "unused")
    assert "collect_list" not in found._jdf.queryExecution().toString()
    order = [i for i in sorted(range(len(keys)), key=lambda i: keys[i] or 0) if keys[i] is not None]
    d2 = ((x[order[1:]] - x[order[:-1]]) ** 2).sum(1)
    got = {r.gamma: r for r in found.collect()}
    assert set(got) == set(kernel.SVM_GAMMA)
    for gamma, r in got.items():
        assert r.pairs == 4 and r.mean_kernel == pytest.approx(np.exp(-gamma * d2).mean(), abs=1e-6) and r.close


def test_kernel_of_repeated_keys(spark, monkeypatch):
    """Two rows of one key are a pair too, and each pair meets the rows of its keys."""
    from outagelab.plans.prepare import Wide
    from outagelab.queries import model_checks

    rows = [(k, 0.5 * k, 1.0, 0, "train") for k in (1, 1, 2)]
    splits = Wide(spark.createDataFrame(rows, "asset_id BIGINT, a DOUBLE, b DOUBLE, y_flag INT, split STRING"), [], ["a", "b"])
    monkeypatch.setattr(model_checks, "prepared", lambda spark, d: splits)
    monkeypatch.setattr(model_checks, "FEATURES", ["a", "b"])
    # (1, 1) is found by 2 x 2 rows, (1, 2) by 2: six rows of key 1, joined with themselves.
    assert {r.pairs for r in model_checks.kernel_error(spark, "unused").collect()} == {36}


def test_product_of_mapped_vectors(spark, monkeypatch):
    monkeypatch.setattr(kernel, "PRODUCT_ROWS", 3)
    x = np.random.default_rng(4).normal(size=(8, 2, 3))
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(x)], "i INT, a ARRAY<DOUBLE>, b ARRAY<DOUBLE>")
    features = kernel.FourierFeatures(0.1, 3, 64)
    got = df.select("i", features.product(array_to_vector("a"), array_to_vector("b")).alias("p")).orderBy("i").collect()
    assert [r.p for r in got] == pytest.approx((features.map(x[:, 0]) * features.map(x[:, 1])).sum(1))
