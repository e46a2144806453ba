import numpy as np
import pytest
from pyspark.sql import functions as F

from outagelab.modeling import estimators as est
from outagelab.modeling import importance as imp
from outagelab.modeling import search as sr
from outagelab.modeling.explain import explain_rows, perturbed
from outagelab.operators.cohort import fold_by_rank
from outagelab.plans import models
from outagelab.plans.prepare import Wide

FEATURES = ["signal", "noise", "software_4.9.16", "flat"]


@pytest.fixture(scope="module")
def splits(spark):
    rng = np.random.default_rng(7)
    data = []
    for i in range(240):
        y = i % 2
        data.append((f"d{i}", int(rng.random() < (0.9 if y else 0.2)), float(rng.normal()),
                     int(rng.random() < (0.6 if y else 0.4)), 1, y, ("train", "train", "train", "test", "valid")[i % 5]))
    df = spark.createDataFrame(data, "asset_id STRING, signal INT, noise DOUBLE, `software_4.9.16` INT, flat INT, "
                                     "y_flag INT, split STRING")
    return Wide(df, ["signal", "software_4.9.16", "flat"], ["noise"])


def test_selection_drops_constant_and_leak_columns(splits):
    assert models.selected_features(splits, drop=["noise"]) == ["signal", "software_4.9.16"]


def test_models_find_the_signal(spark, splits):
    data = models.vectors(splits, "train", FEATURES).persist()
    rows = data.count()
    for make in (est.logistic(1.0, rows), est.linear_svm(0.1, rows), est.decision_tree(max_depth=3),
                 est.random_forest(10, 4)):
        model = make.fit(data)
        table = models.importances(spark, model, FEATURES).collect()
        assert table[0].feature == "signal"
        total = 1 if hasattr(model, "featureImportances") else 100
        assert sum(r.importance for r in table) == pytest.approx(total)
    report = {r.split: r for r in models.evaluate(model, splits, FEATURES).collect()}
    assert set(report) == {"train", "test", "valid"} and report["test"].auc > 0.7


def test_kfold_and_searches(spark, splits):
    data = fold_by_rank(models.vectors(splits, "train", FEATURES), "asset_id", 3)
    table = sr.kfold_metrics(data, {"tree": est.decision_tree(max_depth=2), "bayes": est.gaussian_bayes()}, 3)
    assert table.count() == 6 and table.filter("test_acc between 0 and 1 and fpr between 0 and 1").count() == 6
    tree = est.decision_tree()
    maps = sr.tree_grid(tree, ("gini",), (1, 2), (1, 3))
    assert len(maps) == 4 and sr.draw(maps, 2, 5) == sr.draw(maps, 2, 5)
    fitted = sr.search(data, tree, maps, k=3, fold="fold")
    scores = sr.search_table(spark, fitted, maps).collect()
    assert len(scores) == 4 and max(r.score for r in scores) > 0.7


def test_ablation_removes_the_family(splits):
    out = sr.ablation(lambda cols: models.vectors(splits, "train", cols), lambda d: est.decision_tree(max_depth=2).fit(d),
                      FEATURES, "software_")
    assert out["all"][0].numFeatures == 4 and out["without"][1] == ["signal", "noise", "flat"]


def test_ablation_query_searches_the_study_table(spark, splits, monkeypatch):
    from types import SimpleNamespace

    from outagelab.queries import model_queries
    calls = []

    def search(of, features, **options):
        calls.append((list(features), options))
        return SimpleNamespace(bestModel=est.random_forest(3, 2).fit(models.vectors(of, "train", features)))

    monkeypatch.setattr(model_queries, "_study_features", lambda spark, d: (splits, FEATURES), raising=False)
    monkeypatch.setattr(model_queries, "prepared", lambda spark, d: splits)
    monkeypatch.setattr(models, "tuned_forest", search)
    out = model_queries.ablation(spark, "unused").collect()
    assert calls == [(FEATURES, {}), (["signal", "noise", "flat"], {})] and len(out) == 4


def test_model_file_round_trip(splits, tmp_path):
    model = est.logistic(1.0, 100).fit(models.vectors(splits, "train", FEATURES))
    imp.save_model(model, str(tmp_path / "m"))
    loaded = imp.load_model(str(tmp_path / "m"))
    assert loaded.coefficients == model.coefficients
    assert loaded.getOrDefault("regParam") == model.getOrDefault("regParam")


def test_explanation_recovers_a_linear_effect(splits):
    data = models.vectors(splits, "train", ["signal", "noise"])
    model = est.logistic(1.0, 100).fit(data)
    rows = models.vectors(splits, "valid", ["signal", "noise"])
    cloud = perturbed(rows, "asset_id", 2, 20)
    assert cloud.filter("copy = 0").filter(F.expr("exists(z, v -> v <> 0)")).count() == 0
    local = explain_rows(model, rows, "asset_id", ["signal", "noise"], samples=40)
    mean = {r.feature: r.m for r in local.groupBy("feature").agg(F.avg("weight").alias("m")).collect()}
    assert mean["signal"] > 3 * abs(mean["noise"]) > 0


def test_explanation_sums_moments_per_key(spark):
    """Repeated and null keys are one group each, and no group of copies is shuffled."""
    rng = np.random.default_rng(5)
    keys = [1, 2, 2, None, None, 3]
    x = rng.normal(size=(len(keys), 2)).tolist()
    from pyspark.ml.functions import array_to_vector
    rows = spark.createDataFrame(list(zip(keys, x)), "id BIGINT, x ARRAY<DOUBLE>").withColumn("features", array_to_vector("x")).drop("x")
    model = est.logistic(1.0, 100).fit(rows.withColumn("label", F.pmod(F.coalesce("id", F.lit(0)), F.lit(2)).cast("double")))
    out = explain_rows(model, rows, "id", ["a", "b"], samples=30, width=1.0)
    plan = out._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan and "MapInArrow" in plan
    got = {(r.id, r.feature): r.weight for r in out.collect()}
    cloud = est.scored(model, perturbed(rows, "id", 2, 30)).select("id", "z", "score").collect()
    assert len(got) == 8
    for key in (1, 2, None, 3):
        own = [r for r in cloud if r.id == key]
        z = np.array([r.z for r in own])
        one, w = np.hstack([np.ones((len(z), 1)), z]), np.exp(-(z ** 2).sum(1))
        beta = np.linalg.solve((one * w[:, None]).T @ one + 1e-6 * np.eye(3), (one * w[:, None]).T @ np.array([r.score for r in own]))
        assert [got[key, "a"], got[key, "b"]] == pytest.approx(beta[1:])


def test_fits_have_a_bounded_number_of_tasks(spark, monkeypatch):
    most = 3 * spark.sparkContext.defaultParallelism
    assert est.tasks_worth(spark, 0) == est.tasks_worth(spark, 10_000) == 1
    assert est.tasks_worth(spark, 10 ** 9) == most
    monkeypatch.setattr(est, "ROWS_PER_TASK", 1)
    with models.kept(spark.range(0, 400, 1, 40)) as rows:
        assert rows.rdd.getNumPartitions() == most


def test_predictions_are_scored_once(spark, splits):
    scored = spark.sparkContext.accumulator(0)

    class Counting:
        def transform(self, df):
            def count(batches):
                for batch in batches:
                    scored.add(len(batch))
                    yield batch.assign(prediction=1.0, p=0.5)
            from pyspark.ml.functions import array_to_vector, vector_to_array
            plain = df.withColumn("features", vector_to_array("features"))
            out = plain.mapInPandas(count, "asset_id string, split string, label double, features array<double>, prediction double, p double")
            return out.withColumn("probability", array_to_vector(F.array("p", "p"))).drop("p")

    assert models.evaluate(Counting(), splits, FEATURES).count() == 3
    assert scored.value == splits.df.count()


def test_depth_beyond_the_limit_is_an_error():
    with pytest.raises(ValueError):
        est.decision_tree(max_depth=31)
    with pytest.raises(ValueError):
        est.random_forest(max_depth=50)
