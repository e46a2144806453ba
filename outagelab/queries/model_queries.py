"""Training, search, ablation and explanation on the customer table, with the study's full ranges.

Fitted weights depend on the optimizer, so these results have no check SQL; ``model_checks`` registers what SQL can say
about the same models.
"""

from __future__ import annotations

from functools import partial

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ..functions import rounded
from ..modeling import estimators as est
from ..modeling import evaluation as ev
from ..modeling import forest
from ..modeling import importance as imp
from ..modeling import search as sr
from ..modeling.explain import explain_rows
from ..operators.cohort import class_weights
from ..operators.features import ZScore
from ..plans import models
from ..plans.prepare import Wide
from ..sources import stage
from ..sources.sinks import stage_root
from .binding import source
from .operator_queries import FLAGS, NUMERICS, customer_wide
from .registry import query

FEATURES = [*FLAGS, *NUMERICS]


def prepared(spark, d) -> Wide:
    """The customer table, stored once, with its numerics scaled on the training rows."""
    raw = stage(customer_wide(spark, d).withColumnRenamed("custkey", "asset_id"), "customers")
    scaled = ZScore.fit(raw.filter(F.col("split") == "train"), NUMERICS).apply(raw)
    return Wide(stage(scaled, "scaled"), FLAGS, NUMERICS)


def _train(spark, splits: Wide):
    data = models.vectors(splits, "train", FEATURES).persist()
    return data, data.count()


def _report(model, splits: Wide):
    out = models.evaluate(model, splits, FEATURES)
    rates = ("tpr", "tnr", "ppv", "npv", "fpr", "fnr", "fdr", "acc", "auc")
    return out.withColumns({c: rounded(F.col(c)) for c in rates})


def _fit_and_report(spark, d, make):
    splits = prepared(spark, d)
    data, rows = _train(spark, splits)
    return _report(make(rows).fit(data), splits)


@query("train_lr")
def train_lr(spark, d):
    return _fit_and_report(spark, d, lambda n: est.logistic(1.0, n))


@query("train_svc")
def train_svc(spark, d):
    return _fit_and_report(spark, d, lambda n: est.linear_svm(0.1, n))


@query("train_dt")
def train_dt(spark, d):
    return _fit_and_report(spark, d, lambda n: est.decision_tree("entropy", 5, 5))


@query("train_rf")
def train_rf(spark, d):
    splits = prepared(spark, d)
    with models.kept(class_weights(models.vectors(splits, "train", FEATURES), "label")) as data:
        return _report(forest.grow(data, 100, est.MAX_DEPTH, 5, weight_col="weight"), splits)


@query("train_nb")
def train_nb(spark, d):
    return _fit_and_report(spark, d, lambda n: est.gaussian_bayes())


@query("train_gbt")
def train_gbt(spark, d):
    return _fit_and_report(spark, d, lambda n: est.boosted_trees())


@query("train_nb_embeddings")
def train_nb_embeddings(spark, d):
    """Gaussian naive Bayes with ten classes; training report per class."""
    data = source(spark, d, "embeddings").select(
        F.col("label").cast("double").alias("label"),
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features")).persist()
    return ev.classification_report(est.gaussian_bayes().fit(data).transform(data))


@query("baseline_kfold")
def baseline_kfold(spark, d):
    """Fold scores of the five baselines, summarised per model."""
    splits = prepared(spark, d)
    scores = models.baseline_scores(splits, models.selected_features(splits, drop=["returned"]))
    return ev.score_summary(scores, ["train_acc", "test_acc", "fpr"], by=["model"])


@query("grid_search")
def grid_search(spark, d):
    """Every tried logistic setting with its cross-validated accuracy."""
    return models.tuned_logistic(prepared(spark, d), FEATURES).table(spark)


@query("svm_search")
def svm_search(spark, d):
    """Every tried SVM cost with its cross-validated accuracy."""
    return models.tuned_svm(prepared(spark, d), FEATURES).table(spark)


@query("svm_rbf_search")
def svm_rbf_search(spark, d):
    """Every tried gamma and cost of the kernel machine with its cross-validated accuracy."""
    return models.tuned_rbf(prepared(spark, d), FEATURES).table(spark)


@query("tree_search")
def tree_search(spark, d):
    """Every tried tree setting, all 648, with its mean accuracy on the rows it was and was not fitted on."""
    return models.tuned_tree(prepared(spark, d), FEATURES).table(spark)


@query("svm_report")
def svm_report(spark, d):
    """The final machine, ranked by its calibrated probability, on each split."""
    splits = prepared(spark, d)
    return _report(models.calibrated_svm(splits, FEATURES), splits)


@query("model_report")
def model_report(spark, d):
    """Per-class report of the logistic model on each split."""
    splits = prepared(spark, d)
    data, rows = _train(spark, splits)
    return models.report(est.logistic(1.0, rows).fit(data), splits, FEATURES)


@query("model_roc")
def model_roc(spark, d):
    """ROC points of the SVM's margin on each split."""
    splits = prepared(spark, d)
    data, rows = _train(spark, splits)
    return models.roc(est.linear_svm(0.1, rows).fit(data), splits, FEATURES)


@query("random_search")
def random_search(spark, d):
    """Randomized forest search with balanced weights, reported on each split."""
    splits = prepared(spark, d)
    return _report(models.tuned_forest(splits, FEATURES).bestModel, splits)


def _importance(spark, d, make):
    splits = prepared(spark, d)
    data, rows = _train(spark, splits)
    return models.importances(spark, make(rows).fit(data), FEATURES)


query("importance_lr")(partial(_importance, make=lambda n: est.logistic(1.0, n)))
query("importance_svc")(partial(_importance, make=lambda n: est.linear_svm(0.1, n)))
query("importance_dt")(partial(_importance, make=lambda n: est.decision_tree()))
query("importance_rf")(partial(_importance, make=lambda n: est.random_forest()))


def _study_features(spark, d):
    """The study's splits, stored once, and its selected features."""
    from .study_queries import STUDY, _sampled
    from ..plans.prepare import normalised_splits

    splits = normalised_splits(_sampled(spark, d), STUDY)
    splits = Wide(stage(splits.df, "splits"), splits.flags, splits.numerics)
    return splits, models.selected_features(splits, profiled=models.drop_list(splits))


@query("ablation")
def ablation(spark, d):
    """Importances of the study's searched forests, with all features and without the software family."""
    splits, features = _study_features(spark, d)
    fitted = sr.ablation(lambda cols: cols, lambda cols: models.tuned_forest(splits, cols).bestModel, features, "software_")
    return ev.compare_importances({k: imp.tree_importance(spark, m, cols) for k, (m, cols) in fitted.items()})


@query("model_round_trip")
def model_round_trip(spark, d):
    """A model saved, loaded again and scored; predictions must agree with the original."""
    splits = prepared(spark, d)
    data, rows = _train(spark, splits)
    model = est.logistic(1.0, rows).fit(data)
    path = f"{stage_root(data.sparkSession)}/model-{model.uid}"
    imp.save_model(model, path)
    loaded = imp.load_model(path)
    a = est.scored(model, data).select("asset_id", F.col("prediction").alias("before"))
    b = est.scored(loaded, data).select("asset_id", F.col("prediction").alias("after"))
    return a.join(b, "asset_id").groupBy("before", "after").agg(F.count(F.lit(1)).alias("n"))


@query("explain_batch")
def explain_batch(spark, d):
    """Mean local weight of each feature over the devices of the validation split."""
    splits = prepared(spark, d)
    data, _ = _train(spark, splits)
    model = est.random_forest().fit(data)
    rows = models.vectors(splits, "valid", FEATURES)
    local = explain_rows(model, rows, "asset_id", FEATURES)
    return local.groupBy("feature").agg(F.avg("weight").alias("mean_weight"),
                                        F.avg(F.abs("weight")).alias("mean_size"),
                                        F.count(F.lit(1)).alias("devices"))


@query("study_model")
def study_model(spark, d):
    """The study end to end: cohorts, wide table, sample, splits, selection, searched forest, report."""
    splits, features = _study_features(spark, d)
    return models.evaluate(models.tuned_forest(splits, features).bestModel, splits, features)


@query("study_drop_list")
def study_drop_list(spark, d):
    """Features of the study that are left after leaks, profiled drop list and variance."""
    return spark.createDataFrame([(f,) for f in _study_features(spark, d)[1]], "feature STRING")
