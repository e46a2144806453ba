"""Train, tune, evaluate and explain on prepared splits."""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..modeling import estimators as est
from ..modeling import evaluation as ev
from ..modeling import forest, kernel, linear, nested
from ..modeling import importance as imp
from ..modeling import search as sr
from ..operators.cohort import class_weights, fold_by_rank
from ..operators.features import safe_name, variance_filter
from ..sources import stage
from .prepare import SHARES, Wide
from .tables import category_profile, flags_to_drop

# Columns the study removed as leaks before modelling.
LEAKS = ("clinic_had_mia", "sku_P-WAL-107-ELC-03", "sku_P-WAL-106-ELC-01")


def split_part(splits: Wide, part: str) -> DataFrame:
    return splits.df.filter(F.col("split") == part)


def drop_list(splits: Wide, min_pct: float = 80.0, max_devices: int = 200) -> list[str]:
    """Flags that the category profile finds nearly all in one class; at most one name per column."""
    found = flags_to_drop(category_profile(splits), min_pct, max_devices)
    return sorted(r["variable"] for r in found.collect())


def selected_features(splits: Wide, drop: Sequence[str] = LEAKS, threshold: float = 0.09,
                      profiled: Sequence[str] = ()) -> list[str]:
    """Features without leaks and without the ``profiled`` drop list, whose variance on train is above the threshold."""
    gone = {*drop, *map(safe_name, drop), *profiled}
    kept = [c for c in splits.features if c not in gone]
    return variance_filter(split_part(splits, "train"), kept, threshold)


def vectors(splits: Wide, part: str, features: Sequence[str]) -> DataFrame:
    return est.assemble(split_part(splits, part), features, splits.label, keep=[splits.key])


@contextmanager
def kept(df: DataFrame):
    """Rows that many fits read, in no more partitions than they are worth, released afterwards."""
    rows = df.persist()
    try:
        yield rows.coalesce(est.tasks_worth(rows.sparkSession, rows.count()))
    finally:
        rows.unpersist()


def folds(splits: Wide, features: Sequence[str], k: int, seed: int) -> DataFrame:
    """Training vectors with a fold per key: the same folds for every partitioning and every search."""
    return fold_by_rank(vectors(splits, "train", features), splits.key, k, seed)


def baseline_scores(splits: Wide, features: Sequence[str], k: int = 5, seed: int = 42) -> DataFrame:
    """Fold scores of the baseline models, one row per model and fold."""
    with kept(folds(splits, features, k, seed)) as data:
        return sr.kfold_metrics(data, est.baselines(data.count(), seed), k)


def predictions(model, splits: Wide, features: Sequence[str]) -> DataFrame:
    """Stored, as a report reads them several times and scoring is most of its work."""
    return stage(est.scored(model, est.assemble(splits.df, features, splits.label, keep=[splits.key, "split"])).select(
        "split", "label", "prediction", "score"), "predictions")


def evaluate(model, splits: Wide, features: Sequence[str]) -> DataFrame:
    """Confusion counts, rates and AUC of a fitted model, one row per split."""
    rows = predictions(model, splits, features)
    rates = ev.rate_set(ev.confusion(rows, by=["split"]))
    return rates.join(ev.auc(rows, by=["split"]), "split")


def report(model, splits: Wide, features: Sequence[str]) -> DataFrame:
    """Per-class report of a fitted model on each split."""
    rows = predictions(model, splits, features)
    parts = [ev.classification_report(rows.filter(F.col("split") == part)).withColumn("split", F.lit(part))
             for part, _ in SHARES]
    return reduce(DataFrame.unionByName, parts)


def roc(model, splits: Wide, features: Sequence[str]) -> DataFrame:
    """ROC points of a fitted model on each split."""
    return ev.roc_points(predictions(model, splits, features), by=["split"], start=True)


def tuned_forest(splits: Wide, features: Sequence[str], n: int = 5, k: int = 5, trees=sr.FOREST_TREES,
                 depths=sr.FOREST_DEPTHS, leaves=sr.LEAF_SIZES, seed: int = 42) -> forest.ForestSearch:
    """Random forest from a randomized search with balanced class weights and weighted f1."""
    with kept(class_weights(folds(splits, features, k, seed), "label")) as data:
        drawn = sr.draw(list(product(trees, depths, leaves)), n, seed)
        return forest.search(data, drawn, k, seed=seed, weight_col="weight")


def tuned_logistic(splits: Wide, features: Sequence[str], k: int = 5, costs=sr.LOGISTIC_C,
                   penalties=sr.PENALTIES, seed: int = 42) -> linear.LinearSearch:
    with kept(folds(splits, features, k, seed)) as data:
        return linear.search(data, costs, penalties, k)


def tuned_svm(splits: Wide, features: Sequence[str], k: int = 5, costs=sr.SVM_C, seed: int = 42) -> linear.LinearSearch:
    """The linear half of the machine's grid."""
    with kept(folds(splits, features, k, seed)) as data:
        return linear.search(data, costs, k=k, loss="hinge", tol=1e-4)


def tuned_rbf(splits: Wide, features: Sequence[str], k: int = 5, costs=sr.SVM_C, gammas=kernel.SVM_GAMMA,
              seed: int = 42, **options) -> kernel.KernelSearch:
    """The kernel half of the machine's grid."""
    with kept(folds(splits, features, k, seed)) as data:
        return kernel.rbf_search(data, costs, gammas, k, seed=seed, **options)


def calibrated_svm(splits: Wide, features: Sequence[str], cost: float = 0.1, k: int = 5, seed: int = 42) -> kernel.Calibrated:
    """The final linear machine, with probabilities."""
    with kept(folds(splits, features, k, seed)) as data:
        return kernel.calibrate(lambda rows: est.linear_svm(cost, rows.count()).fit(rows), data, k)


def tuned_tree(splits: Wide, features: Sequence[str], k: int = 5, seed: int = 42, **ranges) -> nested.TreeSearch:
    with kept(folds(splits, features, k, seed)) as data:
        return nested.search(data, k, seed=seed, **ranges)


def importances(spark, model, features: Sequence[str]) -> DataFrame:
    """Feature importances of a linear or a tree model."""
    if hasattr(model, "featureImportances"):
        return imp.tree_importance(spark, model, features)
    return imp.coefficient_importance(spark, model, features)
