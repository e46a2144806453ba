"""Cross-validation and hyper-parameter search."""

from __future__ import annotations

import random
from collections.abc import Callable, Mapping, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.evaluation import Evaluator, MulticlassClassificationEvaluator
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluation import confusion, rate_set

# The study's search ranges, as far as MLlib has the parameter.
LOGISTIC_C = tuple(10.0 ** e for e in range(-3, 4))
PENALTIES = ("l1", "l2")
SVM_C = (0.001, 0.01, 0.1, 1.0, 10.0)
TREE_IMPURITIES = ("gini", "entropy")
TREE_DEPTHS = tuple(range(1, 10))
LEAF_SIZES = tuple(range(1, 10))
FOREST_TREES = (300, 500)
FOREST_DEPTHS = (30,)


def kfold_metrics(data: DataFrame, estimators: Mapping[str, object], k: int, fold: str = "fold",
                  parallelism: int = 4) -> DataFrame:
    """Train accuracy, test accuracy and false-positive rate of each model and fold.

    The fits are independent jobs over the kept rows and run side by side, like those of a
    cross-validator; all predictions are then counted in one aggregate.
    """
    spark = data.sparkSession

    @inheritable_thread_target(spark)
    def fit(task):
        name, i = task
        return estimators[name].fit(data.filter(F.col(fold) != i))

    tasks = [(name, i) for name in estimators for i in range(k)]
    with ThreadPool(min(parallelism, len(tasks))) as pool:
        fitted = pool.map(fit, tasks)
    scored = None
    for (name, i), model in zip(tasks, fitted, strict=True):
        part = F.when(F.col(fold) == i, "test").otherwise("train")
        rows = model.transform(data).select("label", "prediction", F.lit(name).alias("model"),
                                            F.lit(i).alias("fold"), part.alias("part"))
        scored = rows if scored is None else scored.unionByName(rows)
    rates = rate_set(confusion(scored, by=["model", "fold", "part"]))

    def pick(part: str, rate: str):
        return F.max(F.when(F.col("part") == part, F.col(rate)))
    return rates.groupBy("model", "fold").agg(
        pick("train", "acc").alias("train_acc"), pick("test", "acc").alias("test_acc"), pick("test", "fpr").alias("fpr"))


def grid(estimator, choices: Mapping[str, Sequence]) -> list[dict]:
    """All parameter maps of a grid given by parameter name."""
    builder = ParamGridBuilder()
    for name, values in choices.items():
        builder = builder.addGrid(estimator.getParam(name), list(values))
    return builder.build()


def draw(maps: Sequence[dict], n: int, seed: int = 42) -> list[dict]:
    """``n`` distinct maps of a grid, reproducibly."""
    maps = list(maps)
    return random.Random(seed).sample(maps, min(n, len(maps)))


def search(data: DataFrame, estimator, maps: Sequence[dict], k: int = 5, metric: str | Evaluator = "accuracy",
           seed: int = 42, parallelism: int = 8, fold: str | None = None) -> CrossValidatorModel:
    """Cross-validate every map and refit the best one on all rows."""
    evaluator = metric if isinstance(metric, Evaluator) else MulticlassClassificationEvaluator(
        metricName={"f1_weighted": "f1"}.get(metric, metric))
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=list(maps), evaluator=evaluator, numFolds=k,
                        seed=seed, parallelism=parallelism)
    if fold:
        cv = cv.setFoldCol(fold)
    return cv.fit(data)


def randomized_search(data: DataFrame, estimator, choices: Mapping[str, Sequence], n: int = 5, k: int = 5,
                      metric: str = "f1_weighted", seed: int = 42, parallelism: int = 8,
                      fold: str | None = None) -> CrossValidatorModel:
    return search(data, estimator, draw(grid(estimator, choices), n, seed), k, metric, seed, parallelism, fold)


def logistic_grid(estimator, rows: int, costs=LOGISTIC_C, penalties=PENALTIES) -> list[dict]:
    return grid(estimator, {"regParam": [1.0 / (c * rows) for c in costs],
                            "elasticNetParam": [1.0 if p == "l1" else 0.0 for p in penalties]})


def svm_grid(estimator, rows: int, costs=SVM_C) -> list[dict]:
    return grid(estimator, {"regParam": [1.0 / (c * rows) for c in costs]})


def tree_grid(estimator, impurities=TREE_IMPURITIES, depths=TREE_DEPTHS, leaves=LEAF_SIZES) -> list[dict]:
    return grid(estimator, {"impurity": impurities, "maxDepth": depths, "minInstancesPerNode": leaves})


def search_table(spark, fitted: CrossValidatorModel, maps: Sequence[dict] | None = None) -> DataFrame:
    """One row per tried map: its parameters as text and its mean score."""
    maps = fitted.getEstimatorParamMaps() if maps is None else maps
    rows = [(", ".join(sorted(f"{p.name}={v}" for p, v in m.items())), float(s))
            for m, s in zip(maps, fitted.avgMetrics, strict=True)]
    return spark.createDataFrame(rows, "params STRING, score DOUBLE")


def ablation(data_for: Callable[[Sequence[str]], DataFrame], fit: Callable[[DataFrame], object],
             features: Sequence[str], containing: str):
    """Fit with all features and without those whose name contains a text.

    Returns ``{"all": (model, features), "without": (model, features)}``.
    """
    less = [f for f in features if containing not in f]
    return {name: (fit(data_for(cols)), list(cols)) for name, cols in (("all", features), ("without", less))}
