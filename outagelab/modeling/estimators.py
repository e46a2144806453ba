"""MLlib estimators with the study's parameters, and vector assembly.

Inputs are z-scored or 0/1, so linear models run with ``standardization=False``. A scikit-style
cost C maps to ``regParam = 1 / (C * rows)``. MLlib has no kernel SVM, no minimum-split
parameter and a depth limit of 30.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes, RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .forest import Forest
from .growth import MAX_DEPTH

# A fit's iterations are one small job each; fewer rows than this are not worth a task of their own.
ROWS_PER_TASK = 10_000
# Every task of every iteration answers the driver, so tasks beyond what the cores can share add answers and no speed.
TASKS_PER_CORE = 3


def tasks_worth(spark: SparkSession, rows: int) -> int:
    """Tasks a fit over ``rows`` rows is split into: by its rows, up to a few per core of the cluster."""
    return max(1, min(math.ceil(rows / ROWS_PER_TASK), TASKS_PER_CORE * spark.sparkContext.defaultParallelism))


def assemble(df: DataFrame, features: Sequence[str], label: str, keep: Sequence[str] = ()) -> DataFrame:
    """Label and one feature vector per row.

    Names with dots are aliased by position first: the assembler would read them as struct fields.
    """
    alias = {c: f"_f{i}" for i, c in enumerate(features)}
    base = df.select(
        *[F.col(f"`{k}`") for k in keep], F.col(f"`{label}`").cast("double").alias("label"),
        *[F.col(f"`{c}`").cast("double").alias(a) for c, a in alias.items()],
    )
    vectors = VectorAssembler(inputCols=list(alias.values()), outputCol="features").transform(base)
    return vectors.select(*keep, "label", "features")


def logistic(c: float, rows: int, penalty: str = "l2", **kw) -> LogisticRegression:
    return LogisticRegression(regParam=1.0 / (c * rows), elasticNetParam=1.0 if penalty == "l1" else 0.0,
                              standardization=False, maxIter=kw.pop("maxIter", 100), **kw)


def linear_svm(c: float, rows: int, **kw) -> LinearSVC:
    return LinearSVC(regParam=1.0 / (c * rows), standardization=False, maxIter=kw.pop("maxIter", 100), **kw)


def _depth(depth: int) -> int:
    if depth > MAX_DEPTH:
        raise ValueError(f"a tree can be at most {MAX_DEPTH} deep, not {depth}")
    return depth


def decision_tree(impurity: str = "gini", max_depth: int = 5, min_leaf: int = 1, seed: int = 42):
    return DecisionTreeClassifier(impurity=impurity, maxDepth=_depth(max_depth),
                                  minInstancesPerNode=min_leaf, seed=seed)


def random_forest(trees: int = 100, max_depth: int = 10, min_leaf: int = 1, seed: int = 42,
                  weight_col: str | None = None):
    rf = RandomForestClassifier(numTrees=trees, maxDepth=_depth(max_depth), minInstancesPerNode=min_leaf,
                                seed=seed)
    return rf.setWeightCol(weight_col) if weight_col else rf


def gaussian_bayes() -> NaiveBayes:
    return NaiveBayes(modelType="gaussian")


def boosted_trees(iterations: int = 20, max_depth: int = 5, seed: int = 42) -> GBTClassifier:
    return GBTClassifier(maxIter=iterations, maxDepth=max_depth, seed=seed)


def baselines(rows: int, seed: int = 42) -> dict:
    """The five models compared before tuning, at default size: unlimited depth means as deep as a tree can be."""
    return {
        "bayes": gaussian_bayes(), "logistic": logistic(1.0, rows), "svm": linear_svm(1.0, rows),
        "tree": Forest(1, MAX_DEPTH, seed=seed, single=True), "forest": Forest(100, MAX_DEPTH, seed=seed),
    }


def scored(model, df: DataFrame) -> DataFrame:
    """Label, prediction and a ranking score; models without probabilities rank on the margin."""
    out = model.transform(df)
    source = "probability" if "probability" in out.columns else "rawPrediction"
    return out.withColumn("score", vector_to_array(source)[1]).drop("rawPrediction", "probability")
