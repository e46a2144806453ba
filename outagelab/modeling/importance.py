"""Model weights and importances as tables, and model files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from .evaluation import weight_importances


def _pairs(spark: SparkSession, features: Sequence[str], values, name: str) -> DataFrame:
    rows = [(f, float(v)) for f, v in zip(features, values, strict=True)]
    return spark.createDataFrame(rows, f"feature STRING, {name} DOUBLE")


def coefficient_importance(spark: SparkSession, model, features: Sequence[str]) -> DataFrame:
    """Absolute weights of a linear model as shares of 100, largest first."""
    return weight_importances(_pairs(spark, features, model.coefficients.toArray(), "weight"))


def tree_importance(spark: SparkSession, model, features: Sequence[str]) -> DataFrame:
    """Importances of a tree model (sum 1), largest first."""
    from pyspark.sql import functions as F

    table = _pairs(spark, features, model.featureImportances.toArray(), "importance")
    return table.orderBy(F.desc("importance"), "feature")


def save_model(model, path: str) -> None:
    PipelineModel(stages=[model]).write().overwrite().save(path)


def load_model(path: str):
    """The fitted model saved by :func:`save_model`, with its parameters."""
    return PipelineModel.load(path).stages[0]
