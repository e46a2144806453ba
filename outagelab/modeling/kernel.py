"""Support vector machines beyond a linear margin: an approximate RBF kernel and calibrated probabilities.

``FourierFeatures`` maps rows so that inner products approximate exp(-gamma |x - y|^2) (Rahimi and Recht, 2007); a linear
machine on the map is then a kernel machine whose work grows with the rows, not with their pairs. ``calibrate`` fits a
sigmoid to the margins of held-out folds (Platt, 1999), so that a machine without probabilities has them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .estimators import tasks_worth
from .forest import _side_by_side
from .linear import Setting, SharedFit, columns, scored_settings

SVM_GAMMA = (1.0, 0.1, 0.01, 0.001, 0.0001)     # fixed values: the study's range
WIDTH = 256                                     # Fourier features; the kernel's error falls with their root
PRODUCT_ROWS = 1024                             # rows whose mapped vectors are in memory at a time


@dataclass(frozen=True)
class FourierFeatures:
    """sqrt(2 / width) cos(x w + b), with normal w of variance 2 gamma and uniform b; a function of seed and sizes only."""

    gamma: float
    inputs: int
    width: int = WIDTH
    seed: int = 42

    def map(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        w = rng.normal(size=(self.inputs, self.width)) * np.sqrt(2 * self.gamma)
        b = rng.uniform(0, 2 * np.pi, self.width)
        return np.sqrt(2 / self.width) * np.cos(x @ w + b)

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        """``df`` with the mapped vector in place of its features."""
        own = self

        @F.pandas_udf("array<double>")
        def mapped(x: pd.Series) -> pd.Series:
            return pd.Series(list(own.map(np.vstack(x.to_numpy()))) if len(x) else [])

        return df.withColumn(features, array_to_vector(mapped(vector_to_array(features))))

    def product(self, left: Column, right: Column) -> Column:
        """Inner product of two mapped vectors of a row. The mapped rows, ``width`` wide, stay in the task that makes them."""
        own = self

        @F.pandas_udf("double")
        def inner(x: pd.Series, y: pd.Series) -> pd.Series:
            out = np.empty(len(x))
            for at in range(0, len(x), PRODUCT_ROWS):
                a, b = (own.map(np.vstack(side.iloc[at:at + PRODUCT_ROWS].to_numpy())) for side in (x, y))
                out[at:at + PRODUCT_ROWS] = np.einsum("ij,ij->i", a, b)
            return pd.Series(out)

        return inner(vector_to_array(left), vector_to_array(right))


@dataclass(frozen=True)
class KernelMachine:
    """A linear machine on mapped features; takes and scores rows with the plain ones."""

    features: FourierFeatures
    model: object

    def transform(self, df: DataFrame) -> DataFrame:
        plain = df.withColumn("_plain", F.col("features"))
        scored = self.model.transform(self.features.transform(plain))
        return scored.drop("features").withColumnRenamed("_plain", "features")


@dataclass(frozen=True)
class KernelSearch:
    """``scores``: {(gamma, cost): mean accuracy}; ``bestModel`` is fitted on all rows."""

    scores: dict[tuple[float, float], float]
    best: tuple[float, float]
    bestModel: KernelMachine
    passes: int

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame([(g, c, float(v)) for (g, c), v in self.scores.items()], "gamma DOUBLE, cost DOUBLE, score DOUBLE")


def rbf_search(data: DataFrame, costs: Sequence[float], gammas: Sequence[float] = SVM_GAMMA, k: int = 5, fold: str = "fold",
               width: int = WIDTH, seed: int = 42, max_iter: int = 100, tol: float = 1e-4) -> KernelSearch:
    """Cross-validate gamma and cost by accuracy. The fits of all gammas, costs and folds share each pass over the rows."""
    first = data.select(vector_to_array("features").alias("x")).first()
    if first is None:
        raise ValueError("no rows to fit")
    maps = [FourierFeatures(gamma, len(first["x"]), width, seed) for gamma in gammas]
    shared = SharedFit(data, fold, "hinge", [m.map for m in maps])
    settings = [Setting(c, "l2", i, g) for g in range(len(maps)) for c in costs for i in (*range(k), None)]
    weights, _ = shared.fit(settings, max_iter, tol)
    scores = {(gammas[g], c): v for (g, c), v in scored_settings(shared, settings, weights, lambda s: (s.map, s.cost)).items()}
    best = max(scores, key=scores.get)
    at = settings.index(Setting(best[1], "l2", None, list(gammas).index(best[0])))
    return KernelSearch(scores, best, KernelMachine(maps[settings[at].map], columns(weights[:, [at]])[0]), shared.passes)


@dataclass(frozen=True)
class Calibrated:
    """A margin model with ``probability``: a sigmoid of slope and offset over its margin."""

    model: object
    slope: float
    offset: float

    def transform(self, df: DataFrame) -> DataFrame:
        scored = self.model.transform(df)
        margin = vector_to_array("rawPrediction")[1]
        positive = 1 / (1 + F.exp(-(margin * self.slope + self.offset)))
        return scored.withColumn("probability", array_to_vector(F.array(1 - positive, positive)))

    @property
    def coefficients(self):
        return self.model.coefficients


def held_out_margins(fit: Callable[[DataFrame], object], data: DataFrame, k: int = 5, fold: str = "fold") -> DataFrame:
    """``data`` with ``margin``, for each row that of the model fitted without the row's fold."""
    def one(i):
        return fit(data.where(F.col(fold) != i)).transform(data.where(F.col(fold) == i))

    parts = _side_by_side(data.sparkSession, one, range(k))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("margin", vector_to_array("rawPrediction")[1]).drop("rawPrediction", "prediction")


def calibrate(fit: Callable[[DataFrame], object], data: DataFrame, k: int = 5, fold: str = "fold") -> Calibrated:
    """The model fitted on all rows with a sigmoid fitted to held-out margins.

    The sigmoid is fitted without a penalty worth the name, so on the held-out margins the probabilities average the class share.
    """
    margins = held_out_margins(fit, data, k, fold).select("label", array_to_vector(F.array("margin")).alias("features")).persist()
    try:
        # The union has k times the tasks of the data, and a fit runs a job per step.
        few = margins.coalesce(tasks_worth(margins.sparkSession, margins.count()))
        weights, _ = SharedFit(few).fit([Setting(1e9, "l2")], max_iter=500, tol=1e-9)
    finally:
        margins.unpersist()
    return Calibrated(fit(data), float(weights[1, 0]), float(weights[0, 0]))
