"""Linear models for many settings at once: one pass over the rows per step serves all of them.

Weights are the columns of one matrix, a column per penalty, cost and fold. A step sends the matrix out, every batch of
rows returns the sum of its gradients and losses, and the sums meet in an aggregate of one row per column. Folds share
the pass: a column leaves out the rows of its fold.

The method is accelerated proximal descent under a fixed curvature bound: a multiple of the fold's second moments bounds the
curvature of the loss everywhere (Boehning and Lindsay, 1988), so no step length has to be searched. The losses are the
logistic one (a quarter) and the hinge, smoothed over ``KINK`` on both sides of its corner (1 / (2 KINK)). The step
is a ridge solve for ``l2`` and a lasso by coordinate descent for ``l1``, both of the size of the features only. A column
whose objective rises restarts its acceleration (O'Donoghue and Candes, 2015); a column is done when its optimality
conditions hold to ``tol``.

Columns may look at the rows through maps of the features, which are applied to every batch on the way.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SWEEPS = 12         # of coordinate descent in a step
KINK = 0.1          # half the width over which the corner of the hinge is rounded; the loss is at most KINK / 4 off
TOL = 1e-6


@dataclass(frozen=True)
class Setting:
    """``cost`` as in 1 / (strength x rows), ``penalty`` l1 or l2, ``fold`` left out (None: none), number of its ``map``."""

    cost: float
    penalty: str
    fold: int | None = None
    map: int = 0


@dataclass(frozen=True)
class LinearModel:
    """A fitted column; scores like a fitted logistic model."""

    coefficients: DenseVector
    intercept: float

    def margin(self, features: Column) -> Column:
        weights = F.array(*[F.lit(float(c)) for c in self.coefficients.toArray()])
        return F.aggregate(F.zip_with(vector_to_array(features), weights, lambda a, c: a * c), F.lit(float(self.intercept)),
                           lambda s, v: s + v)

    def transform(self, df: DataFrame) -> DataFrame:
        out = df.withColumn("_margin", self.margin(F.col("features")))
        positive = 1 / (1 + F.exp(-F.col("_margin")))
        return out.withColumns({
            "rawPrediction": array_to_vector(F.array(-F.col("_margin"), F.col("_margin"))),
            "probability": array_to_vector(F.array(1 - positive, positive)),
            "prediction": (F.col("_margin") > 0).cast("double"),
        }).drop("_margin")


def _summed(rows: DataFrame, work) -> dict[int, np.ndarray]:
    """``work`` takes (features, label, fold) and yields (number, vector); sums by number. Bounded by settings x features."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, np.ndarray] = {}
        for pdf in frames:
            if len(pdf):
                for number, vector in work(np.vstack(pdf["x"].to_numpy()), pdf["label"].to_numpy(), pdf["fold"].to_numpy()):
                    totals[number] = totals.get(number, 0.0) + vector
        if totals:
            yield pd.DataFrame({"number": list(totals), "v": [t.tolist() for t in totals.values()]})

    parts = rows.mapInPandas(run, "number int, v array<double>").select("number", array_to_vector("v").alias("v"))
    return {r["number"]: r["s"].toArray() for r in parts.groupBy("number").agg(Summarizer.sum(F.col("v")).alias("s")).collect()}


def _plain(x: np.ndarray) -> np.ndarray:
    return x


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.hstack([np.ones((len(x), 1)), x])


def logistic_loss(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss and slope for labels 0 and 1."""
    return np.logaddexp(0, margin) - y * margin, 1 / (1 + np.exp(-np.clip(margin, -500, 500))) - y


def hinge_loss(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """max(0, 1 - signed margin) with a parabola of width 2 KINK in place of the corner."""
    sign = 2 * y - 1
    short = 1 - sign * margin
    inside = np.clip((short + KINK) / (2 * KINK), 0, 1)
    return np.where(short > KINK, short, KINK * inside ** 2), -sign * inside


LOSSES = {"logistic": (logistic_loss, 0.25), "hinge": (hinge_loss, 1 / (2 * KINK))}


class SharedFit:
    """Moments of the rows per map and fold, gradients of many columns per pass. All maps give as many features."""

    def __init__(self, data: DataFrame, fold: str | None = None, loss: str = "logistic", maps: Sequence = (_plain,)):
        held = F.col(fold).cast("int") if fold else F.lit(-1)
        self.rows = data.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label"), held.alias("fold"))
        self.maps, (self.loss, self.curvature) = list(maps), LOSSES[loss]
        each, count = list(self.maps), len(self.maps)

        def moments(x, y, f):
            for i, mapped in enumerate(each):
                z = _with_one(mapped(x))
                for held_out in np.unique(f):
                    own = z[f == held_out]
                    yield int(held_out) * count + i, np.concatenate([[len(own)], (own.T @ own).ravel()])

        found = _summed(self.rows, moments)
        if not found:
            raise ValueError("no rows to fit")
        self.width = round((len(next(iter(found.values()))) - 1) ** 0.5)
        self.by_fold = {divmod(n, count): v for n, v in found.items()}
        self.total = [sum(v for (_, i), v in self.by_fold.items() if i == m) for m in range(count)]
        self.passes = 1

    def _left(self, s: Setting) -> np.ndarray:
        return self.total[s.map] - self.by_fold.get((s.fold, s.map), 0.0)

    def fit(self, settings: Sequence[Setting], max_iter: int = 300, tol: float = TOL) -> tuple[np.ndarray, np.ndarray]:
        """Weights (intercept first), a column per setting, and what is left of each column's optimality conditions."""
        p, m = self.width, len(settings)
        left = [self._left(s) for s in settings]
        n = np.array([v[0] for v in left])
        ridge = np.array([1 / (s.cost * c) if s.penalty == "l2" else 0.0 for s, c in zip(settings, n)])
        lasso = np.array([1 / (s.cost * c) if s.penalty == "l1" else 0.0 for s, c in zip(settings, n)])
        # columns of one map and fold share their curvature bound, and so its axes; a hair on top where features are collinear
        folds, through = np.array([-2 if s.fold is None else s.fold for s in settings]), np.array([s.map for s in settings])
        groups, group = {}, np.zeros(m, dtype=int)
        for i, (s, v, c) in enumerate(zip(settings, left, n)):
            if (s.fold, s.map) not in groups:
                bound = v[1:].reshape(p, p) / c * self.curvature
                bound += 1e-9 * np.trace(bound) / p * np.eye(p)
                groups[s.fold, s.map] = (len(groups), bound, *np.linalg.eigh(bound))
            group[i] = groups[s.fold, s.map][0]
        _, bounds, lengths, axes = zip(*groups.values())
        free = np.zeros(p)
        free[1:] = 1.0                                     # the intercept is not penalised

        def newton(of: np.ndarray, slope: np.ndarray) -> np.ndarray:
            """The step of columns ``of``; their bound takes the ridge on the intercept as well, which keeps it a bound."""
            out = np.empty_like(slope)
            for g in np.unique(group[of]):
                own = group[of] == g
                out[own] = ((slope[own] @ axes[g]) / (lengths[g] + ridge[of][own, None])) @ axes[g].T
            return out

        w, ahead, t = np.zeros((m, p)), np.zeros((m, p)), np.ones(m)
        last, residual, going = np.full(m, np.inf), np.full(m, np.inf), np.arange(m)
        for _ in range(max_iter):
            loss, gradient = self._gradients(ahead[going], folds[going], through[going])
            loss, gradient = loss / n[going], gradient / n[going, None]
            here = gradient + ridge[going, None] * free * ahead[going]
            new = ahead[going] - newton(going, here)
            part = np.flatnonzero(lasso[going] > 0)
            if len(part):
                own = going[part]
                bound = np.stack([bounds[g] for g in group[own]])
                new[part] = _lasso_steps(ahead[own], gradient[part], bound, lasso[own], w[own])
            value = loss + 0.5 * ridge[going] * (ahead[going][:, 1:] ** 2).sum(1) + lasso[going] * np.abs(ahead[going][:, 1:]).sum(1)
            residual[going] = _residual(ahead[going], here, lasso[going])
            rising = value > last[going] + 1e-15
            last[going] = np.where(rising, np.inf, value)
            step = np.where(rising, 1.0, (1 + np.sqrt(1 + 4 * t[going] ** 2)) / 2)
            pull = np.where(rising, 0.0, (t[going] - 1) / step)
            before, t[going] = w[going], step
            done = residual[going] < tol
            w[going] = np.where(done[:, None], ahead[going], new)
            ahead[going] = np.where(done[:, None], ahead[going], new + pull[:, None] * (new - before))
            going = going[~done]
            if not len(going):
                break
        return w.T, residual

    def margins(self, w: np.ndarray, through: np.ndarray):
        """A function from features to (mapped features, numbers, margins) of the columns of each map."""
        maps = [(mapped, np.flatnonzero(through == i)) for i, mapped in enumerate(self.maps) if np.any(through == i)]

        def of(x):
            for mapped, own in maps:
                z = _with_one(mapped(x))
                yield z, own, z @ w[own].T
        return of

    def _gradients(self, w: np.ndarray, folds: np.ndarray, through: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.passes += 1
        of, loss = self.margins(w, through), self.loss

        def work(x, y, f):
            out = np.zeros((len(w), 1 + w.shape[1]))
            for z, own, margin in of(x):
                counted = f[:, None] != folds[None, own]
                value, slope = loss(margin, y[:, None])
                out[own, 0] = np.where(counted, value, 0.0).sum(0)
                out[own, 1:] = np.where(counted, slope, 0.0).T @ z
            yield 0, out.ravel()

        total = _summed(self.rows, work)[0].reshape(len(w), -1)
        return total[:, 0], total[:, 1:]

    def hits(self, settings: Sequence[Setting], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of each column's left-out fold, and how many of them it gets right."""
        self.passes += 1
        folds = np.array([-2 if s.fold is None else s.fold for s in settings])
        of = self.margins(weights.T, np.array([s.map for s in settings]))

        def work(x, y, f):
            out = np.zeros((2, len(folds)))
            for _, own, margin in of(x):
                held = f[:, None] == folds[None, own]
                out[0, own] = held.sum(0)
                out[1, own] = (held & ((margin > 0) == (y[:, None] > 0.5))).sum(0)
            yield 0, out.ravel()

        rows, right = _summed(self.rows, work)[0].reshape(2, -1)
        return rows, right


def _lasso_steps(at: np.ndarray, gradient: np.ndarray, bound: np.ndarray, strength: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Per column: the minimum of gradient.(u - at) + (u - at) bound (u - at) / 2 + strength |u without intercept|."""
    u = start.copy()
    slope = gradient + np.einsum("mij,mj->mi", bound, u - at)
    for _ in range(SWEEPS):
        for j in range(u.shape[1]):
            curve = bound[:, j, j]
            target = u[:, j] - slope[:, j] / curve
            if j:
                target = np.sign(target) * np.maximum(np.abs(target) - strength / curve, 0.0)
            moved = target - u[:, j]
            if np.any(moved):
                slope += moved[:, None] * bound[:, j, :]
                u[:, j] = target
    return u


def _residual(w: np.ndarray, slope: np.ndarray, lasso: np.ndarray) -> np.ndarray:
    """Largest violation of the optimality conditions; ``slope`` is the gradient of the smooth part."""
    free = slope + lasso[:, None] * np.sign(w)
    still = np.maximum(np.abs(slope) - lasso[:, None], 0.0)
    wrong = np.where((w == 0) & (lasso[:, None] > 0), still, np.abs(free))
    wrong[:, 0] = np.abs(slope[:, 0])
    return wrong.max(1)


def columns(weights: np.ndarray) -> list[LinearModel]:
    return [LinearModel(DenseVector(w[1:]), float(w[0])) for w in weights.T]


@dataclass(frozen=True)
class LinearSearch:
    """``scores``: {(cost, penalty): mean accuracy}; ``fitted``: weights per setting and fold; ``passes`` over the rows."""

    scores: dict[tuple[float, str], float]
    settings: list[Setting]
    weights: np.ndarray
    residual: np.ndarray
    passes: int
    best: tuple[float, str]
    bestModel: LinearModel

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame([(c, p, float(v)) for (c, p), v in self.scores.items()], "cost DOUBLE, penalty STRING, score DOUBLE")

    def weight_table(self, spark) -> DataFrame:
        """(number, cost, penalty, fold, intercept, weights) of all fits; settings x folds rows."""
        rows = [(i, s.cost, s.penalty, s.fold, float(w[0]), [float(c) for c in w[1:]])
                for i, (s, w) in enumerate(zip(self.settings, self.weights.T, strict=True))]
        return spark.createDataFrame(rows, "number INT, cost DOUBLE, penalty STRING, fold INT, intercept DOUBLE, weights ARRAY<DOUBLE>")


def scored_settings(shared: SharedFit, settings: Sequence[Setting], weights: np.ndarray, key) -> dict:
    """Mean accuracy over the left-out folds by ``key`` of a setting, in the order of the settings."""
    rows, right = shared.hits(settings, weights)
    shares: dict = {}
    for s, n, hit in zip(settings, rows, right, strict=True):
        if s.fold is not None and n:
            shares.setdefault(key(s), []).append(hit / n)
    return {k: float(np.mean(v)) for k, v in shares.items()}


def search(data: DataFrame, costs: Sequence[float], penalties: Sequence[str] = ("l2",), k: int = 5, fold: str = "fold",
           loss: str = "logistic", max_iter: int = 300, tol: float = TOL) -> LinearSearch:
    """Cross-validate every cost and penalty by accuracy; all fits, those on all rows included, share each pass."""
    shared = SharedFit(data, fold, loss)
    settings = [Setting(c, p, i) for c in costs for p in penalties for i in (*range(k), None)]
    weights, residual = shared.fit(settings, max_iter, tol)
    scores = scored_settings(shared, settings, weights, lambda s: (s.cost, s.penalty))
    best = max(scores, key=scores.get)
    at = settings.index(Setting(*best))
    return LinearSearch(scores, settings, weights, residual, shared.passes, best, columns(weights[:, [at]])[0])
