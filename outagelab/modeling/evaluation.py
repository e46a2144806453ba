"""Evaluation operators over a frame of (label, prediction, score); all of them are aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import percent, rate
from ..operators.ordering import SLICES, running_totals


def confusion(df: DataFrame, label: str = "label", pred: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """TN, FP, FN, TP counts of a binary prediction."""
    def cell(y: int, p: int):
        return F.count_if((F.col(label) == y) & (F.col(pred) == p))
    return df.groupBy(*by).agg(cell(0, 0).alias("tn"), cell(0, 1).alias("fp"),
                               cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))


def rate_set(matrix: DataFrame) -> DataFrame:
    """All rates of a confusion row; a zero denominator gives null."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return matrix.withColumns({
        "tpr": rate(tp, tp + fn), "tnr": rate(tn, tn + fp),
        "ppv": rate(tp, tp + fp), "npv": rate(tn, tn + fn),
        "fpr": rate(fp, fp + tn), "fnr": rate(fn, tp + fn),
        "fdr": rate(fp, tp + fp), "acc": rate(tp + tn, tp + fp + fn + tn),
    })


def classification_report(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Precision, recall, f1 and support per class, then accuracy, macro and weighted averages.

    Everything after the first grouping runs on (label, prediction) counts. Undefined scores
    are zero.
    """
    cells = df.groupBy(F.col(label).cast("int").alias("l"), F.col(pred).cast("int").alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )
    sides = cells.select(F.inline(F.array(
        F.struct(F.col("l").alias("cls"), F.col("n").alias("support"), F.lit(0).alias("predicted"),
                 F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("p").alias("cls"), F.lit(0).alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).alias("hit")),
    )))
    zero = F.lit(0.0)
    per_class = sides.groupBy("cls").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hit")]).select(
        F.col("cls").cast("string").alias("class"),
        F.coalesce(rate(F.col("hit"), F.col("predicted")), zero).alias("precision"),
        F.coalesce(rate(F.col("hit"), F.col("support")), zero).alias("recall"),
        F.coalesce(rate(2 * F.col("hit"), F.col("predicted") + F.col("support")), zero).alias("f1"),
        "support", "hit",
    )
    total = F.sum("support")

    def weighted(c: str):
        return rate(F.sum(F.col(c) * F.col("support")), total)

    acc = rate(F.sum("hit"), total)
    averages = [
        per_class.agg(F.lit("accuracy").alias("class"), acc.alias("precision"), acc.alias("recall"),
                      acc.alias("f1"), total.alias("support")),
        per_class.agg(F.lit("macro avg").alias("class"),
                      *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], total.alias("support")),
        per_class.agg(F.lit("weighted avg").alias("class"),
                      *[weighted(c).alias(c) for c in ("precision", "recall", "f1")], total.alias("support")),
    ]
    out = per_class.drop("hit")
    for a in averages:
        out = out.unionByName(a)
    return out


def accuracy(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    return df.agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"))


def _score_counts(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )


def roc_points(df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = (),
               slices: int = SLICES, start: bool = False) -> DataFrame:
    """One ROC point per distinct score: rates of rows scoring at least that much.

    ``start`` adds the point (0, 0), without a threshold, that a drawn curve starts at.
    """
    counts = _score_counts(df, label, score, by)
    cum = running_totals(counts, "score", ["pos", "neg"], by, descending=True, slices=slices)
    points = cum.select(
        *by, F.col("score").alias("threshold"), "pos", "neg",
        rate(F.col("neg_to"), F.col("neg_all")).alias("fpr"),
        rate(F.col("pos_to"), F.col("pos_all")).alias("tpr"),
    )
    if not start:
        return points
    none = {"threshold": F.lit(None), "pos": F.lit(0), "neg": F.lit(0), "fpr": F.lit(0.0), "tpr": F.lit(0.0)}
    curves = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).where("__n > 0")
    return points.unionByName(curves.select(*by, *[value.cast(points.schema[c].dataType).alias(c) for c, value in none.items()]))


def auc(df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = (),
        slices: int = SLICES) -> DataFrame:
    """Area under the ROC curve, ties counted half, from running counts (no global sort task)."""
    counts = _score_counts(df, label, score, by)
    cum = running_totals(counts, "score", ["neg"], by, slices=slices)
    below = F.col("neg_to") - F.col("neg")
    wins = F.sum(F.col("pos").cast("double") * (below + F.col("neg") / 2))
    return cum.groupBy(*by).agg(rate(wins, F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))


def score_summary(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation of fold scores, one row per metric."""
    long = df.select(*by, F.inline(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in cols
    ])))
    return long.groupBy(*by, "metric").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def compare_importances(runs: dict[str, DataFrame]) -> DataFrame:
    """Importance and rank of each feature in every run, side by side.

    Each run has one row per model feature. A feature missing from a run has nulls there;
    ``rank_delta`` is last run minus first run.
    """
    out = None
    for name, df in runs.items():
        ranked = df.select(
            "feature", F.col("importance").alias(f"importance_{name}"),
            F.row_number().over(Window.orderBy(F.col("importance").desc_nulls_last(), "feature"))
            .cast("bigint").alias(f"rank_{name}"),
        )
        out = ranked if out is None else out.join(ranked, "feature", "full")
    first, last = list(runs)[0], list(runs)[-1]
    return out.withColumn("rank_delta", F.col(f"rank_{last}") - F.col(f"rank_{first}"))


def weight_importances(weights: DataFrame) -> DataFrame:
    """(feature, weight) to shares of 100, largest first."""
    total = weights.agg(F.sum(F.abs("weight"))).scalar()
    return weights.select("feature", percent(F.abs("weight"), total).alias("importance")).orderBy(
        F.desc("importance"), "feature"
    )
