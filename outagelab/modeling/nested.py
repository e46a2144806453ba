"""Grid search over decision trees in which smaller trees are cut out of larger ones.

A tree is grown greedily, so the tree of depth 3 is the top of the tree of depth 9 with the same leaf size, and a larger
minimum of rows per split turns nodes below it into leaves, whatever lies under them. One fit per impurity, leaf size and
fold therefore holds the whole grid of depths and minimum splits, the parameter MLlib lacks among them. Rows are sent down
the fitted trees once: what comes back is the number of rows per (tree, part, leaf, label), and every cut is scored from
these counts, as a cut predicts for a leaf what its node on the way down predicts.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.ml.classification import DecisionTreeClassificationModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import drop_path, stage_root
from .estimators import decision_tree
from .forest import _side_by_side
from .search import LEAF_SIZES, TREE_DEPTHS, TREE_IMPURITIES

MIN_SPLITS = (1, 2, 3, 4)       # fixed values: the study's range


@dataclass(frozen=True)
class Step:
    """A node on the way to a leaf: rows of the fit in it, rows by class, and what it would predict as a leaf."""

    count: int
    stats: tuple[float, ...]
    prediction: float


@dataclass(frozen=True)
class Ways:
    """The way from the root to every leaf of a fitted tree, leaves from left to right as ``leafCol`` numbers them."""

    ways: tuple[tuple[Step, ...], ...]
    splits: tuple[int, ...]     # rows of every split node

    def ends(self, max_depth: int, min_split: int) -> list[Step]:
        """Per leaf: the node that stands for it once the tree is cut."""
        out = []
        for way in self.ways:
            at = next((k for k, step in enumerate(way) if step.count < min_split), len(way) - 1)
            out.append(way[min(at, max_depth, len(way) - 1)])
        return out


def ways_of(model: DecisionTreeClassificationModel, spark) -> Ways:
    """Read a tree's nodes from its model file: at most 2 to the depth, plus one, and so bounded by the grid."""
    path = f"{stage_root(spark)}/tree-{uuid.uuid4().hex}"
    model.write().save(path)
    nodes = {r["id"]: r for r in spark.read.parquet(f"{path}/data").select(
        "id", "prediction", "impurityStats", "rawCount", "leftChild", "rightChild").collect()}
    drop_path(spark, path)
    ways, splits, open_ = [], [], [(0, ())]
    while open_:
        at, way = open_.pop()
        node = nodes[at]
        way = (*way, Step(node["rawCount"], tuple(node["impurityStats"]), node["prediction"]))
        if node["leftChild"] < 0:
            ways.append(way)
        else:
            splits.append(node["rawCount"])
            open_ += [(node["rightChild"], way), (node["leftChild"], way)]
    return Ways(tuple(ways), tuple(splits))


@dataclass(frozen=True)
class CutTree:
    """A fitted tree with a minimum of rows per split; scores like a fitted tree."""

    model: DecisionTreeClassificationModel
    ways: Ways
    max_depth: int
    min_split: int

    @property
    def featureImportances(self):
        """Of the fitted tree before the cut."""
        return self.model.featureImportances

    def transform(self, df: DataFrame) -> DataFrame:
        ends = self.ways.ends(self.max_depth, self.min_split)
        stats = F.array(*[F.array(*[F.lit(float(v)) for v in step.stats]) for step in ends])
        leaves = _with_leaf(self.model, df, "_leaf")
        rows = leaves.withColumn("_votes", F.get(stats, F.col("_leaf")))
        total = F.aggregate("_votes", F.lit(0.0), lambda s, v: s + v)
        predicted = F.get(F.array(*[F.lit(float(step.prediction)) for step in ends]), F.col("_leaf"))
        return rows.withColumns({
            "rawPrediction": array_to_vector("_votes"), "probability": array_to_vector(F.transform("_votes", lambda v: v / total)),
            "prediction": predicted}).drop("_votes", "_leaf")


def _with_leaf(model, df: DataFrame, name: str) -> DataFrame:
    quiet = model.copy().setRawPredictionCol("").setProbabilityCol("").setPredictionCol("").setLeafCol(name)
    return quiet.transform(df).withColumn(name, F.col(name).cast("int"))


@dataclass(frozen=True)
class TreeSearch:
    """``rows``: a dict per setting with mean train and test accuracy; ``small_splits``: split nodes below the minimum."""

    rows: list[dict]
    small_splits: int
    bestModel: CutTree

    @property
    def best(self) -> dict:
        return max(self.rows, key=lambda r: r["test_acc"])

    def table(self, spark) -> DataFrame:
        names = ("impurity", "max_depth", "min_leaf", "min_split", "train_acc", "test_acc")
        return spark.createDataFrame([tuple(r[c] for c in names) for r in self.rows],
                                     "impurity STRING, max_depth INT, min_leaf INT, min_split INT, train_acc DOUBLE, test_acc DOUBLE")


def leaf_counts(data: DataFrame, models: Sequence, held_out: Sequence[int], fold: str) -> DataFrame:
    """(tree, test, leaf, label, n) of all trees in one pass over the rows."""
    rows, names = data, []
    for i, model in enumerate(models):
        names.append(f"_leaf_{i}")
        rows = _with_leaf(model, rows, names[-1])
    seen = rows.select("label", F.inline(F.array(*[
        F.struct(F.lit(i).alias("tree"), (F.col(fold) == held_out[i]).alias("test"), F.col(name).alias("leaf"))
        for i, name in enumerate(names)])))
    return seen.groupBy("tree", "test", "leaf", "label").agg(F.count(F.lit(1)).alias("n"))


def search(data: DataFrame, k: int = 5, impurities: Sequence[str] = TREE_IMPURITIES, depths: Sequence[int] = TREE_DEPTHS,
           leaves: Sequence[int] = LEAF_SIZES, min_splits: Sequence[int] = MIN_SPLITS, fold: str = "fold",
           seed: int = 42) -> TreeSearch:
    """Cross-validate the whole grid by accuracy and fit the best setting on all rows; the first of a tie is the best."""
    spark = data.sparkSession
    tasks = list(product(impurities, leaves, range(k)))

    def one(task):
        impurity, leaf, i = task
        model = decision_tree(impurity, max(depths), leaf, seed).fit(data.where(F.col(fold) != i))
        return model, ways_of(model, spark)

    fitted = _side_by_side(spark, one, tasks)
    counts: dict[tuple, list] = {}
    for r in leaf_counts(data, [m for m, _ in fitted], [i for _, _, i in tasks], fold).collect():
        counts.setdefault((r["tree"], r["test"]), []).append((r["leaf"], r["label"], r["n"]))
    grid = {}
    small = 0
    for number, ((impurity, leaf, _), (_, ways)) in enumerate(zip(tasks, fitted, strict=True)):
        small += sum(n < 2 * leaf for n in ways.splits)
        for depth, min_split in product(depths, min_splits):
            ends = ways.ends(depth, min_split)
            for test in (False, True):
                cells = counts.get((number, test), [])
                rows = sum(n for _, _, n in cells)
                if rows:
                    right = sum(n for at, label, n in cells if ends[at].prediction == label)
                    grid.setdefault((impurity, depth, leaf, min_split), {}).setdefault(test, []).append(right / rows)
    rows = [{"impurity": s[0], "max_depth": s[1], "min_leaf": s[2], "min_split": s[3],
             "train_acc": sum(v[False]) / len(v[False]), "test_acc": sum(v[True]) / len(v[True])}
            for s in product(impurities, depths, leaves, min_splits) if (v := grid.get(s))]
    best = max(rows, key=lambda r: r["test_acc"])
    model = decision_tree(best["impurity"], best["max_depth"], best["min_leaf"], seed).fit(data)
    return TreeSearch(rows, small, CutTree(model, ways_of(model, spark), best["max_depth"], best["min_split"]))
