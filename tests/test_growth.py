"""Trees grown by numpy, against MLlib's and against themselves on other ways."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from outagelab.modeling import estimators as est
from outagelab.modeling import forest, growth


def rows(n=600, classes=2, seed=3, free=False):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, b, n) for b in (2, 2, 32, 20, 32)]).astype(np.uint8)
    y = ((x[2] / 8 + x[0] + rng.normal(size=n)).clip(0, None) // 2 % classes).astype(np.uint8)
    w = rng.random(n) + 0.5 if free else np.where(y == 1, 1.25, 0.75)
    return growth.Rows(x, y, w, classes)


def grown(r, depth=30, least=2, subset=3, trees=6, bootstrap=True):
    return growth.grow(r.ordered(), [growth.tree_key(7, t) for t in range(trees)], depth, least, subset, bootstrap)


def same(a, b):
    return all(np.array_equal(getattr(a, c), getattr(b, c)) for c in ("feature", "bin", "left")) and np.allclose(a.votes, b.votes)


@pytest.mark.parametrize("classes, free", [(2, False), (3, False), (2, True), (3, True)])
def test_tables_and_sorted_numbers_find_the_same_splits(classes, free, monkeypatch):
    r = rows(classes=classes, free=free)
    one, importances = grown(r)
    for table in (0, 10 ** 6):
        monkeypatch.setattr(growth, "TABLE", table)
        other, again = grown(r)
        assert same(one, other) and importances == pytest.approx(again)


def test_trees_do_not_depend_on_blocks_rows_order_or_neighbours(monkeypatch):
    r = rows()
    at = np.random.default_rng(0).permutation(600)
    assert same(grown(r)[0], grown(growth.Rows(np.ascontiguousarray(r.x[:, at]), r.y[at], r.w[at], 2))[0])

    def votes(grove):
        out = np.zeros((600, 2))
        grove.score(r.x, out)
        return out
    whole = votes(grown(r)[0])
    assert np.array_equal(whole.sum(1), np.full(600, 6.0))
    alone = sum(votes(growth.grow(r.ordered(), [growth.tree_key(7, t)], 30, 2, 3)[0]) for t in range(6))
    assert np.array_equal(whole, alone)
    monkeypatch.setattr(growth, "BLOCK", 16)
    assert np.array_equal(whole, votes(grown(r)[0]))


def test_packed_groves_come_back():
    grove = grown(rows(classes=3))[0]
    back = growth.Grove.unpacked(grove.packed())
    assert back.trees == grove.trees and same(grove, back) is np.allclose(grove.votes[grove.feature >= 0], 0)
    assert np.array_equal(back.votes[back.feature < 0], grove.votes[grove.feature < 0])


def test_one_class_and_few_rows_give_leaves():
    r = growth.Rows(np.zeros((2, 5), np.uint8), np.ones(5, np.uint8), np.ones(5), 2)
    grove, importances = growth.grow(r, [1, 2], 30, 1, 2)
    assert grove.feature.tolist() == [-1, -1] and importances.tolist() == [0, 0]


@pytest.fixture(scope="module")
def data(spark):
    r = rows(400, seed=5)
    table = [(float(r.y[i]), [float(v) for v in r.x[:, i]], float(r.w[i])) for i in range(400)]
    out = spark.createDataFrame(table, "label DOUBLE, x ARRAY<DOUBLE>, weight DOUBLE").withColumn("features", array_to_vector("x")).persist()
    yield out
    out.unpersist()


@pytest.mark.parametrize("depth, least", [(3, 1), (6, 4), (30, 10)])
def test_a_single_tree_is_that_of_mllib(data, depth, least):
    own = forest.Forest(1, depth, least, single=True).fit(data).transform(data).select("x", "label", F.col("prediction").alias("a"))
    theirs = est.decision_tree("gini", depth, least).fit(data).transform(data).select("x", "label", F.col("prediction").alias("b"))
    assert own.where("a = label").count() == theirs.where("b = label").count()
    assert own.distinct().join(theirs.distinct(), ["x", "label"]).where("a <> b").count() == 0


def test_a_forest_scores_about_as_well_as_that_of_mllib(data):
    def right(model):
        return model.transform(data).where("label = prediction").count() / 400
    theirs = est.random_forest(60, 6, 3, weight_col="weight").fit(data)
    own = forest.grow(data, 60, 6, 3, weight_col="weight")
    assert right(own) == pytest.approx(right(theirs), abs=0.04)
    assert own.featureImportances.toArray() == pytest.approx(theirs.featureImportances.toArray(), abs=0.06)


def test_a_forest_does_not_depend_on_partitions_and_stays_off_the_driver(data):
    def votes(of):
        grown = forest.grow(of, 9, 30, 1, weight_col="weight", part=4)
        assert [p.getNumTrees for p in grown.parts] == [4, 4, 1] and grown.parts[0].groves.inputFiles()
        got = grown.transform(data).select("x", "label", vector_to_array("rawPrediction").alias("v")).collect()
        return sorted((tuple(r.x), r.label, tuple(r.v)) for r in got)
    one = votes(data.coalesce(1))
    assert len(one) == 400 and one == votes(data.repartition(5))


def test_classes_that_one_part_lacks_get_no_votes_of_it(data):
    three = data.withColumn("label", F.when(F.col("x")[3] == 7, 2.0).otherwise(F.col("label")))
    mixed = forest.GrownForest((forest._fit(data, 3, 0, 5, 2, 1, None), forest._fit(three, 3, 1, 5, 2, 1, None)))
    sizes = mixed.transform(data).select(F.size(vector_to_array("rawPrediction")).alias("n"),
                                         F.aggregate(vector_to_array("rawPrediction"), F.lit(0.0), lambda a, b: a + b).alias("s"))
    assert sizes.distinct().collect() == [(3, 6.0)]


def test_labels_must_be_class_numbers(data):
    with pytest.raises(ValueError):
        forest.grow(data.withColumn("label", F.lit(0.5)), 2)
    with pytest.raises(ValueError):
        forest.grow(data, 2, 31)


def test_edges_between_few_values_and_at_shares_of_many():
    assert forest._cut(np.array([3.0, 0.0, 1.0]), np.ones(3)).tolist() == [0.5, 2.0]
    edges = forest._cut(np.arange(3200.0), np.ones(3200))
    assert len(edges) == 31 and np.diff(np.searchsorted(np.arange(3200), edges)).tolist() == [100] * 30
    rare = forest._cut(np.array([0.0, 1.0]), np.array([1e6, 1.0]))
    assert rare.tolist() == [0.5] and forest._cut(np.array([2.0]), np.ones(1)).size == 0


def test_unlimited_baselines_are_grown_apart(data):
    """The tree and the forest without a limit of depth keep their nodes off the driver."""
    made = est.baselines(400)
    assert made["tree"] == forest.Forest(1, 30, seed=42, single=True) and made["forest"] == forest.Forest(100, 30, seed=42)
    tree = made["tree"].fit(data)
    assert tree.trees == 1 and tree.transform(data).where("label = prediction").count() >= 380
