"""Forests grown by level: counts, splits and importances against plain loops, whatever the blocks."""
import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from panelforge.operators import forest, models


def rows_of(spark, x, y):
    return spark.createDataFrame([(Vectors.dense([float(v) for v in r]), float(c)) for r, c in zip(x, y)], ["features", "label"])


def some(n=600, width=5, seed=3):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, width))
    x[:, 1] = np.round(x[:, 1])
    return x, ((x[:, 0] > 0.2) ^ (x[:, 1] > 0)).astype(int)


def test_counts_of_a_level_equal_plain_loops():
    x, y = some()
    shape = forest.Shape(5, 2, 32, 4, 3, 7)
    cuts = [np.unique(np.quantile(x[:, j], np.arange(1, 32) / 32)) for j in range(5)]
    codes = forest.ranges(x, cuts)
    feature, cut = np.full((4, 8), -1, np.int16), np.zeros((4, 8), np.uint8)
    feature[:, 1], cut[:, 1], feature[:, 2], cut[:, 2], feature[:3, 3], cut[:3, 3] = 0, 15, 1, 3, 2, 9
    blocks = [(0, codes[:250], y[:250].astype(np.uint8)), (9, codes[250:], y[250:].astype(np.uint8))]
    got = forest.count_level(iter(blocks), shape, feature, cut, 2).reshape(4, 4, 3, 32, 2)
    want = np.zeros_like(got)
    for t in range(4):
        of = forest.candidates(7, t, 2, 5, 3)
        for number, xs, ys in blocks:
            for row, label, times in zip(xs, ys, forest.drawn(7, number, t, len(ys))):
                at = 1
                while at < 4 and feature[t, at] >= 0:
                    at = 2 * at + int(row[feature[t, at]] > cut[t, at])
                for j in range(3) if at >= 4 else ():
                    want[t, at - 4, j, row[of[at - 4, j]], label] += times
    assert (got == want).all() and got[3, 2:].sum() == 0
    assert (got.sum((3, 4)) == got.sum((3, 4))[:, :, :1]).all()  # each candidate sees every row of the node


def test_best_split_equals_trying_all():
    r = np.random.default_rng(5)
    counts = r.integers(0, 9, (6, 3, 8, 2))
    counts[:, 1:] = np.array([[r.permutation(counts[i, 0]) for _ in range(2)] for i in range(6)])
    counts[5, :, :, 1] = 0  # one class: nothing to gain
    of = forest.candidates(0, 0, 3, 7, 3)[:6]

    def gini(c):
        return c.sum() - (c ** 2).sum() / max(c.sum(), 1)

    feature, cut, gain, left, right = forest.best_splits(counts, of)
    for i in range(5):
        tried = {(j, b): gini(counts[i, j].sum(0)) - gini(counts[i, j, :b + 1].sum(0)) - gini(counts[i, j, b + 1:].sum(0)) for j in range(3) for b in range(7)}
        assert gain[i] == pytest.approx(max(tried.values()))
        j = list(of[i]).index(feature[i])
        assert tried[j, cut[i]] == pytest.approx(gain[i])
        assert (left[i] == counts[i, j, :cut[i] + 1].sum(0)).all() and (left[i] + right[i] == counts[i, j].sum(0)).all()
    assert feature[5] == -1 and gain[5] == 0


def test_forest_learns_and_scores_alike_on_both_sides(spark):
    x, y = some(3000)
    df = rows_of(spark, x, y).repartition(3)
    model = models.random_forest(30, 6, 1).fit(df)
    scored = models.score(model, rows_of(spark, x, y).withColumn("i", F.monotonically_increasing_id())).orderBy("i").toPandas()
    assert (scored["pred"] == y).mean() > 0.93
    assert np.allclose(scored["proba"], model.probabilities(x)[:, 1])
    assert ((scored["proba"] > 0.5).astype(int) == scored["pred"]).all()
    imp = model.featureImportances.toArray()
    assert imp.sum() == pytest.approx(1) and set(imp.argsort()[-2:]) == {0, 1}


def test_all_trees_grow_by_a_level_in_one_pass(spark, monkeypatch):
    """Passes over the rows follow the depth, not the number of trees or nodes."""
    x, y = some(2000)
    passes = []
    grown = forest.ForestClassifier.grown
    monkeypatch.setattr(forest.ForestClassifier, "grown", lambda self, *a: passes.append(a[-1]) or grown(self, *a))
    model = models.random_forest(200, 5, 1).fit(rows_of(spark, x, y))
    assert passes == [0, 1, 2, 3, 4]
    # every drawn row is in one node of a level; the bootstrap draws about as many rows as there are
    root = model.counts[:, 1].sum(1)
    assert root.mean() == pytest.approx(len(y), rel=0.02) and len(set(root)) > 50
    assert (model.counts[:, 2:4].sum((1, 2)) == root).all()


def test_one_class_few_rows_and_no_rows(spark):
    model = models.random_forest(5, 3, 0).fit(rows_of(spark, [[1.0, 2.0], [3.0, 4.0], [1.0, 2.0]], [0, 0, 0]))
    assert (model.feature == -1).all() and (model.featureImportances.toArray() == 0).all()
    assert models.score(model, rows_of(spark, [[1.0, 2.0]], [0])).first()["pred"] == 0
    with pytest.raises(ValueError):
        models.random_forest(5, 3, 0).fit(rows_of(spark, [[1.0]], [0.0]).limit(0))
