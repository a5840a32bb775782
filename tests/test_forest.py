"""The forest for large tables against plain recursion over all rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from failwatch.operators import forest, importance
from failwatch.storage import materialize

WIDTH = 5


def _rows(spark, n, label):
    """Rows of four noisy features, the last two with few values, and one constant."""
    values = [F.rand(1), F.rand(2) * 3 - 1, F.floor(F.rand(3) * 4), F.when(F.col("id") == 7, 9.0).otherwise(F.col("id") % 2), F.lit(2.0)]
    plain = spark.range(n, numPartitions=3).select("id", F.array(*[v.cast("double") for v in values]).alias("values"))
    return materialize(plain.select(
        F.xxhash64("id").alias("draw"), array_to_vector("values").alias("features"), label.cast("double").alias("label"),
        (F.col("id") % 5 == 0).alias("held_out"), "values"))


def _recursion(bins, label, weights, head, depth, gains):
    """One tree as nested tuples, by trying every split of every node."""
    normal, failed = weights[label == 0].sum(), weights[label == 1].sum()
    share = failed / max(1.0, normal + failed)
    if not normal or not failed or not depth:
        return share

    def gini(n, f):
        return 2.0 * n * f / (n + f)

    best = (forest.LEAST_GAIN, None, None)
    for f in forest._tried_features(head, bins.shape[1])[0]:
        for at in range(forest.BINS - 1):
            left = bins[:, f] <= at
            if not weights[left].sum() or not weights[~left].sum():
                continue
            n, y = weights[left & (label == 0)].sum(), weights[left & (label == 1)].sum()
            gain = (gini(normal, failed) - gini(n, y) - gini(normal - n, failed - y)) / (normal + failed)
            if gain > best[0] + 1e-15:
                best = (gain, f, at)
    gain, f, at = best
    if f is None:
        return share
    gains[f] += gain * (normal + failed)
    left = bins[:, f] <= at
    kids = [_recursion(bins[m], label[m], weights[m], forest._child_hash(head, r), depth - 1, gains) for r, m in enumerate((left, ~left))]
    return f, at, *kids


def _share(tree, row):
    while isinstance(tree, tuple):
        f, at, left, right = tree
        tree = left if row[f] <= at else right
    return tree


@pytest.mark.parametrize("local_rows, batch_rows", [(1 << 20, 1 << 25), (2_000, 12_000)])
def test_grown_trees_equal_recursion_over_all_rows(spark, monkeypatch, local_rows, batch_rows):
    """F1 to F4: every tree draws from all rows; large nodes, pieces and batches give the same forest."""
    monkeypatch.setattr(forest, "LOCAL_ROWS", local_rows)
    monkeypatch.setattr(forest, "BATCH_ROWS", batch_rows)
    label = (F.rand(5) < 0.2) | (F.col("values")[0] > 0.8) & (F.col("values")[2] == 1)
    rows = _rows(spark, 30_000, label)
    grown = importance.train_forest(rows, trees=3, max_depth=5)
    assert isinstance(grown, forest.Forest)
    assert (len(grown.batches) > 1) == (batch_rows == 12_000)

    table = rows.select("draw", "values", "label", "held_out").toPandas()
    values = np.array(table["values"].tolist())
    bins = np.column_stack([np.searchsorted(limit, values[:, f]) for f, limit in enumerate(grown.limits)])
    known = ~table["held_out"].to_numpy()
    draws, labels = table["draw"].to_numpy().view(np.uint64), table["label"].to_numpy()
    importances, votes = np.zeros(WIDTH), np.zeros(200)
    some = bins[~known][:200]
    for t in range(3):
        root = forest._root_hash(importance.SEED, t)
        weights = forest._times_drawn(draws[known], root).astype(float)
        assert abs(weights.sum() - 24_000) < 1_000 and 0.6 < (weights > 0).mean() < 0.66
        gains = np.zeros(WIDTH)
        tree = _recursion(bins[known], labels[known], weights, root, 5, gains)
        importances += gains / gains.sum()
        votes = votes + [_share(tree, row) for row in some]
    assert grown.featureImportances.toArray() == pytest.approx(importances / 3, rel=1e-9)

    held = rows.where("held_out").select("draw", "features", "label")
    found = {r["draw"]: r["prediction"] for r in grown.transform(held).collect()}
    assert len(found) == 6_000
    for draw, vote in zip(table["draw"][~known][:200], votes):
        assert found[draw] == float(vote > 1.5)


def test_thresholds_come_from_all_rows(spark):
    """a value that one row of 30,000 has is a bin of its own; others hold equally many rows."""
    rows = _rows(spark, 30_000, F.lit(0))
    grown = importance.train_forest(rows, trees=1, max_depth=1)
    assert [list(limit) for limit in grown.limits[2:]] == [[0.0, 1.0, 2.0], [0.0, 1.0], []]
    values = np.array([r["values"] for r in rows.where("not held_out").collect()])
    for f in (0, 1):
        held = np.bincount(np.searchsorted(grown.limits[f], values[:, f]))
        assert len(held) == 32 and abs(held - 750).max() < 12


@pytest.mark.parametrize("local_rows", [1 << 20, 2_000])
def test_rows_of_one_class_give_no_splits(spark, monkeypatch, local_rows):
    monkeypatch.setattr(forest, "LOCAL_ROWS", local_rows)
    grown = importance.train_forest(_rows(spark, 15_000, F.lit(1)), trees=2)
    assert not grown.featureImportances.toArray().any()
    assert grown.transform(_rows(spark, 10, F.lit(1)).select("label", "features")).where("prediction = 1.0").count() == 10


def test_rows_drawn_often_keep_their_weight():
    rows, times = np.arange(4, dtype=np.uint64), np.array([1, 7, 8, 15])
    out = forest._repeated(rows, times)
    row, weight = out & np.uint64((1 << 61) - 1), out >> np.uint64(61)
    assert [int(weight[row == k].sum()) for k in range(4)] == [1, 7, 8, 15]


def test_small_tables_keep_the_trainer_of_spark(spark):
    from pyspark.ml.classification import RandomForestClassificationModel

    assert isinstance(importance.train_forest(_rows(spark, 1_000, F.col("id") % 2), trees=1), RandomForestClassificationModel)
