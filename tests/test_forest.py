"""The forest fitted a few trees at a time is one of Spark's own models."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from contrail.operators import forest
from contrail.operators.churn import binary_metrics, classifiers, compared, final_forest, with_score


def _rows(spark, n=600):
    x = [F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 1000.0 for i in range(4)]
    df = spark.range(n).select(F.array(*x).alias("x"))
    return df.select(array_to_vector("x").alias("features"), (F.col("x")[0] + F.col("x")[1] > 1).cast("double").alias("cancelled"))


def _whole(trees=7):
    return RandomForestClassifier(numTrees=trees, maxDepth=6, seed=3, labelCol="cancelled")


def _scores(model, df):
    return [tuple(r) for r in model.transform(df).select(vector_to_array("probability").alias("p"), "prediction").collect()]


def test_trees_fitted_apart_are_one_model(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(forest, "MANY", 100)
    monkeypatch.setattr(forest, "ROWS", 250)
    monkeypatch.setattr(forest, "TREES", 3)
    df = _rows(spark)
    made, join = [], forest.joined
    monkeypatch.setattr(forest, "joined", lambda whole, parts: made.extend(parts) or join(whole, parts))
    model = forest.Forest(_whole()).fit(df)
    assert [len(p.trees) for p in made] == [3, 3, 1]
    assert model.getNumTrees == 7 and len({t.toDebugString.split("\n", 1)[1] for t in model.trees}) == 7
    # every tree has one vote
    parts = [_scores(p, df) for p in made]
    for i, (p, prediction) in enumerate(_scores(model, df)):
        assert p[1] == pytest.approx(sum(w * s[i][0][1] for w, s in zip((3, 3, 1), parts)) / 7)
        assert prediction == (p[1] > 0.5) or p[1] == pytest.approx(0.5)
    mean = sum(w * p.featureImportances.toArray() for w, p in zip((3, 3, 1), made)) / 7
    assert model.featureImportances.toArray() == pytest.approx(mean)
    model.write().save(str(tmp_path / "forest"))
    loaded = RandomForestClassificationModel.load(str(tmp_path / "forest"))
    assert _scores(loaded, df) == _scores(model, df) and loaded.getNumTrees == 7
    # the same rows in the same layout give the same trees
    assert _scores(forest.Forest(_whole()).fit(df), df) == _scores(model, df)


def test_few_rows_are_fitted_at_once(spark):
    df = _rows(spark, 200)
    assert _scores(forest.Forest(_whole()).fit(df), df) == _scores(_whole().fit(df), df)


def test_a_tree_has_the_whole_forests_parameters(spark, monkeypatch):
    monkeypatch.setattr(forest, "MANY", 100)
    for f in (final_forest(), classifiers()["Random Forest"]):
        whole = f.whole
        assert (whole.getNumTrees(), whole.getMaxDepth()) == (100, 30)
    model = final_forest().fit(_rows(spark, 200))
    assert model.getNumTrees == 100 and model.getOrDefault("minInstancesPerNode") == 3


def test_compared_models_score_each_row_once(spark):
    df = _rows(spark, 300)
    model, scored = _whole().fit(df), spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            scored.add(b.num_rows)
            yield b

    class Counted:
        def transform(self, rows):
            out = model.transform(rows)
            return out.mapInArrow(count, out.schema)

    r = compared({"a": Counted()}, df).first()
    assert scored.value == 300
    want = binary_metrics(with_score(model.transform(df))).first()
    assert r["model"] == "a" and all(r[c] == pytest.approx(want[c]) for c in ("accuracy", "precision", "recall", "f1", "roc_auc"))


def test_deep_nodes_are_grown_where_their_rows_are(spark, monkeypatch):
    monkeypatch.setattr(forest, "MANY", 100)
    df, fitted, asked = _rows(spark), [], []
    plain, splits = RandomForestClassifier._fit, forest._splits
    monkeypatch.setattr(RandomForestClassifier, "_fit", lambda self, rows: fitted.append(rows.count()) or plain(self, rows))

    def counted(even, tops, chosen, plan):
        found = splits(even, tops, chosen, plan)
        asked.extend(sum(r["total"]) for r in found)
        return found

    monkeypatch.setattr(forest, "_splits", counted)
    near = forest.Forest(_whole()).fit(df)
    # no histogram of all tasks, and Spark's fit never sees the rows
    assert not asked and max(fitted) <= 2
    monkeypatch.setattr(forest, "SMALL", 150)
    far = forest.Forest(_whole()).fit(df)
    # only nodes of many rows got one (a root's rows are known by it), and the trees are the same
    assert asked and min(asked) > 150
    assert _scores(far, df) == _scores(near, df) and far.totalNumNodes == near.totalNumNodes
    assert far.featureImportances.toArray() == pytest.approx(near.featureImportances.toArray())


def test_a_subtree_holds_its_rows_and_splits_best():
    r = np.random.default_rng(5)
    x, y, w = r.integers(0, 8, (500, 6)).astype(np.uint8), r.integers(0, 2, 500).astype(np.uint8), r.integers(1, 4, 500)
    y[x[:, 2] > 4] = 1
    plan = forest.Plan([np.arange(7.0)] * 6, frozenset(), 2, 6, 3, forest.NO_GAIN, 30, 1)
    total, feature, code, gain, left = forest._subtree(x, y, w, 11, 0, plan)
    # the root's split against all splits, one by one
    def gini(i):
        p = np.bincount(y[i], w[i], 2) / w[i].sum()
        return w[i].sum() * (1 - (p ** 2).sum())
    every = np.ones(500, bool)
    best = max((gini(every) - gini(x[:, f] <= c) - gini(x[:, f] > c)) / w.sum() for f in range(6) for c in range(7) if 0 < (x[:, f] <= c).sum() < 500)
    assert gain[0] == pytest.approx(best) and (feature[0], code[0]) == (2, 4)
    # each node's weights are those of the rows that reach it; leaves keep the least rows, siblings that say the same are one
    at = [(0, every)]
    for node, rows in at:
        assert total[node] == pytest.approx(np.bincount(y[rows], w[rows], 2))
        if left[node] >= 0:
            goes = x[:, feature[node]] > code[node]
            at += [(left[node], rows & ~goes), (left[node] + 1, rows & goes)]
            assert min(total[left[node]].sum(), total[left[node] + 1].sum()) >= 3
            both = left[left[node]] < 0 and left[left[node] + 1] < 0
            assert not both or total[left[node]].argmax() != total[left[node] + 1].argmax()
    assert len(at) == len(left)
