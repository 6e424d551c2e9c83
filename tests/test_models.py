"""Clustering and class balancing on small synthetic frames."""

import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from contrail.operators import churn as M
from contrail.operators import clustering as K


def brute_silhouette(x, labels):
    d, out = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), []
    for i, own in enumerate(labels):
        same = (labels == own) & (np.arange(len(x)) != i)
        if not same.any():
            out.append(0.0)
            continue
        a, b = d[i, same].mean(), min(d[i, labels == c].mean() for c in set(labels) - {own})
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return float(np.mean(out))


@pytest.mark.parametrize("block", [16, 1000])
def test_silhouette_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(K, "BLOCK", block)
    r = np.random.default_rng(8)
    x = np.concatenate([r.normal(size=(100, 3)), r.normal(4, 1, (40, 3)), np.ones((20, 3)), [[50.0, 0, 0]]])
    labels = np.array(["a"] * 90 + ["b"] * 50 + ["c"] * 20 + ["alone"])
    points = spark.createDataFrame([(c, v) for c, v in zip(labels.tolist(), x.tolist(), strict=True)], "cluster string, v array<double>").repartition(3)
    got = K.silhouettes(points)
    assert got.count() == len(x)
    assert got.agg(F.avg("silhouette")).first()[0] == pytest.approx(brute_silhouette(x, labels), abs=1e-12)
    assert {r["silhouette"] for r in K.silhouettes(points.where("cluster = 'a'")).collect()} == {None}


def test_preprocessing_is_exact_and_survives_saving(spark, tmp_path):
    from pyspark.ml import PipelineModel
    r = np.random.default_rng(2)
    rows = [(i, None if i % 7 == 0 else float("nan") if i % 11 == 0 else float(r.integers(0, 50)), float(r.normal()) if i % 5 else None, 3.0,
             None if i % 6 == 0 else ["x", "y", "z"][int(r.integers(0, 3))], None) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, a double, b double, flat double, c string, none string")
    model = M.preprocessor(["a", "b", "flat"], ["c", "none"]).fit(df)
    model.write().overwrite().save(str(tmp_path / "prep"))
    for m in (model, PipelineModel.load(str(tmp_path / "prep"))):
        out = m.transform(df).orderBy("id").toPandas()
        for k, col in enumerate("ab"):
            v = np.array([np.nan if x[1 + k] is None else x[1 + k] for x in rows])
            v = np.where(np.isnan(v), np.median(v[~np.isnan(v)]), v)
            assert np.allclose(out[f"{col}__scl"], (v - v.mean()) / v.std(), atol=1e-12)
        assert set(out["flat__scl"]) == {0.0}
        words = [x[4] for x in rows if x[4]]
        mode = min(sorted(set(words)), key=lambda w: -words.count(w))
        assert [w if w else mode for w in (x[4] for x in rows)] == list(out["c__mode"]) and set(out["none__mode"]) == {"missing"}
    unseen = model.transform(spark.createDataFrame([(1, 1.0, 1.0, 1.0, "new", "new")], df.schema)).first()["features"]
    assert len(unseen) == len(out["features"][0]) and np.isfinite(unseen.toArray()).all()


def test_kmeans_blobs_and_metrics(spark):
    rnd = np.random.default_rng(0)
    centres = np.array([[0, 0, 0], [10, 0, 0], [0, 10, 0], [0, 0, 10], [10, 10, 10]], dtype=float)
    rows = [(Vectors.dense(c + rnd.normal(0, 0.5, 3)),) for c in centres for _ in range(60)]
    df = spark.createDataFrame(rows, ["pca"])
    models = K.kmeans_sweep(df, [2, 5], restarts=3)
    m5 = models[5]
    met = K.centroid_metrics(m5.transform(df), m5)
    x, labels = (np.array(v) for v in zip(*[(r["pca"].toArray(), r["cluster"]) for r in m5.transform(df).collect()]))
    assert met["silhouette"] == pytest.approx(brute_silhouette(x, labels), abs=1e-9) and met["silhouette"] > 0.85
    assert met["davies_bouldin"] < 0.3
    assert met["inertia"] < K.centroid_metrics(models[2].transform(df), models[2])["inertia"]
    sizes = sorted(r["n"] for r in m5.transform(df).groupBy("cluster").agg(F.count("*").alias("n")).collect())
    assert sizes == [60] * 5


def test_kmeans_sweep_reaches_the_library_and_falls_with_k(spark):
    from pyspark.ml.clustering import KMeans
    rnd = np.random.default_rng(3)
    df = spark.createDataFrame([(Vectors.dense(rnd.normal(0, 1, 4) * [3, 2, 1, 1]),) for _ in range(600)], ["pca"])
    got = {k: K.centroid_metrics(m.transform(df), m)["inertia"]
           for k, m in K.kmeans_sweep(df, [2, 3, 4], restarts=8).items()}
    assert got[2] > got[3] > got[4]
    best = min(KMeans(k=3, seed=s, featuresCol="pca", maxIter=300).fit(df).summary.trainingCost for s in range(4))
    assert got[3] <= best * 1.01


def test_kmeans_steps_read_every_row_in_pieces(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(5003, 3)) + 4 * rng.integers(0, 2, (5003, 1))
    odd = [[float("nan"), 0.0, 0.0], [0.0, float("inf"), 0.0]]
    rows = spark.createDataFrame([(v,) for v in x.tolist() + odd], "v array<double>").coalesce(2)
    pieces = K._pieces(rows, 3).collect()
    assert max(len(r["x"]) for r in pieces) == K.PIECE * 3 * 8 and len(pieces) < 200
    got = np.vstack([np.frombuffer(r["x"]).reshape(-1, 3) for r in pieces])
    assert sorted(map(tuple, got)) == sorted(map(tuple, x))
    # one step from given centres is the mean of each centre's rows
    starts = np.array([[0.0, 0.0, 0.0], [4.0, 4.0, 4.0]])
    monkeypatch.setattr(K, "kmeans_starts", lambda *a: [starts])
    data = rows.select(array_to_vector("v").alias("pca"))
    near = ((x[:, None] - starts) ** 2).sum(2).argmin(1)
    want = np.array([x[near == i].mean(0) for i in (0, 1)])
    assert K.kmeans_sweep(data, [2], 1, max_iter=1)[2].centers == pytest.approx(want)


def test_kmeans_fewer_rows_than_centres(spark):
    df = spark.createDataFrame([(Vectors.dense([0.0, 1.0]),)] * 5 + [(Vectors.dense([2.0, 1.0]),)] * 3, ["pca"])
    model = K.kmeans_best(df, 4, restarts=2)
    assert sorted(c.tolist() for c in model.clusterCenters()) == [[0.0, 1.0], [2.0, 1.0]]
    sizes = sorted(r["n"] for r in model.transform(df).groupBy("cluster").agg(F.count("*").alias("n")).collect())
    assert sizes == [3, 5]
    with pytest.raises(ValueError):
        K.kmeans_best(df.limit(0), 2, restarts=1)


def test_segment_names_rule():
    prof = {0: {"total_flights": 1, "clv": 5, "redemption_ratio": 0.1},
            1: {"total_flights": 9, "clv": 6, "redemption_ratio": 0.2},
            2: {"total_flights": 5, "clv": 50, "redemption_ratio": 0.1},
            3: {"total_flights": 4, "clv": 7, "redemption_ratio": 0.9},
            4: {"total_flights": 3, "clv": 20, "redemption_ratio": 0.3}}
    names = K.name_segments(prof)
    assert names == {0: "Inactive Customers", 2: "Premium Customers", 3: "Reward Seekers", 1: "Frequent Flyers",
                     4: "High Value At-Risk"}


def test_smote_balances_on_segments(spark):
    rnd = np.random.default_rng(1)
    major = [(Vectors.dense(rnd.normal(0, 1, 2)), 0.0) for _ in range(90)]
    minor = [(Vectors.dense(rnd.normal(3, 0.3, 2)), 1.0) for _ in range(10)]
    df = spark.createDataFrame(major + minor, ["features", "cancelled"])
    out = M.smote(df, k=5, seed=42)
    counts = {r["cancelled"]: r["n"] for r in out.groupBy("cancelled").agg(F.count("*").alias("n")).collect()}
    assert counts[0.0] == 90 and counts[1.0] == 90
    # synthetic points lie inside the minority's bounding box (convex combos)
    pts = np.array([r["features"].toArray() for r in out.filter("cancelled = 1").collect()])
    src = np.array([v.toArray() for v, _ in minor])
    assert (pts.min(0) >= src.min(0) - 1e-9).all() and (pts.max(0) <= src.max(0) + 1e-9).all()


def _smote_case(spark, minor, majority=90):
    rnd = np.random.default_rng(2)
    rows = [(i, Vectors.dense(rnd.normal(0, 1, 2)), 0.0) for i in range(majority)]
    rows += [(1000 + i, Vectors.dense(p), 1.0) for i, p in enumerate(minor)]
    return spark.createDataFrame(rows, ["id", "features", "cancelled"])


@pytest.mark.parametrize("minor", [
    [(1000.0 * i, -500.0 * i * i) for i in range(10)],  # all far apart
    [(0.01 * i, 0.0) for i in range(8)] + [(1e6, 0.0), (0.0, 1e6)],
    [(5.0, 5.0)] * 10,  # one point ten times
    [(5.0, 5.0)],
])
def test_smote_is_whole(spark, minor):
    df = _smote_case(spark, minor)
    out = M.smote(df, keys=["id"])
    counts = {r["cancelled"]: r["n"] for r in out.groupBy("cancelled").agg(F.count("*").alias("n")).collect()}
    assert counts == {0.0: 90, 1.0: 90}


def test_smote_does_not_depend_on_the_partitioning(spark):
    rnd = np.random.default_rng(4)
    df = _smote_case(spark, rnd.normal(3, 2, (20, 2)).tolist())
    one, two = (sorted(tuple(r["features"]) for r in M.smote(d, keys=["id"]).where("cancelled = 1").collect())
                for d in (df, df.repartition(7)))
    assert one == two


def test_split_is_deterministic_and_member_grouped(spark):
    rows = [(m, y, mo, float(m % 7 == 0)) for m in range(200) for y in (1, 2) for mo in (1, 2, 3)]
    df = spark.createDataFrame(rows, "member_id long, year int, month int, cancelled double")
    tr1, te1 = M.split(df, split_by="member")
    tr2, te2 = M.split(df, split_by="member")
    assert sorted(map(tuple, te1.collect())) == sorted(map(tuple, te2.collect()))
    both = tr1.select("member_id").distinct().join(te1.select("member_id").distinct(), "member_id")
    assert both.count() == 0
    frac = te1.count() / df.count()
    assert 0.1 < frac < 0.3


def test_split_keeps_class_shares_exactly(spark):
    rows = [(m, 1, mo, float(m % 10 == 0)) for m in range(100) for mo in (1, 2, 3)]
    df = spark.createDataFrame(rows, "member_id long, year int, month int, cancelled double")
    train, test = M.split(df)
    assert {r[0]: r[1] for r in test.groupBy("cancelled").count().collect()} == {0.0: 54, 1.0: 6}
    assert train.count() == 240
    again = M.split(df.repartition(5))[1]
    assert sorted(map(tuple, test.collect())) == sorted(map(tuple, again.collect()))


def test_a_step_takes_blocks_of_its_own_size():
    """The blocks of the silhouette once made those of the KMeans steps small."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros((5000, 2)).tolist())], ["v"])
    assert [len(x) for x in K._blocks(iter([batch]), 2)] == [4096, 904]


def test_shared_steps_are_taken_once(L, monkeypatch):
    """Quantiles, assignment, model inputs and the balanced rows are made once for all that read them."""
    from contrail.plans import models

    monkeypatch.setattr(models, "_FEATURES", {k: v for k, v in models._FEATURES.items() if k[-1] == "features"})
    mo, scaled, plain = models.Models(L), [], K.robust_scale
    monkeypatch.setattr(K, "robust_scale", lambda *a: scaled.append(1) or plain(*a))
    mo.segmented()
    mo.churn_inputs()
    mo.pca2()
    assert len(scaled) == 1
    assert mo.churn_inputs()[0] is models.Models(L).churn_inputs()[0] and mo.assigned() is mo.assigned()


def test_first_components_are_those_of_a_fit(spark, tmp_path):
    from pyspark.ml import PipelineModel
    from pyspark.ml.linalg import Vectors
    from contrail.operators import clustering as K
    r = np.random.default_rng(4)
    df = spark.createDataFrame([(Vectors.dense(v),) for v in r.normal(size=(200, 5)) * [5, 4, 3, 2, 1]], ["features"])
    kept, fitted = K.first_components(K.fit_pca(df, 5), 2), K.fit_pca(df, 2)
    kept.write().save(str(tmp_path / "pca"))
    want = np.array([row["pca"].toArray() for row in fitted.transform(df).collect()])
    for model in (kept, PipelineModel.load(str(tmp_path / "pca"))):
        assert model.stages[-1].getK() == 2
        assert model.stages[-1].explainedVariance.toArray() == pytest.approx(fitted.stages[-1].explainedVariance.toArray())
        assert np.array([row["pca"].toArray() for row in model.transform(df).collect()]) == pytest.approx(want)


def test_a_query_reads_a_model_once(L, monkeypatch):
    from contrail.plans import models
    read = []
    monkeypatch.setattr(models, "_load_or_fit", lambda loader, path, fit: read.append(path) or object())
    mo = models.Models(L)
    assert mo.forest() is mo.forest() and mo.pca_full() is mo.pca_full() and len(read) == 2
    assert models.Models(L).forest() is not mo.forest()
