"""Member-month segmentation (K1-K9, E44) with Spark ML.

log1p on the skewed inputs -> robust scaling (exact median / IQR scalars) ->
PCA (centred; 95 % of variance) -> KMeans.  PCA needs only the d x d
covariance (tree-aggregated); all k and restarts of KMeans share one pass per
step with per-task partial sums, so both scale with the row count.  Cluster validity: Spark's silhouette (squared
Euclidean, exact, O(n k)), Davies-Bouldin and Calinski-Harabasz from per
cluster aggregates plus the k centroids.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkContext, TaskContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import PCA, PCAModel, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import SEGMENT_NAMES
from ..functions.ranking import exact_quantiles
from ..session import stored

CLUSTER_FEATURES = ["total_flights", "distance", "points_accumulated", "points_redeemed", "clv", "salary", "tenure",
                    "membership_age_months", "redemption_ratio", "avg_distance_per_flight", "points_per_flight",
                    "travel_intensity", "reward_dependency", "loyalty_efficiency", "engagement_score"]
SKEWED = ["total_flights", "distance", "points_accumulated", "points_redeemed", "clv", "travel_intensity",
          "reward_dependency"]


def cluster_inputs(features: DataFrame, key=("member_id", "year", "month")) -> DataFrame:
    """K1: the 15 clustering inputs, log1p on the 7 skewed ones."""
    cols = [F.log1p(F.col(c).cast("double")).alias(c) if c in SKEWED else F.col(c).cast("double").alias(c)
            for c in CLUSTER_FEATURES]
    return features.select(*key, *cols)


def robust_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """K2: (x - median) / IQR with exact linear quantiles; IQR 0 -> 1."""
    # one aggregate row (3 numbers per column) read once, used as literals:
    # keeps the plan flat however deep the input's lineage is
    long = df.select(*columns).unpivot([], columns, "column", "value")
    q = {r["column"]: (r["q0"], r["q1"], r["q2"])  # one row per column
         for r in exact_quantiles(long, "value", [0.25, 0.5, 0.75], by=["column"]).collect()}
    out = df
    for c in columns:
        q1, med, q3 = q[c]
        iqr = (q3 - q1) or 1.0
        out = out.withColumn(c, (F.col(c) - F.lit(med)) / F.lit(iqr))
    return out


def assemble(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=out, handleInvalid="keep").transform(df)


def fit_pca(vec: DataFrame, k: int, input_col: str = "features") -> PipelineModel:
    """Centred PCA (Spark's PCA does not centre the scores)."""
    return Pipeline(stages=[
        StandardScaler(withMean=True, withStd=False, inputCol=input_col, outputCol="_centred"),
        PCA(k=k, inputCol="_centred", outputCol="pca"),
    ]).fit(vec)


def first_components(model: PipelineModel, k: int) -> PipelineModel:
    """What ``fit_pca`` gives for ``k`` of the components of ``model``: Spark takes all and keeps the first
    (its Python side has no call for it)."""
    scaler, pca = model.stages
    if k > pca.pc.numCols:
        raise ValueError("fewer components than asked for")
    sc, values = SparkContext.getOrCreate(), pca.pc.toArray()[:, :k]
    jvm = sc._jvm.org.apache.spark.ml
    kept = PCAModel(jvm.feature.PCAModel(
        jvm.util.Identifiable.randomUID("pca"), _py2java(sc, DenseMatrix(len(values), k, values.ravel(order="F"))),
        _py2java(sc, DenseVector(pca.explainedVariance.toArray()[:k]))))
    kept._resetUid(kept._java_obj.uid())
    kept = pca._copyValues(kept)._set(k=k)
    kept._transfer_params_to_java()
    return PipelineModel([scaler, kept])


class Centroids:
    """A fitted set of centres: assigns every row to its nearest one (the first
    of equally near ones) with built-in expressions."""

    def __init__(self, centers, col: str = "pca"):
        self.centers = np.asarray(centers, dtype=float)
        self.col = col

    def clusterCenters(self) -> list[np.ndarray]:
        return list(self.centers)

    def transform(self, df: DataFrame) -> DataFrame:
        d = [F.aggregate(F.zip_with("_v", F.lit(c.tolist()), lambda x, y: (x - y) * (x - y)), F.lit(0.0),
                         lambda acc, x: acc + x) for c in self.centers]
        return (df.withColumn("_v", vector_to_array(self.col)).withColumn("_d", F.array(*d))
                .withColumn("cluster", (F.array_position("_d", F.array_min("_d")) - 1).cast("int")).drop("_v", "_d"))

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, self.col, c.tolist()) for i, c in enumerate(self.centers)]  # k rows
        spark.createDataFrame(rows, "cluster int, col string, center array<double>").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Centroids:
        rows = spark.read.parquet(path).orderBy("cluster").collect()  # k rows
        return cls([r["center"] for r in rows], rows[0]["col"])


#: Rows whose distances to all open centres are held at once in a task.
STEP_BLOCK = 4096


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    for batch in batches:
        x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        x = x[np.isfinite(x).all(1)]
        for i in range(0, len(x), STEP_BLOCK):
            yield x[i:i + STEP_BLOCK]


#: Rows of one stored piece: a few KB.
PIECE = 32


def _pieces(rows: DataFrame, d: int) -> DataFrame:
    """The rows of ``rows`` (v array) that have a distance, PIECE at a time as the bytes of
    their numbers: a pass reads one flat value for many rows, not an array for each."""
    def pack(batches):
        for x in _blocks(batches, d):
            yield pa.RecordBatch.from_arrays([pa.array([x[i:i + PIECE].tobytes() for i in range(0, len(x), PIECE)], pa.binary())], ["x"])

    return rows.mapInArrow(pack, "x binary")


def _piece_blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for i in range(0, batch.num_rows, STEP_BLOCK // PIECE):
            pieces = batch.column(0).slice(i, STEP_BLOCK // PIECE).to_pylist()
            yield np.frombuffer(b"".join(pieces)).reshape(-1, d)


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances (rows x centres); rounding noise counts as none."""
    size = (x * x).sum(1)[:, None] + (c * c).sum(1)
    out = size - 2.0 * (x @ c.T)
    out[out <= 1e-12 * size] = 0.0
    return out


def kmeans_starts(rows: DataFrame, d: int, k: int, restarts: int, seed: int) -> list[np.ndarray]:
    """k-means++ starts of every restart, one pass over ``rows`` (v array) per
    further centre: a row is drawn with a chance in proportion to its squared
    distance from the centres drawn before (the smallest of exponential keys
    divided by that distance), so each task sends one row per restart."""
    chosen = [np.empty((0, d)) for _ in range(restarts)]
    for step in range(k):
        def draw(batches, step=step, chosen=chosen):
            rng = np.random.default_rng([seed, step, TaskContext.get().partitionId()])
            best, row = np.full(restarts, np.inf), [None] * restarts
            for x in _blocks(batches, d):
                key = rng.exponential(size=(len(x), restarts))
                if step:
                    far = np.stack([_squares(x, c).min(1) for c in chosen], 1)
                    key = np.divide(key, far, out=np.full(far.shape, np.inf), where=far > 0)
                at = key.argmin(0)
                for r in np.flatnonzero(key[at, np.arange(restarts)] < best):
                    best[r], row[r] = key[at[r], r], x[at[r]].tolist()
            found = [r for r in range(restarts) if row[r] is not None]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.int32()), pa.array([best[r] for r in found], pa.float64()),
                 pa.array([row[r] for r in found], pa.list_(pa.float64()))], ["restart", "key", "v"])

        drawn = rows.mapInArrow(draw, "restart int, key double, v array<double>")
        # one row per restart
        found = {r["restart"]: r["v"] for r in drawn.groupBy("restart").agg(F.min_by("v", "key").alias("v")).collect()}
        if not found:  # fewer different rows than centres
            break
        chosen = [np.vstack([c, found[r]]) if r in found else c for r, c in enumerate(chosen)]
    return chosen


def kmeans_sweep(data: DataFrame, ks, restarts: int = 20, seed: int = 42, col: str = "pca", max_iter: int = 300,
                 tol: float = 1e-4) -> dict[int, Centroids]:
    """K4: for every k the best of ``restarts`` seeded fits (``n_init``).

    All open (k, restart) sets move in ONE pass per step: each task returns the
    count, sum and cost of every open centre, Spark adds them up, and the driver
    gets one row per open centre (at most restarts * sum(ks)).  A set is closed
    when the squared moves of its centres add up to at most ``tol`` times the
    mean variance of a dimension.  A centre without rows stays where
    it is.  Rows with a missing or infinite value have no distance and take no
    part; with fewer different rows than k there are fewer centres; no rows are
    an error."""
    ks = sorted(set(ks))
    rows = stored(data.select(vector_to_array(col).alias("v")).where("v IS NOT NULL"), "kmeans-rows")
    first = rows.first()
    if first is None:
        raise ValueError("no rows to cluster")
    d = len(first["v"])
    starts = kmeans_starts(rows, d, ks[-1], restarts, seed)
    spread = rows.agg(*[F.var_pop(F.when(~F.isnan(F.col("v")[i]), F.col("v")[i])) for i in range(d)]).first()
    stop = tol * float(np.nanmean([x if x is not None else 0.0 for x in spread]))
    stop = stop if math.isfinite(stop) else 0.0
    sets = {(k, r): starts[r][:k] for k in ks for r in range(restarts)}
    cost = dict.fromkeys(sets, math.inf)
    left = list(sets)
    pieces = stored(_pieces(rows, d), "kmeans-pieces")  # every step reads them
    for _ in range(max_iter):
        ends = np.cumsum([len(sets[m]) for m in left])
        spans = [(int(e) - len(sets[m]), int(e)) for m, e in zip(left, ends)]
        centers = np.vstack([sets[m] for m in left])

        def add_up(batches, spans=spans, centers=centers):
            sums = np.zeros((len(centers), d + 2))
            line = np.column_stack([-2.0 * centers, (centers * centers).sum(1)])
            for x in _piece_blocks(batches, d):
                # squared distances less the row's own square, a line per centre
                far, x2 = line @ np.column_stack([x, np.ones(len(x))]).T, (x * x).sum(1)
                full = np.column_stack([x, np.ones(len(x)), x2])  # the last: a row's cost
                for a, b in spans:
                    best = far[a:b].min(0)
                    own = far[a:b] == best
                    if np.count_nonzero(own) > len(x):  # equally near: the first
                        own = far[a:b].argmin(0) == np.arange(b - a)[:, None]
                    np.add(best, x2, out=full[:, -1])
                    full[full[:, -1] <= 2e-12 * x2, -1] = 0.0  # rounding noise
                    sums[a:b] += own.astype(float) @ full
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(centers), dtype=np.int32)), pa.array(sums[:, d]), pa.array(sums[:, d + 1]),
                 pa.array(sums[:, :d].tolist(), pa.list_(pa.float64()))], ["slot", "n", "paid", "total"])

        parts = pieces.mapInArrow(add_up, "slot int, n double, paid double, total array<double>")
        sums = parts.groupBy("slot").agg(F.sum("n").alias("n"), F.sum("paid").alias("paid"),
                                         *[F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(d)]).collect()
        moved, paid = centers.copy(), np.zeros(len(centers))
        for r in sums:
            paid[r["slot"]] = r["paid"]
            if r["n"]:
                moved[r["slot"]] = np.array([r[f"t{i}"] for i in range(d)]) / r["n"]
        step = ((moved - centers) ** 2).sum(1)
        still = []
        for m, (a, b) in zip(left, spans):
            sets[m], cost[m] = moved[a:b], float(paid[a:b].sum())
            if step[a:b].sum() > stop:
                still.append(m)
        left = still
        if not left:
            break
    return {k: Centroids(sets[min(((k, r) for r in range(restarts)), key=lambda m: cost[m])], col) for k in ks}


def kmeans_best(data: DataFrame, k: int, restarts: int = 20, seed: int = 42, col: str = "pca") -> Centroids:
    """KMeans keeping the lowest-cost of several seeded restarts."""
    return kmeans_sweep(data, [k], restarts, seed, col)[k]


#: Rows that the silhouette is taken over, as in the analysed notebook, and rows of one block.
SILHOUETTE_ROWS, BLOCK = 10_000, 512


def _block_sums(left: pa.Table, right: pa.Table) -> pa.Table:
    """Of each row of a pair of blocks: the sum of its distances to the other block's rows
    of each cluster, and how many there are."""
    out = []
    both = [(left, right)] if len(left) and len(right) and left["block"][0] == right["block"][0] else [(left, right), (right, left)]
    for a, b in both:
        if not len(a) or not len(b):
            continue
        x, y = (t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1) for t in (a, b))
        d = np.sqrt(sum((x[:, c, None] - y[None, :, c]) ** 2 for c in range(x.shape[1])))
        names = b["cluster"].to_pylist()
        for name in sorted(set(names)):
            own = np.array([n == name for n in names])
            out.append(pa.table({"row": a["row"], "cluster": a["cluster"], "other": pa.array([name] * len(a), pa.string()),
                                 "total": pa.array(d[:, own].sum(1)), "n": pa.array(np.full(len(a), own.sum(), np.int64))}))
    return pa.concat_tables(out)


def silhouettes(points: DataFrame) -> DataFrame:
    """K5: (row, cluster, silhouette) of each of ``points`` (cluster, v array<double>; a
    sample of bounded size) by plain Euclidean distances.

    Rows are dealt to blocks; each pair of blocks meets once and gives partial sums of
    distances by cluster, which aggregates add up.  A row alone in its cluster has 0;
    with one cluster there is no other to compare with, and all are null."""
    rows = stored(points.select(F.col("cluster").cast("string").alias("cluster"), "v").withColumn("row", F.monotonically_increasing_id()), "silhouette")
    blocks = -(-rows.count() // BLOCK) or 1
    rows = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    left = rows.withColumn("a", F.col("block")).withColumn("b", F.explode(F.sequence("block", F.lit(blocks - 1))))
    right = rows.withColumn("b", F.col("block")).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("block"))))
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    sums = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(
        _block_sums, "row long, cluster string, other string, total double, n long")
    each = sums.groupBy("row", "cluster", "other").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    own = F.col("cluster") == F.col("other")
    per = each.groupBy("row", "cluster").agg(
        F.max(F.when(own, F.try_divide(F.col("total"), F.col("n") - 1))).alias("a"),
        F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"))
    s = F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    return per.select("row", "cluster", F.when(F.col("b").isNotNull(), F.when(F.col("a").isNull(), 0.0).otherwise(s)).alias("silhouette"))


def silhouette(pred: DataFrame, col: str = "pca", sample_size: int = SILHOUETTE_ROWS, seed: int = 42) -> float:
    """K5: mean Euclidean silhouette over ``sample_size`` rows, the first by a seeded hash of
    the vector (all rows, if they are fewer); NaN with one cluster."""
    points = pred.select("cluster", vector_to_array(col).alias("v"))
    points = points.withColumn("h", F.xxhash64("v", F.lit(seed))).orderBy("h", "cluster").limit(sample_size)
    found = silhouettes(points).agg(F.avg("silhouette")).first()[0]
    return math.nan if found is None else float(found)


def centroid_metrics(pred: DataFrame, model: Centroids, col: str = "pca") -> dict:
    """K5-K7: silhouette (Euclidean, on a seeded sample), Davies-Bouldin, Calinski-Harabasz."""
    centers = [np.asarray(c, dtype=float) for c in model.clusterCenters()]
    k = len(centers)
    sil = silhouette(pred, col)
    arr = pred.select("cluster", vector_to_array(col).alias("v"))
    cent = pred.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centers)],
                                             "cluster int, c array<double>")
    # k rows of centroids: a bounded broadcast
    d = arr.join(F.broadcast(cent), "cluster").select(
        "cluster", F.sqrt(F.aggregate(F.zip_with("v", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0),
                                      lambda acc, x: acc + x)).alias("dist"), "v")
    # one row per cluster (k rows)
    rows = d.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("dist").alias("s"),
                                    F.sum(F.col("dist") * F.col("dist")).alias("ss")).collect()
    per = {r["cluster"]: (r["n"], r["s"]) for r in rows}
    n = sum(v[0] for v in per.values())
    db = 0.0
    for i in range(k):
        worst = 0.0
        for j in range(k):
            if i != j and i in per and j in per:
                dij = float(np.linalg.norm(centers[i] - centers[j]))
                worst = max(worst, (per[i][1] + per[j][1]) / dij if dij > 0 else math.inf)
        db += worst
    db /= k
    overall = sum(per[i][0] * centers[i] for i in per) / n
    between = sum(per[i][0] * float(np.sum((centers[i] - overall) ** 2)) for i in per)
    within = float(sum(r["ss"] for r in rows))
    ch = (between / (k - 1)) / (within / (n - k)) if k > 1 and within > 0 else float("nan")
    return {"silhouette": sil, "davies_bouldin": float(db), "calinski_harabasz": float(ch),
            "inertia": within}


def name_segments(profile: dict[int, dict[str, float]]) -> dict[int, str]:
    """K9: cluster ids are arbitrary, so names follow a centroid rule:
    fewest flights -> Inactive Customers; of the rest highest CLV -> Premium
    Customers; highest redemption ratio -> Reward Seekers; most flights ->
    Frequent Flyers; the remaining cluster -> High Value At-Risk.  With k != 5
    the leftover clusters keep a generic name."""
    left = set(profile)
    names = {}

    def take(metric, label, largest):
        if not left:
            return
        pick = (max if largest else min)(sorted(left), key=lambda c: profile[c][metric])
        names[pick] = label
        left.discard(pick)

    take("total_flights", SEGMENT_NAMES[0], False)
    take("clv", SEGMENT_NAMES[2], True)
    take("redemption_ratio", SEGMENT_NAMES[3], True)
    take("total_flights", SEGMENT_NAMES[1], True)
    for c in sorted(left):
        names[c] = SEGMENT_NAMES[4] if len(left) == 1 else f"Segment {c}"
    return names


def cluster_profile(assigned: DataFrame, columns: list[str]) -> DataFrame:
    """Mean per cluster (round 2) and the z-score of each cluster mean
    across clusters (sample std over the k cluster rows)."""
    from ..functions.exprs import rnd
    from pyspark.sql import Window
    prof = assigned.groupBy("cluster").agg(*[F.avg(c).alias(c) for c in columns])
    allw = Window.partitionBy()  # k rows
    out = prof
    for c in columns:
        out = out.withColumn(f"z_{c}", (F.col(c) - F.avg(c).over(allw)) / F.stddev_samp(c).over(allw))
    return out.select("cluster", *[rnd(c, 2).alias(c) for c in columns], *[f"z_{c}" for c in columns])
