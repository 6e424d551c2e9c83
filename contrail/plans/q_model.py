"""Clustering and churn-model queries (K1-K9, E44, E46, E47, M1-M21, A3, A4,
G12, I1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import churn as M
from ..operators import clustering as K
from ..operators import statistics as S
from ..operators.neighbours import nearest
from ..operators.prepare import MedianImputer, ModeImputer, PopulationScaler
from ..operators.sampling import sample_order_sql, seeded_sample
from ..functions.ranking import quantile_array
from ..session import stored
from .models import Models
from .oracle_base import query
from .q_features import _FEAT_ROWS, _scale_sql
from .registry import register

_FEAT_ALL = f"""feat_all AS (
  SELECT member_id, year, month, {_scale_sql('total_flights')} AS total_flights, {_scale_sql('distance')} AS distance,
    points_accumulated, points_redeemed, clv, salary, tenure, membership_age_months,
    {_scale_sql('redemption_ratio')} AS redemption_ratio, avg_distance_per_flight, points_per_flight
  FROM feat_rows),
feat_comp AS (
  SELECT *, distance / (tenure + 1) AS travel_intensity, points_redeemed / (clv + 1) AS reward_dependency,
    clv / (total_flights + 1) AS loyalty_efficiency,
    0.4 * total_flights + 0.3 * distance + 0.3 * redemption_ratio AS engagement_score
  FROM feat_all),
cin AS (
  SELECT member_id, year, month, """ + ", ".join(
    f"ln(1 + CAST({c} AS DOUBLE)) AS {c}" if c in K.SKEWED else f"CAST({c} AS DOUBLE) AS {c}"
    for c in K.CLUSTER_FEATURES) + " FROM feat_comp)"


@register("cluster_inputs", query("SELECT * FROM cin", _FEAT_ROWS, _FEAT_ALL), doubles=K.CLUSTER_FEATURES)
def cluster_inputs(L):
    """K1: the 15 clustering inputs with log1p on the skewed ones."""
    return K.cluster_inputs(Models(L).features())


@register("cluster_skew", query("\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", skewness(CAST({c} AS DOUBLE)) AS skewness FROM feat_comp" for c in K.CLUSTER_FEATURES),
    _FEAT_ROWS, _FEAT_ALL), doubles="skewness", digits=4)
def cluster_skew(L):
    """The 15 clustering features ranked by skewness, before their log1p."""
    return S.skew_rank(Models(L).features(), K.CLUSTER_FEATURES)


@register("cluster_correlation", query("\nUNION ALL\n".join(
    f"SELECT '{a}' AS x, '{b}' AS y, corr({a}, {b}) AS r FROM cin" for a in K.CLUSTER_FEATURES for b in K.CLUSTER_FEATURES),
    _FEAT_ROWS, _FEAT_ALL), doubles="r", digits=5)
def cluster_correlation(L):
    """S3: Pearson matrix of the 15 clustering inputs."""
    inputs = K.cluster_inputs(Models(L).features())
    gaps = [c for c, n in S.null_counts(inputs, K.CLUSTER_FEATURES).items() if n]
    return S.pearson_matrix(inputs, K.CLUSTER_FEATURES, gaps)


def _robust_sql():
    cols = []
    for c in K.CLUSTER_FEATURES:
        iqr = f"(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))"
        cols.append(f"({c} - (SELECT median({c}) FROM cin)) / (SELECT CASE WHEN {iqr} = 0 THEN 1.0 ELSE {iqr} END "
                    f"FROM cin) AS {c}")
    return "SELECT member_id, year, month, " + ", ".join(cols) + " FROM cin"


@register("robust_scale", query(_robust_sql(), _FEAT_ROWS, _FEAT_ALL), doubles=K.CLUSTER_FEATURES, digits=4)
def robust_scale(L):
    """K2: robust scaling (median / IQR) of the clustering inputs."""
    return K.robust_scale(K.cluster_inputs(Models(L).features()), K.CLUSTER_FEATURES)


@register("pca_variance")
def pca_variance(L):
    """K3: explained variance ratio of every component (centred PCA)."""
    m = Models(L).pca_full()
    import numpy as np
    ev = [float(x) for x in m.stages[-1].explainedVariance.toArray()]
    rows = [(i + 1, v, float(np.cumsum(ev)[i])) for i, v in enumerate(ev)]
    # d rows: derived from the fitted d x d covariance
    return L.spark.createDataFrame(rows, "pc int, variance double, cumulative double")


@register("pca_scores")
def pca_scores(L):
    """K3: 2-D centred PCA scores per member-month (scatter input)."""
    mo = Models(L)
    from pyspark.ml.functions import vector_to_array
    sc = mo.pca2().transform(mo.cluster_vectors())
    return sc.select(*M.ID_COLS, vector_to_array("pca")[0].alias("pc1"), vector_to_array("pca")[1].alias("pc2"))


@register("kmeans_elbow")
def kmeans_elbow(L):
    """K4 + K5-K7: k = 2..10 (best of restarts), inertia and validity metrics."""
    mo = Models(L)
    # nine models are measured on it
    data = stored(mo.projected().select("pca"), "projected")
    rows = []
    for k, model in sorted(mo.kmeans_sweep().items()):
        met = K.centroid_metrics(model.transform(data), model)
        rows.append((k, met["inertia"], met["silhouette"], met["davies_bouldin"],
                     met["calinski_harabasz"]))
    return L.spark.createDataFrame(rows, "k int, inertia double, silhouette double, davies_bouldin double, "
                                         "calinski_harabasz double")


@register("cluster_metrics")
def cluster_metrics(L):
    """K5-K7: validity metrics of the final k = 5 segmentation."""
    mo = Models(L)
    model = mo.kmeans()
    # the sample and the sums read it
    met = K.centroid_metrics(stored(model.transform(mo.projected()).select("cluster", "pca"), "assigned-points"), model)
    return L.spark.createDataFrame([(5, *[float(met[x]) for x in
                                          ("inertia", "silhouette", "davies_bouldin",
                                           "calinski_harabasz")])],
                                   "k int, inertia double, silhouette double, davies_bouldin double, "
                                   "calinski_harabasz double")


_SIL = ["total_flights", "total_distance", "clv"]


@register("silhouette_tiers", query(f"""
SELECT CAST(avg(CASE WHEN same = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END) AS DOUBLE) AS silhouette, CAST(count(*) AS BIGINT) AS rows
FROM (SELECT member_id, max(same) AS same, max(a) AS a, min(b) AS b FROM (
  SELECT p.member_id, CASE WHEN p.tier = q.tier THEN count(*) ELSE 0 END AS same,
    CASE WHEN p.tier = q.tier THEN avg(d) END AS a, CASE WHEN p.tier <> q.tier THEN avg(d) END AS b
  FROM pts p JOIN pts q ON p.member_id <> q.member_id,
    LATERAL (SELECT sqrt({' + '.join(f'power(p.{c} - q.{c}, 2)' for c in _SIL)}) AS d) GROUP BY p.member_id, p.tier, q.tier) GROUP BY member_id)""",
    f"pts AS (SELECT member_id, loyalty_card AS tier, {', '.join(_SIL)} FROM customers WHERE clv IS NOT NULL "
    f"ORDER BY {sample_order_sql(['member_id'])}, member_id LIMIT {K.SILHOUETTE_ROWS})"), doubles="silhouette", digits=8)
def silhouette_tiers(L):
    """K5: Euclidean silhouette of the tiers as clusters, on the seeded sample of members."""
    pts = seeded_sample(L.customers.where("clv IS NOT NULL"), "member_id", K.SILHOUETTE_ROWS)
    pts = pts.select(F.col("loyalty_card").alias("cluster"), F.array(*[F.col(c).cast("double") for c in _SIL]).alias("v"))
    return K.silhouettes(pts).agg(F.avg("silhouette").alias("silhouette"), F.count(F.lit(1)).alias("rows"))


@register("customer_segments")
def customer_segments(L):
    """K8 + K9: segment id and business name per member-month."""
    return Models(L).segmented().select(*M.ID_COLS, "customer_segment", "customer_segment_name")


@register("segment_centroids")
def segment_centroids(L):
    """K8: centroids of the 2-D k = 5 model."""
    m = Models(L).kmeans(space="pca2")
    rows = [(i, float(c[0]), float(c[1])) for i, c in enumerate(m.clusterCenters())]
    return L.spark.createDataFrame(rows, "cluster int, pc1 double, pc2 double")


@register("cluster_profile")
def cluster_profile(L):
    """Mean features per segment and their z-scores across segments."""
    mo = Models(L)
    seg = mo.segmented().withColumnRenamed("customer_segment", "cluster")
    return K.cluster_profile(seg, K.CLUSTER_FEATURES)


@register("segment_counts")
def segment_counts(L):
    """Member-months per segment name."""
    return Models(L).segmented().groupBy("customer_segment_name").agg(F.count(F.lit(1)).alias("rows"))


# ----------------------------------------------------------------- churn --

@register("model_inputs")
def model_inputs(L):
    """M1: numeric and categorical model inputs."""
    df, num, cat = Models(L).churn_inputs()
    rows = [(c, "numeric") for c in num] + [(c, "categorical") for c in cat]
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in num + cat])
    return (L.spark.createDataFrame(rows, "column string, kind string")
            .join(counts.unpivot([], num + cat, "column", "non_null"), "column"))


_SIDES = f"""sides AS (
  SELECT 'row' AS split_by, member_id, cancelled, CASE WHEN row_number() OVER (PARTITION BY cancelled ORDER BY h)
    <= round(count(*) OVER (PARTITION BY cancelled) * 0.2) THEN 'test' ELSE 'train' END AS side
  FROM (SELECT *, {sample_order_sql(M.ID_COLS)} AS h FROM feat_rows)
  UNION ALL
  SELECT 'member', member_id, cancelled, CASE WHEN {sample_order_sql(['member_id'])} % 1000000 < 200000
    THEN 'test' ELSE 'train' END FROM feat_rows)"""


@register("stratified_split", query("""
SELECT split_by, side, CAST(count(*) AS BIGINT) AS rows, avg(CAST(cancelled AS DOUBLE)) AS churn_rate,
  CAST(count(DISTINCT member_id) AS BIGINT) AS members FROM sides GROUP BY ALL""", _FEAT_ROWS, _SIDES),
    doubles="churn_rate", digits=8)
def stratified_split(L):
    """M2: rows and churn rate on each side of the 80/20 split, by row and by member."""
    df, _, _ = Models(L).churn_inputs()
    # two splits and four aggregates read it
    df = stored(df.select(*M.ID_COLS, M.LABEL), "split-rows")
    out = None
    for how in ("row", "member"):
        tr, te = M.split(df, split_by=how)
        for side, d in (("train", tr), ("test", te)):
            part = d.agg(F.count(F.lit(1)).alias("rows"), F.avg(M.LABEL).alias("churn_rate"),
                         F.count_distinct("member_id").alias("members")) \
                .select(F.lit(how).alias("split_by"), F.lit(side).alias("side"), "*")
            out = part if out is None else out.unionByName(part)
    return out


_IMP_COLS = ["salary", "clv", "total_flights", "distance"]


@register("impute_scale", query("SELECT member_id, year, month, " + ", ".join(
    f"({c} - (SELECT avg({c}) FROM imp)) / (SELECT CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END FROM imp) AS {c}"
    for c in _IMP_COLS) + ", city FROM imp",
    "holed AS (SELECT member_id, year, month, nullif(salary, 0) AS salary, clv, nullif(total_flights, 1) AS total_flights, "
    "distance, CASE WHEN gender = 'Male' THEN city END AS city FROM master)",
    "imp AS (SELECT member_id, year, month, " + ", ".join(
        f"coalesce(CAST({c} AS DOUBLE), (SELECT median({c}) FROM holed)) AS {c}" for c in _IMP_COLS)
    + ", coalesce(city, (SELECT city FROM holed WHERE city IS NOT NULL GROUP BY city ORDER BY count(*) DESC, city "
      "LIMIT 1)) AS city FROM holed)"), doubles=_IMP_COLS, digits=4)
def impute_scale(L):
    """M3-M5: the model's own stages on the master table: median impute and population
    scaling of numerics, mode fill of a category.  No salary, a single flight and the
    city of half of the members count as unknown, so that there is something to fill."""
    from pyspark.ml import Pipeline
    holed = L.master.select(
        *M.ID_COLS, F.nullif(F.col("salary"), F.lit(0.0)).alias("salary"), "clv",
        F.nullif(F.col("total_flights"), F.lit(1)).alias("total_flights"), "distance",
        F.when(F.col("gender") == "Male", F.col("city")).alias("city"))
    stages = [MedianImputer(_IMP_COLS, _IMP_COLS), PopulationScaler(_IMP_COLS, _IMP_COLS), ModeImputer(["city"], ["city"])]
    return Pipeline(stages=stages).fit(holed).transform(holed)


@register("churn_pipeline")
def churn_pipeline(L):
    """M6-M7: the fitted preprocessing applied to the test side (vector size)."""
    _, test = Models(L).prepared()
    from pyspark.ml.functions import vector_to_array
    return test.select(*M.ID_COLS, M.LABEL, F.size(vector_to_array("features")).alias("n_features"))


@register("smote", query("""
SELECT CAST(cancelled AS DOUBLE) AS cancelled, CAST(n AS BIGINT) AS rows, 'before' AS stage FROM tr
UNION ALL SELECT CAST(cancelled AS DOUBLE), CAST((SELECT max(n) FROM tr) AS BIGINT), 'after' FROM tr""", _FEAT_ROWS, _SIDES,
    "tr AS (SELECT cancelled, count(*) AS n FROM sides WHERE split_by = 'row' AND side = 'train' GROUP BY 1)"),
    doubles="cancelled")
def smote(L):
    """M8: class counts before and after SMOTE on the training side."""
    mo = Models(L)
    train, _ = mo.prepared()
    before = train.groupBy(M.LABEL).agg(F.count(F.lit(1)).alias("rows")).withColumn("stage", F.lit("before"))
    after = mo.smote_rows().groupBy(M.LABEL).agg(F.count(F.lit(1)).alias("rows")) \
        .withColumn("stage", F.lit("after"))
    return before.unionByName(after)


NEAR_COLS = ["total_flights", "total_distance", "total_points", "points_redeemed"]


@register("minority_neighbours", query("""
SELECT member_id, rank, neighbour, sqrt(d) AS distance FROM (
  SELECT a.member_id, b.member_id AS neighbour, d,
    CAST(row_number() OVER (PARTITION BY a.member_id ORDER BY d, b.member_id) AS INTEGER) AS rank
  FROM gone a JOIN gone b ON a.member_id <> b.member_id,
    LATERAL (SELECT """ + " + ".join(f"power(a.{c} - b.{c}, 2)" for c in NEAR_COLS) + """ AS d)) WHERE rank <= 5""",
    "gone AS (SELECT * FROM customers WHERE cancelled = 1)"), doubles="distance")
def minority_neighbours(L):
    """M8: the five nearest cancelled members of each cancelled member by their totals (the
    search that balances the classes, on whole numbers, so that ties are exact)."""
    gone = L.customers.where("cancelled = 1")
    points = gone.select(F.lpad(F.col("member_id").cast("string"), 20, "0").alias("i"),
                         F.array(*[F.col(c).cast("double") for c in NEAR_COLS]).alias("v"))
    near = nearest(points, 5).select("i", F.posexplode("near").alias("rank", "p"))
    return near.select(F.col("i").cast("long").alias("member_id"), (F.col("rank") + 1).alias("rank"),
                       F.col("p.j").cast("long").alias("neighbour"), F.col("p.d").alias("distance"))


@register("model_compare")
def model_compare(L):
    """M9-M12 + M14: each classifier trained on the balanced side, tested on
    the hold-out, sorted by ROC AUC."""
    from concurrent.futures import ThreadPoolExecutor
    mo = Models(L)
    train = mo.balanced_train()
    _, test = mo.prepared()
    clfs = M.classifiers()
    # independent fits run as concurrent Spark jobs
    with ThreadPoolExecutor(max_workers=len(clfs)) as pool:
        fitted = dict(zip(clfs, pool.map(lambda c: c.fit(train), clfs.values())))
    out = M.compared(fitted, test)
    return out.orderBy(F.desc("roc_auc"))


@register("churn_model")
def churn_model(L):
    """M11 + M13 + M14: the final forest's hold-out metrics."""
    return M.binary_metrics(Models(L).test_predictions())


@register("feature_importance")
def feature_importance(L):
    """M19 + C21: forest feature importances with tidy names, top 20."""
    mo = Models(L)
    _, test = mo.prepared()
    names = M.feature_names(mo.prep(), df=test)
    imp = mo.forest().featureImportances.toArray()
    rows = [(names[i] if i < len(names) else f"f{i}", M.tidy_feature(names[i] if i < len(names) else f"f{i}"),
             float(v)) for i, v in enumerate(imp)]
    # one row per model input (bounded by the feature count)
    df = L.spark.createDataFrame(rows, "feature string, label string, importance double")
    return df.orderBy(F.desc("importance"), "feature").limit(20)


@register("score_customers")
def score_customers(L):
    """M20 + G12: max churn probability per member with profile and risk."""
    return M.score_customers(Models(L).scored_rows(), L.master)


def _scored(L):
    return M.score_customers(Models(L).scored_rows(), L.master)


@register("risk_label")
def risk_label_q(L):
    """Risk band, plain-language prediction and recommended action."""
    s = _scored(L)
    pred, act = M.risk_action("churn_probability")
    return s.select("member_id", "churn_probability", "risk_category", pred.alias("prediction"), act.alias("action"))


@register("risk_counts")
def risk_counts(L):
    """Members per risk category in fixed order (zero-filled), share,
    mean CLV of the high- and low-risk groups."""
    return M.risk_counts(_scored(L))


@register("risk_by_tier")
def risk_by_tier(L):
    """Risk category x tier counts."""
    return M.risk_by_tier(_scored(L))


@register("risk_quadrant")
def risk_quadrant(L):
    """Risk (70 %) x CLV (median of all members) quadrant of every member."""
    samp = _scored(L).filter(F.col("clv").isNotNull())
    med = quantile_array(samp, "clv", [0.5])[0]
    q = (F.when((F.col("churn_pct") >= 70) & (F.col("clv") >= med), "High Risk / High CLV")
         .when(F.col("churn_pct") >= 70, "High Risk / Low CLV")
         .when(F.col("clv") >= med, "Low Risk / High CLV").otherwise("Low Risk / Low CLV"))
    return samp.select("member_id", "churn_pct", "clv", q.alias("quadrant"))


@register("top_risk")
def top_risk(L):
    """the 500 members with the highest churn probability."""
    s = _scored(L)
    return s.orderBy(F.desc("churn_pct"), "member_id").limit(500).select(
        "member_id", "loyalty_card", "clv", "total_revenue", "total_flights", "churn_pct", "risk_category")


@register("extract_high_risk")
def extract_high_risk(L):
    """A3: high-risk members written as CSV to the shared folder, read back."""
    from ..sources import files
    s = _scored(L).filter(F.col("risk_category") == "High Risk")
    path = files.scratch_dir(L.spark, "high_risk")
    files.write_csv(s, path)
    return L.spark.read.option("header", True).schema(s.schema).csv(path)


@register("extract_prediction_report")
def extract_prediction_report(L):
    """A3: the full prediction report of the model as one CSV file by member, read back."""
    from .q_features import _as_one_file
    return _as_one_file(M.prediction_report(_scored(L)), "prediction_report", ["member_id"])


@register("model_bundle")
def model_bundle(L):
    """A4: preprocessor, model, columns, metrics and names saved as one bundle and loaded
    back; the loaded parts score the hold-out side as the saved ones do."""
    from ..sources.files import scratch_dir
    from . import bundle as B
    mo = Models(L)
    df, num, cat = mo.churn_inputs()
    _, test = mo.sides()
    prepared = mo.prep().transform(test)
    first = stored(M.with_score(mo.forest().transform(prepared)).select(*M.ID_COLS, M.LABEL, "score", "prediction"), "holdout-scores")
    # one row
    metrics = M.binary_metrics(first).first().asDict()
    saved = B.Bundle(mo.prep(), mo.forest(), [*num, *cat], {k: float(v) for k, v in metrics.items()},
                     M.feature_names(mo.prep(), df=prepared))
    path = scratch_dir(L.spark, "bundle")
    B.save(L.spark, path, saved, df.schema, L.data_key)
    loaded = B.load(L.spark, path, L.data_key)
    again = M.with_score(loaded.model.transform(loaded.preprocessor.transform(test))).select(*M.ID_COLS, F.col("score").alias("reloaded"))
    return first.select(*M.ID_COLS, "score").join(again, M.ID_COLS).agg(
        F.count(F.lit(1)).alias("rows"), F.max(F.abs(F.col("score") - F.col("reloaded"))).alias("max_diff"),
        F.lit(len(loaded.columns)).alias("columns"), F.lit(len(loaded.names)).alias("names"),
        F.lit(loaded.metrics == saved.metrics and loaded.names == saved.names and loaded.columns == saved.columns).alias("same"))


@register("model_roundtrip")
def model_roundtrip(L):
    """A4: the fitted pipeline and forest saved and loaded back give the same
    scores on the hold-out side."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import RandomForestClassificationModel
    from ..sources.files import scratch_dir
    mo = Models(L)
    path = scratch_dir(L.spark, "model")
    mo.prep().write().overwrite().save(path + "/prep")
    mo.forest().write().overwrite().save(path + "/forest")
    prep, forest = PipelineModel.load(path + "/prep"), RandomForestClassificationModel.load(path + "/forest")
    _, test = mo.sides()
    again = M.with_score(forest.transform(prep.transform(test))).select(*M.ID_COLS, F.col("score").alias("reloaded"))
    first = mo.test_predictions().select(*M.ID_COLS, "score")
    return first.join(again, M.ID_COLS).agg(F.count(F.lit(1)).alias("rows"),
                                             F.max(F.abs(F.col("score") - F.col("reloaded"))).alias("max_diff"))


# ------------------------------------------- reports on fixed scores (S) --
# The rule-based churn_risk_score stands for the model's, so the reports can be
# checked in SQL row by row.

_REPORT = ("""report AS (
  SELECT s.member_id, s.churn_probability, p.clv, p.total_flights, p.clv AS total_revenue, p.loyalty_card, p.province, p.gender,
    p.cancelled, CASE WHEN s.churn_probability < 0.4 THEN 'Low Risk' WHEN s.churn_probability < 0.7 THEN 'Medium Risk' ELSE 'High Risk' END AS risk_category,
    round(s.churn_probability * 100, 1) AS churn_pct
  FROM (SELECT member_id, round(churn_risk_score, 4) AS churn_probability FROM customers) s
  LEFT JOIN (SELECT member_id, avg(clv) AS clv, CAST(sum(total_flights) AS BIGINT) AS total_flights, any_value(loyalty_card) AS loyalty_card,
      any_value(province) AS province, any_value(gender) AS gender, max(cancelled) AS cancelled FROM master GROUP BY member_id) p USING (member_id))""")


def _rule_scored(L):
    return M.score_customers(L.customers.select("member_id", F.col("churn_risk_score").alias("score")), L.master)


@register("rule_scores", query("SELECT * FROM report", _REPORT), doubles="churn_probability clv total_revenue churn_pct")
def rule_scores(L):
    """M20 + D6 + D7: the score report of each member on fixed scores."""
    return _rule_scored(L)


@register("rule_risk_by_tier", query("""
SELECT loyalty_card, risk_category, CAST(count(*) AS BIGINT) AS members FROM report GROUP BY ALL""", _REPORT))
def rule_risk_by_tier(L):
    """Risk category x tier counts on fixed scores."""
    return M.risk_by_tier(_rule_scored(L))


@register("rule_risk_counts", query("""
SELECT c.risk_category, CAST(count(r.member_id) AS BIGINT) AS members, count(r.member_id) * 100.0 / (SELECT count(*) FROM report) AS share_pct,
  avg(r.clv) AS avg_clv FROM (VALUES ('Low Risk'), ('Medium Risk'), ('High Risk')) c(risk_category)
LEFT JOIN report r USING (risk_category) GROUP BY c.risk_category""", _REPORT), doubles="share_pct avg_clv", digits=4)
def rule_risk_counts(L):
    """Members per risk category, zero-filled, on fixed scores."""
    return M.risk_counts(_rule_scored(L))


@register("rule_prediction_report", query("""
SELECT *, CASE risk_category WHEN 'Low Risk' THEN 'Likely to Stay' WHEN 'Medium Risk' THEN 'At Risk' ELSE 'Likely to Churn' END AS prediction,
  CASE risk_category WHEN 'Low Risk' THEN 'Keep in touch: routine news on points and tier'
    WHEN 'Medium Risk' THEN 'Win back interest: a cheaper flight or extra points for a while'
    ELSE 'Call now: a personal offer such as points or a step up in tier' END AS action FROM report""", _REPORT),
    doubles="churn_probability clv total_revenue churn_pct")
def rule_prediction_report(L):
    """A3 + G12: the full prediction report on fixed scores as one CSV file, read back."""
    from .q_features import _as_one_file
    return _as_one_file(M.prediction_report(_rule_scored(L)), "rule_report", ["member_id"])


@register("rule_top_risk", query("""
SELECT * FROM report ORDER BY churn_probability DESC, member_id LIMIT 20""", _REPORT), doubles="churn_probability clv total_revenue churn_pct")
def rule_top_risk(L):
    """the twenty members of highest fixed score."""
    return _rule_scored(L).orderBy(F.desc("churn_probability"), "member_id").limit(20)


# ------------------------------------------- metrics on fixed scores (S) --
# The rule-based churn_risk_score is the score and the cancellation flag the
# label, so the model-evaluation operators can be checked exactly in SQL.

def _fixed(L):
    return L.customers.select("member_id", F.col("cancelled").alias(M.LABEL), F.col("churn_risk_score").alias("score"),
                              (F.col("churn_risk_score") >= 0.5).cast("double").alias("prediction"))


_FIXED = ("fixed AS (SELECT member_id, cancelled, churn_risk_score AS score, "
          "CAST(churn_risk_score >= 0.5 AS DOUBLE) AS prediction FROM customers)")
_AUC = """(SELECT sum(neg * (2 * cum_pos - pos) / 2.0) / (sum(pos) * CAST(sum(neg) AS DOUBLE)) FROM (
  SELECT pos, neg, sum(pos) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS cum_pos
  FROM (SELECT score AS s, count_if(cancelled = 1) AS pos, count_if(cancelled = 0) AS neg FROM fixed
        WHERE score IS NOT NULL GROUP BY score)))"""


@register("binary_metrics", query(f"""
SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn,
  (tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE) AS accuracy,
  coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0.0) AS precision,
  coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0.0) AS recall,
  coalesce(2 * (tp / nullif(CAST(tp + fp AS DOUBLE), 0)) * (tp / nullif(CAST(tp + fn AS DOUBLE), 0))
    / nullif((tp / nullif(CAST(tp + fp AS DOUBLE), 0)) + (tp / nullif(CAST(tp + fn AS DOUBLE), 0)), 0), 0.0) AS f1,
  {_AUC} AS roc_auc
FROM (SELECT count_if(cancelled = 1 AND prediction = 1) AS tp, count_if(cancelled = 0 AND prediction = 1) AS fp,
        count_if(cancelled = 1 AND prediction = 0) AS fn, count_if(cancelled = 0 AND prediction = 0) AS tn FROM fixed)""",
    _FIXED), doubles="accuracy precision recall f1 roc_auc", digits=8)
def binary_metrics(L):
    """M14 on fixed scores: confusion counts, accuracy, precision, recall, F1, AUC."""
    return M.binary_metrics(_fixed(L))


def _report_sql():
    per = []
    for cls in (0, 1):
        per.append(f"""SELECT '{cls}' AS class,
  coalesce(count_if(cancelled = {cls} AND prediction = {cls}) / nullif(CAST(count_if(prediction = {cls}) AS DOUBLE), 0), 0.0)
    AS precision,
  coalesce(count_if(cancelled = {cls} AND prediction = {cls}) / nullif(CAST(count_if(cancelled = {cls}) AS DOUBLE), 0), 0.0)
    AS recall, CAST(count_if(cancelled = {cls}) AS BIGINT) AS support FROM fixed""")
    return ("per AS (SELECT class, precision, recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0)"
            " AS f1, support FROM (" + " UNION ALL ".join(per) + "))")


@register("classification_report", query("""
SELECT * FROM per
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM per
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
  sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM per""", _FIXED, _report_sql()),
    doubles="precision recall f1", digits=8)
def classification_report(L):
    """M15 on fixed scores."""
    return M.classification_report(_fixed(L))


@register("confusion_matrix", query("""
SELECT CAST(cancelled AS INTEGER) AS label, CAST(count_if(prediction = 0) AS BIGINT) AS "0.0",
  CAST(count_if(prediction = 1) AS BIGINT) AS "1.0" FROM fixed GROUP BY cancelled""", _FIXED))
def confusion_matrix(L):
    """M16 on fixed scores."""
    return M.confusion(_fixed(L))


@register("roc_curve", query("""
SELECT CAST('inf' AS DOUBLE) AS threshold, 0.0 AS fpr, 0.0 AS tpr
UNION ALL
SELECT s, sum(neg) OVER w / (SELECT CAST(count_if(cancelled = 0) AS DOUBLE) FROM fixed WHERE score IS NOT NULL),
  sum(pos) OVER w / (SELECT CAST(count_if(cancelled = 1) AS DOUBLE) FROM fixed WHERE score IS NOT NULL)
FROM (SELECT score AS s, count_if(cancelled = 1) AS pos, count_if(cancelled = 0) AS neg FROM fixed
      WHERE score IS NOT NULL GROUP BY score)
WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING)""", _FIXED), doubles="threshold fpr tpr", digits=8)
def roc_curve(L):
    """M17 on fixed scores."""
    return M.roc_curve(_fixed(L))


@register("pr_curve", query("""
SELECT s AS threshold, sum(pos) OVER w / CAST(sum(pos + neg) OVER w AS DOUBLE) AS precision,
  sum(pos) OVER w / (SELECT CAST(count_if(cancelled = 1) AS DOUBLE) FROM fixed WHERE score IS NOT NULL) AS recall
FROM (SELECT score AS s, count_if(cancelled = 1) AS pos, count_if(cancelled = 0) AS neg FROM fixed
      WHERE score IS NOT NULL GROUP BY score)
WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING)
UNION ALL SELECT NULL, 1.0, 0.0""", _FIXED), doubles="threshold precision recall", digits=8)
def pr_curve(L):
    """M18 on fixed scores."""
    return M.pr_curve(_fixed(L))
