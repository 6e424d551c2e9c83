"""Fitted models behind the clustering and churn queries.

Fits are the expensive part, so every fitted model is saved under the shared
checkpoint folder (keyed by the input folder) and loaded on the next query,
the way the dashboard loads its saved artefacts.  Everything else stays lazy.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import churn as M
from ..operators import clustering as K
from ..operators import features as FE
from ..session import checkpoint_root, path_exists, stored


def _code_version() -> str:
    """Hash of the package source: saved models are only reused by the code
    that fitted them."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    h = hashlib.sha1()
    for dirpath, _, names in sorted(os.walk(root)):
        if os.path.relpath(dirpath, root).split(os.sep)[0] == "llm":  # no model here depends on it
            continue
        for n in sorted(names):
            if n.endswith(".py"):
                with open(os.path.join(dirpath, n), "rb") as fh:
                    h.update(fh.read())
    return h.hexdigest()[:12]


CODE_VERSION = _code_version()

KMEANS_RESTARTS = 20
_FEATURES: dict = {}
FINAL_K = 5


def _dir(L, name: str) -> str:
    return os.path.join(checkpoint_root(L.spark), "contrail-models", CODE_VERSION, L.data_key, name)


def _load_or_fit(loader, path: str, fit):
    if path_exists(SparkSession.active(), path):
        return loader.load(path)
    model = fit()
    model.write().overwrite().save(path)
    return model


class Models:
    def __init__(self, L):
        self.L = L
        self._read: dict = {}

    def _fitted(self, loader, name: str, fit):
        """The model of this name, read or fitted once by a query."""
        if name not in self._read:
            self._read[name] = _load_or_fit(loader, _dir(self.L, name), fit)
        return self._read[name]

    def _once(self, name: str, build):
        """What ``build`` gives, made once per application and input folder."""
        key = (self.L.spark.sparkContext.applicationId, self.L.data_key, name)
        if key not in _FEATURES:
            _FEATURES[key] = build()
        return _FEATURES[key]

    # ---- clustering ---------------------------------------------------
    def features(self) -> DataFrame:
        """The engineered table, written once to the shared checkpoint folder:
        clustering and the churn model read it many times, and the cut keeps
        their plans small."""
        key = (self.L.spark.sparkContext.applicationId, self.L.data_key)
        if key not in _FEATURES:
            _FEATURES[key] = stored(FE.feature_table(self.L.master), "features")
        return _FEATURES[key]

    def cluster_vectors(self) -> DataFrame:
        """Scaled by quantiles that are taken once: every fit and every projection reads them."""
        def build():
            return K.assemble(K.robust_scale(K.cluster_inputs(self.features()), K.CLUSTER_FEATURES), K.CLUSTER_FEATURES)

        return self._once("vectors", build)

    def pca_full(self) -> PipelineModel:
        return self._fitted(PipelineModel, "pca_full", lambda: K.fit_pca(self.cluster_vectors(), len(K.CLUSTER_FEATURES)))

    def n_components(self) -> int:
        import numpy as np
        cum = np.cumsum(self.pca_full().stages[-1].explainedVariance.toArray())
        return int(np.searchsorted(cum, 0.95) + 1)

    def pca95(self) -> PipelineModel:
        return self._fitted(PipelineModel, "pca95", lambda: K.first_components(self.pca_full(), self.n_components()))

    def pca2(self) -> PipelineModel:
        return self._fitted(PipelineModel, "pca2", lambda: K.first_components(self.pca_full(), 2))

    def projected(self) -> DataFrame:
        return self.pca95().transform(self.cluster_vectors())

    def space(self, name: str = "pca95") -> DataFrame:
        return self.projected() if name == "pca95" else self.pca2().transform(self.cluster_vectors())

    def kmeans(self, k: int = FINAL_K, restarts: int = KMEANS_RESTARTS, space: str = "pca95") -> K.Centroids:
        return self._centroids(space, [k], restarts)[k]

    def kmeans_sweep(self, ks=range(2, 11), restarts: int = KMEANS_RESTARTS) -> dict[int, K.Centroids]:
        return self._centroids("pca95", ks, restarts)

    def _centroids(self, space: str, ks, restarts: int) -> dict[int, K.Centroids]:
        spark = self.L.spark
        paths = {k: _dir(self.L, f"centroids_{space}_{k}_{restarts}") for k in ks}
        # a folder without the writer's mark is an unfinished write
        missing = [k for k, p in paths.items() if not path_exists(spark, f"{p}/_SUCCESS")]
        fitted = K.kmeans_sweep(self.space(space), missing, restarts) if missing else {}
        for k, m in fitted.items():
            m.save(spark, paths[k])
        return {k: fitted[k] if k in fitted else K.Centroids.load(spark, p) for k, p in paths.items()}

    def assigned(self) -> DataFrame:
        """Cluster of every member-month and the columns that name it, written once."""
        return self._once("assigned", lambda: stored(self.kmeans().transform(self.projected()).select(
            *M.ID_COLS, "cluster", "total_flights", "clv", "redemption_ratio"), "assigned"))

    def segment_names(self) -> dict[int, str]:
        prof = self.assigned().groupBy("cluster").agg(*[F.avg(c).alias(c) for c in
                                                 ("total_flights", "clv", "redemption_ratio")])
        # k rows
        profile = {r["cluster"]: r.asDict() for r in prof.collect()}
        return K.name_segments(profile)

    def segmented(self) -> DataFrame:
        """Feature table + Customer_Segment (+ name), member id carried."""
        names = self.segment_names()
        mapping = F.create_map(*[x for c, n in sorted(names.items()) for x in (F.lit(c), F.lit(n))])
        seg = self.assigned().select(*M.ID_COLS, F.col("cluster").alias("customer_segment"))
        return (self.features().join(seg, M.ID_COLS)
                .withColumn("customer_segment_name", mapping[F.col("customer_segment")]))

    # ---- churn --------------------------------------------------------
    def churn_inputs(self) -> tuple[DataFrame, list[str], list[str]]:
        return self._once("churn-inputs", self._churn_inputs)

    def churn_rows(self) -> DataFrame:
        """The rows of ``churn_inputs``, written once: split, preprocessing and scoring read them."""
        return self._once("churn-rows", lambda: stored(self.churn_inputs()[0], "churn-rows"))

    def _churn_inputs(self) -> tuple[DataFrame, list[str], list[str]]:
        df = self.segmented()
        num, cat = M.model_columns(df, drop=("member_id",))
        df = df.select(*[F.col(c).cast("double").alias(c) if c in num else F.col(c) for c in df.columns])
        df = df.withColumn(M.LABEL, F.col(M.LABEL).cast("double"))
        return df, num, cat

    def sides(self) -> tuple[DataFrame, DataFrame]:
        """Training and hold-out rows, written once to the shared folder: every fit
        and every evaluation reads the same ones."""
        key = (self.L.spark.sparkContext.applicationId, self.L.data_key, "sides")
        if key not in _FEATURES:
            _FEATURES[key] = tuple(stored(side, name) for side, name in zip(M.split(self.churn_rows()), ("train", "holdout"), strict=True))
        return _FEATURES[key]

    def prep(self) -> PipelineModel:
        _, num, cat = self.churn_inputs()
        return self._fitted(PipelineModel, "prep", lambda: M.preprocessor(num, cat).fit(self.sides()[0]))

    def prepared(self) -> tuple[DataFrame, DataFrame]:
        train, test = self.sides()
        p = self.prep()
        return p.transform(train), p.transform(test)

    def smote_rows(self) -> DataFrame:
        train, _ = self.prepared()
        return M.smote(train.select(*M.ID_COLS, "features", M.LABEL), keys=M.ID_COLS)

    def balanced_train(self) -> DataFrame:
        """``smote_rows`` written once: all fits read the same rows in the same layout, which
        the forest's bootstrap samples depend on."""
        return self._once("balanced-train", lambda: stored(self.smote_rows(), "balanced-train"))

    def forest(self):
        from pyspark.ml.classification import RandomForestClassificationModel
        return self._fitted(RandomForestClassificationModel, "forest", lambda: M.final_forest().fit(self.balanced_train()))

    def test_predictions(self) -> DataFrame:
        _, test = self.prepared()
        return M.with_score(self.forest().transform(test))

    def scored_rows(self) -> DataFrame:
        """Every member-month scored once and written to the shared folder
        (the risk reports all read it)."""
        key = (self.L.spark.sparkContext.applicationId, self.L.data_key, "scored")
        if key not in _FEATURES:
            scored = M.with_score(self.forest().transform(self.prep().transform(self.churn_rows())))
            _FEATURES[key] = stored(scored.select(*M.ID_COLS, M.LABEL, "score", "prediction"), "scored")
        return _FEATURES[key]
