"""Churn model (M1-M21): split, preprocessing pipeline, SMOTE, classifiers,
metrics, scoring.

* The split orders each class by a hash of the key and a seed and cuts it at
  the exact share (bucketed global order, no window over a class); reruns give
  the same split on any layout.
  ``split_by="member"`` keeps a member's months on one side (no leakage).
* Preprocessing is a Spark ML ``Pipeline`` (exact median, population scaling, mode
  fill of ``prepare``; string index, one-hot, assembler) fitted on the training side.
* SMOTE finds the k nearest minority rows of each point exactly by a distributed
  metric tree (``neighbours``); synthetic rows are drawn on the segments with a
  seeded hash.
* Metrics come from aggregates over (label, prediction, score); ROC/PR/AUC
  use the bucketed global order over distinct scores.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType, BooleanType

from ..functions.exprs import RISK_LEVELS, risk_label, rnd
from ..functions.ranking import ordered_cumsum
from ..session import stored
from .boosting import BoostedTrees
from .forest import Forest
from .neighbours import nearest
from .prepare import MedianImputer, ModeImputer, PopulationScaler
from .sampling import sample_order

LABEL = "cancelled"
# Speed settings for deep trees (no effect on the fitted model): keep node ids
# per row instead of re-walking the trees each level, and let each pass over
# the data split more nodes.
TREE_SPEED = {"cacheNodeIds": True, "maxMemoryInMB": 1024}
ID_COLS = ["member_id", "year", "month"]


def model_columns(df: DataFrame, label: str = LABEL, drop=("member_id",)) -> tuple[list[str], list[str]]:
    """M1: numeric (bool cast to int) and categorical inputs; target and id out."""
    num, cat = [], []
    for f in df.schema.fields:
        if f.name in (label, *drop):
            continue
        if isinstance(f.dataType, (NumericType, BooleanType)):
            num.append(f.name)
        elif isinstance(f.dataType, StringType):
            cat.append(f.name)
    return num, cat


def split(df: DataFrame, test_fraction: float = 0.2, seed: int = 42, split_by: str = "row",
          keys=ID_COLS) -> tuple[DataFrame, DataFrame]:
    """M2: (train, test).  By row: of each class the ``round(n * test_fraction)``
    rows first in a seeded hash order are the test side, so class shares hold
    exactly.  By member: a member's rows share a side, chosen by its hash.  A
    null label is a class of its own."""
    if split_by == "member":
        test = F.pmod(sample_order("member_id", seed), F.lit(1_000_000)) < int(test_fraction * 1_000_000)
        return df.filter(~test), df.filter(test)
    h, cls = sample_order(keys, seed), F.coalesce(F.col(LABEL).cast("double"), F.lit(-1.0))
    order = df.select(cls.alias("cls"), h.alias("h")).groupBy("cls", "h").agg(F.count(F.lit(1)).alias("n"))
    cum = ordered_cumsum(order, "h", ["n"], by=["cls"]).where(F.col("cum_n") <= F.round(F.col("all_n") * test_fraction))
    test = F.lit(False)
    for r in cum.groupBy("cls").agg(F.max("h").alias("h")).collect():  # one row per class
        test = test | ((cls == r["cls"]) & (h <= r["h"]))
    return df.filter(~test), df.filter(test)


def preprocessor(num: list[str], cat: list[str]) -> Pipeline:
    """M3-M7: median impute + scale numerics; mode fill, index and one-hot
    categories (unseen levels kept in an extra slot); assemble."""
    scaled, oh = [f"{c}__scl" for c in num], [f"{c}__oh" for c in cat]
    stages = [MedianImputer(num, [f"{c}__imp" for c in num]), PopulationScaler([f"{c}__imp" for c in num], scaled)]
    if cat:
        filled, idx = [f"{c}__mode" for c in cat], [f"{c}__idx" for c in cat]
        stages += [ModeImputer(cat, filled),
                   StringIndexer(inputCols=filled, outputCols=idx, handleInvalid="keep",
                                 stringOrderType="frequencyDesc"),
                   OneHotEncoder(inputCols=idx, outputCols=oh, handleInvalid="keep", dropLast=False)]
    stages.append(VectorAssembler(inputCols=[*scaled, *oh], outputCol="features", handleInvalid="keep"))
    return Pipeline(stages=stages)


#: Samples that one row makes at once.
RUN = 4096


def smote(df: DataFrame, label: str = LABEL, k: int = 5, seed: int = 42, features: str = "features",
          keys=()) -> DataFrame:
    """M8: SMOTE to equal class counts (the minority is the smaller class).

    For every minority point its k nearest by exact distance; synthetic row = x + u * (neighbour - x), u ~ U(0, 1) from a seeded
    hash; points are cycled so each makes ``base`` or one more sample.  ``keys``
    name each row, so the result does not depend on how rows are partitioned;
    without keys rows are numbered as they are stored.  A single minority point
    is repeated.  Rows of a null label stay out of the counts and are returned."""
    counts = {r[label]: r["n"] for r in df.where(F.col(label).isNotNull()).groupBy(label)
              .agg(F.count(F.lit(1)).alias("n")).collect()}  # two classes
    if len(counts) < 2:
        return df.select(features, label)
    minority = min(counts, key=lambda c: (counts[c], c))
    n_min, need = counts[minority], max(counts.values()) - counts[minority]
    if need <= 0:
        return df.select(features, label)
    name = F.concat_ws("/", *[F.col(c).cast("string") for c in keys]) if keys else \
        F.monotonically_increasing_id().cast("string")
    # written once: the numbers hold, and the joins below read short plans
    mino = stored(df.where(F.col(label) == minority).select(name.alias("i"), vector_to_array(features).alias("v")),
                  "minority")
    near = nearest(mino, k, seed).select("i", F.col("near")["j"].alias("js"))
    xi, xj = mino.select("i", F.col("v").alias("xi")), mino.select(F.col("i").alias("j"), F.col("v").alias("xj"))
    base, rem = divmod(need, n_min)
    # exact count without a global sort: every point makes `base` samples and
    # the `rem` points first in a seeded hash order make one more
    order = mino.select("i", F.xxhash64("i", F.lit(seed)).alias("h"), F.lit(1).alias("n"))
    ranks = ordered_cumsum(order, "h", ["n"]).select("i", (base + (F.col("cum_n") <= rem).cast("int"))
                                                   .alias("copies"))
    gen = (ranks.where(F.col("copies") > 0).join(near, "i", "left")
           # in two steps: no long array where few points make many samples
           .withColumn("first", F.explode(F.sequence(F.lit(0), F.col("copies") - 1, F.lit(RUN))))
           .withColumn("copy", F.explode(F.sequence("first", F.least(F.col("first") + RUN, F.col("copies")) - 1))))
    pick = F.pmod(F.xxhash64("i", "copy", F.lit(seed)), F.greatest(F.size("js"), F.lit(1))).cast("int")
    gen = gen.select("i", "copy", F.coalesce(F.get("js", pick), F.col("i")).alias("j"),
                     (F.pmod(F.xxhash64("i", "copy", F.lit(seed + 2)), F.lit(1_000_000)) / 1_000_000.0).alias("u"))
    syn = gen.join(xi, "i").join(xj, "j").select(
        array_to_vector(F.zip_with("xi", "xj", lambda a, b: a + F.col("u") * (b - a))).alias(features),
        F.lit(minority).cast(df.schema[label].dataType).alias(label))
    return df.select(features, label).unionByName(syn)


def classifiers(seed: int = 42) -> dict:
    """The compared models; boosted trees as Spark's own and as second-order, leaf-wise ones."""
    return {
        "Logistic Regression": LogisticRegression(maxIter=1000, labelCol=LABEL),
        "Decision Tree": DecisionTreeClassifier(seed=seed, labelCol=LABEL, maxDepth=30, **TREE_SPEED),
        "Random Forest": Forest(RandomForestClassifier(seed=seed, labelCol=LABEL, numTrees=100, maxDepth=30, **TREE_SPEED)),
        "Gradient Boosted Trees": GBTClassifier(seed=seed, labelCol=LABEL, maxIter=100, **TREE_SPEED),
        "Second-Order Boosting": BoostedTrees(labelCol=LABEL),
    }


def final_forest(seed: int = 42) -> Forest:
    """The shipped forest: 100 trees, depth 30, at least 3 rows per leaf."""
    return Forest(RandomForestClassifier(numTrees=100, maxDepth=30, minInstancesPerNode=3, seed=seed, labelCol=LABEL,
                                         **TREE_SPEED))


def with_score(pred: DataFrame) -> DataFrame:
    """Probability of class 1 as a plain column."""
    return pred.withColumn("score", vector_to_array("probability")[1])


def confusion(pred: DataFrame, label: str = LABEL, prediction: str = "prediction") -> DataFrame:
    """Label x prediction counts (2 x 2, zero-filled)."""
    return (pred.groupBy(F.col(label).cast("int").alias("label"))
            .pivot(prediction, [0.0, 1.0]).count()
            .fillna(0))


def binary_metrics(pred: DataFrame, label: str = LABEL, prediction: str = "prediction",
                   score: str = "score") -> DataFrame:
    """Accuracy, precision, recall, F1 and exact ROC AUC (ties averaged)."""
    y, p = F.col(label).cast("int"), F.col(prediction).cast("int")
    c = pred.agg(F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
                 F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 0) & (p == 0)).alias("tn"))
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    prec = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    rec = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))
    auc = roc_auc(pred, label, score)
    return c.select("tp", "fp", "fn", "tn", ((tp + tn) / (tp + fp + fn + tn)).alias("accuracy"),
                    prec.alias("precision"), rec.alias("recall"), f1.alias("f1"), auc.alias("roc_auc"))


def compared(fitted: dict, test: DataFrame) -> DataFrame:
    """M14 of each of the named models on ``test``; every row is scored once by each."""
    out = None
    for name, model in fitted.items():
        # the counts and the order of the scores read it
        pred = stored(with_score(model.transform(test)).select(LABEL, "score", "prediction"), "compared")
        row = binary_metrics(pred).select(F.lit(name).alias("model"), "accuracy", "precision", "recall", "f1", "roc_auc")
        out = row if out is None else out.unionByName(row)
    return out


def _score_counts(pred: DataFrame, label: str, score: str) -> DataFrame:
    return (pred.filter(F.col(score).isNotNull())
            .groupBy(F.col(score).cast("double").alias("s"))
            .agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")))


def roc_curve(pred: DataFrame, label: str = LABEL, score: str = "score") -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score, highest first,
    plus the (inf, 0, 0) start."""
    vc = _score_counts(pred, label, score)
    cum = ordered_cumsum(vc, "s", ["pos", "neg"], descending=True)
    tot = vc.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    p, n = tot.select("p").scalar(), tot.select("n").scalar()
    pts = cum.select(F.col("s").alias("threshold"), F.try_divide(F.col("cum_neg").cast("double"), n).alias("fpr"),
                     F.try_divide(F.col("cum_pos").cast("double"), p).alias("tpr"))
    start = pred.sparkSession.range(1).select(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"),
                                              F.lit(0.0).alias("tpr"))
    return start.unionByName(pts)


def roc_auc(pred: DataFrame, label: str = LABEL, score: str = "score"):
    """Area under the ROC steps (trapezoids; ties form one diagonal step)."""
    vc = _score_counts(pred, label, score)
    cum = ordered_cumsum(vc, "s", ["pos", "neg"], descending=True)
    area = cum.agg(F.sum(F.col("neg") * (2 * F.col("cum_pos") - F.col("pos")) / 2.0).alias("a"),
                   F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return area.select(F.try_divide(F.col("a"), F.col("p").cast("double") * F.col("n"))).scalar()


def pr_curve(pred: DataFrame, label: str = LABEL, score: str = "score") -> DataFrame:
    """(threshold, precision, recall) per distinct score plus the final
    (recall 0, precision 1) point."""
    vc = _score_counts(pred, label, score)
    cum = ordered_cumsum(vc, "s", ["pos", "neg"], descending=True)
    p = vc.select(F.sum("pos")).scalar()
    pts = cum.select(F.col("s").alias("threshold"),
                     (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
                     F.try_divide(F.col("cum_pos").cast("double"), p).alias("recall"))
    end = pred.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"),
                                            F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return pts.unionByName(end)


def classification_report(pred: DataFrame, label: str = LABEL, prediction: str = "prediction") -> DataFrame:
    """Per class precision / recall / F1 / support, macro and weighted."""
    y, p = F.col(label).cast("int"), F.col(prediction).cast("int")
    rows = []
    for cls in (0, 1):
        agg = pred.agg(F.count_if((y == cls) & (p == cls)).alias("tp"), F.count_if((y != cls) & (p == cls)).alias("fp"),
                       F.count_if((y == cls) & (p != cls)).alias("fn"), F.count_if(y == cls).alias("support"))
        prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), F.lit(0.0))
        rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")), F.lit(0.0))
        f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))
        rows.append(agg.select(F.lit(str(cls)).alias("class"), prec.alias("precision"), rec.alias("recall"),
                               f1.alias("f1"), "support"))
    per = rows[0].unionByName(rows[1])
    tot = per.agg(F.avg("precision").alias("p"), F.avg("recall").alias("r"), F.avg("f1").alias("f"),
                  F.sum("support").alias("s"),
                  (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
                  (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
                  (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("wf"))
    macro = tot.select(F.lit("macro avg").alias("class"), F.col("p").alias("precision"), F.col("r").alias("recall"),
                       F.col("f").alias("f1"), F.col("s").alias("support"))
    weighted = tot.select(F.lit("weighted avg").alias("class"), F.col("wp").alias("precision"),
                          F.col("wr").alias("recall"), F.col("wf").alias("f1"), F.col("s").alias("support"))
    return per.unionByName(macro).unionByName(weighted)


def feature_names(model: PipelineModel, vec_col: str = "features", df: DataFrame | None = None) -> list[str]:
    """Slot names of the assembled vector (from the ML attribute metadata)."""
    meta = df.schema[vec_col].metadata.get("ml_attr", {}).get("attrs", {})
    names = {}
    for group in meta.values():
        for a in group:
            names[a["idx"]] = a["name"]
    return [names.get(i, f"f{i}") for i in range(max(names) + 1)] if names else []


def tidy_feature(name: str) -> str:
    """Strip pipeline suffixes, underscores to spaces, title case."""
    import re
    n = re.sub(r"__(imp|scl|mode|idx|oh)", "", name)
    n = n.replace("_", " ")
    return n.strip().title()


def score_customers(scored_rows: DataFrame, master: DataFrame) -> DataFrame:
    """M20 + D6/D7 + G12: max churn probability per member (rounded 4), the
    member profile (mean CLV, flights, CLV as 'revenue' as the dashboard
    does, card, province, gender, cancelled), risk category and percent."""
    agg = scored_rows.groupBy("member_id").agg(F.max(rnd("score", 4)).alias("churn_probability"))
    prof = (master.groupBy("member_id")
            .agg(F.avg("clv").alias("clv"), F.sum("total_flights").alias("total_flights"),
                 F.avg("clv").alias("total_revenue"), F.first("loyalty_card", ignorenulls=True).alias("loyalty_card"),
                 F.first("province", ignorenulls=True).alias("province"),
                 F.first("gender", ignorenulls=True).alias("gender"), F.max("cancelled").alias("cancelled")))
    return (agg.join(prof, "member_id", "left")
            .withColumn("risk_category", F.concat(risk_label("churn_probability"), F.lit(" Risk")))
            .withColumn("churn_pct", rnd(F.col("churn_probability") * 100, 1)))


def risk_action(p) -> tuple:
    """Plain-language prediction and recommended action per risk band."""
    p = F.col(p) if isinstance(p, str) else p
    pred = F.when(p < 0.40, "Likely to Stay").when(p < 0.70, "At Risk").otherwise("Likely to Churn")
    act = (F.when(p < 0.40, "Keep in touch: routine news on points and tier")
           .when(p < 0.70, "Win back interest: a cheaper flight or extra points for a while")
           .otherwise("Call now: a personal offer such as points or a step up in tier"))
    return pred, act


def risk_counts(scored: DataFrame) -> DataFrame:
    """Members per risk category in fixed order (zero-filled), share and mean CLV."""
    order = [f"{x} Risk" for x in RISK_LEVELS]
    wide = scored.groupBy().pivot("risk_category", order).count().fillna(0, order)
    total = scored.select(F.count(F.lit(1))).scalar()
    clv = scored.groupBy("risk_category").agg(F.avg("clv").alias("avg_clv"))
    return (wide.unpivot([], order, "risk_category", "members").withColumn("share_pct", F.col("members") * 100.0 / total)
            .join(clv, "risk_category", "left"))


def risk_by_tier(scored: DataFrame) -> DataFrame:
    """Risk category x tier counts."""
    return scored.groupBy("loyalty_card", "risk_category").agg(F.count(F.lit(1)).alias("members"))


def prediction_report(scored: DataFrame) -> DataFrame:
    """A3 + G12: every member's score, profile, plain-language prediction and action."""
    prediction, action = risk_action("churn_probability")
    return scored.select("*", prediction.alias("prediction"), action.alias("action"))
