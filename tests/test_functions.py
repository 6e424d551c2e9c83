"""Hand-made frames for the semantic quirks (qcut ties, bias-adjusted moments,
drop-first levels, zero denominators, rounding) and brute-force checks of the
bucketed global-order primitive."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from contrail.functions import exprs as X
from contrail.functions.ranking import average_ranks, ordered_cumsum, value_counts
from contrail.operators import features as FE
from contrail.operators import statistics as S


def test_qcut_ties(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 2, 3, 9, 20])], "id int, x double")
    edges = df.select(F.percentile("x", [0.25, 0.5, 0.75])).scalar()
    out = df.withColumn("q", X.quantile_label("x", edges, ["a", "b", "c", "d"])).orderBy("id")
    assert [r.q for r in out.collect()] == ["a", "a", "a", "c", "d", "d"]


def test_moments_bias_adjusted(spark):
    vals = [1, 2, 2, 3.5, 9, 20]
    df = spark.createDataFrame([(float(v),) for v in vals], "value double")
    r = df.agg(S.sample_skew().alias("s"), S.sample_kurtosis().alias("k")).first()
    assert r.s == pytest.approx(1.760619, abs=1e-6)
    assert r.k == pytest.approx(2.839650, abs=1e-6)
    s = pd.Series(vals)
    assert r.s == pytest.approx(s.skew(), rel=1e-9)
    assert r.k == pytest.approx(s.kurtosis(), rel=1e-9)


def test_drop_first_levels(spark):
    df = spark.createDataFrame([("Low", "Low"), ("High", "VIP"), ("Medium", "High")], "f string, c string")
    out = FE.one_hot_drop_first(df, {"f": ["High", "Low", "Medium"], "c": ["Low", "Medium", "High", "VIP"]})
    assert out.columns == ["f_Low", "f_Medium", "c_Medium", "c_High", "c_VIP"]
    rows = [tuple(r) for r in out.collect()]
    assert rows == [(1, 0, 0, 0, 0), (0, 0, 0, 0, 1), (0, 1, 0, 1, 0)]


def test_zero_denominators(spark):
    df = spark.createDataFrame([(0, 0, 0, 0.0)], "total_flights long, distance long, points long, red double")
    r = df.select(X.safe_div("distance", "total_flights").alias("a"),
                  (F.col("points") / (F.col("total_flights") + 1)).alias("b"),
                  X.clip(F.when(F.col("points") > 0, F.col("red") / F.col("points")).otherwise(0.0), 0.0, 1.0)
                  .alias("c")).first()
    assert r.a is None and r.b == 0.0 and r.c == 0.0


def test_salary_band_left_closed(spark):
    df = spark.createDataFrame([(0.0,), (39999.99,), (40000.0,), (150000.0,), (1e6,), (None,)], "s double")
    got = [r.b for r in df.select(X.salary_band("s").alias("b")).collect()]
    assert got == ["< $40K", "< $40K", "$40K–$70K", "$150K+", None, None]


def test_binary_rounding_matches_numpy(spark):
    # rounding acts on the binary value (1.34875 is stored just below the
    # tie), exact ties go away from zero, -0.0 comes out as 0.0
    df = spark.createDataFrame([(1.34875,), (0.125,), (1.005,), (-0.0,)], "x double")
    got = [r.r for r in df.select(X.rnd("x", 4).alias("r")).collect()]
    assert got == [1.3487, 0.125, 1.005, 0.0]
    got2 = [r.r for r in df.select(X.rnd("x", 2).alias("r")).collect()]
    assert got2 == [1.35, 0.13, 1.0, 0.0]
    assert math.copysign(1.0, got2[3]) == 1.0


def test_ordered_cumsum_matches_pandas(spark):
    rnd = random.Random(7)
    vals = [rnd.choice([1, 2, 2, 3, 5, 8, 13]) * rnd.random() // 0.01 for _ in range(3000)]
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    vc = value_counts(df, "v")
    got = ordered_cumsum(vc, "v", ["n"], buckets=7).toPandas().sort_values("v")
    ref = pd.Series(vals).value_counts().sort_index().cumsum()
    assert list(got["cum_n"]) == list(ref.values)
    desc = ordered_cumsum(vc, "v", ["n"], descending=True, buckets=5).toPandas().sort_values("v", ascending=False)
    assert list(desc["cum_n"]) == list(pd.Series(vals).value_counts().sort_index(ascending=False).cumsum().values)


def test_average_ranks_match_pandas(spark):
    vals = [3.0, 1.0, 2.0, 2.0, 5.0, 5.0, 5.0, 0.5]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = {r.x: r.rank for r in average_ranks(df, "x", buckets=3).collect()}
    ref = pd.Series(vals).rank()
    assert [got[v] for v in vals] == list(ref.values)
