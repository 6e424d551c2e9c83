"""Hot keys: one value / one member-month holding a third of all rows."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from contrail.functions.ranking import exact_quantiles, in_stretches, ordered_cumsum, value_counts
from contrail.operators import cleaning as C
from contrail.sources import files


def test_order_primitive_with_a_hot_value(spark):
    rnd = random.Random(2)
    vals = [7.0] * 3000 + [float(rnd.randint(0, 500)) for _ in range(6000)]
    df = spark.createDataFrame([(v,) for v in vals], "x double").repartition(8)
    vc = value_counts(df, "x")
    assert vc.filter("x = 7.0").first().n >= 3000          # the hot value is one row
    got = ordered_cumsum(vc, "x", ["n"], buckets=16).toPandas().sort_values("x")
    assert list(got["cum_n"]) == list(pd.Series(vals).value_counts().sort_index().cumsum().values)
    q = exact_quantiles(df, "x", [0.1, 0.33, 0.5, 0.9]).first()
    want = np.quantile(np.array(vals), [0.1, 0.33, 0.5, 0.9])
    assert [q[f"q{i}"] for i in range(4)] == pytest.approx(list(want), abs=1e-9)


def test_grouped_quantiles_with_a_hot_group(spark):
    rnd = random.Random(4)
    rows = [("hot", float(rnd.randint(0, 1000))) for _ in range(4000)] + \
           [(g, float(rnd.randint(0, 50))) for g in ("a", "b") for _ in range(1000)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: r.q0 for r in exact_quantiles(df, "x", [0.5], by=["g"], buckets=8).collect()}
    pdf = pd.DataFrame(rows, columns=["g", "x"])
    want = pdf.groupby("g")["x"].quantile(0.5).to_dict()
    assert got == pytest.approx(want)


def test_hot_member_month_rollup(spark):
    hot = [(1, 2017, 1, 1, 10, 1, 0, 0.0)] * 2 + [(1, 2017, 1, i, 10, 1, 0, 0.0) for i in range(2, 1500)]
    rest = [(m, 2017, 2, 1, 5, 1, 0, 0.0) for m in range(2, 3000)]
    df = spark.createDataFrame(hot + rest, files.ACTIVITY_SCHEMA).repartition(8)
    m = C.monthly_activity(C.dedup_activity(df))
    r = m.filter("member_id = 1").first()
    assert r.total_flights == sum(range(1, 1500)) and r.distance == 10 * 1499
    assert m.count() == 1 + 2998


def test_a_hot_group_is_spread_as_its_share_asks(spark):
    """Half of all distinct values belong to one group: it takes about half of the tasks."""
    df = spark.range(8000).selectExpr("if(id % 2 = 0, 'hot', concat('g', id % 100)) AS g", "cast(id AS double) AS x")
    for stretches in (8, 32):
        tasks = {r["g"]: r["n"] for r in in_stretches(df, ["g"], "x", stretches).groupBy("g").agg(F.countDistinct("_bkt").alias("n")).collect()}
        assert 0.35 * stretches <= tasks["hot"] <= 0.65 * stretches + 1
        assert all(n <= 2 for g, n in tasks.items() if g != "hot")
    cum = ordered_cumsum(df.withColumn("n", F.lit(1)), "x", ["n"], by=["g"], buckets=32).where("g = 'hot'").orderBy("x").collect()
    assert [r["cum_n"] for r in cum] == list(range(1, 4001)) and {r["all_n"] for r in cum} == {4000}
