"""Rank statistics, tests and curves against brute force on small frames."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from contrail.functions import special
from contrail.operators import churn as M
from contrail.operators import statistics as S
from contrail.operators import windows as W


@pytest.fixture(scope="module")
def two_groups(spark):
    rnd = random.Random(3)
    rows = [(i, i % 3 == 0 and 1 or 0, float(rnd.randint(0, 40)), float(rnd.randint(0, 9))) for i in range(400)]
    return spark.createDataFrame(rows, "member_id int, g int, a double, b double"), pd.DataFrame(
        rows, columns=["member_id", "g", "a", "b"])


def test_spearman_matches_pandas(two_groups):
    df, pdf = two_groups
    got = {(r.x, r.y): r.r for r in S.spearman_matrix(df, ["a", "b"]).collect()}
    # Spearman = Pearson of tie-averaged ranks
    want = pdf["a"].rank().corr(pdf["b"].rank())
    assert got[("a", "b")] == pytest.approx(want, abs=1e-12)


def test_mann_whitney_brute_force(two_groups):
    df, pdf = two_groups
    r = S.mann_whitney(df, ["a"], "g").first()
    x, y = pdf.loc[pdf.g == 0, "a"].values, pdf.loc[pdf.g == 1, "a"].values
    u = sum((xi > yi) + 0.5 * (xi == yi) for xi in x for yi in y)
    assert r.u_stat == pytest.approx(u)
    n1, n2 = len(x), len(y)
    allv = np.concatenate([x, y])
    _, t = np.unique(allv, return_counts=True)
    n = n1 + n2
    sigma = np.sqrt(n1 * n2 / 12 * ((n + 1) - (t ** 3 - t).sum() / (n * (n - 1))))
    z = (max(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sigma
    assert r.z == pytest.approx(z, rel=1e-9)


def test_welch_matches_formula(two_groups):
    df, pdf = two_groups
    r = S.welch_t(df, ["a"], "g").first()
    x, y = pdf.loc[pdf.g == 0, "a"], pdf.loc[pdf.g == 1, "a"]
    se = x.var() / len(x) + y.var() / len(y)
    assert r.t_stat == pytest.approx((x.mean() - y.mean()) / np.sqrt(se), rel=1e-9)
    p = df.select(special.student_t_two_sided(F.lit(r.t_stat), F.lit(r.dof)).alias("p")).first().p
    assert p == pytest.approx(t_tail(r.t_stat, r.dof), abs=1e-9)


def t_tail(t, dof):
    """Two-sided tail by Gauss-Legendre sums over pieces of the angle."""
    low = math.atan(abs(t) / math.sqrt(dof))
    x, w = np.polynomial.legendre.leggauss(60)
    edges = np.linspace(low, math.pi / 2, 201)
    mid, half = (edges[1:] + edges[:-1]) / 2, (edges[1:] - edges[:-1]) / 2
    angles = mid[:, None] + half[:, None] * x
    total = (half[:, None] * w * np.cos(angles) ** (dof - 1)).sum()
    return float(2 * math.exp(math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2)) / math.sqrt(math.pi) * total)


def test_tails_equal_closed_forms(spark):
    poisson = lambda n, x: sum(math.exp(k * math.log(x) - x - math.lgamma(k + 1)) for k in range(n))
    student = [(t, 1.0, 1 - 2 / math.pi * math.atan(t)) for t in (1e-9, 0.3, 1.0, 12.706, 1e6)]
    student += [(t, 2.0, 1 - t / math.sqrt(2 + t * t)) for t in (0.01, 1.0, 4.303, 50.0)]
    student += [(-t, dof, t_tail(t, dof)) for t in (0.2, 1.96, 5.0) for dof in (3.0, 7.5, 40.25, 999.0, 9999.0, 12345.6)]
    student += [(t, 1e12, math.erfc(t / math.sqrt(2))) for t in (0.1, 1.96, 4.0)] + [(0.0, 5.0, 1.0), (2.2281388519649385, 10.0, 0.05)]
    chi = [(x, 1, math.erfc(math.sqrt(x / 2))) for x in (1e-6, 0.5, 3.841458820694124, 30.0)]
    chi += [(x, 2 * n, poisson(n, x / 2)) for n in (1, 2, 5, 60, 500) for x in (0.3, 1.0 * n, 2.0 * n, 2.0 * n + 3, 5.0 * n)] + [(0.0, 3, 1.0)]
    normal = [(z, math.erfc(abs(z) / math.sqrt(2))) for z in (0.0, 1e-4, -0.7, 1.96, 3.3, 8.0)]
    for rows, of, tail in ((student, "t double, dof double, p double", lambda: special.student_t_two_sided(F.col("t"), F.col("dof"))),
                           (chi, "x double, dof int, p double", lambda: special.chi_square_upper(F.col("x"), F.col("dof"))),
                           (normal, "z double, p double", lambda: special.normal_two_sided(F.col("z")))):
        for r in spark.createDataFrame(rows, of).withColumn("found", tail()).collect():
            assert r.found == pytest.approx(r.p, abs=2e-9 if "t" in r else 1e-11), r
    nothing = spark.createDataFrame([(None, 3.0), (1.0, None), (1.0, 0.0)], "t double, dof double")
    assert {tuple(r) for r in nothing.select(special.student_t_two_sided(F.col("t"), F.col("dof")), special.chi_square_upper(F.col("t"), F.col("dof")),
                                             special.normal_two_sided(F.col("t") * F.lit(None).cast("double"))).collect()} == {(None, None, None)}


def test_chi_square_yates_2x2(spark):
    rows = [("A", 1)] * 10 + [("A", 0)] * 30 + [("B", 1)] * 25 + [("B", 0)] * 35
    df = spark.createDataFrame(rows, "c string, y int")
    r = S.chi_square(df, ["c"], "y").first()
    obs = np.array([[30, 10], [35, 25]], dtype=float)
    e = obs.sum(1, keepdims=True) * obs.sum(0, keepdims=True) / obs.sum()
    chi = (((np.abs(obs - e) - np.minimum(0.5, np.abs(obs - e))) ** 2) / e).sum()
    assert r.dof == 1 and r.chi2 == pytest.approx(chi, rel=1e-12)


def test_auc_with_ties_brute_force(spark):
    rnd = random.Random(11)
    rows = [(i, rnd.randint(0, 1), round(rnd.random(), 1)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, cancelled int, score double")
    auc = df.select(M.roc_auc(df, "cancelled", "score").alias("auc")).first().auc
    pos = [s for _, y, s in rows if y == 1]
    neg = [s for _, y, s in rows if y == 0]
    brute = sum((p > q) + 0.5 * (p == q) for p, q in itertools.product(pos, neg)) / (len(pos) * len(neg))
    assert auc == pytest.approx(brute, abs=1e-12)
    roc = M.roc_curve(df, "cancelled", "score").toPandas()
    assert roc["fpr"].max() == pytest.approx(1.0) and roc["tpr"].max() == pytest.approx(1.0)


def test_gini_matches_numpy(spark):
    rnd = random.Random(5)
    vals = [float(rnd.choice([10, 20, 20, 35, 80, 200])) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in vals], "clv double")
    got = W.gini(df, "clv").first().gini
    s = np.sort(np.array(vals))
    cum = np.cumsum(s) / s.sum()
    pop = np.arange(1, len(s) + 1) / len(s)
    want = 1 - 2 * np.sum((pop[1:] - pop[:-1]) * (cum[1:] + cum[:-1]) / 2)
    assert got == pytest.approx(want, abs=1e-12)
    lz = W.lorenz(df, "clv").toPandas().sort_values("value")
    assert lz["cum_pop"].iloc[-1] == pytest.approx(1.0) and lz["cum_share"].iloc[-1] == pytest.approx(1.0)


def test_binary_metrics_and_report(spark):
    rows = [(1, 1.0, 0.9), (1, 0.0, 0.4), (0, 1.0, 0.6), (0, 0.0, 0.1), (0, 0.0, 0.2)]
    df = spark.createDataFrame(rows, "cancelled int, prediction double, score double")
    m = M.binary_metrics(df).first()
    assert (m.tp, m.fp, m.fn, m.tn) == (1, 1, 1, 2)
    assert m.accuracy == pytest.approx(0.6) and m.precision == pytest.approx(0.5) and m.recall == pytest.approx(0.5)
    rep = {r["class"]: r for r in M.classification_report(df).collect()}
    assert rep["1"].support == 2 and rep["0"].recall == pytest.approx(2 / 3)


def test_correlations_are_pairwise_complete(spark):
    """Two columns with nulls of their own, ties and a constant column, against pandas."""
    r = np.random.default_rng(6)
    pdf = pd.DataFrame({"a": r.integers(0, 9, 200), "b": r.normal(size=200), "c": r.normal(size=200), "d": r.integers(0, 4, 200)}, dtype=float)
    pdf["b"] += pdf["a"]
    pdf.loc[r.random(200) < 0.2, "b"] = None
    pdf.loc[r.random(200) < 0.3, "c"] = None
    rows = [(i, *[None if np.isnan(v) else float(v) for v in row]) for i, row in enumerate(pdf.to_numpy())]
    df = spark.createDataFrame(rows, "member_id long, a double, b double, c double, d double")
    for method, make in (("pearson", S.pearson_matrix), ("spearman", S.spearman_matrix)):
        want = pdf.corr(method=method)
        got = {(x["x"], x["y"]): x["r"] for x in make(df, list("abcd")).collect()}
        assert len(got) == 16
        for (x, y), value in got.items():
            assert value == pytest.approx(want.loc[x, y], abs=1e-12)
    flat = df.withColumn("d", F.lit(1.0))
    assert {x["r"] for x in S.pearson_matrix(flat, ["a", "d"]).collect() if "d" in (x["x"], x["y"])} == {None}


def test_pearson_with_known_gaps_is_the_same_with_fewer_aggregates(spark):
    rows = [(float(i % 7), float(i * i % 11), None if i % 5 == 0 else float(i % 3), 1.0, None if i % 4 == 0 else float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    cols = df.columns
    gaps = [c for c, n in S.null_counts(df, cols).items() if n]
    assert gaps == ["c", "e"]
    plain, known = ({(r["x"], r["y"]): r["r"] for r in S.pearson_matrix(df, cols, g).collect()} for g in (None, gaps))
    assert plain.keys() == known.keys()
    assert all(known[p] is None if r is None else abs(known[p] - r) < 1e-12 for p, r in plain.items())

    def conditions(g):
        return S.pearson_matrix(df, ["a", "b", "d"], g)._jdf.queryExecution().optimizedPlan().toString().count("CASE WHEN")

    assert conditions([]) < conditions(None)
