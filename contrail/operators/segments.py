"""Binning, quantile labels, rule-based segments.

Quantile edges are one scalar aggregate (computed once, inlined as a scalar
subquery) applied row-wise with a ``when`` chain: no UDFs, no join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import column_quantiles, exact_quantiles, quantile_array
from ..functions.exprs import band, quantile_label


def qcut_labels(df: DataFrame, column: str, labels: list[str], out: str) -> DataFrame:
    """Pandas ``qcut(q=len(labels))`` labels from exact linear quantiles."""
    q = len(labels)
    edges = quantile_array(df, column, [i / q for i in range(1, q)])
    return df.withColumn(out, quantile_label(column, edges, labels))


def decile_share(df: DataFrame, column: str) -> DataFrame:
    """Decile label D1..D10 and each decile's share of the column total."""
    labels = [f"D{i}" for i in range(1, 11)]
    d = qcut_labels(df.filter(F.col(column).isNotNull()), column, labels, "decile")
    total = d.select(F.sum(F.col(column).cast("decimal(38,10)"))).scalar()
    return (d.groupBy("decile")
            .agg(F.count(F.lit(1)).alias("members"),
                 F.sum(F.col(column).cast("decimal(38,10)")).cast("double").alias("total"))
            .withColumn("share_pct", F.col("total") * 100.0 / total.cast("double")))


def value_bands(df: DataFrame, column: str, lo_q: float = 0.33, hi_q: float = 0.67,
                labels=("Low Value", "Medium Value", "High Value"), out: str = "value_band") -> DataFrame:
    """``cut`` at (0, p33], (p33, p67], (p67, inf): right-closed, 0 excluded."""
    q = quantile_array(df, column, [lo_q, hi_q])
    c = F.col(column)
    lab = (F.when((c > 0) & (c <= q[0]), labels[0]).when((c > q[0]) & (c <= q[1]), labels[1])
           .when(c > q[1], labels[2]))
    return df.withColumn(out, lab)


def thresholds(df: DataFrame, column: str) -> DataFrame:
    """Members above p99 / p95 / p90 and below p10."""
    q = quantile_array(df, column, [0.99, 0.95, 0.90, 0.10])
    c = F.col(column)
    agg = df.agg(F.count_if(c > q[0]).alias("top_1"), F.count_if(c > q[1]).alias("top_5"),
                 F.count_if(c > q[2]).alias("top_10"), F.count_if(c < q[3]).alias("bottom_10"))
    return agg.select(q[0].alias("p99"), q[1].alias("p95"), q[2].alias("p90"), q[3].alias("p10"), "*")


def histogram(df: DataFrame, column: str, bins: int, name: str | None = None,
              group: str | None = None, density: bool = False, lo=None, hi=None) -> DataFrame:
    """``bins`` equal-width bins over [min, max] (or given bounds); the top
    edge falls in the last bin; optional overlay group and density."""
    c = F.col(column).cast("double")
    d = df.filter(F.col(column).isNotNull())
    if lo is None or hi is None:
        mm = d.agg(F.min(c).alias("lo"), F.max(c).alias("hi"))
        lo, hi = mm.select("lo").scalar(), mm.select("hi").scalar()
    else:
        lo, hi = F.lit(float(lo)), F.lit(float(hi))
    width = (hi - lo) / bins
    b = F.floor(F.try_divide(c - lo, width)).cast("int")
    b = F.when(b.isNull(), F.lit(0)).when(b > bins - 1, F.lit(bins - 1)).when(b < 0, F.lit(0)).otherwise(b)
    keys = [F.lit(name or column).alias("variable")]
    if group:
        keys.append(F.col(group).cast("string").alias("grp"))
    h = (d.filter((c >= lo) & (c <= hi)).groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
         .withColumn("bin_lo", lo + F.col("bin") * width)
         .withColumn("bin_hi", lo + (F.col("bin") + 1) * width))
    if density:
        from pyspark.sql import Window
        tot = Window.partitionBy(*(["variable", "grp"] if group else ["variable"]))  # <= bins rows per group
        h = h.withColumn("density", F.col("count") / (F.sum("count").over(tot) * width))
    return h


def box_stats(df: DataFrame, value: str, group: str, k: float = 1.5) -> DataFrame:
    """Quartiles, whiskers (most extreme points inside the 1.5 IQR fences)
    and outlier count per group."""
    d = df.filter(F.col(value).isNotNull())
    # per-group quartiles from the bucketed order: no group's values sit in one task
    q = (exact_quantiles(d, value, [0.25, 0.5, 0.75], by=[group])
         .join(d.groupBy(group).agg(F.count(F.lit(1)).alias("n")), group)
         .select(group, "n", F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3")))
    fences = q.select(group, (F.col("q1") - k * (F.col("q3") - F.col("q1"))).alias("lo_f"),
                      (F.col("q3") + k * (F.col("q3") - F.col("q1"))).alias("hi_f"))
    v = F.col(value)
    inside = (v >= F.col("lo_f")) & (v <= F.col("hi_f"))
    w = (d.join(F.broadcast(fences), group)  # one row per group
         .groupBy(group)
         .agg(F.min(F.when(inside, v)).alias("whisker_lo"), F.max(F.when(inside, v)).alias("whisker_hi"),
              F.count_if(~inside).alias("outliers")))
    return q.join(w, group)


def kde(df: DataFrame, column: str, grid_points: int = 300, lo_q: float = 0.01, hi_q: float = 0.99) -> DataFrame:
    """Gaussian KDE (Scott bandwidth) evaluated on an even grid between p1
    and p99 of all rows.  Each task adds the kernels of its distinct values, times
    their counts, into one grid; only these grids are exchanged, and summed by position."""
    rows = df.filter(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"))
    st = rows.agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("x").alias("sd"))
    n, sd, q = st.select("n").scalar(), st.select("sd").scalar(), quantile_array(rows, "x", [lo_q, hi_q])
    s = rows.groupBy("x").agg(F.count(F.lit(1)).alias("w"))
    s = s.select("x", "w", q[0].alias("q0"), ((q[1] - q[0]) / (grid_points - 1)).alias("step"),
                 (sd * F.pow(n.cast("double"), -0.2)).alias("bw"))
    parts = s.mapInArrow(_kernel_sums(grid_points), "sums array<double>, q0 double, step double, bw double")
    exploded = parts.select(F.posexplode("sums").alias("pos", "k"), "q0", "step", "bw")
    norm = n.cast("double") * F.first("bw") * F.sqrt(F.lit(2 * 3.141592653589793))
    return (exploded.groupBy("pos").agg((F.sum("k") / norm).alias("density"),
                                        (F.first("q0") + F.col("pos") * F.first("step")).alias("x"))
            .select(F.col("pos").alias("point"), "x", "density"))


def _kernel_sums(grid_points: int):
    def run(batches):
        sums, at = np.zeros(grid_points), None
        for batch in batches:
            x, w, q0, step, bw = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            if not len(x):
                continue
            at = q0[0], step[0], bw[0]
            grid = at[0] + np.arange(grid_points) * at[1]
            for i in range(0, len(x), 4096):
                sums += w[i : i + 4096].astype(float) @ np.exp(-0.5 * ((grid - x[i : i + 4096, None]) / at[2]) ** 2)
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([sums.tolist()], pa.list_(pa.float64())), *(pa.array([float(v)]) for v in at)],
                                             ["sums", "q0", "step", "bw"])

    return run


def persona(cust: DataFrame, inclusive: bool = False) -> DataFrame:
    """Rule-based personas with the CLV and flight quartiles computed once.

    strict: ``>`` p75, ``<`` p25, redemption ``> 0.3``, label 'At-Risk Members';
    inclusive: ``>=`` / ``<=`` / ``>= 0.30``, label 'At Risk Members'."""
    q = column_quantiles(cust, {"clv": [0.75], "total_flights": [0.25, 0.75]})
    qc, qf = q["clv"][0], q["total_flights"]
    clv, fl, rr = F.col("clv"), F.col("total_flights"), F.col("redemption_rate")
    if inclusive:
        high_clv, high_fl, low_fl, high_red = clv >= qc, fl >= qf[1], fl <= qf[0], rr >= 0.30
        at_risk = "At Risk Members"
    else:
        high_clv, high_fl, low_fl, high_red = clv > qc, fl > qf[1], fl < qf[0], rr > 0.3
        at_risk = "At-Risk Members"
    # pandas comparisons with NaN are False
    high_clv, high_fl, low_fl, high_red = (F.coalesce(x, F.lit(False)) for x in (high_clv, high_fl, low_fl, high_red))
    inactive = F.coalesce(F.col("active_months") < 3, F.lit(False))
    label = (F.when(high_clv & high_fl & high_red, "Champions")
             .when(high_clv & high_fl, "Loyal Customers")
             .when(high_clv & inactive, "Dormant High Value")
             .when(~high_clv & high_fl & inactive, at_risk)
             .when(low_fl & ~inactive, "Casual Travelers")
             .otherwise("Frequent Flyers"))
    return cust.withColumn("persona", label)


def persona_profile(labelled: DataFrame, inclusive: bool = False) -> DataFrame:
    """Per persona: members, mean CLV / flights / redemption / active
    months, cancellation rate and share of members."""
    from .kpis import eavg
    total = labelled.select(F.count(F.lit(1))).scalar()
    g = (labelled.groupBy("persona")
         .agg(F.count(F.lit(1)).alias("members"), eavg("clv").alias("avg_clv"),
              F.avg("total_flights").alias("avg_flights"), eavg("redemption_rate").alias("avg_redemption"),
              F.avg("active_months").alias("avg_active_months"), F.avg("cancelled").alias("cancelled_rate"))
         .withColumn("member_pct", F.col("members") * 100.0 / total))
    if inclusive:
        g = g.withColumn("cancelled_rate", F.col("cancelled_rate") * 100.0)
    return g


def salary_band_counts(df: DataFrame, column: str = "salary") -> DataFrame:
    from ..functions.exprs import SALARY_BANDS
    return (df.withColumn("band", band(column, SALARY_BANDS)).groupBy("band")
            .agg(F.count(F.lit(1)).alias("members")))
