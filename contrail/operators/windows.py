"""Ordered, cumulative and top-k operators.

Windows here run either per partition key (``partitionBy(member)``) or over
already-aggregated series whose length is bounded by a calendar or a category
list (months, years, provinces, tiers).  The one global order over raw members
(Lorenz / Gini) goes through ``functions.ranking.ordered_cumsum``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import TIER_ORDER, order_rank
from ..functions.ranking import ordered_cumsum
from .kpis import esum, revenue_by, revenue_monthly


def moving_average(series: DataFrame, order: str, value: str, n: int = 3, out: str = "ma") -> DataFrame:
    """n-period moving average, null until n periods exist (``rolling(n)``).

    ``series`` is one row per period (a calendar-bounded series)."""
    w = Window.orderBy(order).rowsBetween(-(n - 1), 0)
    return series.withColumn(out, F.when(F.count(value).over(w) == n, F.avg(value).over(w)))


def pct_change(series: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """``pct_change() * 100`` in period order (null for the first period)."""
    w = Window.orderBy(order)
    prev = F.lag(value).over(w)
    return series.withColumn(out, F.try_divide((F.col(value) - prev) * 100.0, prev))


def revenue_ma3(activity: DataFrame) -> DataFrame:
    return moving_average(revenue_monthly(activity), "date", "revenue", 3, "ma3")


def revenue_yoy(activity: DataFrame) -> DataFrame:
    """E18 + F2: revenue per year and year-on-year change (%)."""
    yr = activity.groupBy("year").agg(esum("revenue").alias("revenue"))
    return pct_change(yr, "year", "revenue", "yoy_pct")


def pareto(grouped: DataFrame, key: str, value: str, top_n: int = 20) -> DataFrame:
    """top-n groups by value, cumulative percent of the kept total."""
    top = grouped.orderBy(F.desc(value), key).limit(top_n)
    w = Window.orderBy(F.desc(value), key).rowsBetween(Window.unboundedPreceding, 0)  # <= top_n rows
    total = top.select(F.sum(value)).scalar()
    return top.withColumn("cumulative_pct", F.sum(value).over(w) / total * 100.0)


def lorenz(df: DataFrame, value: str) -> DataFrame:
    """Lorenz points at each distinct value: population share and value
    share up to and including that value (non-null values)."""
    vc = (df.filter(F.col(value).isNotNull()).groupBy(value)
          .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value).cast("decimal(38,10)")).alias("s")))
    cum = ordered_cumsum(vc, value, ["n", "s"])
    tot = vc.agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    n_all, s_all = tot.select("n").scalar(), tot.select("s").scalar()
    return cum.select(F.col(value).alias("value"), "n",
                      (F.col("cum_n") / n_all).alias("cum_pop"),
                      (F.col("cum_s").cast("double") / s_all.cast("double")).alias("cum_share"))


def gini(df: DataFrame, value: str) -> DataFrame:
    """``1 - 2 * trapz(cum_share, cum_pop)`` over the sorted values
    (points start at 1/n, as with numpy), summed per distinct value:
    a tie run of c values v after a cumulated total C contributes
    c*C + v*c(c+1)/2 to the sum of partial sums."""
    vc = (df.filter(F.col(value).isNotNull()).groupBy(value)
          .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value).cast("decimal(38,10)")).alias("s")))
    cum = ordered_cumsum(vc, value, ["n", "s"])
    before = (F.col("cum_s") - F.col("s")).cast("double")
    v = F.col(value).cast("double")
    c = F.col("n").cast("double")
    agg = cum.agg(F.sum(c * before + v * c * (c + 1) / 2.0).alias("sum_partial"),
                  F.sum("n").alias("n"), F.sum("s").cast("double").alias("total"),
                  F.min(value).cast("double").alias("first"))
    s_l = F.col("sum_partial") / F.col("total")
    l0 = F.col("first") / F.col("total")
    return agg.select(F.col("n").alias("members"),
                      (1 - (2 * s_l - l0 - 1) / F.col("n")).alias("gini"))


def waterfall(cdf: DataFrame) -> DataFrame:
    """relative steps per tier (alphabetical, as grouped) and a total row."""
    tiers = revenue_by(cdf, ["loyalty_card"])
    w = Window.orderBy("loyalty_card").rowsBetween(Window.unboundedPreceding, 0)  # tier rows only
    steps = tiers.select(F.col("loyalty_card").alias("step"), F.lit("relative").alias("measure"),
                         F.col("revenue").alias("value"), F.sum("revenue").over(w).alias("running_total"))
    total = tiers.agg(F.sum("revenue").alias("value")).select(
        F.lit("Total").alias("step"), F.lit("total").alias("measure"), "value", F.col("value").alias("running_total"))
    return steps.unionByName(total)


def tier_funnel(cdf: DataFrame, tiers=tuple(TIER_ORDER)) -> DataFrame:
    """member count per tier in fixed order (zero-filled) and percent of
    the first stage."""
    counts = cdf.groupBy("loyalty_card").agg(F.count(F.lit(1)).alias("members"))
    wide = counts.groupBy().pivot("loyalty_card", list(tiers)).agg(F.first("members")).fillna(0, list(tiers))
    long = wide.unpivot([], list(tiers), "tier", "members")
    first = wide.select(F.col(tiers[0])).scalar()
    return (long.withColumn("stage", order_rank("tier", list(tiers)))
            .withColumn("pct_of_initial", F.try_divide(F.col("members") * 100.0, first)))


def top_n(df: DataFrame, by: str, n: int, key: str, ascending: bool = False) -> DataFrame:
    """``nlargest`` / ``nsmallest`` with the key breaking ties (top-n plan)."""
    o = F.col(by).asc() if ascending else F.col(by).desc()
    return df.orderBy(o, F.col(key).asc()).limit(n)


def arg_extreme(grouped: DataFrame, label: str, value: str, fact: str, largest: bool = True) -> DataFrame:
    """F8: the group with the largest (smallest) value as a (fact, subject,
    value) row; ties go to the smallest label (``idxmax`` order).  ``grouped``
    is an aggregate with one row per group, so this is a top-1 over it."""
    o = F.desc(value) if largest else F.asc(value)
    return grouped.orderBy(o, F.asc(label)).limit(1).select(
        F.lit(fact).alias("fact"), F.col(label).cast("string").alias("subject"),
        F.col(value).cast("double").alias("value"))
