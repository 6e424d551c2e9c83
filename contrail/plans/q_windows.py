"""Ordered / cumulative / top-k queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import kpis as K
from ..operators import rollups
from ..operators import windows as W
from ..operators.sampling import sample_order_sql, seeded_sample
from .oracle_base import query
from .registry import register


def RS(c):
    return f"CAST(sum(CAST({c} AS DECIMAL(38,10))) AS DOUBLE)"


def _union(dfs):
    return reduce(lambda a, b: a.unionByName(b), dfs)


@register("revenue_ma3", query(f"""
SELECT date, revenue, CASE WHEN count(revenue) OVER w = 3 THEN avg(revenue) OVER w END AS ma3
FROM (SELECT date, {RS('revenue')} AS revenue FROM activity GROUP BY date) t
WINDOW w AS (ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"""), doubles="revenue ma3", digits=4)
def revenue_ma3(L):
    """monthly revenue with a 3-month moving average."""
    return W.revenue_ma3(L.activity)


@register("revenue_yoy", query(f"""
SELECT year, revenue, (revenue - lag(revenue) OVER (ORDER BY year)) * 100.0
  / nullif(lag(revenue) OVER (ORDER BY year), 0) AS yoy_pct
FROM (SELECT year, {RS('revenue')} AS revenue FROM activity GROUP BY year) t"""), doubles="revenue yoy_pct", digits=4)
def revenue_yoy(L):
    """E18 + F2: annual revenue, year-on-year %."""
    return W.revenue_yoy(L.activity)


@register("mom_growth", query("""
SELECT year, month, flights, points, round((flights - lag(flights) OVER w) * 100.0 / nullif(lag(flights) OVER w, 0), 2)
  AS flight_growth_pct, round((points - lag(points) OVER w) * 100.0 / nullif(lag(points) OVER w, 0), 2) AS point_growth_pct
FROM (SELECT year, month, CAST(sum(total_flights) AS BIGINT) AS flights, CAST(sum(points_accumulated) AS BIGINT) AS points
      FROM master GROUP BY year, month) t WINDOW w AS (ORDER BY year, month)"""),
    doubles="flight_growth_pct point_growth_pct")
def mom_growth(L):
    """month-on-month growth of flights and points (round 2)."""
    from ..functions.exprs import rnd
    m = L.master.groupBy("year", "month").agg(F.sum("total_flights").alias("flights"),
                                               F.sum("points_accumulated").alias("points"))
    m = m.withColumn("month_key", F.col("year").cast("int") * 12 + F.col("month").cast("int"))
    m = W.pct_change(m, "month_key", "flights", "flight_growth_pct")
    m = W.pct_change(m, "month_key", "points", "point_growth_pct")
    return m.select("year", "month", "flights", "points", rnd("flight_growth_pct", 2).alias("flight_growth_pct"),
                    rnd("point_growth_pct", 2).alias("point_growth_pct"))


@register("pareto_province", query(f"""
SELECT province, revenue, sum(revenue) OVER (ORDER BY revenue DESC, province ROWS UNBOUNDED PRECEDING)
  / sum(revenue) OVER () * 100.0 AS cumulative_pct
FROM (SELECT province, {RS('total_revenue')} AS revenue FROM customers GROUP BY province
      ORDER BY revenue DESC, province LIMIT 20) t"""), doubles="revenue cumulative_pct", digits=4)
def pareto_province(L):
    """top 20 provinces by revenue with cumulative percent."""
    g = L.customers.groupBy("province").agg(K.esum("total_revenue").alias("revenue"))
    return W.pareto(g, "province", "revenue", 20)


@register("lorenz_curve", query("""
SELECT value, n, sum(n) OVER w / CAST((SELECT count(clv) FROM members) AS DOUBLE) AS cum_pop,
  CAST(sum(s) OVER w AS DOUBLE) / (SELECT CAST(sum(CAST(clv AS DECIMAL(38,10))) AS DOUBLE) FROM members) AS cum_share
FROM (SELECT clv AS value, CAST(count(*) AS BIGINT) AS n, sum(CAST(clv AS DECIMAL(38,10))) AS s
      FROM members WHERE clv IS NOT NULL GROUP BY clv) t
WINDOW w AS (ORDER BY value ROWS UNBOUNDED PRECEDING)"""), doubles="value cum_pop cum_share", digits=8)
def lorenz_curve(L):
    """Lorenz curve of member CLV (one point per distinct value)."""
    return W.lorenz(L.members, "clv")


@register("gini", query("""
SELECT CAST(sum(n) AS BIGINT) AS members,
  1 - (2 * (sum(n * before + value * n * (n + 1) / 2.0) / CAST(sum(s) AS DOUBLE))
       - min(value) / CAST(sum(s) AS DOUBLE) - 1) / sum(n) AS gini
FROM (SELECT value, n, s, CAST(sum(s) OVER (ORDER BY value ROWS UNBOUNDED PRECEDING) - s AS DOUBLE) AS before
      FROM (SELECT clv AS value, count(*) AS n, sum(CAST(clv AS DECIMAL(38,10))) AS s
            FROM members WHERE clv IS NOT NULL GROUP BY clv)) t"""), doubles="gini", digits=8)
def gini(L):
    """Gini of member CLV (trapezoid on the Lorenz points)."""
    return W.gini(L.members, "clv")


@register("revenue_waterfall", query(f"""
SELECT loyalty_card AS step, 'relative' AS measure, revenue AS value,
  sum(revenue) OVER (ORDER BY loyalty_card ROWS UNBOUNDED PRECEDING) AS running_total
FROM (SELECT loyalty_card, {RS('total_revenue')} AS revenue FROM customers GROUP BY loyalty_card) t
UNION ALL
SELECT 'Total', 'total', sum(revenue), sum(revenue)
FROM (SELECT loyalty_card, {RS('total_revenue')} AS revenue FROM customers GROUP BY loyalty_card) t"""),
    doubles="value running_total", digits=4)
def revenue_waterfall(L):
    """tier revenue steps and total; the rollup is pruned to tier and revenue, and no score is taken."""
    return W.waterfall(rollups.customer_rollup(L.activity))


@register("tier_funnel", query("""
SELECT tier, CAST(coalesce(c.members, 0) AS BIGINT) AS members, stage,
  coalesce(c.members, 0) * 100.0 / nullif((SELECT count(*) FROM customers WHERE loyalty_card = 'Star'), 0)
    AS pct_of_initial
FROM (VALUES ('Star', 1), ('Nova', 2), ('Aurora', 3)) v(tier, stage)
LEFT JOIN (SELECT loyalty_card, count(*) AS members FROM customers GROUP BY 1) c ON c.loyalty_card = v.tier"""),
    doubles="pct_of_initial")
def tier_funnel(L):
    """tier funnel Star -> Nova -> Aurora, percent of the first stage."""
    return W.tier_funnel(L.customers)


@register("top_clv", query("""
SELECT f.member_id, f.clv, f.total_flights, f.total_distance, f.total_points, f.redemption_rate, m.loyalty_card,
  m.province, m.cancelled
FROM cust_flights f JOIN members m ON m.member_id = f.member_id
ORDER BY f.clv DESC, f.member_id LIMIT 20"""), doubles="clv redemption_rate")
def top_clv(L):
    """D8 + F7: top 20 members by CLV with profile (the intended join)."""
    prof = L.members.select("member_id", "province")
    j = L.customer_flights.join(prof, "member_id")
    return W.top_n(j, "clv", 20, "member_id").select(
        "member_id", "clv", "total_flights", "total_distance", "total_points", "redemption_rate", "loyalty_card",
        "province", "cancelled")


@register("top_flights", query("""
SELECT member_id, total_flights, total_distance, clv, active_months, redemption_rate, cancelled
FROM cust_flights ORDER BY total_flights DESC, member_id LIMIT 20"""), doubles="clv redemption_rate")
def top_flights(L):
    """top 20 members by flights."""
    return W.top_n(L.customer_flights, "total_flights", 20, "member_id").select(
        "member_id", "total_flights", "total_distance", "clv", "active_months", "redemption_rate", "cancelled")


@register("bottom_clv", query("""
SELECT member_id, clv, total_flights, active_months, cancelled FROM cust_flights
ORDER BY clv ASC, member_id LIMIT 20"""), doubles="clv")
def bottom_clv(L):
    """bottom 20 members by CLV."""
    return W.top_n(L.customer_flights, "clv", 20, "member_id", ascending=True).select(
        "member_id", "clv", "total_flights", "active_months", "cancelled")


def _extreme_sql(fact, sub, label, value, largest=True):
    o = "DESC" if largest else "ASC"
    return (f"SELECT * FROM (SELECT '{fact}' AS fact, CAST({label} AS VARCHAR) AS subject, CAST({value} AS DOUBLE) "
            f"AS value FROM ({sub}) g ORDER BY {value} {o}, {label} ASC LIMIT 1)")


_TIER_SQL = (f"SELECT loyalty_card, {RS('total_revenue')} AS revenue, avg(cancelled) AS churn_rate, "
             f"CAST(sum(CAST(engagement AS DECIMAL(38,10))) AS DOUBLE) / count(engagement) AS avg_engagement "
             f"FROM customers GROUP BY loyalty_card")
_PROV_SQL = f"SELECT province, {RS('total_revenue')} AS revenue FROM customers GROUP BY province"
_EDU_SQL = ("SELECT education, CAST(sum(CAST(clv AS DECIMAL(38,10))) AS DOUBLE) / count(clv) AS avg_clv "
            "FROM customers GROUP BY education")
_MONTH_SQL = "SELECT month, CAST(sum(total_flights) AS BIGINT) AS flights FROM master GROUP BY month"
_YEAR_SQL = f"SELECT year, {RS('revenue')} AS revenue FROM activity GROUP BY year"


@register("group_extremes", query("\nUNION ALL\n".join([
    _extreme_sql("top_tier_by_revenue", _TIER_SQL, "loyalty_card", "revenue"),
    _extreme_sql("safest_tier", _TIER_SQL, "loyalty_card", "churn_rate", largest=False),
    _extreme_sql("worst_churn_tier", _TIER_SQL, "loyalty_card", "churn_rate"),
    _extreme_sql("best_engagement_tier", _TIER_SQL, "loyalty_card", "avg_engagement"),
    _extreme_sql("top_province_by_revenue", _PROV_SQL, "province", "revenue"),
    _extreme_sql("top_education_by_clv", _EDU_SQL, "education", "avg_clv"),
    _extreme_sql("best_year_by_revenue", _YEAR_SQL, "year", "revenue"),
])), doubles="value", digits=4)
def group_extremes(L):
    """F8: arg-max / arg-min groups."""
    c = L.customers
    tiers = c.groupBy("loyalty_card").agg(K.esum("total_revenue").alias("revenue"),
                                          F.avg("cancelled").alias("churn_rate"),
                                          K.eavg("engagement").alias("avg_engagement"))
    prov = c.groupBy("province").agg(K.esum("total_revenue").alias("revenue"))
    edu = c.groupBy("education").agg(K.eavg("clv").alias("avg_clv"))
    yr = L.activity.groupBy("year").agg(K.esum("revenue").alias("revenue"))
    return _union([
        W.arg_extreme(tiers, "loyalty_card", "revenue", "top_tier_by_revenue"),
        W.arg_extreme(tiers, "loyalty_card", "churn_rate", "safest_tier", largest=False),
        W.arg_extreme(tiers, "loyalty_card", "churn_rate", "worst_churn_tier"),
        W.arg_extreme(tiers, "loyalty_card", "avg_engagement", "best_engagement_tier"),
        W.arg_extreme(prov, "province", "revenue", "top_province_by_revenue"),
        W.arg_extreme(edu, "education", "avg_clv", "top_education_by_clv"),
        W.arg_extreme(yr, "year", "revenue", "best_year_by_revenue"),
    ])


_YM_SQL = ("SELECT CAST(year AS INTEGER) * 100 + month AS ym, CAST(sum(total_flights) AS BIGINT) AS flights "
           "FROM master GROUP BY year, month")


@register("season_peak", query("\nUNION ALL\n".join([
    _extreme_sql("peak_month", _YM_SQL, "ym", "flights"),
    _extreme_sql("low_month", _YM_SQL, "ym", "flights", largest=False),
    _extreme_sql("peak_calendar_month", _MONTH_SQL, "month", "flights"),
    _extreme_sql("low_calendar_month", _MONTH_SQL, "month", "flights", largest=False),
])), doubles="value")
def season_peak(L):
    """F8: peak and low month by flights (year-month and calendar month)."""
    ym = L.master.groupBy((F.col("year").cast("int") * 100 + F.col("month").cast("int")).alias("ym")) \
        .agg(F.sum("total_flights").alias("flights"))
    mo = L.master.groupBy("month").agg(F.sum("total_flights").alias("flights"))
    return _union([W.arg_extreme(ym, "ym", "flights", "peak_month"),
                   W.arg_extreme(ym, "ym", "flights", "low_month", largest=False),
                   W.arg_extreme(mo, "month", "flights", "peak_calendar_month"),
                   W.arg_extreme(mo, "month", "flights", "low_calendar_month", largest=False)])


@register("concentration", query(f"""
SELECT t.loyalty_card AS top_tier, t.revenue * 100.0 / tot.revenue AS pct_revenue,
  t.customers * 100.0 / tot.customers AS pct_customers,
  (t.revenue * 100.0 / tot.revenue) / (t.customers * 100.0 / tot.customers) AS concentration_ratio,
  (SELECT sum(revenue) FROM (SELECT {RS('total_revenue')} AS revenue FROM customers GROUP BY province
     ORDER BY revenue DESC, province LIMIT 3)) * 100.0 / tot.revenue AS top3_province_pct
FROM (SELECT loyalty_card, {RS('total_revenue')} AS revenue, count(*) AS customers FROM customers
      GROUP BY loyalty_card ORDER BY revenue DESC, loyalty_card LIMIT 1) t,
     (SELECT {RS('total_revenue')} AS revenue, count(*) AS customers FROM customers) tot"""),
    doubles="pct_revenue pct_customers concentration_ratio top3_province_pct", digits=4)
def concentration(L):
    """top tier's revenue vs customer share, and the top-3 province share."""
    c = L.customers
    tiers = K.revenue_by(c, ["loyalty_card"])
    top = tiers.orderBy(F.desc("revenue"), "loyalty_card").limit(1)
    tot = c.agg(K.esum("total_revenue").alias("revenue"), F.count(F.lit(1)).alias("customers"))
    tot_rev, tot_cust = tot.select("revenue").scalar(), tot.select("customers").scalar()
    top3 = (K.revenue_by(c, ["province"]).orderBy(F.desc("revenue"), "province").limit(3)
            .select(F.sum("revenue")).scalar())
    pr = F.col("revenue") * 100.0 / tot_rev
    pc = F.col("customers") * 100.0 / tot_cust
    return top.select(F.col("loyalty_card").alias("top_tier"), pr.alias("pct_revenue"), pc.alias("pct_customers"),
                      (pr / pc).alias("concentration_ratio"), (top3 * 100.0 / tot_rev).alias("top3_province_pct"))


@register("sample_customers", query(f"""
SELECT member_id, total_flights, clv, redemption_rate, engagement, loyalty_card FROM customers
ORDER BY {sample_order_sql(['member_id'])}, member_id LIMIT 3000"""), doubles="clv redemption_rate engagement")
def sample_customers(L):
    """repeatable sample of at most 3000 members (scatter input)."""
    return seeded_sample(L.customers, "member_id", 3000, seed=42).select(
        "member_id", "total_flights", "clv", "redemption_rate", "engagement", "loyalty_card")
