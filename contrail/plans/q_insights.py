"""The facts behind the insight cards as (topic, subject, value) rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import kpis as K
from ..operators import windows as W
from .oracle_base import query
from .q_windows import _EDU_SQL, _PROV_SQL, _TIER_SQL, _extreme_sql, RS
from .registry import register

_KPI_SQL = f"""SELECT count_if(cancelled = 1) * 100.0 / count(*) AS churn_pct,
  sum(points_redeemed) * 100.0 / nullif(sum(total_points), 0) AS redemption_rate,
  CAST(sum(CAST(engagement AS DECIMAL(38,10))) AS DOUBLE) / count(engagement) AS avg_engagement,
  CAST(sum(CAST(clv AS DECIMAL(38,10))) AS DOUBLE) / count(clv) AS avg_clv, avg(total_flights) AS avg_flights
FROM customers"""

KPI_FACTS = ["churn_pct", "redemption_rate", "avg_engagement", "avg_clv", "avg_flights"]


def _sql():
    parts = [f"SELECT 'kpi' AS topic, '{k}' AS subject, {k} AS value FROM ({_KPI_SQL}) k" for k in KPI_FACTS]
    parts.append("SELECT 'kpi', 'unredeemed_pct', 100.0 - redemption_rate FROM (" + _KPI_SQL + ") k")
    ext = [("top_tier_by_revenue", _TIER_SQL, "loyalty_card", "revenue", True),
           ("safest_tier", _TIER_SQL, "loyalty_card", "churn_rate", False),
           ("worst_churn_tier", _TIER_SQL, "loyalty_card", "churn_rate", True),
           ("best_engagement_tier", _TIER_SQL, "loyalty_card", "avg_engagement", True),
           ("top_province_by_revenue", _PROV_SQL, "province", "revenue", True),
           ("top_education_by_clv", _EDU_SQL, "education", "avg_clv", True)]
    for fact, sub, label, value, largest in ext:
        parts.append(f"SELECT fact AS topic, subject, value FROM ({_extreme_sql(fact, sub, label, value, largest)})")
    parts.append(f"""SELECT 'top_tier_revenue_pct', loyalty_card, revenue * 100.0 / (SELECT {RS('total_revenue')}
        FROM customers) FROM (SELECT loyalty_card, {RS('total_revenue')} AS revenue, count(*) AS customers
        FROM customers GROUP BY loyalty_card ORDER BY revenue DESC, loyalty_card LIMIT 1)""")
    parts.append("""SELECT 'top_tier_customer_pct', loyalty_card, customers * 100.0 / (SELECT count(*) FROM customers)
        FROM (SELECT loyalty_card, """ + RS('total_revenue') + """ AS revenue, count(*) AS customers FROM customers
        GROUP BY loyalty_card ORDER BY revenue DESC, loyalty_card LIMIT 1)""")
    parts.append("""SELECT 'avg_clv_by_gender', gender, CAST(sum(CAST(clv AS DECIMAL(38,10))) AS DOUBLE) / count(clv)
        FROM customers WHERE gender IS NOT NULL GROUP BY gender""")
    return "\nUNION ALL\n".join(parts)


@register("insight_facts", query(_sql()), doubles="value", digits=4)
def insight_facts(L):
    """KPIs, arg-max / arg-min groups and shares behind the insight cards."""
    c = L.customers
    k = K.executive_kpis(c)
    rows = [k.select(F.lit("kpi").alias("topic"), F.lit(x).alias("subject"), F.col(src).cast("double").alias("value"))
            for x, src in (("churn_pct", "churn_pct"), ("redemption_rate", "redemption_rate"),
                           ("avg_engagement", "avg_engagement"), ("avg_clv", "avg_clv"),
                           ("avg_flights", "avg_flights"))]
    rows.append(k.select(F.lit("kpi").alias("topic"), F.lit("unredeemed_pct").alias("subject"),
                         (100.0 - F.col("redemption_rate")).alias("value")))
    tiers = c.groupBy("loyalty_card").agg(K.esum("total_revenue").alias("revenue"),
                                          F.count(F.lit(1)).alias("customers"),
                                          F.avg("cancelled").alias("churn_rate"),
                                          K.eavg("engagement").alias("avg_engagement"))
    prov = c.groupBy("province").agg(K.esum("total_revenue").alias("revenue"))
    edu = c.groupBy("education").agg(K.eavg("clv").alias("avg_clv"))
    ext = [W.arg_extreme(tiers, "loyalty_card", "revenue", "top_tier_by_revenue"),
           W.arg_extreme(tiers, "loyalty_card", "churn_rate", "safest_tier", largest=False),
           W.arg_extreme(tiers, "loyalty_card", "churn_rate", "worst_churn_tier"),
           W.arg_extreme(tiers, "loyalty_card", "avg_engagement", "best_engagement_tier"),
           W.arg_extreme(prov, "province", "revenue", "top_province_by_revenue"),
           W.arg_extreme(edu, "education", "avg_clv", "top_education_by_clv")]
    rows += [e.select(F.col("fact").alias("topic"), "subject", "value") for e in ext]
    tot = c.agg(K.esum("total_revenue").alias("r"), F.count(F.lit(1)).alias("n"))
    top = tiers.orderBy(F.desc("revenue"), "loyalty_card").limit(1)
    rows.append(top.select(F.lit("top_tier_revenue_pct").alias("topic"), F.col("loyalty_card").alias("subject"),
                           (F.col("revenue") * 100.0 / tot.select("r").scalar()).alias("value")))
    rows.append(top.select(F.lit("top_tier_customer_pct").alias("topic"), F.col("loyalty_card").alias("subject"),
                           (F.col("customers") * 100.0 / tot.select("n").scalar()).alias("value")))
    rows.append(c.filter(F.col("gender").isNotNull()).groupBy("gender").agg(K.eavg("clv").alias("value"))
                .select(F.lit("avg_clv_by_gender").alias("topic"), F.col("gender").alias("subject"), "value"))
    return reduce(lambda a, b: a.unionByName(b), rows)
