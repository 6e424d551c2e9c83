"""KPI and aggregate queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions.exprs import EDUCATION_ORDER
from ..operators import kpis as K
from .oracle_base import query
from .registry import register


def RS(c):
    return f"CAST(sum(CAST({c} AS DECIMAL(38,10))) AS DOUBLE)"


def RA(c):
    return f"(CAST(sum(CAST({c} AS DECIMAL(38,10))) AS DOUBLE) / count({c}))"


def U(parts):
    return "\nUNION ALL\n".join(parts)


def _union(dfs):
    return reduce(lambda a, b: a.unionByName(b), dfs)


@register("executive_kpis", query(f"""
SELECT CAST(count(*) AS BIGINT) AS total_customers, {RS('total_revenue')} AS total_revenue, {RA('clv')} AS avg_clv,
  avg(total_flights) AS avg_flights, CAST(count_if(cancelled = 0) AS BIGINT) AS active_members,
  coalesce(count_if(cancelled = 1) * 100.0 / nullif(count(*), 0), 0.0) AS churn_pct,
  coalesce(sum(points_redeemed) * 100.0 / nullif(sum(total_points), 0), 0.0) AS redemption_rate,
  {RA('engagement')} AS avg_engagement, CAST(sum(total_points) AS BIGINT) AS total_points_acc,
  CAST(sum(points_redeemed) AS BIGINT) AS total_points_red
FROM customers"""), doubles="total_revenue avg_clv avg_flights churn_pct redemption_rate avg_engagement")
def executive_kpis(L):
    """E5: executive KPIs."""
    return K.executive_kpis(L.customers)


@register("tier_counts", query("""
SELECT loyalty_card AS value, CAST(count(*) AS BIGINT) AS count FROM customers
WHERE loyalty_card IS NOT NULL GROUP BY 1"""))
def tier_counts(L):
    """E5: members per tier."""
    return K.category_counts(L.customers, "loyalty_card")


@register("program_kpis", query("""
SELECT CAST(count(*) AS BIGINT) AS total_members, CAST(count_if(cancelled = 0) AS BIGINT) AS active_members,
  CAST(count_if(cancelled = 1) AS BIGINT) AS cancelled_members,
  CAST(sum(CAST(clv AS DECIMAL(38,4))) AS DOUBLE) AS total_clv,
  CAST(sum(CAST(clv AS DECIMAL(38,4))) AS DOUBLE) / count(clv) AS avg_clv,
  (SELECT avg(total_flights) FROM cust_flights) AS avg_flights,
  (SELECT avg(total_distance) FROM cust_flights) AS avg_distance,
  (SELECT CAST(sum(points_accumulated) AS BIGINT) FROM master) AS total_points_earned,
  (SELECT CAST(sum(points_redeemed) AS BIGINT) FROM master) AS total_points_redeemed,
  count_if(cancelled = 1) / nullif(CAST(count(*) AS DOUBLE), 0) AS churn_rate,
  (SELECT sum(points_redeemed) / nullif(CAST(sum(points_accumulated) AS DOUBLE), 0) FROM master) AS redemption_ratio,
  (SELECT CAST(sum(points_accumulated) - sum(points_redeemed) AS BIGINT) FROM master) AS unredeemed_points
FROM members"""), doubles="total_clv avg_clv avg_flights avg_distance churn_rate redemption_ratio")
def program_kpis(L):
    """Programme KPIs."""
    return K.program_kpis(L.members, L.customer_flights, L.master)


@register("revenue_by_tier", query(f"""
SELECT loyalty_card, {RS('total_revenue')} AS revenue, CAST(count(*) AS BIGINT) AS customers
FROM customers GROUP BY loyalty_card"""), doubles="revenue")
def revenue_by_tier(L):
    """E7."""
    return K.revenue_by(L.customers, ["loyalty_card"])


@register("revenue_by_province", query(f"""
SELECT province, {RS('total_revenue')} AS revenue, CAST(count(*) AS BIGINT) AS customers
FROM customers GROUP BY province ORDER BY revenue DESC, province LIMIT 10"""), doubles="revenue")
def revenue_by_province(L):
    """Top 10 provinces by revenue."""
    return K.revenue_by_province(L.customers, 10)


@register("revenue_summary", query(f"""
SELECT province, loyalty_card, {RS('total_revenue')} AS revenue, CAST(count(*) AS BIGINT) AS customers
FROM customers GROUP BY province, loyalty_card"""), doubles="revenue")
def revenue_summary(L):
    """A3 extract: revenue and customers per province x tier."""
    return K.revenue_by(L.customers, ["province", "loyalty_card"])


@register("revenue_monthly", query(f"SELECT date, {RS('revenue')} AS revenue FROM activity GROUP BY date"),
          doubles="revenue")
def revenue_monthly(L):
    """Revenue per month."""
    return K.revenue_monthly(L.activity)


@register("tier_performance", query(f"""
SELECT loyalty_card AS tier, CAST(count(*) AS BIGINT) AS customers, {RA('clv')} AS avg_clv,
  avg(total_flights) AS avg_flights, {RS('total_revenue')} AS total_revenue, {RA('engagement')} AS avg_engagement,
  avg(cancelled) AS churn_rate
FROM customers GROUP BY loyalty_card"""), doubles="avg_clv avg_flights total_revenue avg_engagement churn_rate")
def tier_performance(L):
    """E10."""
    return K.tier_performance(L.customers)


@register("engagement_by_education", query(f"""
SELECT education, {RA('engagement')} AS avg_engagement, {RA('clv')} AS avg_clv, avg(total_flights) AS avg_flights,
  CAST(count(*) AS BIGINT) AS count
FROM customers GROUP BY education"""), doubles="avg_engagement avg_clv avg_flights")
def engagement_by_education(L):
    """E11."""
    return K.engagement_by_education(L.customers)


@register("churn_by_tier", query("""
SELECT loyalty_card AS tier, CAST(sum(cancelled) AS BIGINT) AS churned, CAST(count(cancelled) AS BIGINT) AS total,
  avg(cancelled) AS churn_rate FROM customers GROUP BY loyalty_card"""), doubles="churn_rate")
def churn_by_tier(L):
    """E12."""
    return K.churn_by_tier(L.customers)


@register("points_kpis", query("""
SELECT CAST(sum(total_points) AS BIGINT) AS total_points_acc, CAST(sum(points_redeemed) AS BIGINT) AS total_points_red,
  coalesce(sum(points_redeemed) * 100.0 / nullif(sum(total_points), 0), 0.0) AS redemption_pct,
  CAST(sum(total_points) - sum(points_redeemed) AS BIGINT) AS points_balance FROM customers"""),
    doubles="redemption_pct")
def points_kpis(L):
    """E13."""
    return K.points_kpis(L.customers)


@register("points_by_tier", query("""
SELECT loyalty_card, CAST(sum(total_points) AS BIGINT) AS accumulated, CAST(sum(points_redeemed) AS BIGINT) AS redeemed
FROM customers GROUP BY loyalty_card"""))
def points_by_tier(L):
    """E14."""
    return K.points_by_tier(L.customers)


@register("churn_tier_marital", query("""
SELECT loyalty_card,
  avg(CASE WHEN marital_status = 'Divorced' THEN cancelled END) * 100.0 AS "Divorced",
  avg(CASE WHEN marital_status = 'Married' THEN cancelled END) * 100.0 AS "Married",
  avg(CASE WHEN marital_status = 'Single' THEN cancelled END) * 100.0 AS "Single"
FROM customers GROUP BY loyalty_card"""), doubles="Divorced Married Single")
def churn_tier_marital(L):
    """Churn % tier x marital status."""
    return K.churn_tier_marital(L.customers)


@register("churn_by_enrollment", query("""
SELECT enrollment_yr, avg(cancelled) AS churn_rate FROM customers GROUP BY enrollment_yr"""), doubles="churn_rate")
def churn_by_enrollment(L):
    """E16."""
    return K.churn_by_enrollment(L.customers)


@register("points_monthly_tier", query("""
SELECT date, loyalty_card, CAST(sum(points_accumulated) AS BIGINT) AS points,
  CAST(sum(points_redeemed) AS BIGINT) AS redeemed FROM activity GROUP BY date, loyalty_card"""))
def points_monthly_tier(L):
    """E17."""
    return K.points_monthly_tier(L.activity)


@register("revenue_per_customer", query(f"""
SELECT loyalty_card AS tier, CAST(count(*) AS BIGINT) AS customers, {RS('total_revenue')} AS total_revenue,
  {RS('total_revenue')} / count(*) AS rev_per_customer,
  (SELECT {RS('total_revenue')} FROM customers) AS total_rev,
  (SELECT {RA('total_revenue')} FROM customers) AS avg_rev_cust,
  (SELECT sum(points_redeemed) * 0.01 FROM customers) AS points_cost
FROM customers GROUP BY loyalty_card"""),
    doubles="total_revenue rev_per_customer total_rev avg_rev_cust points_cost")
def revenue_per_customer(L):
    """E19."""
    return K.revenue_per_customer(L.customers)


@register("revenue_marital_tier", query(f"""
SELECT marital_status, loyalty_card, {RS('total_revenue')} AS revenue, CAST(count(*) AS BIGINT) AS customers
FROM customers GROUP BY marital_status, loyalty_card"""), doubles="revenue")
def revenue_marital_tier(L):
    """E20."""
    return K.revenue_by(L.customers, ["marital_status", "loyalty_card"])


@register("revenue_matrix", query("""
SELECT province, "Star", "Nova", "Aurora", "Star" + "Nova" + "Aurora" AS total FROM (
  SELECT province,
    coalesce(CAST(sum(CASE WHEN loyalty_card = 'Star' THEN CAST(total_revenue AS DECIMAL(38,10)) END) AS DOUBLE), 0.0) AS "Star",
    coalesce(CAST(sum(CASE WHEN loyalty_card = 'Nova' THEN CAST(total_revenue AS DECIMAL(38,10)) END) AS DOUBLE), 0.0) AS "Nova",
    coalesce(CAST(sum(CASE WHEN loyalty_card = 'Aurora' THEN CAST(total_revenue AS DECIMAL(38,10)) END) AS DOUBLE), 0.0) AS "Aurora"
  FROM customers GROUP BY province) t
ORDER BY total DESC, province LIMIT 12"""), doubles="Star Nova Aurora total")
def revenue_matrix(L):
    """Province x tier revenue, top 12 provinces."""
    return K.revenue_matrix(L.customers)


@register("enrollment_cohort", query(f"""
SELECT enrollment_yr, {RS('total_revenue')} AS revenue, CAST(count(*) AS BIGINT) AS customers, {RA('clv')} AS avg_clv
FROM customers GROUP BY enrollment_yr"""), doubles="revenue avg_clv")
def enrollment_cohort(L):
    """E22."""
    return K.enrollment_cohort(L.customers)


@register("members_by_province", query("""
SELECT province, CAST(count(*) AS BIGINT) AS members FROM customers GROUP BY province
ORDER BY members DESC, province LIMIT 12"""))
def members_by_province(L):
    """E23."""
    return K.members_by_province(L.customers)


@register("income_tier", query(f"""
SELECT salary_group, loyalty_card, CAST(count(*) AS BIGINT) AS count, {RA('clv')} AS avg_clv,
  avg(total_flights) AS avg_flights FROM customers GROUP BY salary_group, loyalty_card"""),
    doubles="avg_clv avg_flights")
def income_tier(L):
    """E24."""
    return K.income_tier(L.customers)


CLV_GROUPS = ["loyalty_card", "education", "gender", "marital_status"]


@register("clv_by_group", query(U([
    f"SELECT '{g}' AS grouping, {g} AS level, {RA('clv')} AS mean, CAST(count(*) AS BIGINT) AS rows "
    f"FROM customers GROUP BY {g}" for g in CLV_GROUPS])), doubles="mean")
def clv_by_group(L):
    """Mean CLV per tier / education / gender / marital status."""
    return _union([K.mean_by(L.customers, g, "clv").select(F.lit(g).alias("grouping"), F.col(g).alias("level"),
                                                            "mean", "rows") for g in CLV_GROUPS])


COUNT_COLS = ["education", "marital_status", "gender", "loyalty_card", "city", "province", "status"]


@register("category_counts", query(U([
    f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, CAST(count(*) AS BIGINT) AS count FROM activity "
    f"WHERE {c} IS NOT NULL GROUP BY {c}" for c in COUNT_COLS])))
def category_counts(L):
    """Value counts of the categorical columns (member-month rows)."""
    return _union([K.category_counts(L.activity, c).select(F.lit(c).alias("column"), "value", "count")
                   for c in COUNT_COLS])


PCT_COLS = ["loyalty_card", "gender", "marital_status", "cancelled", "education"]


@register("category_percent", query(U([
    f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, CAST(count(*) AS BIGINT) AS count, "
    f"round(count(*) * 100.0 / (SELECT count({c}) FROM master), 2) AS pct FROM master "
    f"WHERE {c} IS NOT NULL GROUP BY {c}" for c in PCT_COLS])), doubles="pct")
def category_percent(L):
    """Category shares (%) over member-months."""
    return _union([K.category_percent(L.master, c).select(F.lit(c).alias("column"), "value", "count", "pct")
                   for c in PCT_COLS])


@register("top_cities_percent", query("""
SELECT city AS value, CAST(count(*) AS BIGINT) AS count, round(count(*) * 100.0 / (SELECT count(city) FROM master), 2)
  AS pct FROM master WHERE city IS NOT NULL GROUP BY city ORDER BY count DESC, value LIMIT 10"""), doubles="pct")
def top_cities_percent(L):
    """Top 10 cities by share of member-months."""
    return K.category_percent(L.master, "city", top_n=10)


@register("churn_crosstab", query("""
SELECT loyalty_card, round(count_if(cancelled = 0) * 100.0 / count(*), 2) AS pct_active,
  round(count_if(cancelled = 1) * 100.0 / count(*), 2) AS pct_cancelled
FROM master GROUP BY loyalty_card"""), doubles="pct_active pct_cancelled")
def churn_crosstab(L):
    """Card x cancelled, row-normalised (member-months)."""
    return K.churn_crosstab(L.master)


@register("churn_rate_distinct", query("""
SELECT CAST(count(DISTINCT member_id) AS BIGINT) AS total_customers,
  CAST(count(DISTINCT CASE WHEN cancelled = 1 THEN member_id END) AS BIGINT) AS churned,
  round(count(DISTINCT CASE WHEN cancelled = 1 THEN member_id END) * 100.0 / count(DISTINCT member_id), 2)
    AS churn_rate FROM master"""), doubles="churn_rate")
def churn_rate_distinct(L):
    """E29."""
    return K.churn_rate_distinct(L.master)


def _profile_sql(src, key, flights, dist=False, order=None):
    extra = "avg(total_distance) AS avg_distance, " if dist else ""
    ordc = ""
    if order:
        ordc = ", CASE " + " ".join(f"WHEN {key} = '{v}' THEN {i}" for i, v in enumerate(order, 1)) + " END AS \"order\""
    return (f"SELECT {key}, CAST(count(*) AS BIGINT) AS members, {RA('clv')} AS avg_clv, avg({flights}) AS avg_flights, "
            f"{extra}avg(cancelled) AS cancellation_rate, count(*) * 100.0 / (SELECT count(*) FROM {src}) AS member_pct"
            f"{ordc} FROM {src} GROUP BY {key}")


_DEMO = """demo AS (
  SELECT t.member_id, t.total_flights, t.total_distance, t.total_points, t.points_redeemed,
    m.gender, m.education, m.province, m.loyalty_card, m.marital_status, m.clv, m.cancelled
  FROM (SELECT member_id, CAST(sum(total_flights) AS BIGINT) AS total_flights,
          CAST(sum(distance) AS BIGINT) AS total_distance, CAST(sum(points_accumulated) AS BIGINT) AS total_points,
          CAST(sum(points_redeemed) AS BIGINT) AS points_redeemed FROM master GROUP BY member_id) t
  LEFT JOIN members m ON m.member_id = t.member_id)"""


def demographics(L):
    """Member activity totals left-joined to the member profile."""
    t = (L.master.groupBy("member_id")
         .agg(F.sum("total_flights").alias("total_flights"), F.sum("distance").alias("total_distance"),
              F.sum("points_accumulated").alias("total_points"), F.sum("points_redeemed").alias("points_redeemed")))
    prof = L.members.select("member_id", "gender", "education", "province", "loyalty_card", "marital_status",
                            "clv", "cancelled")
    return t.join(prof, "member_id", "left")


@register("demographics", query("SELECT * FROM demo", _DEMO), doubles="clv")
def demographics_q(L):
    """Member totals with profile."""
    return demographics(L)


@register("education_stats", query(_profile_sql("demo", "education", "total_flights", order=EDUCATION_ORDER),
                                   _DEMO), doubles="avg_clv avg_flights cancellation_rate member_pct")
def education_stats(L):
    """Education table in fixed order (member grain)."""
    return K.group_profile(demographics(L), "education", "total_flights", order=EDUCATION_ORDER)


@register("education_stats_rows", query(_profile_sql("master", "education", "total_flights",
                                                     order=EDUCATION_ORDER)),
          doubles="avg_clv avg_flights cancellation_rate member_pct")
def education_stats_rows(L):
    """Education table at member-month grain."""
    return K.group_profile(L.master, "education", "total_flights", order=EDUCATION_ORDER)


@register("gender_stats", query(_profile_sql("demo", "gender", "total_flights", dist=True), _DEMO),
          doubles="avg_clv avg_flights avg_distance cancellation_rate member_pct")
def gender_stats(L):
    """E31."""
    return K.group_profile(demographics(L), "gender", "total_flights", with_distance=True)


@register("province_stats", query(_profile_sql("demo", "province", "total_flights")
                                  + " ORDER BY members DESC, province LIMIT 10", _DEMO),
          doubles="avg_clv avg_flights cancellation_rate member_pct")
def province_stats(L):
    """Top 10 provinces by members."""
    return (K.group_profile(demographics(L), "province", "total_flights")
            .orderBy(F.desc("members"), "province").limit(10))


@register("tier_comparison", query(f"""
SELECT loyalty_card, CAST(count(*) AS BIGINT) AS members, {RA('clv')} AS avg_clv, median(clv) AS median_clv,
  avg(total_flights) AS avg_flights, avg(total_distance) AS avg_distance, avg(total_points) AS avg_pts_acc,
  avg(points_redeemed) AS avg_pts_red, avg(cancelled) AS cancellation_rate FROM demo GROUP BY loyalty_card""", _DEMO),
    doubles="avg_clv median_clv avg_flights avg_distance avg_pts_acc avg_pts_red cancellation_rate")
def tier_comparison(L):
    """Tier comparison incl. median CLV."""
    return K.tier_comparison(demographics(L))


CANCEL_COLS = ["total_flights", "total_distance", "total_points", "points_redeemed", "active_months", "clv",
               "redemption_rate"]


@register("cancel_profile", query("SELECT metric, active_mean, cancelled_mean, "
                                  "active_mean / nullif(cancelled_mean, 0.0) AS ratio FROM (" + U([
                                      f"SELECT '{c}' AS metric, {RA(f'CASE WHEN cancelled = 0 THEN CAST({c} AS DOUBLE) END')}"
                                      f" AS active_mean, {RA(f'CASE WHEN cancelled = 1 THEN CAST({c} AS DOUBLE) END')}"
                                      f" AS cancelled_mean FROM cust_flights" for c in CANCEL_COLS]) + ") t"),
          doubles="active_mean cancelled_mean ratio")
def cancel_profile(L):
    """Active vs cancelled means and ratio."""
    return K.cancel_profile(L.customer_flights, CANCEL_COLS)


@register("monthly_seasonality", query("""
SELECT year, month, total_flights, total_distance, total_pts_acc, total_pts_red, active_customers, active_members,
  strftime(make_date(CAST(year AS BIGINT), CAST(month AS BIGINT), 1), '%b %Y') AS period,
  round((total_flights - lag(total_flights) OVER w) * 100.0 / nullif(lag(total_flights) OVER w, 0), 2)
    AS flight_growth_pct,
  round((total_pts_acc - lag(total_pts_acc) OVER w) * 100.0 / nullif(lag(total_pts_acc) OVER w, 0), 2)
    AS point_growth_pct
FROM (SELECT year, month, CAST(sum(total_flights) AS BIGINT) AS total_flights,
        CAST(sum(distance) AS BIGINT) AS total_distance, CAST(sum(points_accumulated) AS BIGINT) AS total_pts_acc,
        CAST(sum(points_redeemed) AS BIGINT) AS total_pts_red,
        CAST(count_if(total_flights > 0) AS BIGINT) AS active_customers,
        CAST(count(DISTINCT CASE WHEN total_flights > 0 THEN member_id END) AS BIGINT) AS active_members
      FROM master GROUP BY year, month) m
WINDOW w AS (ORDER BY year, month)"""), doubles="flight_growth_pct point_growth_pct")
def monthly_seasonality(L):
    """E35 + C14 + F2: month series, labels, both active counts, MoM growth."""
    return K.monthly_seasonality(L.master)


def _season_sql(measure):
    cols = ", ".join(f"CAST(sum(CASE WHEN month = {m} THEN {measure} END) AS BIGINT) AS m{m:02d}" for m in range(1, 13))
    return f"SELECT year, {cols} FROM master GROUP BY year"


@register("season_pivot", query(_season_sql("total_flights")))
def season_pivot(L):
    """Year x month flights."""
    return K.season_pivot(L.master, "total_flights")


@register("season_pivot_points", query(_season_sql("points_accumulated")))
def season_pivot_points(L):
    """Year x month points accumulated."""
    return K.season_pivot(L.master, "points_accumulated")


@register("flights_province_tier", query("""
SELECT province,
  CAST(coalesce(sum(CASE WHEN loyalty_card = 'Star' THEN total_flights END), 0) AS BIGINT) AS "Star",
  CAST(coalesce(sum(CASE WHEN loyalty_card = 'Nova' THEN total_flights END), 0) AS BIGINT) AS "Nova",
  CAST(coalesce(sum(CASE WHEN loyalty_card = 'Aurora' THEN total_flights END), 0) AS BIGINT) AS "Aurora"
FROM activity GROUP BY province"""))
def flights_province_tier(L):
    """E37."""
    return K.flights_province_tier(L.activity)


@register("rows_per_year", query("SELECT year, CAST(count(*) AS BIGINT) AS rows FROM master GROUP BY year"))
def rows_per_year(L):
    """E38."""
    return L.master.groupBy("year").agg(F.count(F.lit(1)).alias("rows"))


@register("enrollment_trend", query(f"""
SELECT 'members_per_enrollment_year' AS series, CAST(enrollment_year AS BIGINT) AS key,
  CAST(count(DISTINCT member_id) AS DOUBLE) AS value FROM master GROUP BY enrollment_year
UNION ALL
SELECT 'rows_per_enrollment_month', CAST(enrollment_month AS BIGINT), CAST(count(*) AS DOUBLE)
FROM master WHERE enrollment_month IS NOT NULL GROUP BY enrollment_month
UNION ALL
SELECT 'avg_clv_per_enrollment_year', CAST(enrollment_year AS BIGINT), {RA('clv')} FROM master GROUP BY enrollment_year"""),
    doubles="value")
def enrollment_trend(L):
    """Distinct members per enrollment year, rows per enrollment month,
    mean CLV per enrollment year (member-month grain)."""
    m = L.master
    a = m.groupBy("enrollment_year").agg(F.count_distinct("member_id").cast("double").alias("value")) \
        .select(F.lit("members_per_enrollment_year").alias("series"), F.col("enrollment_year").alias("key"), "value")
    b = m.filter(F.col("enrollment_month").isNotNull()).groupBy("enrollment_month") \
        .agg(F.count(F.lit(1)).cast("double").alias("value")) \
        .select(F.lit("rows_per_enrollment_month").alias("series"), F.col("enrollment_month").alias("key"), "value")
    c = m.groupBy("enrollment_year").agg(K.eavg("clv").alias("value")) \
        .select(F.lit("avg_clv_per_enrollment_year").alias("series"), F.col("enrollment_year").alias("key"), "value")
    return _union([a, b, c])


@register("disengagement_rates", query("""
SELECT avg(CASE WHEN total_flights = 0 THEN 1.0 ELSE 0.0 END) AS never_flew_share,
  CAST(count_if(total_flights = 0) AS BIGINT) AS never_flew,
  avg(CASE WHEN redemption_rate = 0 THEN 1.0 ELSE 0.0 END) AS never_redeemed_share,
  avg(CASE WHEN cancelled = 1 THEN total_flights END) AS cancelled_avg_flights,
  avg(CASE WHEN cancelled = 0 THEN total_flights END) AS active_avg_flights,
  median(total_flights) AS median_flights, avg(total_flights) AS mean_flights
FROM cust_flights"""), doubles="never_flew_share never_redeemed_share cancelled_avg_flights active_avg_flights "
                              "median_flights mean_flights")
def disengagement_rates(L):
    """E40."""
    return K.disengagement_rates(L.customer_flights)


CHURN_GROUPS = ["marital_status", "education"]


@register("churn_by_group", query(U([
    f"SELECT '{g}' AS grouping, {g} AS level, avg(cancelled) AS mean, CAST(count(*) AS BIGINT) AS rows "
    f"FROM demo GROUP BY {g}" for g in CHURN_GROUPS]
    + [f"SELECT '{g}_rows' AS grouping, {g} AS level, avg(cancelled) AS mean, CAST(count(*) AS BIGINT) AS rows "
       f"FROM master GROUP BY {g}" for g in CHURN_GROUPS]), _DEMO), doubles="mean")
def churn_by_group(L):
    """Churn rate by marital status / education (member and row grain)."""
    demo = demographics(L)
    parts = [K.mean_by(demo, g, "cancelled", exact_money=False)
             .select(F.lit(g).alias("grouping"), F.col(g).alias("level"), "mean", "rows") for g in CHURN_GROUPS]
    parts += [K.mean_by(L.master, g, "cancelled", exact_money=False)
              .select(F.lit(f"{g}_rows").alias("grouping"), F.col(g).alias("level"), "mean", "rows")
              for g in CHURN_GROUPS]
    return _union(parts)


@register("dataset_snapshot", query(f"""
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT member_id) AS BIGINT) AS members,
  CAST(count(DISTINCT province) AS BIGINT) AS provinces, min(date) AS first_month, max(date) AS last_month,
  avg(cancelled) AS churn_rate, {RA('redemption_rate')} AS avg_redemption_rate FROM activity"""),
    doubles="churn_rate avg_redemption_rate")
def dataset_snapshot(L):
    """E42."""
    return K.dataset_snapshot(L.activity)


LEVEL_PAIRS = [("total_flights", "points_accumulated"), ("loyalty_card", "points_redeemed"),
               ("loyalty_card", "clv"), ("loyalty_card", "distance")]


@register("mean_by_level", query(U([
    f"SELECT '{y}_by_{x}' AS series, CAST({x} AS VARCHAR) AS level, {RA(f'CAST({y} AS DOUBLE)')} AS mean, "
    f"CAST(count(*) AS BIGINT) AS rows FROM master GROUP BY {x}" for x, y in LEVEL_PAIRS])), doubles="mean")
def mean_by_level(L):
    """Mean of y per level of x (points by flights; redeemed, CLV, distance by card)."""
    return _union([L.master.groupBy(F.col(x).cast("string").alias("level"))
                   .agg(K.eavg(F.col(y).cast("double")).alias("mean"), F.count(F.lit(1)).alias("rows"))
                   .select(F.lit(f"{y}_by_{x}").alias("series"), "level", "mean", "rows") for x, y in LEVEL_PAIRS])


@register("monthly_active_distinct", query("""
SELECT year, month, CAST(count(DISTINCT CASE WHEN total_flights > 0 THEN member_id END) AS BIGINT) AS active_customers
FROM master GROUP BY year, month"""))
def monthly_active_distinct(L):
    """E35 (second variant): distinct members with flights per month."""
    return (L.master.groupBy("year", "month")
            .agg(F.count_distinct(F.when(F.col("total_flights") > 0, F.col("member_id"))).alias("active_customers")))
