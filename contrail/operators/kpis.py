"""KPIs and grouped aggregates over the member summary and the enriched fact
(E5-E43).

Every function is one ``groupBy`` (partial aggregation map-side; few groups,
so the final aggregate is tiny) or one global ``agg``.  Shares and
"percent of total" use a scalar subquery for the total, never a
single-partition window over the data.  Money is summed as decimal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import quantile_array
from ..functions.exprs import TIER_ORDER, money_avg, money_sum, order_rank, safe_div


def esum(c):
    return money_sum(c, 10)


def eavg(c):
    return money_avg(c, 10)


def count_rows():
    return F.count(F.lit(1))


def executive_kpis(cdf: DataFrame) -> DataFrame:
    """E5: headline KPIs of the member summary (one row)."""
    n = count_rows()
    cancelled = F.count_if(F.col("cancelled") == 1)
    acc, red = F.sum("total_points"), F.sum("points_redeemed")
    return cdf.agg(
        n.alias("total_customers"), esum("total_revenue").alias("total_revenue"),
        eavg("clv").alias("avg_clv"), F.avg("total_flights").alias("avg_flights"),
        F.count_if(F.col("cancelled") == 0).alias("active_members"),
        F.coalesce(safe_div(cancelled * 100.0, n), F.lit(0.0)).alias("churn_pct"),
        F.coalesce(safe_div(red * 100.0, F.nullif(acc, F.lit(0))), F.lit(0.0)).alias("redemption_rate"),
        eavg("engagement").alias("avg_engagement"),
        acc.alias("total_points_acc"), red.alias("total_points_red"))


def program_kpis(members: DataFrame, cust_flights: DataFrame, master: DataFrame) -> DataFrame:
    """Programme KPIs from the member table, member totals and the master."""
    m = members.agg(count_rows().alias("total_members"),
                    F.count_if(F.col("cancelled") == 0).alias("active_members"),
                    F.count_if(F.col("cancelled") == 1).alias("cancelled_members"),
                    money_sum("clv", 4).alias("total_clv"), money_avg("clv", 4).alias("avg_clv"))
    cf = cust_flights.agg(F.avg("total_flights").alias("avg_flights"),
                          F.avg("total_distance").alias("avg_distance"))
    pts = master.agg(F.sum("points_accumulated").alias("total_points_earned"),
                     F.sum("points_redeemed").alias("total_points_redeemed"))
    out = m.select("*", *[cf.select(c).scalar().alias(c) for c in cf.columns],
                   *[pts.select(c).scalar().alias(c) for c in pts.columns])
    return (out.withColumn("churn_rate", safe_div("cancelled_members", "total_members"))
            .withColumn("redemption_ratio", safe_div("total_points_redeemed", "total_points_earned"))
            .withColumn("unredeemed_points", F.col("total_points_earned") - F.col("total_points_redeemed")))


def revenue_by(cdf: DataFrame, keys: list[str]) -> DataFrame:
    """E7 / E20 / rev_summary: revenue and customers per group."""
    return cdf.groupBy(*keys).agg(esum("total_revenue").alias("revenue"), count_rows().alias("customers"))


def revenue_by_province(cdf: DataFrame, top_n: int = 10) -> DataFrame:
    """Top-n provinces by revenue (ties broken by name)."""
    return revenue_by(cdf, ["province"]).orderBy(F.desc("revenue"), "province").limit(top_n)


def revenue_monthly(df: DataFrame) -> DataFrame:
    """Revenue per month-start date."""
    return df.groupBy("date").agg(esum("revenue").alias("revenue")).orderBy("date")


def tier_performance(cdf: DataFrame) -> DataFrame:
    """Per tier: customers, avg CLV / flights / engagement, revenue, churn."""
    return (cdf.groupBy(F.col("loyalty_card").alias("tier"))
            .agg(count_rows().alias("customers"), eavg("clv").alias("avg_clv"),
                 F.avg("total_flights").alias("avg_flights"), esum("total_revenue").alias("total_revenue"),
                 eavg("engagement").alias("avg_engagement"), F.avg("cancelled").alias("churn_rate")))


def engagement_by_education(cdf: DataFrame) -> DataFrame:
    """E11."""
    return (cdf.groupBy("education")
            .agg(eavg("engagement").alias("avg_engagement"), eavg("clv").alias("avg_clv"),
                 F.avg("total_flights").alias("avg_flights"), count_rows().alias("count")))


def churn_by_tier(cdf: DataFrame) -> DataFrame:
    """Churned, total, rate per tier."""
    return (cdf.groupBy(F.col("loyalty_card").alias("tier"))
            .agg(F.sum("cancelled").alias("churned"), F.count("cancelled").alias("total"),
                 F.avg("cancelled").alias("churn_rate")))


def points_kpis(cdf: DataFrame) -> DataFrame:
    """Points accumulated, redeemed, redemption %, balance."""
    acc, red = F.sum("total_points"), F.sum("points_redeemed")
    return cdf.agg(acc.alias("total_points_acc"), red.alias("total_points_red"),
                   F.coalesce(safe_div(red * 100.0, F.nullif(acc, F.lit(0))), F.lit(0.0)).alias("redemption_pct"),
                   (acc - red).alias("points_balance"))


def points_by_tier(cdf: DataFrame) -> DataFrame:
    """E14."""
    return cdf.groupBy("loyalty_card").agg(F.sum("total_points").alias("accumulated"),
                                           F.sum("points_redeemed").alias("redeemed"))


def churn_tier_marital(cdf: DataFrame, statuses=("Divorced", "Married", "Single")) -> DataFrame:
    """Churn rate (%) tier x marital status, marital pivoted to columns."""
    return (cdf.groupBy("loyalty_card").pivot("marital_status", list(statuses))
            .agg((F.avg("cancelled") * 100.0).alias("churn_pct")))


def churn_by_enrollment(cdf: DataFrame) -> DataFrame:
    """E16."""
    return cdf.groupBy("enrollment_yr").agg(F.avg("cancelled").alias("churn_rate"))


def points_monthly_tier(df: DataFrame) -> DataFrame:
    """Monthly points accumulated and redeemed per tier."""
    return df.groupBy("date", "loyalty_card").agg(F.sum("points_accumulated").alias("points"),
                                                  F.sum("points_redeemed").alias("redeemed"))


def revenue_per_customer(cdf: DataFrame) -> DataFrame:
    """Revenue per customer by tier, plus overall average and the
    estimated redemption cost at $0.01 a point."""
    from ..functions.exprs import POINT_COST_DOLLARS
    tiers = tier_performance(cdf).select("tier", "customers", "total_revenue",
                                         (F.col("total_revenue") / F.col("customers")).alias("rev_per_customer"))
    overall = cdf.agg(esum("total_revenue").alias("total_rev"), eavg("total_revenue").alias("avg_rev_cust"),
                      (F.sum("points_redeemed") * POINT_COST_DOLLARS).alias("points_cost"))
    return tiers.select("*", *[overall.select(c).scalar().alias(c) for c in overall.columns])


def revenue_matrix(cdf: DataFrame, tiers=tuple(TIER_ORDER), top_n: int = 12) -> DataFrame:
    """Province x tier revenue, zero-filled, top-n provinces by total."""
    wide = (cdf.groupBy("province").pivot("loyalty_card", list(tiers)).agg(esum("total_revenue"))
            .fillna(0.0, list(tiers)))
    total = sum((F.col(t) for t in tiers), F.lit(0.0))
    return wide.withColumn("total", total).orderBy(F.desc("total"), "province").limit(top_n)


def enrollment_cohort(cdf: DataFrame) -> DataFrame:
    """E22."""
    return cdf.groupBy("enrollment_yr").agg(esum("total_revenue").alias("revenue"),
                                            count_rows().alias("customers"), eavg("clv").alias("avg_clv"))


def members_by_province(cdf: DataFrame, top_n: int = 12) -> DataFrame:
    """E23."""
    return (cdf.groupBy("province").agg(count_rows().alias("members"))
            .orderBy(F.desc("members"), "province").limit(top_n))


def income_tier(cdf: DataFrame) -> DataFrame:
    """Salary band x tier: count, avg CLV, avg flights."""
    return (cdf.groupBy("salary_group", "loyalty_card")
            .agg(count_rows().alias("count"), eavg("clv").alias("avg_clv"),
                 F.avg("total_flights").alias("avg_flights")))


def mean_by(df: DataFrame, key: str, value: str, exact_money: bool = True) -> DataFrame:
    """Mean of ``value`` per level of ``key``."""
    agg = eavg(value) if exact_money else F.avg(value)
    return df.groupBy(key).agg(agg.alias("mean"), count_rows().alias("rows"))


def category_counts(df: DataFrame, column: str) -> DataFrame:
    """``value_counts``: count per value, most frequent first (nulls dropped)."""
    return (df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value"))
            .agg(count_rows().alias("count")).orderBy(F.desc("count"), "value"))


def category_percent(df: DataFrame, column: str, top_n: int | None = None) -> DataFrame:
    """``value_counts(normalize=True) * 100`` rounded to 2."""
    from ..functions.exprs import rnd
    total = df.filter(F.col(column).isNotNull()).select(count_rows()).scalar()
    out = category_counts(df, column).withColumn("pct", rnd(F.col("count") * 100.0 / total, 2))
    return out.limit(top_n) if top_n else out


def churn_crosstab(df: DataFrame, row: str = "loyalty_card", col: str = "cancelled") -> DataFrame:
    """Row-normalised crosstab (percent, rounded 2)."""
    from ..functions.exprs import rnd
    cnt = df.groupBy(row).pivot(col, [0, 1]).count().fillna(0, ["0", "1"])
    tot = F.col("0") + F.col("1")
    return cnt.select(row, rnd(F.col("0") * 100.0 / tot, 2).alias("pct_active"),
                      rnd(F.col("1") * 100.0 / tot, 2).alias("pct_cancelled"))


def churn_rate_distinct(df: DataFrame) -> DataFrame:
    """Distinct members, distinct churned members, rate % (round 2)."""
    from ..functions.exprs import rnd
    total = F.count_distinct("member_id")
    churned = F.count_distinct(F.when(F.col("cancelled") == 1, F.col("member_id")))
    return df.agg(total.alias("total_customers"), churned.alias("churned"),
                  rnd(churned * 100.0 / total, 2).alias("churn_rate"))


def group_profile(df: DataFrame, key: str, flights: str, with_distance: bool = False,
                  order: list[str] | None = None) -> DataFrame:
    """Members, mean CLV, mean flights, cancellation rate (+ share)."""
    aggs = [count_rows().alias("members"), eavg("clv").alias("avg_clv"), F.avg(flights).alias("avg_flights")]
    if with_distance:
        aggs.append(F.avg("total_distance").alias("avg_distance"))
    aggs.append(F.avg("cancelled").alias("cancellation_rate"))
    out = df.groupBy(key).agg(*aggs)
    total = df.select(count_rows()).scalar()
    out = out.withColumn("member_pct", F.col("members") * 100.0 / total)
    if order:
        out = out.withColumn("order", order_rank(key, order))
    return out


def tier_comparison(cust: DataFrame) -> DataFrame:
    """Per tier incl. median CLV (exact, linear)."""
    from ..functions.ranking import exact_quantiles
    med = exact_quantiles(cust, "clv", [0.5], by=["loyalty_card"]).select("loyalty_card",
                                                                           F.col("q0").alias("median_clv"))
    return (cust.groupBy("loyalty_card")
            .agg(count_rows().alias("members"), eavg("clv").alias("avg_clv"), F.avg("total_flights").alias("avg_flights"),
                 F.avg("total_distance").alias("avg_distance"), F.avg("total_points").alias("avg_pts_acc"),
                 F.avg("points_redeemed").alias("avg_pts_red"), F.avg("cancelled").alias("cancellation_rate"))
            .join(med, "loyalty_card", "left"))


def cancel_profile(cust_flights: DataFrame, cols: list[str]) -> DataFrame:
    """Mean of each metric for active (0) and cancelled (1) members and
    the ratio active / cancelled (a zero denominator gives null)."""
    long = (cust_flights.select("cancelled", *[F.col(c).cast("double").alias(c) for c in cols])
            .unpivot(["cancelled"], cols, "metric", "value"))
    m = (long.groupBy("metric")
         .agg(eavg(F.when(F.col("cancelled") == 0, F.col("value"))).alias("active_mean"),
              eavg(F.when(F.col("cancelled") == 1, F.col("value"))).alias("cancelled_mean")))
    return m.withColumn("ratio", F.try_divide("active_mean", F.nullif(F.col("cancelled_mean"), F.lit(0.0))))


def monthly_seasonality(master: DataFrame) -> DataFrame:
    """E35 + C14 + F2: month series with period label, active rows (flights>0),
    distinct active members and month-on-month growth (round 2)."""
    from pyspark.sql import Window
    from ..functions.exprs import rnd
    m = (master.groupBy("year", "month")
         .agg(F.sum("total_flights").alias("total_flights"), F.sum("distance").alias("total_distance"),
              F.sum("points_accumulated").alias("total_pts_acc"), F.sum("points_redeemed").alias("total_pts_red"),
              F.count_if(F.col("total_flights") > 0).alias("active_customers"),
              F.count_distinct(F.when(F.col("total_flights") > 0, F.col("member_id"))).alias("active_members")))
    # one row per calendar month: a series of a few dozen rows, ordered window is bounded
    w = Window.orderBy("year", "month")
    growth = lambda c: rnd(F.try_divide((F.col(c) - F.lag(c).over(w)) * 100.0, F.lag(c).over(w)), 2)
    return (m.withColumn("period", F.date_format(F.make_date(F.col("year").cast("int"), F.col("month").cast("int"),
                                                              F.lit(1)), "MMM yyyy"))
            .withColumn("flight_growth_pct", growth("total_flights"))
            .withColumn("point_growth_pct", growth("total_pts_acc")))


def season_pivot(master: DataFrame, measure: str) -> DataFrame:
    """Year x month (1..12) sums, months as columns."""
    months = list(range(1, 13))
    return (master.groupBy("year").pivot("month", months).agg(F.sum(measure))
            .select("year", *[F.col(str(m)).alias(f"m{m:02d}") for m in months]))


def flights_province_tier(df: DataFrame, tiers=tuple(TIER_ORDER)) -> DataFrame:
    """Province x tier flights, zero-filled."""
    return (df.groupBy("province").pivot("loyalty_card", list(tiers)).agg(F.sum("total_flights"))
            .fillna(0, list(tiers)))


def disengagement_rates(cust_flights: DataFrame) -> DataFrame:
    """Never-flew share, never-redeemed share, mean flights by status."""
    return cust_flights.agg(
        F.avg((F.col("total_flights") == 0).cast("double")).alias("never_flew_share"),
        F.count_if(F.col("total_flights") == 0).alias("never_flew"),
        F.avg((F.col("redemption_rate") == 0).cast("double")).alias("never_redeemed_share"),
        F.avg(F.when(F.col("cancelled") == 1, F.col("total_flights"))).alias("cancelled_avg_flights"),
        F.avg(F.when(F.col("cancelled") == 0, F.col("total_flights"))).alias("active_avg_flights"),
        quantile_array(cust_flights, "total_flights", [0.5])[0].alias("median_flights"),
        F.avg("total_flights").alias("mean_flights"))


def dataset_snapshot(df: DataFrame) -> DataFrame:
    """Rows, members, provinces, first and last month, churn and redemption rates."""
    return df.agg(count_rows().alias("rows"), F.count_distinct("member_id").alias("members"),
                  F.count_distinct("province").alias("provinces"), F.min("date").alias("first_month"),
                  F.max("date").alias("last_month"),
                  F.avg("cancelled").alias("churn_rate"), eavg("redemption_rate").alias("avg_redemption_rate"))
