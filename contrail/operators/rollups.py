"""Per-member rollups of the enriched member-month fact.

All are one ``groupBy("member_id")``: partial aggregation runs map-side, so a
member with many months costs one row per task in the shuffle.  When the
master join was a sort-merge join the fact is already hash-partitioned on
``member_id`` and the rollup adds no exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import quantile_array
from ..functions.exprs import rnd, CLV_MEMBER_QUARTILES, clip, money_avg, money_sum, quantile_label, tier_number

ATTRIBUTES = {
    "gender": "gender", "education": "education", "province": "province", "city": "city",
    "loyalty_card": "loyalty_card", "marital_status": "marital_status", "salary_group": "salary_group",
    "enrollment_yr": "enrollment_year",
}


def customer_rollup(activity: DataFrame) -> DataFrame:
    """E2 ``get_customer_df`` part 1: one ``groupBy(member_id)`` with sums,
    means, attributes and maxima, plus the per-member ratios (H14).

    Attributes are functionally dependent on ``member_id`` (they come from the
    member dimension), so ``first`` is deterministic in value.
    """
    grp = (activity.groupBy("member_id")
           .agg(F.sum("total_flights").alias("total_flights"),
                F.sum("distance").alias("total_distance"),
                F.sum("points_accumulated").alias("total_points"),
                F.sum("points_redeemed").alias("points_redeemed"),
                money_sum("revenue", 10).alias("total_revenue"),
                money_avg("clv", 4).alias("clv"),
                money_avg("salary", 2).alias("salary"),
                money_avg("engagement_score", 2).alias("engagement"),
                money_avg("loyalty_efficiency_score", 4).alias("efficiency"),
                *[F.first(src, ignorenulls=True).alias(dst) for dst, src in ATTRIBUTES.items()],
                F.max("cancelled").alias("cancelled"),
                F.max("enrollment_duration").alias("months_active")))
    flights_or_one = F.when(F.col("total_flights") == 0, F.lit(1)).otherwise(F.col("total_flights"))
    points_or_one = F.when(F.col("total_points") == 0, F.lit(1)).otherwise(F.col("total_points"))
    return (grp
            .withColumn("revenue_per_customer", F.col("total_revenue") / flights_or_one)
            .withColumn("redemption_rate", clip(F.col("points_redeemed") / points_or_one, 0.0, 1.0)))


def customer_scores(grp: DataFrame) -> DataFrame:
    """E2 part 2: the churn risk score (H15, global max of flights) and the
    CLV quartile label (G3).  Works on the member-level rollup, so its global
    statistics read the small table, not the fact."""
    max_flights = grp.select(F.max("total_flights")).scalar()
    risk = ((1 - F.col("redemption_rate")) * 0.4
            + (1 - F.try_divide(F.col("total_flights").cast("double"), max_flights)) * 0.35
            + F.col("cancelled") * 0.25)
    grp = grp.withColumn("churn_risk_score", rnd(clip(risk, 0.0, 1.0), 4))
    edges = quantile_array(grp, "clv", [0.25, 0.5, 0.75])
    return grp.withColumn("clv_segment", quantile_label("clv", edges, CLV_MEMBER_QUARTILES))


def customer_summary(activity: DataFrame) -> DataFrame:
    """E2, H14, H15, G3 in one lazy chain."""
    return customer_scores(customer_rollup(activity))


def customer_flights(activity: DataFrame, members: DataFrame) -> DataFrame:
    """E3 + D3 + D5: member totals, months with flights, redemption rate,
    inner-joined to the member profile (card, CLV, cancelled)."""
    tot = (activity.groupBy("member_id")
           .agg(F.sum("total_flights").alias("total_flights"),
                F.sum("distance").alias("total_distance"),
                F.sum("points_accumulated").alias("total_points"),
                F.sum("points_redeemed").alias("points_redeemed"),
                F.count_if(F.col("total_flights") > 0).alias("active_months")))
    prof = members.select("member_id", "loyalty_card", "clv", "cancelled")
    return (tot.join(prof, "member_id", "inner")
            .withColumn("redemption_rate",
                        clip(F.when(F.col("total_points") > 0,
                                    F.col("points_redeemed") / F.col("total_points")).otherwise(F.lit(0.0)),
                             0.0, 1.0)))


def customer_flights_distinct(master: DataFrame) -> DataFrame:
    """E4 + D4: member totals where 'active months' = distinct month numbers
    (max 12) whatever the activity (quirk 7), left-joined to the distinct
    profile rows; redemption rate 0 when nothing was accumulated; tier number."""
    tot = (master.groupBy("member_id")
           .agg(F.sum("total_flights").alias("total_flights"),
                F.sum("distance").alias("total_distance"),
                F.sum("points_accumulated").alias("total_points"),
                F.sum("points_redeemed").alias("points_redeemed"),
                F.first("clv", ignorenulls=True).alias("clv"),
                F.first("cancelled", ignorenulls=True).alias("cancelled"),
                F.count_distinct("month").alias("active_months")))
    profile = master.select("member_id", "salary", "loyalty_card", "education", "gender",
                            "marital_status").dropDuplicates()
    acc = F.col("total_points")
    return (tot.join(profile, "member_id", "left")
            .withColumn("redemption_rate",
                        F.when(acc == 0, F.lit(0.0)).otherwise(F.col("points_redeemed") / acc))
            .withColumn("card_num", tier_number("loyalty_card")))
