"""Feature engineering (H1-H9, H16) and the prose-specified member features
(X1-X7).

All row features are column expressions; the global min / max / quantiles
they need are scalar subqueries; frequency encodings are a grouped count
joined back on the category (AQE broadcasts it when small).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import quantile_array
from ..functions.exprs import (CLV_ROW_QUARTILES, PREMIUM_CARDS, clip, flight_segment, month_index,
                               quantile_label, rnd, tier_number)

# Fixed level lists of the one-hot columns (first level is the dropped one:
# alphabetical for text, label order for the CLV quartile).
ONE_HOT_LEVELS = {
    "gender": ["Female", "Male"],
    "education": ["Bachelor", "College", "Doctor", "High School or Below", "Master"],
    "marital_status": ["Divorced", "Married", "Single"],
    "loyalty_card": ["Aurora", "Nova", "Star"],
    "flight_segment": ["High", "Low", "Medium"],
    "clv_segment": ["Low", "Medium", "High", "VIP"],
}
SCALED = ["total_flights", "distance", "redemption_ratio"]


def row_features(master: DataFrame) -> DataFrame:
    """H1-H5, G10, G3 (row grain): tenure, membership age, ratios with +1
    denominators, premium flag, flight segment (rule), CLV quartile label."""
    y, m = F.col("year").cast("bigint"), F.col("month").cast("bigint")
    df = (master
          .withColumn("tenure", clip(y - F.col("enrollment_year"), lower=0))
          .withColumn("membership_age_months",
                      clip((y * 12 + m) - (F.col("enrollment_year") * 12 + F.col("enrollment_month")), lower=0))
          .withColumn("redemption_ratio", F.col("points_redeemed") / (F.col("points_accumulated") + 1))
          .withColumn("avg_distance_per_flight", F.col("distance") / (F.col("total_flights") + 1))
          .withColumn("points_per_flight", F.col("points_accumulated") / (F.col("total_flights") + 1))
          .withColumn("redeemed_cost_per_point",
                      F.col("dollar_cost_points_redeemed") / (F.col("points_redeemed") + 1))
          .withColumn("premium_customer", F.col("loyalty_card").isin(PREMIUM_CARDS).cast("bigint"))
          .withColumn("flight_segment", flight_segment("total_flights")))
    edges = quantile_array(df, "clv", [0.25, 0.5, 0.75])
    return df.withColumn("clv_segment", quantile_label("clv", edges, CLV_ROW_QUARTILES))


def minmax_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """H6: scikit-learn ``MinMaxScaler`` arithmetic: x * (1/range) - min/range,
    a zero range counting as 1; the columns are overwritten (quirk 4)."""
    # one aggregate row read once; its values enter the plan as literals
    row = df.agg(*[F.min(F.col(c).cast("double")).alias(f"mn_{c}") for c in columns],
                 *[F.max(F.col(c).cast("double")).alias(f"mx_{c}") for c in columns]).first()
    out = df
    for c in columns:
        mn, mx = row[f"mn_{c}"], row[f"mx_{c}"]
        scale = 1.0 / ((mx - mn) or 1.0)
        out = out.withColumn(c, F.col(c).cast("double") * F.lit(scale) + F.lit(-mn * scale))
    return out


def scaled_features(rows: DataFrame) -> DataFrame:
    """H6-H7: scale, then the composite scores on the scaled columns."""
    s = minmax_scale(rows, SCALED)
    return (s.withColumn("engagement_score",
                         0.4 * F.col("total_flights") + 0.3 * F.col("distance") + 0.3 * F.col("redemption_ratio"))
            .withColumn("travel_intensity", F.col("distance") / (F.col("tenure") + 1))
            .withColumn("reward_dependency", F.col("points_redeemed") / (F.col("clv") + 1))
            .withColumn("loyalty_efficiency", F.col("clv") / (F.col("total_flights") + 1)))


def frequency_encode(df: DataFrame, columns: list[str]) -> DataFrame:
    """H8: value share of each category over all rows, joined back."""
    total = df.select(F.count(F.lit(1))).scalar()
    out = df
    for c in columns:
        freq = (df.groupBy(c).agg((F.count(F.lit(1)) / total).alias(f"{c}_fe")))
        out = out.join(freq, out[c].eqNullSafe(freq[c]), "left").drop(freq[c])
    return out


def dummy_name(col: str, level: str) -> str:
    return f"{col}_{level}".replace(" ", "_")


def one_hot_drop_first(df: DataFrame, levels: dict[str, list[str]] = ONE_HOT_LEVELS) -> DataFrame:
    """H9: ``get_dummies(drop_first=True)`` as 0/1 columns; source columns dropped."""
    out = df
    for c, lv in levels.items():
        for v in lv[1:]:
            out = out.withColumn(dummy_name(c, v), (F.col(c) == v).cast("bigint"))
        out = out.drop(c)
    return out


def feature_table(master: DataFrame) -> DataFrame:
    """The full engineered member-month table (member_id carried along)."""
    return one_hot_drop_first(frequency_encode(scaled_features(row_features(master)),
                                               ["city", "province", "country"]))


def loyalty_score(df: DataFrame) -> DataFrame:
    """Mean of four min-max columns x 100, round 2 (zero range -> 1)."""
    cols = ["total_flights", "distance", "points_accumulated", "clv"]
    agg = df.agg(*[F.min(F.col(c).cast("double")).alias(f"mn_{c}") for c in cols],
                 *[F.max(F.col(c).cast("double")).alias(f"mx_{c}") for c in cols])
    parts = []
    for c in cols:
        mn, mx = agg.select(f"mn_{c}").scalar(), agg.select(f"mx_{c}").scalar()
        rng = F.when((mx - mn) == 0, F.lit(1.0)).otherwise(mx - mn)
        parts.append((F.col(c).cast("double") - mn) / rng)
    return df.withColumn("loyalty_score", rnd((parts[0] + parts[1] + parts[2] + parts[3]) / 4 * 100, 2))


# ---------------------------------------------------------------------------
# Member features defined in prose
# ---------------------------------------------------------------------------

def rfm(master: DataFrame) -> DataFrame:
    """Recency (months from the last month with flights to the latest
    month in the data), frequency (flights per month, active-month ratio) and
    monetary (CLV + dollars redeemed)."""
    idx = month_index()
    ref = master.select(F.max(idx)).scalar()
    g = (master.groupBy("member_id")
         .agg(F.max(F.when(F.col("total_flights") > 0, idx)).alias("last_active_idx"),
              F.sum("total_flights").alias("total_flights"), F.count(F.lit(1)).alias("months"),
              F.count_if(F.col("total_flights") > 0).alias("active_months"),
              F.first("clv", ignorenulls=True).alias("clv"),
              F.sum(F.col("dollar_cost_points_redeemed").cast("decimal(38,2)")).cast("double").alias("dollars"),
              F.first("loyalty_card", ignorenulls=True).alias("loyalty_card")))
    return g.select("member_id", (ref - F.col("last_active_idx")).alias("recency_months"),
                    (F.col("total_flights") / F.col("months")).alias("flights_per_month"),
                    (F.col("active_months") / F.col("months")).alias("active_ratio"),
                    (F.col("clv") + F.col("dollars")).alias("monetary"), "clv", "loyalty_card")


def activity_growth(master: DataFrame, months: int = 6) -> DataFrame:
    """(flights in the last 6 months - first 6 months) / first 6 months,
    over the observation window; null when the first window had none."""
    idx = month_index()
    b = master.agg(F.min(idx).alias("lo"), F.max(idx).alias("hi"))
    lo, hi = b.select("lo").scalar(), b.select("hi").scalar()
    g = (master.groupBy("member_id")
         .agg(F.sum(F.when(idx < lo + months, F.col("total_flights")).otherwise(0)).alias("first_flights"),
              F.sum(F.when(idx > hi - months, F.col("total_flights")).otherwise(0)).alias("last_flights")))
    return g.withColumn("activity_growth",
                        F.try_divide((F.col("last_flights") - F.col("first_flights")).cast("double"),
                                     F.nullif(F.col("first_flights"), F.lit(0))))


def rolling_activity(master: DataFrame, months: int = 3) -> DataFrame:
    """Flights over the member's last 3 calendar months at each row
    (range window on the month index, per member)."""
    idx = month_index()
    w = Window.partitionBy("member_id").orderBy(idx).rangeBetween(-(months - 1), 0)
    return master.select("member_id", "year", "month", "total_flights",
                         F.sum("total_flights").over(w).alias("rolling_3m_flights"))


def seasonal_ratio(master: DataFrame, summer=(6, 7, 8)) -> DataFrame:
    """Summer flights / all flights per member (null when no flights)."""
    g = (master.groupBy("member_id")
         .agg(F.sum(F.when(F.col("month").isin(list(summer)), F.col("total_flights")).otherwise(0))
              .alias("summer_flights"), F.sum("total_flights").alias("total_flights")))
    return g.withColumn("seasonal_ratio",
                        F.try_divide(F.col("summer_flights").cast("double"), F.nullif(F.col("total_flights"),
                                                                                       F.lit(0))))


def interaction_features(master: DataFrame) -> DataFrame:
    """CLV x recency, tier number x frequency, points-hoarding flag
    (accumulated above the member median and nothing redeemed)."""
    r = rfm(master)
    pts = master.groupBy("member_id").agg(F.sum("points_accumulated").alias("acc"),
                                          F.sum("points_redeemed").alias("red"))
    med = quantile_array(pts, "acc", [0.5])[0]
    return (r.join(pts, "member_id")
            .select("member_id", (F.col("clv") * F.col("recency_months")).alias("clv_x_recency"),
                    (tier_number("loyalty_card") * F.col("flights_per_month")).alias("card_x_frequency"),
                    ((F.col("acc") > med) & (F.col("red") == 0)).cast("bigint").alias("hoarding_flag")))
