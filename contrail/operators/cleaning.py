"""Cleaning, member-month rollup, the master join and the enriched fact.

Plan shape at scale (checked with ``explain``):

* ``dedup_activity`` + ``monthly_activity``: the full-row dedup hashes on every
  column, so even a member-month holding a third of all raw rows is spread
  over many reducers; the monthly sum then combines map-side and its shuffle
  carries at most one row per member-month per task.
* ``build_master``: fact (member-month) left join member dimension on
  ``member_id``.  No hint: AQE broadcasts the dimension only when its measured
  size is under ``spark.sql.adaptive.autoBroadcastJoinThreshold``, otherwise
  both sides are hash-partitioned on ``member_id`` (sort-merge join) and the
  later per-member rollups reuse that partitioning.
* ``load_clean``: one projection; the only global value (max points) is a
  scalar subquery, computed once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import rnd, clip, salary_band, title_strip

MEASURES = ["total_flights", "distance", "points_accumulated", "points_redeemed",
            "dollar_cost_points_redeemed"]
ACTIVITY_KEY = ["member_id", "year", "month"]
MEMBER_FINAL_COLUMNS = ["member_id", "country", "province", "city", "gender", "education", "salary",
                        "salary_college", "marital_status", "loyalty_card", "clv", "enrollment_year",
                        "enrollment_month", "cancelled"]
STRING_COLUMNS = ["country", "province", "city", "education", "marital_status", "loyalty_card"]


def missing_salary_flag(df: DataFrame) -> DataFrame:
    """1 when salary is missing (any education, see quirk 1)."""
    return df.withColumn("salary_college", F.col("salary").isNull().cast("bigint"))


def churn_label(df: DataFrame) -> DataFrame:
    """C4: cancelled = both cancellation fields present."""
    return df.withColumn("cancelled", (F.col("cancellation_year").isNotNull()
                                       & F.col("cancellation_month").isNotNull()).cast("bigint"))


def clean_members(members_raw: DataFrame) -> DataFrame:
    """C1-C6 on the member feed.

    * salary_college flags every null salary;
    * College nulls set to 0 and every 0 turned back to null: net effect
      ``nullif(salary, 0)``;
    * negative salaries have their sign flipped (not removed);
    * gender title-cased then stripped, all other strings stripped.
    """
    df = missing_salary_flag(members_raw)
    salary = F.when((F.col("education") == "College") & F.col("salary").isNull(), F.lit(0.0)) \
        .otherwise(F.col("salary"))
    salary = F.nullif(salary, F.lit(0.0))
    salary = F.when(salary < 0, -salary).otherwise(salary)
    df = churn_label(df.withColumn("salary", salary))
    df = df.withColumn("gender", title_strip("gender"))
    for c in STRING_COLUMNS:
        df = df.withColumn(c, F.trim(F.col(c)))
    return df


def members_final(members_clean: DataFrame) -> DataFrame:
    """The 14 member columns kept for the master table."""
    return members_clean.select(*MEMBER_FINAL_COLUMNS)


def dedup_activity(activity_raw: DataFrame) -> DataFrame:
    """Drop exact duplicate rows."""
    return activity_raw.dropDuplicates()


def monthly_activity(activity: DataFrame) -> DataFrame:
    """One row per (member, year, month), the five measures summed.

    Dollar cost is summed as decimal (cents are exact)."""
    return (activity.groupBy(*ACTIVITY_KEY)
            .agg(F.sum("total_flights").alias("total_flights"),
                 F.sum("distance").alias("distance"),
                 F.sum("points_accumulated").alias("points_accumulated"),
                 F.sum("points_redeemed").alias("points_redeemed"),
                 F.sum(F.col("dollar_cost_points_redeemed").cast("decimal(18,2)")).cast("double")
                 .alias("dollar_cost_points_redeemed")))


def typed_activity(monthly: DataFrame) -> DataFrame:
    """Narrow year to smallint and month to tinyint."""
    return monthly.select("member_id", F.col("year").cast("smallint").alias("year"),
                          F.col("month").cast("tinyint").alias("month"), *MEASURES)


def build_master(activity_final: DataFrame, members: DataFrame) -> DataFrame:
    """C7 + D1: member-month fact left-joined to the member dimension.

    Salary nulls become 0 before the join (quirk 3)."""
    dim = members.withColumn("salary", F.coalesce(F.col("salary"), F.lit(0.0)))
    return activity_final.join(dim, "member_id", "left")


def coerce_numeric(df: DataFrame, columns) -> DataFrame:
    """C11: numbers stored as text become numbers, bad text becomes null."""
    out = df
    for c in columns:
        out = out.withColumn(c, F.col(c).cast("string").try_cast("double"))
    return out


def load_clean(master: DataFrame, assume_unique_rows: bool = True) -> DataFrame:
    """Enriched member-month fact (the dashboard's working table).

    C8 dedup, C12 drop rows without CLV / member / salary, C13 month-start
    date, H10 revenue and points balance, H11 redemption rate, H12 flight
    frequency index and engagement score, H13 loyalty efficiency, enrollment
    duration, G1 salary band, C15 status.

    ``assume_unique_rows``: the master's (member, year, month) key is unique by
    construction (E1 rollup joined to a keyed dimension), so the full-row
    dedup is a no-op; skip that shuffle unless the input may repeat rows.
    """
    df = master if assume_unique_rows else master.dropDuplicates()
    df = df.dropna(subset=["clv", "member_id"]).dropna(subset=["salary", "clv"])
    acc, red = F.col("points_accumulated"), F.col("points_redeemed")
    max_acc = df.select(F.max("points_accumulated")).scalar()
    rr = clip(F.when(acc > 0, red / acc).otherwise(F.lit(0.0)), 0.0, 1.0)
    ffi = F.log1p(F.col("total_flights").cast("double"))
    max_or_one = F.coalesce(F.nullif(max_acc, F.lit(0)), F.lit(1)).cast("double")
    duration = ((F.col("year") - F.col("enrollment_year")) * 12
                + (F.col("month") - F.col("enrollment_month"))).cast("bigint")
    return (df
            .withColumn("date", F.make_date(F.col("year").cast("int"), F.col("month").cast("int"), F.lit(1)))
            .withColumn("revenue", F.col("clv") / 12 + F.col("dollar_cost_points_redeemed"))
            .withColumn("points_balance", acc - red)
            .withColumn("redemption_rate", rr)
            .withColumn("flight_frequency_index", ffi)
            .withColumn("engagement_score",
                        rnd(0.4 * ffi + 0.3 * (F.col("redemption_rate") * 10)
                                + 0.3 * (acc / max_or_one * 10), 2))
            .withColumn("loyalty_efficiency_score",
                        rnd(acc / F.coalesce(F.nullif(F.col("distance"), F.lit(0)), F.lit(1)).cast("double"), 4))
            .withColumn("enrollment_duration", clip(duration, lower=0))
            .withColumn("salary_group", salary_band("salary"))
            .withColumn("status", F.when(F.col("cancelled") == 1, "Cancelled").otherwise("Active")))
