"""Queries over the base layers: scans, cleaning, rollup, master, enriched fact,
member summary, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning
from ..sources import files
from .oracle_base import query
from .registry import register

MEMBER_RAW_COLS = ("member_id, country, province, city, gender, education, salary, marital_status, "
                   "loyalty_card, clv, enrollment_year, enrollment_month, cancellation_year, cancellation_month")


@register("scan_members", query("SELECT * FROM members_raw"), doubles="salary clv")
def scan_members(L):
    """A1: member feed as scanned (before cleaning)."""
    return L.members_raw


@register("scan_activity", query("SELECT * FROM activity_raw"), doubles="dollar_cost_points_redeemed")
def scan_activity(L):
    """A1: activity feed as scanned (duplicates included)."""
    return L.activity_raw


@register("clean_members", query("SELECT * FROM members_clean"), doubles="salary clv")
def clean_members(L):
    """Missing-salary flag, 0 -> null, sign flip, churn label, trims."""
    return L.members_clean


@register("churn_label", query(
    "SELECT cancelled, CAST(count(*) AS BIGINT) AS members FROM members_clean GROUP BY cancelled"))
def churn_label(L):
    """C4: members per churn label."""
    return L.members_clean.groupBy("cancelled").agg(F.count(F.lit(1)).alias("members"))


@register("dedup_activity", query("SELECT * FROM activity_dedup"), doubles="dollar_cost_points_redeemed")
def dedup_activity(L):
    """Exact duplicate rows removed."""
    return L.activity_dedup


@register("monthly_activity", query("SELECT * FROM activity_monthly"), doubles="dollar_cost_points_redeemed")
def monthly_activity(L):
    """Member-month sums of the five measures."""
    return L.activity_monthly


@register("typed_activity", query("SELECT * FROM activity_final"), doubles="dollar_cost_points_redeemed")
def typed_activity(L):
    """Year smallint, month tinyint."""
    return L.activity_final


@register("build_master", query("SELECT * FROM master"), doubles="dollar_cost_points_redeemed salary clv")
def build_master(L):
    """C7 + C9 + D1: master member-month table."""
    return L.master


@register("load_clean", query("SELECT * FROM activity"),
          doubles="dollar_cost_points_redeemed salary clv revenue redemption_rate flight_frequency_index "
                  "engagement_score loyalty_efficiency_score")
def load_clean(L):
    """The enriched member-month fact."""
    return L.activity


@register("customer_summary", query("SELECT * FROM customers"),
          doubles="total_revenue clv salary engagement efficiency revenue_per_customer redemption_rate "
                  "churn_risk_score")
def customer_summary(L):
    """One row per member."""
    return L.customers


@register("customer_flights", query("SELECT * FROM cust_flights"), doubles="clv redemption_rate")
def customer_flights(L):
    """E3 + D3 + D5: member totals, months with flights, profile."""
    return L.customer_flights


@register("customer_flights_distinct", query("""
SELECT t.*, p.salary, p.loyalty_card, p.education, p.gender, p.marital_status,
  CASE WHEN t.total_points = 0 THEN 0.0 ELSE t.points_redeemed / t.total_points END AS redemption_rate,
  CASE p.loyalty_card WHEN 'Star' THEN 1 WHEN 'Nova' THEN 2 WHEN 'Aurora' THEN 3 END AS card_num
FROM (SELECT member_id, CAST(sum(total_flights) AS BIGINT) AS total_flights,
        CAST(sum(distance) AS BIGINT) AS total_distance, CAST(sum(points_accumulated) AS BIGINT) AS total_points,
        CAST(sum(points_redeemed) AS BIGINT) AS points_redeemed, first(clv) AS clv,
        first(cancelled) AS cancelled, CAST(count(DISTINCT month) AS BIGINT) AS active_months
      FROM master GROUP BY member_id) t
LEFT JOIN (SELECT DISTINCT member_id, salary, loyalty_card, education, gender, marital_status FROM master) p
  ON p.member_id = t.member_id"""), doubles="clv salary redemption_rate")
def customer_flights_distinct(L):
    """E4 + D4: distinct-month variant with profile and tier number."""
    return L.customer_flights_distinct


@register("coerce_numeric", query("""
SELECT member_id, TRY_CAST(CAST(salary AS VARCHAR) AS DOUBLE) AS salary,
  TRY_CAST(CAST(clv AS VARCHAR) AS DOUBLE) AS clv,
  TRY_CAST(CAST(points_accumulated AS VARCHAR) AS DOUBLE) AS points_accumulated,
  TRY_CAST(city AS DOUBLE) AS city
FROM master"""), doubles="salary clv points_accumulated city")
def coerce_numeric(L):
    """C11: text to number, unparsable text to null (numbers stored as text
    parse; the city names do not and become null)."""
    df = L.master.select("member_id", F.col("salary").cast("string").alias("salary"),
                         F.col("clv").cast("string").alias("clv"),
                         F.col("points_accumulated").cast("string").alias("points_accumulated"), "city")
    return cleaning.coerce_numeric(df, ["salary", "clv", "points_accumulated", "city"])


@register("load_clean_counts", query("""
SELECT CAST(count(*) AS BIGINT) AS master_rows,
  CAST((SELECT count(*) FROM activity) AS BIGINT) AS kept_rows,
  CAST(count(DISTINCT member_id) AS BIGINT) AS members
FROM master"""))
def load_clean_counts(L):
    """Rows before and after the null drops."""
    kept = L.activity.select(F.count(F.lit(1))).scalar()
    return L.master.agg(F.count(F.lit(1)).alias("master_rows"), kept.alias("kept_rows"),
                        F.count_distinct("member_id").alias("members"))


@register("sink_roundtrip", query(f"SELECT {MEMBER_RAW_COLS} FROM members_raw"), doubles="salary clv")
def sink_roundtrip(L):
    """A1 + A2: member feed written as CSV to the shared folder and scanned
    back with the declared schema."""
    path = files.scratch_dir(L.spark, "members_csv")
    files.write_csv(L.members_raw, path)
    return files.read_members_csv(L.spark, path)
