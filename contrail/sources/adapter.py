"""Member and activity feeds derived from the order tables.

The loyalty programme has two raw feeds: one row per member (profile, CLV,
enrollment and cancellation dates) and several activity rows per member-month
(flights, distance, points).  The test tables carry neither, so both are
derived from customer/orders/lineitem by a fixed mapping:

* member  = customer, country = region name, province = nation name,
  CLV = order value / 100, enrollment = first order, cancellation = last order
  before the cut-off date;
* activity = one row per order: flights = lines, distance = quantity x 10,
  points = price / 100, redeemed = twice the points of returned, finished
  lines.  Every 50th member's rows are repeated to give exact duplicates.

The mapping also plants padded / mixed-case gender, null and negative
salaries, so the cleaning rules have something to do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table

# Fixed values of the mapping.
CANCEL_CUTOFF = "2000-07-01 00:00:00"
SEGMENT_TO_EDUCATION = {
    "AUTOMOBILE": "High School or Below",
    "BUILDING": "College",
    "FURNITURE": "Bachelor",
    "HOUSEHOLD": "Master",
}
OTHER_EDUCATION = "Doctor"
AURORA_MIN_BALANCE = 7500
NOVA_MIN_BALANCE = 4000
DUPLICATE_EVERY = 50


def _order_rollup(orders: DataFrame) -> DataFrame:
    return (orders.groupBy("o_custkey")
            .agg((F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / 100).alias("clv"),
                 F.min("o_orderdate").alias("first_dt"),
                 F.max("o_orderdate").alias("last_dt")))


def members_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = read_table(spark, sf_dir, "customer")
    # nation and region are fixed code lists (25 and 5 rows): safe to broadcast.
    nation = F.broadcast(read_table(spark, sf_dir, "nation"))
    region = F.broadcast(read_table(spark, sf_dir, "region"))
    ords = _order_rollup(read_table(spark, sf_dir, "orders"))

    seg = F.col("c_mktsegment")
    education = None
    for k, v in SEGMENT_TO_EDUCATION.items():
        education = F.when(seg == k, v) if education is None else education.when(seg == k, v)
    education = education.otherwise(OTHER_EDUCATION)

    key = F.col("c_custkey")
    cutoff = F.lit(CANCEL_CUTOFF).cast("timestamp_ntz")
    cancelled = F.col("last_dt") < cutoff
    return (customer
            .join(nation, customer.c_nationkey == nation.n_nationkey)
            .join(region, F.col("n_regionkey") == region.r_regionkey)
            .join(ords, ords.o_custkey == key, "left")
            .select(
                key.alias("member_id"),
                F.col("r_name").alias("country"),
                F.col("n_name").alias("province"),
                F.concat(F.col("n_name"), F.lit("_C"), (key % 3).cast("string")).alias("city"),
                F.when(key % 2 == 0, " female").otherwise("MALE ").alias("gender"),
                education.alias("education"),
                F.when(seg == "BUILDING", F.lit(None).cast("double"))
                 .otherwise((F.col("c_acctbal").cast("decimal(18,2)") * 12).cast("double")).alias("salary"),
                F.when(key % 3 == 0, "Married").when(key % 3 == 1, "Single").otherwise("Divorced")
                 .alias("marital_status"),
                F.when(F.col("c_acctbal") >= AURORA_MIN_BALANCE, "Aurora")
                 .when(F.col("c_acctbal") >= NOVA_MIN_BALANCE, "Nova").otherwise("Star").alias("loyalty_card"),
                F.col("clv"),
                (F.year("first_dt") + F.when(key % 4 == 0, 1).otherwise(0)).cast("bigint").alias("enrollment_year"),
                F.month("first_dt").cast("bigint").alias("enrollment_month"),
                F.when(cancelled, F.year("last_dt")).cast("bigint").alias("cancellation_year"),
                F.when(cancelled, F.month("last_dt")).cast("bigint").alias("cancellation_month"),
            ))


def activity_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lineitem = read_table(spark, sf_dir, "lineitem")
    points = F.floor(F.col("l_extendedprice") / 100).cast("bigint")
    redeemed = F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), 2 * points).otherwise(0)
    lines = (lineitem.groupBy("l_orderkey")
             .agg(F.count(F.lit(1)).alias("n"),
                  (F.sum("l_quantity") * 10).cast("bigint").alias("dist"),
                  F.sum(points).alias("acc"),
                  F.sum(redeemed).alias("red")))
    act = (orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left")
           .select(F.col("o_custkey").alias("member_id"),
                   F.year("o_orderdate").alias("year"),
                   F.month("o_orderdate").alias("month"),
                   F.coalesce("n", F.lit(0)).cast("bigint").alias("total_flights"),
                   F.coalesce("dist", F.lit(0)).cast("bigint").alias("distance"),
                   F.coalesce("acc", F.lit(0)).cast("bigint").alias("points_accumulated"),
                   F.coalesce("red", F.lit(0)).cast("bigint").alias("points_redeemed"),
                   (F.coalesce("red", F.lit(0)).cast("double") / 100).alias("dollar_cost_points_redeemed")))
    # one pass over the facts: a repeated member's rows come twice
    twice = F.when(F.col("member_id") % DUPLICATE_EVERY == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return act.withColumn("_copy", F.explode(twice)).drop("_copy")
