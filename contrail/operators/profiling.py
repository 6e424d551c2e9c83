"""Profiling and data-quality operators.

Per-column checks run as ONE aggregation over the table (one scan, partial
aggregation map-side) and are then turned into rows with ``unpivot``; nothing
loops over columns with separate jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from ..functions.exprs import rnd
from ..functions.ranking import exact_quantiles, quantile_array


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in exclude]


def string_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType) and f.name not in exclude]


def shape(df: DataFrame, name: str) -> DataFrame:
    """B1: (table, rows, columns)."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(name).alias("table"), "rows", F.lit(len(df.columns)).cast("bigint").alias("columns"))


def preview(df: DataFrame, order_by: list[str], n: int = 10) -> DataFrame:
    """B2: ``head(n)`` with the order made explicit (top-n sort, no full sort)."""
    return df.orderBy(*order_by).limit(n)


def _unpivot_one_row(agg: DataFrame, names: list[str], value: str) -> DataFrame:
    return agg.unpivot([], names, "column", value)


def null_counts(df: DataFrame) -> DataFrame:
    """Nulls per column, one pass."""
    agg = df.agg(*[F.sum(F.col(c).isNull().cast("bigint")).alias(c) for c in df.columns])
    return _unpivot_one_row(agg, df.columns, "nulls")


def null_percent(df: DataFrame, digits: int = 2) -> DataFrame:
    """Nulls and percent of rows per column, highest first."""
    total = df.select(F.count(F.lit(1))).scalar()
    return (null_counts(df)
            .withColumn("null_pct", rnd(F.col("nulls") * 100.0 / total, digits))
            .orderBy(F.desc("null_pct"), "column"))


def schema_info(df: DataFrame) -> DataFrame:
    """B3 (+A5): ``info()``: column, type, non-null count and dictionary text."""
    agg = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
    types = F.create_map(*[x for f in df.schema.fields for x in (F.lit(f.name), F.lit(f.dataType.simpleString()))])
    docs = F.create_map(*[x for f in df.schema.fields
                          for x in (F.lit(f.name), F.lit((f.metadata or {}).get("comment", "")))])
    return (_unpivot_one_row(agg, df.columns, "non_null")
            .withColumn("dtype", types[F.col("column")])
            .withColumn("description", docs[F.col("column")]))


def duplicate_key_count(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows repeating an earlier row's key (all columns when no key).

    rows - groups; null keys form a group of their own, as in pandas."""
    keys = keys or df.columns
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg((F.sum("n") - F.count(F.lit(1))).cast("bigint").alias("duplicates"))


def duplicate_key_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Every row whose key occurs more than once (``keep=False``), sorted.

    Key counts come from a map-side-combined aggregate; the rows are then
    picked with a left-semi join (AQE splits a skewed key on the left side),
    not a window that would put a hot key's rows into one task."""
    dup_keys = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
                .filter(F.col("n") > 1).drop("n"))
    return df.join(dup_keys, keys, "left_semi").orderBy(*keys)


def nulls_by_group(df: DataFrame, column: str, group: str) -> DataFrame:
    """Nulls of one column per group value."""
    return (df.groupBy(group)
            .agg(F.sum(F.col(column).isNull().cast("bigint")).alias("nulls"),
                 F.count(F.lit(1)).alias("rows")))


def crosstab_null(df: DataFrame, group: str, column: str) -> DataFrame:
    """Group x (value present, value missing) counts, zero-filled."""
    return (df.withColumn("_isnull", F.col(column).isNull())
            .groupBy(group).pivot("_isnull", [False, True]).count()
            .withColumnRenamed("false", "not_null").withColumnRenamed("true", "is_null")
            .fillna(0, ["not_null", "is_null"]))


def describe_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, sample std, min, quartiles (linear), max per column.

    Long format (column, value) so one grouped aggregate covers all columns."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]) \
        .unpivot([], columns, "column", "value")
    m = (long.groupBy("column")
         .agg(F.count("value").alias("count"), F.avg("value").alias("mean"),
              F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max")))
    q = exact_quantiles(long, "value", [0.25, 0.5, 0.75], by=["column"])
    return m.join(q, "column", "left").select("column", "count", "mean", "std", "min", F.col("q0").alias("q25"),
                                              F.col("q1").alias("q50"), F.col("q2").alias("q75"), "max")


def describe_categorical(df: DataFrame, columns: list[str]) -> DataFrame:
    """B11 (``include='all'``): count, unique, top, freq per text column.

    Ties for the most frequent value go to the smallest value."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]) \
        .unpivot([], columns, "column", "value").filter(F.col("value").isNotNull())
    vc = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return (vc.groupBy("column")
            .agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"),
                 F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top"),
                 F.max("n").alias("freq")))


def negative_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows below zero per numeric column."""
    columns = columns or numeric_columns(df)
    agg = df.agg(*[F.sum((F.col(c) < 0).cast("bigint")).alias(c) for c in columns])
    return _unpivot_one_row(agg, columns, "negatives").fillna(0, ["negatives"])


def domain_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values of each categorical column (value_counts too)."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]) \
        .unpivot([], columns, "column", "value")
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("rows"))


def month_out_of_range(df: DataFrame, month: str = "month") -> DataFrame:
    """Rows whose month is outside 1..12."""
    return df.filter(~F.col(month).between(1, 12))


def rule_dates(df: DataFrame) -> DataFrame:
    """Members cancelled before they enrolled."""
    bad = F.col("cancellation_year") < F.col("enrollment_year")
    return df.agg(F.count_if(bad).alias("invalid_records"), F.count(F.lit(1)).alias("members"))


def rule_counts(df: DataFrame) -> DataFrame:
    """Cross-field rules on member-months, one row per rule."""
    n = F.count(F.lit(1))
    rules = {
        "flights_zero_distance_positive": (F.col("total_flights") == 0) & (F.col("distance") > 0),
        "distance_zero_points_positive": (F.col("distance") == 0) & (F.col("points_accumulated") > 0),
        "redeemed_above_accumulated": F.col("points_redeemed") > F.col("points_accumulated"),
        "negative_flights": F.col("total_flights") < 0,
        "negative_distance": F.col("distance") < 0,
        "negative_points_accumulated": F.col("points_accumulated") < 0,
        "negative_points_redeemed": F.col("points_redeemed") < 0,
    }
    agg = df.agg(n.alias("_rows"), *[F.count_if(c).alias(k) for k, c in rules.items()])
    return (agg.unpivot(["_rows"], list(rules), "rule", "violations")
            .withColumn("violation_pct", rnd(F.col("violations") * 100.0 / F.col("_rows"), 2))
            .withColumnRenamed("_rows", "rows"))


def quality_report(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells and duplicate rows as (metric, value)."""
    missing = sum((F.col(c).isNull().cast("bigint") for c in df.columns), F.lit(0).cast("bigint"))
    base = df.agg(F.count(F.lit(1)).alias("Rows"), F.sum(missing).alias("Missing Values"))
    dups = duplicate_key_count(df).select("duplicates").scalar()
    wide = base.select(F.col("Rows").cast("bigint").alias("Rows"),
                       F.lit(len(df.columns)).cast("bigint").alias("Columns"),
                       F.col("Missing Values").cast("bigint").alias("Missing Values"),
                       dups.cast("bigint").alias("Duplicate Rows"))
    return wide.unpivot([], ["Rows", "Columns", "Missing Values", "Duplicate Rows"], "metric", "value")


def iqr_bounds(df: DataFrame, columns: list[str], k: float = 1.5) -> DataFrame:
    """Q1, Q3, IQR, fences and outlier count per column.

    Quartiles per column in one grouped aggregate over the long format; the
    outlier count is a second pass joined on the (tiny) per-column bounds."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]) \
        .unpivot([], columns, "column", "value").filter(F.col("value").isNotNull())
    b = (exact_quantiles(long, "value", [0.25, 0.75], by=["column"])
         .select("column", F.col("q0").alias("q1"), F.col("q1").alias("q3"))
         .withColumn("iqr", F.col("q3") - F.col("q1"))
         .withColumn("lower", F.col("q1") - k * F.col("iqr"))
         .withColumn("upper", F.col("q3") + k * F.col("iqr")))
    # one row per column: bounded by the column list, safe to broadcast
    counts = (long.join(F.broadcast(b.select("column", "lower", "upper")), "column")
              .groupBy("column")
              .agg(F.count_if((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper")))
                   .alias("outliers"), F.count(F.lit(1)).alias("rows")))
    return b.join(counts, "column")


def iqr_outliers(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    """The rows outside the 1.5 IQR fences of one column."""
    q = quantile_array(df, column, [0.25, 0.75])
    iqr = q[1] - q[0]
    return df.filter((F.col(column) < q[0] - k * iqr) | (F.col(column) > q[1] + k * iqr))


def outlier_share(df: DataFrame, columns: list[str], lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """Share of non-null values outside their own p1..p99."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]) \
        .unpivot([], columns, "column", "value").filter(F.col("value").isNotNull())
    b = exact_quantiles(long, "value", [lo, hi], by=["column"]).select(
        "column", F.col("q0").alias("p_lo"), F.col("q1").alias("p_hi"))
    return (long.join(F.broadcast(b), "column")
            .groupBy("column")
            .agg(F.avg(((F.col("value") < F.col("p_lo")) | (F.col("value") > F.col("p_hi"))).cast("double"))
                 .alias("outlier_share")))
