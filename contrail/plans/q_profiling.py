"""Profiling and data-quality queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from ..operators import profiling as P
from .oracle_base import query
from .registry import register

MEMBER_RAW = ["member_id", "country", "province", "city", "gender", "education", "salary", "marital_status",
              "loyalty_card", "clv", "enrollment_year", "enrollment_month", "cancellation_year",
              "cancellation_month"]
ACTIVITY_COLS = ["member_id", "year", "month", "total_flights", "distance", "points_accumulated",
                 "points_redeemed", "dollar_cost_points_redeemed"]
MEMBER_NUMERIC = ["member_id", "salary", "clv", "enrollment_year", "enrollment_month", "cancellation_year",
                  "cancellation_month", "salary_college", "cancelled"]
MEMBER_TEXT = ["country", "province", "city", "gender", "education", "marital_status", "loyalty_card"]
DOMAIN_COLS = ["gender", "education", "marital_status", "loyalty_card", "country", "province"]
ACTIVITY_KEY = ["member_id", "year", "month"]


def _union(dfs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)


def _q(name: str) -> str:
    return '"' + name + '"'


def _union_sql(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


SHAPES = [("members_raw", 14), ("activity_raw", 8), ("members", 14), ("activity_final", 8), ("master", 21)]


@register("profile_shape", query(_union_sql([
    f"SELECT '{t}' AS \"table\", CAST(count(*) AS BIGINT) AS rows, CAST({c} AS BIGINT) AS columns FROM {t}"
    for t, c in SHAPES])))
def profile_shape(L):
    """B1: rows and columns of each stage."""
    return _union([P.shape(getattr(L, t), t) for t, _ in SHAPES])


@register("profile_preview", query(
    "SELECT * FROM master ORDER BY member_id, year, month LIMIT 10"),
    doubles="dollar_cost_points_redeemed salary clv")
def profile_preview(L):
    """B2: first rows of the master table in key order."""
    return P.preview(L.master, ACTIVITY_KEY, 10)


@register("profile_schema")
def profile_schema(L):
    """B3 + A5: info() of the scanned member feed with dictionary text."""
    from ..sources.files import MEMBER_SCHEMA, with_docs
    docs = {f.name: f.metadata for f in with_docs(MEMBER_SCHEMA).fields}
    df = L.members_raw
    df = df.select(*[df[c].alias(c, metadata=docs.get(c, {})) for c in df.columns])
    return P.schema_info(df)


@register("null_counts", query(_union_sql([
    f"SELECT '{c}' AS \"column\", CAST(count(*) - count({c}) AS BIGINT) AS nulls FROM members_raw"
    for c in MEMBER_RAW])))
def null_counts(L):
    """Nulls per column of the member feed."""
    return P.null_counts(L.members_raw)


@register("null_percent", query("SELECT \"column\", nulls, round(nulls * 100.0 / (SELECT count(*) FROM master), 2) "
                                "AS null_pct FROM (" + _union_sql([
                                    f"SELECT '{c}' AS \"column\", CAST(count(*) - count({c}) AS BIGINT) AS nulls "
                                    f"FROM master" for c in
                                    ["member_id", "year", "month", "total_flights", "distance",
                                     "points_accumulated", "points_redeemed", "dollar_cost_points_redeemed",
                                     "country", "province", "city", "gender", "education", "salary",
                                     "salary_college", "marital_status", "loyalty_card", "clv",
                                     "enrollment_year", "enrollment_month", "cancelled"]]) + ") t"),
    doubles="null_pct")
def null_percent(L):
    """Null percent per column of the master table."""
    return P.null_percent(L.master)


@register("dup_key_count", query(_union_sql([
    f"SELECT '{t}' AS stage, CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT member_id, year, month "
    f"FROM {t})) AS BIGINT) AS duplicates FROM {t}"
    for t in ("activity_raw", "activity_dedup", "activity_monthly")])))
def dup_key_count(L):
    """Repeated (member, year, month) before dedup, after dedup, after the sum."""
    stages = {"activity_raw": L.activity_raw, "activity_dedup": L.activity_dedup,
              "activity_monthly": L.activity_monthly}
    from pyspark.sql import functions as F
    return _union([P.duplicate_key_count(df, ACTIVITY_KEY).select(F.lit(k).alias("stage"), "duplicates")
                   for k, df in stages.items()])


@register("dup_row_count", query(_union_sql([
    f"SELECT '{t}' AS \"table\", CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {t})) AS BIGINT) "
    f"AS duplicates FROM {t}" for t in ("activity_raw", "members_raw")])))
def dup_row_count(L):
    """Exact duplicate rows per feed."""
    from pyspark.sql import functions as F
    return _union([P.duplicate_key_count(df).select(F.lit(k).alias("table"), "duplicates")
                   for k, df in (("activity_raw", L.activity_raw), ("members_raw", L.members_raw))])


@register("dup_key_rows", query("""
SELECT d.* FROM activity_dedup d
JOIN (SELECT member_id, year, month FROM activity_dedup GROUP BY 1, 2, 3 HAVING count(*) > 1) k
  ON d.member_id = k.member_id AND d.year = k.year AND d.month = k.month"""),
    doubles="dollar_cost_points_redeemed")
def dup_key_rows(L):
    """All rows of a repeated member-month after the full-row dedup."""
    return P.duplicate_key_rows(L.activity_dedup, ACTIVITY_KEY)


@register("nulls_by_group", query("""
SELECT education, CAST(sum(CASE WHEN salary IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nulls,
  CAST(count(*) AS BIGINT) AS rows
FROM members_raw GROUP BY education"""))
def nulls_by_group(L):
    """Missing salaries per education level."""
    return P.nulls_by_group(L.members_raw, "salary", "education")


@register("crosstab_null", query("""
SELECT loyalty_card, CAST(count_if(salary IS NOT NULL) AS BIGINT) AS not_null,
  CAST(count_if(salary IS NULL) AS BIGINT) AS is_null
FROM members_raw GROUP BY loyalty_card"""))
def crosstab_null(L):
    """Card x salary-missing crosstab."""
    return P.crosstab_null(L.members_raw, "loyalty_card", "salary")


@register("describe_numeric", query(_union_sql([
    f"""SELECT '{c}' AS "column", CAST(count({c}) AS BIGINT) AS count, avg(CAST({c} AS DOUBLE)) AS mean,
  stddev_samp(CAST({c} AS DOUBLE)) AS std, min(CAST({c} AS DOUBLE)) AS min,
  quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q25, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS q50,
  quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q75, max(CAST({c} AS DOUBLE)) AS max FROM members_clean"""
    for c in MEMBER_NUMERIC])), doubles="mean std min q25 q50 q75 max")
def describe_numeric(L):
    """describe() of the cleaned member table."""
    return P.describe_numeric(L.members_clean, MEMBER_NUMERIC)


@register("describe_categorical", query("""
SELECT "column", CAST(sum(n) AS BIGINT) AS count, CAST(count(*) AS BIGINT) AS unique,
  arg_min(value, (-n, value)) AS top, CAST(max(n) AS BIGINT) AS freq
FROM (""" + _union_sql([
    f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n FROM members_clean WHERE {c} IS NOT NULL GROUP BY {c}"
    for c in MEMBER_TEXT]) + ") t GROUP BY \"column\""))
def describe_categorical(L):
    """Count / unique / top / freq of the member text columns."""
    return P.describe_categorical(L.members_clean, MEMBER_TEXT)


@register("negative_counts", query(_union_sql(
    [f"SELECT 'activity.{c}' AS \"column\", CAST(count_if({c} < 0) AS BIGINT) AS negatives FROM activity_raw"
     for c in ACTIVITY_COLS]
    + ["SELECT 'members.salary' AS \"column\", CAST(count_if(salary < 0) AS BIGINT) AS negatives FROM members_raw"])))
def negative_counts(L):
    """Negatives per numeric column (activity feed, member salary)."""
    from pyspark.sql import functions as F
    a = P.negative_counts(L.activity_raw, ACTIVITY_COLS).withColumn("column", F.concat(F.lit("activity."), "column"))
    m = P.negative_counts(L.members_raw, ["salary"]).withColumn("column", F.concat(F.lit("members."), "column"))
    return a.unionByName(m)


@register("domain_values", query(_union_sql([
    f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, CAST(count(*) AS BIGINT) AS rows "
    f"FROM members_clean GROUP BY {c}" for c in DOMAIN_COLS]
    + ["SELECT 'year' AS \"column\", CAST(year AS VARCHAR) AS value, CAST(count(*) AS BIGINT) AS rows "
       "FROM activity_final GROUP BY year",
       "SELECT 'month' AS \"column\", CAST(month AS VARCHAR) AS value, CAST(count(*) AS BIGINT) AS rows "
       "FROM activity_final GROUP BY month"])))
def domain_values(L):
    """Categories, years and months present."""
    return P.domain_values(L.members_clean, DOMAIN_COLS).unionByName(
        P.domain_values(L.activity_final, ["year", "month"]))


@register("month_out_of_range", query("SELECT * FROM activity_final WHERE NOT (month BETWEEN 1 AND 12)"),
          doubles="dollar_cost_points_redeemed")
def month_out_of_range(L):
    """Member-months with an impossible month."""
    return P.month_out_of_range(L.activity_final)


@register("rule_dates", query("""
SELECT CAST(count_if(cancellation_year < enrollment_year) AS BIGINT) AS invalid_records,
  CAST(count(*) AS BIGINT) AS members FROM members_clean"""))
def rule_dates(L):
    """Cancellation before enrollment."""
    return P.rule_dates(L.members_clean)


_RULES = {
    "flights_zero_distance_positive": "total_flights = 0 AND distance > 0",
    "distance_zero_points_positive": "distance = 0 AND points_accumulated > 0",
    "redeemed_above_accumulated": "points_redeemed > points_accumulated",
    "negative_flights": "total_flights < 0",
    "negative_distance": "distance < 0",
    "negative_points_accumulated": "points_accumulated < 0",
    "negative_points_redeemed": "points_redeemed < 0",
}


@register("rule_counts", query(_union_sql([
    f"SELECT '{k}' AS rule, CAST(count_if({v}) AS BIGINT) AS violations, CAST(count(*) AS BIGINT) AS rows, "
    f"round(count_if({v}) * 100.0 / count(*), 2) AS violation_pct FROM activity_monthly"
    for k, v in _RULES.items()])), doubles="violation_pct")
def rule_counts(L):
    """Cross-field rule violations on member-months."""
    return P.rule_counts(L.activity_monthly)


@register("quality_report", query("""
SELECT 'Rows' AS metric, CAST(count(*) AS BIGINT) AS value FROM members_raw
UNION ALL SELECT 'Columns', 14
UNION ALL SELECT 'Missing Values', CAST(""" + " + ".join(f"(count(*) - count({c}))" for c in MEMBER_RAW)
    + """ AS BIGINT) FROM members_raw
UNION ALL SELECT 'Duplicate Rows', CAST((SELECT count(*) FROM members_raw)
  - (SELECT count(*) FROM (SELECT DISTINCT * FROM members_raw)) AS BIGINT)"""))
def quality_report(L):
    """Quality summary of the member feed."""
    return P.quality_report(L.members_raw)


IQR_SQL = """
SELECT b."column", q1, q3, iqr, lower, upper, CAST(count_if(value < lower OR value > upper) AS BIGINT) AS outliers,
  CAST(count(*) AS BIGINT) AS rows
FROM ({long}) v JOIN (
  SELECT "column", q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper
  FROM (SELECT "column", quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
        FROM ({long}) GROUP BY "column")) b ON v."column" = b."column"
GROUP BY b."column", q1, q3, iqr, lower, upper"""

_IQR_LONG = _union_sql([
    "SELECT 'salary' AS \"column\", CAST(salary AS DOUBLE) AS value FROM members_clean WHERE salary IS NOT NULL",
    "SELECT 'clv' AS \"column\", CAST(clv AS DOUBLE) AS value FROM members_clean WHERE clv IS NOT NULL",
    "SELECT 'distance' AS \"column\", CAST(distance AS DOUBLE) AS value FROM activity_dedup",
    "SELECT 'points_accumulated' AS \"column\", CAST(points_accumulated AS DOUBLE) AS value FROM activity_dedup",
])


@register("iqr_bounds", query(IQR_SQL.format(long=_IQR_LONG)), doubles="q1 q3 iqr lower upper", digits=8)
def iqr_bounds(L):
    """1.5 IQR fences and outlier counts (salary, CLV, distance, points)."""
    m = P.iqr_bounds(L.members_clean, ["salary", "clv"])
    a = P.iqr_bounds(L.activity_dedup, ["distance", "points_accumulated"])
    return m.unionByName(a)


@register("iqr_outliers", query("""
SELECT * FROM activity_dedup, (SELECT quantile_cont(distance, 0.25) AS q1, quantile_cont(distance, 0.75) AS q3
  FROM activity_dedup) q
WHERE distance < q1 - 1.5 * (q3 - q1) OR distance > q3 + 1.5 * (q3 - q1)""".replace(
    "SELECT *", "SELECT member_id, year, month, total_flights, distance, points_accumulated, points_redeemed, "
    "dollar_cost_points_redeemed")), doubles="dollar_cost_points_redeemed")
def iqr_outliers(L):
    """Activity rows outside the distance fences."""
    return P.iqr_outliers(L.activity_dedup, "distance")


@register("outlier_share", query("""
SELECT v."column", avg(CASE WHEN value < p_lo OR value > p_hi THEN 1.0 ELSE 0.0 END) AS outlier_share
FROM member_vars_long v JOIN (SELECT "column", quantile_cont(value, 0.01) AS p_lo, quantile_cont(value, 0.99) AS p_hi
  FROM member_vars_long GROUP BY "column") b ON v."column" = b."column"
GROUP BY v."column" """), doubles="outlier_share")
def outlier_share(L):
    """Share outside p1..p99 for the seven summary variables."""
    from ..operators.statistics import SUMMARY_VARS, member_variables
    return P.outlier_share(member_variables(L), SUMMARY_VARS).select("column", "outlier_share")


def _dictionary_sql():
    from ..sources.files import ACTIVITY_SCHEMA, ACTIVITY_TABLE, FIELD_DOCS, MEMBER_SCHEMA, MEMBER_TABLE
    parts = []
    for table, view, schema in ((ACTIVITY_TABLE, "activity_raw", ACTIVITY_SCHEMA),
                                (MEMBER_TABLE, "members_raw", MEMBER_SCHEMA)):
        for f in schema.fields:
            doc = FIELD_DOCS.get(f.name, "").replace("'", "''")
            parts.append(f"SELECT '{table}' AS \"table\", '{f.name}' AS field, '{doc}' AS description, "
                         f"CAST(count({f.name}) AS BIGINT) AS non_null FROM {view}")
    return _union_sql(parts)


@register("data_dictionary", query(_dictionary_sql()))
def data_dictionary(L):
    """A5: field descriptions attached to both raw feeds, with non-null counts."""
    from pyspark.sql import functions as F
    from ..sources.files import ACTIVITY_SCHEMA, ACTIVITY_TABLE, MEMBER_SCHEMA, MEMBER_TABLE, with_docs
    out = []
    for table, df, schema in ((ACTIVITY_TABLE, L.activity_raw, ACTIVITY_SCHEMA),
                              (MEMBER_TABLE, L.members_raw, MEMBER_SCHEMA)):
        docs = {f.name: f.metadata for f in with_docs(schema).fields}
        typed = df.select(*[df[c].alias(c, metadata=docs.get(c, {})) for c in df.columns])
        out.append(P.schema_info(typed).select(F.lit(table).alias("table"), F.col("column").alias("field"),
                                               "description", "non_null"))
    return _union(out)
