"""Statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.special import chi_square_upper, normal_two_sided, student_t_two_sided
from ..operators import statistics as S
from ..operators.sampling import sample_order_sql, seeded_sample
from .oracle_base import query
from .registry import register

CF_COLS = ["clv", "total_flights", "total_distance", "total_points", "points_redeemed", "active_months",
           "redemption_rate", "cancelled"]
TEST_COLS = CF_COLS[:-1]
#: The members' behaviour and their salary, which some do not tell.
CORR_COLS = [*CF_COLS, "salary"]
#: Numeric columns of the cleaned member feed and of the raw activity feed.
MEMBER_NUM = ["member_id", "salary", "clv", "enrollment_year", "enrollment_month", "cancellation_year", "cancellation_month"]
ACTIVITY_NUM = ["member_id", "year", "month", "total_flights", "distance", "points_accumulated", "points_redeemed",
                "dollar_cost_points_redeemed"]
_CORR = "cf_salary AS (SELECT c.*, m.salary FROM cust_flights c LEFT JOIN members m USING (member_id))"


def _with_salary(L):
    return L.customer_flights.join(L.members.select("member_id", "salary"), "member_id", "left")


def _corr_sql(columns, table):
    return _u([f"SELECT '{a}' AS x, '{b}' AS y, corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS r FROM {table}"
               for a in columns for b in columns])
CHI_COLS = ["loyalty_card", "gender", "education", "marital_status"]
TREND_PAIRS = [("clv", "total_flights"), ("clv", "total_distance"), ("clv", "total_points"),
               ("total_flights", "total_points"), ("total_distance", "points_redeemed"),
               ("total_points", "points_redeemed")]


def _u(parts):
    return "\nUNION ALL\n".join(parts)


@register("numeric_summary", query("""
SELECT s."column", n, mean, median, std, min, max, skewness, kurtosis, iqr, o.outlier_share
FROM (SELECT "column", CAST(count(value) AS BIGINT) AS n, avg(value) AS mean, median(value) AS median,
        stddev_samp(value) AS std, min(value) AS min, max(value) AS max, skewness(value) AS skewness,
        kurtosis(value) AS kurtosis, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr,
        quantile_cont(value, 0.01) AS p_lo, quantile_cont(value, 0.99) AS p_hi
      FROM member_vars_long GROUP BY "column") s
JOIN (SELECT v."column", avg(CASE WHEN value < p_lo OR value > p_hi THEN 1.0 ELSE 0.0 END) AS outlier_share
      FROM member_vars_long v JOIN (SELECT "column", quantile_cont(value, 0.01) AS p_lo,
        quantile_cont(value, 0.99) AS p_hi FROM member_vars_long GROUP BY "column") b ON v."column" = b."column"
      GROUP BY v."column") o ON o."column" = s."column" """),
    doubles="mean median std min max skewness kurtosis iqr outlier_share", digits=4)
def numeric_summary(L):
    """Univariate summary of the seven member variables."""
    return S.numeric_summary(S.member_variables(L), S.SUMMARY_VARS)


@register("skew_rank", query("""
SELECT "column", skewness(value) AS skewness FROM member_vars_long GROUP BY "column" """),
    doubles="skewness", digits=4)
def skew_rank(L):
    """Variables ranked by skewness."""
    return S.skew_rank(S.member_variables(L), S.SUMMARY_VARS)


@register("pearson_matrix", query(_corr_sql(CORR_COLS, "cf_salary"), _CORR), doubles="r")
def pearson_matrix(L):
    """S3: Pearson matrix of the member behaviour metrics and salary (pairwise-complete)."""
    return S.pearson_matrix(_with_salary(L), CORR_COLS)


@register("pearson_members", query(_corr_sql(MEMBER_NUM, "members_clean")), doubles="r")
def pearson_members(L):
    """S3: Pearson matrix of the member feed's numeric columns (pairwise-complete)."""
    return S.pearson_matrix(L.members_clean, MEMBER_NUM)


@register("pearson_activity", query(_corr_sql(ACTIVITY_NUM, "activity_raw")), doubles="r")
def pearson_activity(L):
    """S3: Pearson matrix of the raw activity feed's numeric columns."""
    return S.pearson_matrix(L.activity_raw, ACTIVITY_NUM)


def _spearman_sql():
    parts = []
    for a in CORR_COLS:
        for b in CORR_COLS:
            rank = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"
            parts.append(f"SELECT '{a}' AS x, '{b}' AS y, corr(ra, rb) AS r FROM (SELECT {rank.format(a)} AS ra, "
                         f"{rank.format(b)} AS rb FROM cf_salary WHERE {a} IS NOT NULL AND {b} IS NOT NULL)")
    return _u(parts)


@register("spearman_matrix", query(_spearman_sql(), _CORR), doubles="r")
def spearman_matrix(L):
    """Spearman matrix (tie-averaged ranks, taken for each pair among the rows that know both)."""
    return S.spearman_matrix(_with_salary(L), CORR_COLS)


@register("churn_correlates", query("""
SELECT feature, r, abs(r) AS abs_r, CASE WHEN r > 0 THEN 'up' ELSE 'down' END AS direction FROM (""" + _u([
    f"SELECT '{c}' AS feature, corr(CAST({c} AS DOUBLE), CAST(cancelled AS DOUBLE)) AS r FROM cf_salary"
    for c in [*TEST_COLS, "salary"]]) + ") t", _CORR), doubles="r abs_r")
def churn_correlates(L):
    """Correlates of cancellation, salary among them, ranked by |r|."""
    return S.target_correlates(_with_salary(L), [*TEST_COLS, "salary"], "cancelled")


def _welch_sql():
    parts = []
    for c in TEST_COLS:
        parts.append(f"""SELECT '{c}' AS feature,
  CAST(count(CASE WHEN cancelled = 0 THEN {c} END) AS BIGINT) AS n_a,
  CAST(count(CASE WHEN cancelled = 1 THEN {c} END) AS BIGINT) AS n_b,
  avg(CASE WHEN cancelled = 0 THEN CAST({c} AS DOUBLE) END) AS mean_a,
  avg(CASE WHEN cancelled = 1 THEN CAST({c} AS DOUBLE) END) AS mean_b,
  var_samp(CASE WHEN cancelled = 0 THEN CAST({c} AS DOUBLE) END) AS var_a,
  var_samp(CASE WHEN cancelled = 1 THEN CAST({c} AS DOUBLE) END) AS var_b
FROM cust_flights WHERE {c} IS NOT NULL""")
    return ("SELECT feature, n_a, n_b, mean_a, mean_b, (mean_a - mean_b) * 100.0 / nullif(mean_a, 0) AS diff_pct, "
            "(mean_a - mean_b) / nullif(sqrt(var_a / n_a + var_b / n_b), 0) AS t_stat, "
            "power(var_a / n_a + var_b / n_b, 2) / nullif(power(var_a / n_a, 2) / (n_a - 1) "
            "+ power(var_b / n_b, 2) / (n_b - 1), 0) AS dof FROM (" + _u(parts) + ") m")


@register("welch_t", query(_welch_sql()), doubles="mean_a mean_b diff_pct t_stat dof", digits=4)
def welch_t(L):
    """Welch t-test active (0) vs cancelled (1): t and Welch df."""
    return S.welch_t(L.customer_flights, TEST_COLS, "cancelled")


# midpoint sums: 2 K times the integral of cos^(dof - 1) from atan(|t| / sqrt(dof)) to pi / 2
@register("welch_t_pvalues", query("""
SELECT w.*, p_value, p_value < 0.05 AS significant FROM w LEFT JOIN tails USING (feature)""", f"w AS ({_welch_sql()})", """
tails AS (SELECT feature, exp(lgamma((dof + 1) / 2) - lgamma(dof / 2)) / sqrt(pi()) * 2 * (pi() / 2 - atan(abs(t_stat) / sqrt(dof))) / 100000
    * sum(power(cos(atan(abs(t_stat) / sqrt(dof)) + (pi() / 2 - atan(abs(t_stat) / sqrt(dof))) * (i + 0.5) / 100000), dof - 1)) AS p_value
  FROM w, range(100000) AS steps(i) WHERE t_stat IS NOT NULL AND dof > 0 GROUP BY feature, t_stat, dof)"""),
    doubles="mean_a mean_b diff_pct t_stat dof p_value", digits=4)
def welch_t_pvalues(L):
    """With two-sided p-values (Student t tail on the per-test rows)."""
    t = S.welch_t(L.customer_flights, TEST_COLS, "cancelled")
    return t.withColumn("p_value", student_t_two_sided(F.col("t_stat"), F.col("dof"))) \
        .withColumn("significant", F.col("p_value") < 0.05)


def _mw_sql():
    parts = []
    for c in TEST_COLS:
        parts.append(f"""SELECT '{c}' AS feature, r_a - n_a * (n_a + 1) / 2.0 AS u_stat,
  (greatest(r_a - n_a * (n_a + 1) / 2.0, n_a * (n - n_a) - (r_a - n_a * (n_a + 1) / 2.0))
    - n_a * (n - n_a) / 2.0 - 0.5)
  / nullif(sqrt(n_a * (n - n_a) / 12.0 * ((n + 1) - ties / (n * (n - 1)))), 0) AS z
FROM (SELECT sum(n_a * rnk) AS r_a, CAST(sum(n_a) AS DOUBLE) AS n_a, CAST(sum(n) AS DOUBLE) AS n,
        sum(power(CAST(n AS DOUBLE), 3) - n) AS ties
      FROM (SELECT n, n_a, sum(n) OVER (ORDER BY value ROWS UNBOUNDED PRECEDING) - n + (n + 1) / 2.0 AS rnk
            FROM (SELECT CAST({c} AS DOUBLE) AS value, count(*) AS n, count_if(cancelled = 0) AS n_a
                  FROM cust_flights WHERE {c} IS NOT NULL AND cancelled IN (0, 1) GROUP BY 1)))""")
    return _u(parts)


@register("mann_whitney", query(_mw_sql()), doubles="u_stat z", digits=4)
def mann_whitney(L):
    """Mann-Whitney U (active group) and tie-corrected z."""
    return S.mann_whitney(L.customer_flights, TEST_COLS, "cancelled")


# the normal tail as (2 / pi) times the integral of exp(-z^2 / (2 sin^2)) from 0 to pi / 2, a midpoint sum
@register("mann_whitney_pvalues", query("""
SELECT w.*, p_value FROM w LEFT JOIN (
  SELECT feature, sum(exp(-z * z / 2 / power(sin(pi() / 2 * (i + 0.5) / 4000), 2))) / 4000 AS p_value
  FROM w, range(4000) AS steps(i) WHERE z IS NOT NULL GROUP BY feature) USING (feature)""", f"w AS ({_mw_sql()})"), doubles="u_stat z p_value", digits=4)
def mann_whitney_pvalues(L):
    """With two-sided normal p-values."""
    return S.mann_whitney(L.customer_flights, TEST_COLS, "cancelled").withColumn("p_value", normal_two_sided(F.col("z")))


def _chi_sql():
    parts = []
    for c in CHI_COLS:
        parts.append(f"""SELECT '{c}' AS feature,
  sum(power(abs(o - e) - CASE WHEN dof = 1 THEN least(0.5, abs(o - e)) ELSE 0.0 END, 2) / e) AS chi2,
  CAST(max(dof) AS BIGINT) AS dof
FROM (SELECT g.r, g.k, coalesce(c.o, 0) AS o, rt * ct / CAST(tot AS DOUBLE) AS e, (nr - 1) * (nc - 1) AS dof
      FROM (SELECT r.r, k.k, r.rt, k.ct FROM
              (SELECT {c} AS r, count(*) AS rt FROM members WHERE {c} IS NOT NULL AND cancelled IS NOT NULL GROUP BY 1) r,
              (SELECT cancelled AS k, count(*) AS ct FROM members WHERE {c} IS NOT NULL AND cancelled IS NOT NULL
               GROUP BY 1) k) g
      LEFT JOIN (SELECT {c} AS r, cancelled AS k, count(*) AS o FROM members
                 WHERE {c} IS NOT NULL AND cancelled IS NOT NULL GROUP BY 1, 2) c ON c.r = g.r AND c.k = g.k,
      (SELECT count(*) AS tot, count(DISTINCT {c}) AS nr, count(DISTINCT cancelled) AS nc FROM members
       WHERE {c} IS NOT NULL AND cancelled IS NOT NULL) t)""")
    return _u(parts)


@register("chi_square", query(_chi_sql()), doubles="chi2", digits=4)
def chi_square(L):
    """Chi-square of card, gender, education, marital vs cancellation."""
    return S.chi_square(L.members, CHI_COLS, "cancelled")


# finite sums for whole degrees of freedom: Poisson terms for even ones; for odd ones the
# normal tail (as above) and terms of half steps
@register("chi_square_pvalues", query("""
SELECT w.*, CASE WHEN dof < 1 OR chi2 IS NULL THEN NULL WHEN chi2 <= 0 THEN 1.0 ELSE coalesce(terms.p, 0) + coalesce(tails.p, 0) END AS p_value
FROM w LEFT JOIN terms USING (feature) LEFT JOIN tails USING (feature)""", f"w AS ({_chi_sql()})", """
terms AS (SELECT feature, sum(exp((i + dof % 2 * 0.5) * ln(chi2 / 2) - chi2 / 2 - lgamma(i + dof % 2 * 0.5 + 1))) AS p
  FROM w, range(200) AS steps(i) WHERE chi2 > 0 AND i < dof // 2 GROUP BY feature),
tails AS (SELECT feature, sum(exp(-chi2 / 2 / power(sin(pi() / 2 * (i + 0.5) / 4000), 2))) / 4000 AS p
  FROM w, range(4000) AS steps(i) WHERE chi2 > 0 AND dof % 2 = 1 GROUP BY feature)"""), doubles="chi2 p_value", digits=4)
def chi_square_pvalues(L):
    """With upper-tail p-values."""
    return S.chi_square(L.members, CHI_COLS, "cancelled").withColumn("p_value", chi_square_upper(F.col("chi2"), F.col("dof")))


@register("linear_trend", query(_u([
    f"SELECT '{x}' AS x, '{y}' AS y, regr_slope(coalesce(CAST({y} AS DOUBLE), 0.0), coalesce(CAST({x} AS DOUBLE), 0.0)) "
    f"AS slope, regr_intercept(coalesce(CAST({y} AS DOUBLE), 0.0), coalesce(CAST({x} AS DOUBLE), 0.0)) AS intercept, "
    f"corr(coalesce(CAST({x} AS DOUBLE), 0.0), coalesce(CAST({y} AS DOUBLE), 0.0)) AS r FROM cust_flights"
    for x, y in TREND_PAIRS])), doubles="slope intercept r", digits=4)
def linear_trend(L):
    """Regression line and r for six metric pairs (all members)."""
    return S.linear_trend(L.customer_flights, TREND_PAIRS)


@register("scatter_points", query(f"""
SELECT member_id, clv, total_flights, total_distance, total_points, points_redeemed, cancelled,
  (SELECT median(total_flights) FROM cust_flights) AS median_total_flights
FROM cust_flights ORDER BY {sample_order_sql(['member_id'])}, member_id LIMIT 4000"""), doubles="clv median_total_flights")
def scatter_points(L):
    """S10 + F10: seeded sample of at most 4000 members for a scatter
    (a sample is the feature here), with a median reference line."""
    cf = L.customer_flights
    from ..functions.ranking import quantile_array
    med = quantile_array(cf, "total_flights", [0.5])[0]
    return (seeded_sample(cf, "member_id", 4000, seed=42)
            .select("member_id", "clv", "total_flights", "total_distance", "total_points", "points_redeemed",
                    "cancelled", med.alias("median_total_flights")))


@register("scatter_matrix", query(f"""
SELECT member_id, year, month, total_flights, distance, points_accumulated, clv FROM master
WHERE total_flights IS NOT NULL AND distance IS NOT NULL AND points_accumulated IS NOT NULL AND clv IS NOT NULL
ORDER BY {sample_order_sql(['member_id', 'year', 'month'])}, member_id, year, month LIMIT 2000"""), doubles="clv")
def scatter_matrix(L):
    """Four metrics, rows with nulls dropped, seeded sample of 2000."""
    cols = ["total_flights", "distance", "points_accumulated", "clv"]
    return seeded_sample(L.activity.select("member_id", "year", "month", *cols).dropna(subset=cols),
                         ["member_id", "year", "month"], 2000, seed=42)
