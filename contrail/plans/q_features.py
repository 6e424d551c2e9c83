"""Binning, segments, features, hierarchies, filters and extracts
(A3, C17-C21, G1-G11, H1-H16, J1-J3, X1-X7)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions.exprs import SALARY_BANDS, tier_number
from ..operators import features as FE
from ..operators import hierarchy as H
from ..operators import segments as G
from ..operators.kpis import esum
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


SALARY_CASE = "CASE " + " ".join(
    f"WHEN {{c}} >= {lo} AND {{c}} < {hi} THEN '{lab}'" for lo, hi, lab in SALARY_BANDS) + " END"


# ---------------------------------------------------------------- G1-G8 ----

@register("salary_band", query(
    "SELECT " + SALARY_CASE.format(c="salary") + " AS band, CAST(count(*) AS BIGINT) AS members "
    "FROM members GROUP BY 1"))
def salary_band(L):
    """G1: members per salary band (missing salary -> no band)."""
    return G.salary_band_counts(L.members)


@register("clv_quartile", query("""
SELECT clv_segment, CAST(count(*) AS BIGINT) AS members, min(clv) AS min_clv, max(clv) AS max_clv
FROM customers GROUP BY clv_segment"""), doubles="min_clv max_clv")
def clv_quartile(L):
    """Member CLV quartile labels Bronze..Platinum (qcut)."""
    return (L.customers.groupBy("clv_segment")
            .agg(F.count(F.lit(1)).alias("members"), F.min("clv").alias("min_clv"), F.max("clv").alias("max_clv")))


@register("clv_decile", query("""
SELECT decile, CAST(count(*) AS BIGINT) AS members, CAST(sum(CAST(clv AS DECIMAL(38,10))) AS DOUBLE) AS total,
  CAST(sum(CAST(clv AS DECIMAL(38,10))) AS DOUBLE) * 100.0
    / (SELECT CAST(sum(CAST(clv AS DECIMAL(38,10))) AS DOUBLE) FROM members WHERE clv IS NOT NULL) AS share_pct
FROM (SELECT clv, CASE """ + " ".join(f"WHEN clv <= e{i} THEN 'D{i}'" for i in range(1, 10)) + """ ELSE 'D10' END
        AS decile FROM members, dec_edges WHERE clv IS NOT NULL) t GROUP BY decile""",
    "dec_edges AS (SELECT " + ", ".join(f"quantile_cont(clv, {i / 10}) AS e{i}" for i in range(1, 10))
    + " FROM members)"), doubles="total share_pct", digits=4)
def clv_decile(L):
    """CLV deciles and each decile's share of total CLV."""
    return G.decile_share(L.members, "clv")


@register("clv_tercile", query("""
SELECT value_band, CAST(count(*) AS BIGINT) AS members FROM (
  SELECT CASE WHEN clv > 0 AND clv <= q1 THEN 'Low Value' WHEN clv > q1 AND clv <= q2 THEN 'Medium Value'
    WHEN clv > q2 THEN 'High Value' END AS value_band
  FROM members, (SELECT quantile_cont(clv, 0.33) AS q1, quantile_cont(clv, 0.67) AS q2 FROM members) q) t
GROUP BY value_band"""))
def clv_tercile(L):
    """Low / Medium / High value bands at p33 / p67."""
    return G.value_bands(L.members, "clv").groupBy("value_band").agg(F.count(F.lit(1)).alias("members"))


@register("clv_thresholds", query("""
SELECT p99, p95, p90, p10, CAST(count_if(clv > p99) AS BIGINT) AS top_1, CAST(count_if(clv > p95) AS BIGINT) AS top_5,
  CAST(count_if(clv > p90) AS BIGINT) AS top_10, CAST(count_if(clv < p10) AS BIGINT) AS bottom_10
FROM members, (SELECT quantile_cont(clv, 0.99) AS p99, quantile_cont(clv, 0.95) AS p95,
  quantile_cont(clv, 0.90) AS p90, quantile_cont(clv, 0.10) AS p10 FROM members) q
GROUP BY p99, p95, p90, p10"""), doubles="p99 p95 p90 p10", digits=4)
def clv_thresholds(L):
    """Members above p99 / p95 / p90 and below p10 of CLV."""
    return G.thresholds(L.members, "clv")


def _hist_sql(name, src, col, bins, where="TRUE"):
    return f"""SELECT '{name}' AS variable, bin, CAST(count(*) AS BIGINT) AS count, lo + bin * w AS bin_lo,
  lo + (bin + 1) * w AS bin_hi
FROM (SELECT lo, w, CASE WHEN b IS NULL THEN 0 WHEN b > {bins - 1} THEN {bins - 1} WHEN b < 0 THEN 0 ELSE b END AS bin
      FROM (SELECT lo, w, CAST(floor((CAST({col} AS DOUBLE) - lo) / nullif(w, 0)) AS INTEGER) AS b
            FROM {src}, (SELECT min(CAST({col} AS DOUBLE)) AS lo, (max(CAST({col} AS DOUBLE)) - min(CAST({col} AS DOUBLE)))
                               / {bins} AS w FROM {src} WHERE {col} IS NOT NULL AND {where}) mm
            WHERE {col} IS NOT NULL AND {where})) t
GROUP BY bin, lo, w"""


HISTS = [("salary", "members", "salary", 30), ("clv", "members", "clv", 80),
         ("distance", "activity_dedup", "distance", 30), ("member_flights", "cust_flights", "total_flights", 40)]


@register("histogram", query(U([_hist_sql(*h) for h in HISTS])), doubles="bin_lo bin_hi", digits=4)
def histogram(L):
    """Equal-width histograms (salary 30, CLV 80, distance 30, member flights 40 bins)."""
    srcs = {"members": L.members, "activity_dedup": L.activity_dedup, "cust_flights": L.customer_flights}
    return _union([G.histogram(srcs[s], c, b, name=n).select("variable", "bin", "count", "bin_lo", "bin_hi")
                   for n, s, c, b in HISTS])


@register("histogram_by_status", query("""
SELECT 'flights' AS variable, CAST(cancelled AS VARCHAR) AS grp, bin, CAST(count(*) AS BIGINT) AS count, CAST(bin * 2 AS DOUBLE) AS bin_lo, CAST(bin * 2 + 2 AS DOUBLE) AS bin_hi,
  count(*) / (any_value(total) * 2.0) AS density
FROM (SELECT cancelled, CAST(least(floor(least(total_flights, 60) / 2.0), 29) AS INTEGER) AS bin,
        count(*) OVER (PARTITION BY cancelled) AS total FROM cust_flights WHERE total_flights IS NOT NULL) GROUP BY cancelled, bin"""),
    doubles="bin_lo bin_hi density")
def histogram_by_status(L):
    """Overlaid density histograms of member flights (0..60) by status."""
    cf = L.customer_flights.withColumn("flights_capped", F.least(F.col("total_flights"), F.lit(60)))
    return G.histogram(cf, "flights_capped", 30, name="flights", group="cancelled", density=True, lo=0, hi=60)


BOX = [("clv", "loyalty_card"), ("salary", "loyalty_card"), ("engagement", "loyalty_card")]


def _box_sql(value, group):
    return f"""SELECT '{value}' AS variable, q.{group} AS grp, n, q1, median, q3,
  min(CASE WHEN v >= lo_f AND v <= hi_f THEN v END) AS whisker_lo,
  max(CASE WHEN v >= lo_f AND v <= hi_f THEN v END) AS whisker_hi,
  CAST(count_if(NOT (v >= lo_f AND v <= hi_f)) AS BIGINT) AS outliers
FROM (SELECT {group}, {value} AS v FROM customers WHERE {value} IS NOT NULL) d
JOIN (SELECT {group}, CAST(count(*) AS BIGINT) AS n, quantile_cont({value}, 0.25) AS q1,
        quantile_cont({value}, 0.5) AS median, quantile_cont({value}, 0.75) AS q3,
        quantile_cont({value}, 0.25) - 1.5 * (quantile_cont({value}, 0.75) - quantile_cont({value}, 0.25)) AS lo_f,
        quantile_cont({value}, 0.75) + 1.5 * (quantile_cont({value}, 0.75) - quantile_cont({value}, 0.25)) AS hi_f
      FROM customers WHERE {value} IS NOT NULL GROUP BY {group}) q ON d.{group} = q.{group}
GROUP BY q.{group}, n, q1, median, q3"""


@register("box_stats", query(U([_box_sql(v, g) for v, g in BOX])),
          doubles="q1 median q3 whisker_lo whisker_hi", digits=8)
def box_stats(L):
    """Box summary of CLV, salary and engagement per tier."""
    return _union([G.box_stats(L.customers, v, g)
                   .select(F.lit(v).alias("variable"), F.col(g).alias("grp"), "n", "q1", "median", "q3",
                           "whisker_lo", "whisker_hi", "outliers") for v, g in BOX])


@register("kde", query("""
SELECT CAST(g.i AS INTEGER) AS point, q0 + g.i * step AS x, sum(exp(-0.5 * power((q0 + g.i * step - clv) / bw, 2))) / (any_value(n) * any_value(bw) * sqrt(2 * pi())) AS density
FROM (SELECT unnest(range(300)) AS i) g, k, (SELECT clv FROM members WHERE clv IS NOT NULL) m GROUP BY g.i, q0, step, bw""",
    "k AS (SELECT quantile_cont(clv, 0.01) AS q0, (quantile_cont(clv, 0.99) - quantile_cont(clv, 0.01)) / 299 AS step, "
    "count(clv) AS n, stddev_samp(clv) * power(count(clv), -0.2) AS bw FROM members)"), doubles="x density", digits=9)
def kde(L):
    """Gaussian KDE of member CLV on 300 points, over all members."""
    return G.kde(L.members, "clv")


@register("flight_segment", query("""
SELECT CASE WHEN total_flights <= 2 THEN 'Low' WHEN total_flights <= 6 THEN 'Medium' ELSE 'High' END AS flight_segment,
  CAST(count(*) AS BIGINT) AS rows FROM master GROUP BY 1"""))
def flight_segment(L):
    """Flight-frequency rule on member-months."""
    return FE.row_features(L.master).groupBy("flight_segment").agg(F.count(F.lit(1)).alias("rows"))


def _persona_sql(inclusive):
    ge, le, red, lab = (">=", "<=", ">= 0.30", "At Risk Members") if inclusive else (">", "<", "> 0.3",
                                                                                      "At-Risk Members")
    return f"""persona_t AS (
  SELECT c.*, CASE
    WHEN coalesce(clv {ge} qc, FALSE) AND coalesce(total_flights {ge} qf3, FALSE) AND coalesce(redemption_rate {red}, FALSE)
      THEN 'Champions'
    WHEN coalesce(clv {ge} qc, FALSE) AND coalesce(total_flights {ge} qf3, FALSE) THEN 'Loyal Customers'
    WHEN coalesce(clv {ge} qc, FALSE) AND coalesce(active_months < 3, FALSE) THEN 'Dormant High Value'
    WHEN NOT coalesce(clv {ge} qc, FALSE) AND coalesce(total_flights {ge} qf3, FALSE) AND coalesce(active_months < 3, FALSE)
      THEN '{lab}'
    WHEN coalesce(total_flights {le} qf1, FALSE) AND NOT coalesce(active_months < 3, FALSE) THEN 'Casual Travelers'
    ELSE 'Frequent Flyers' END AS persona
  FROM {'cfd' if inclusive else 'cust_flights'} c, (SELECT quantile_cont(clv, 0.75) AS qc,
    quantile_cont(total_flights, 0.25) AS qf1, quantile_cont(total_flights, 0.75) AS qf3
    FROM {'cfd' if inclusive else 'cust_flights'}) q)"""


_CFD = """cfd AS (
  SELECT t.*, p.salary, p.loyalty_card, p.education, p.gender, p.marital_status,
    CASE WHEN t.total_points = 0 THEN 0.0 ELSE t.points_redeemed / t.total_points END AS redemption_rate
  FROM (SELECT member_id, CAST(sum(total_flights) AS BIGINT) AS total_flights,
          CAST(sum(distance) AS BIGINT) AS total_distance, CAST(sum(points_accumulated) AS BIGINT) AS total_points,
          CAST(sum(points_redeemed) AS BIGINT) AS points_redeemed, first(clv) AS clv,
          first(cancelled) AS cancelled, CAST(count(DISTINCT month) AS BIGINT) AS active_months
        FROM master GROUP BY member_id) t
  LEFT JOIN (SELECT DISTINCT member_id, salary, loyalty_card, education, gender, marital_status FROM master) p
    ON p.member_id = t.member_id)"""


@register("persona", query("SELECT persona, CAST(count(*) AS BIGINT) AS members FROM persona_t GROUP BY persona",
                           _persona_sql(False)))
def persona(L):
    """Strict persona rule (member grain, flights > 0 months)."""
    return G.persona(L.customer_flights).groupBy("persona").agg(F.count(F.lit(1)).alias("members"))


@register("persona_incl", query("SELECT persona, CAST(count(*) AS BIGINT) AS members FROM persona_t GROUP BY persona",
                                _CFD, _persona_sql(True)))
def persona_incl(L):
    """Inclusive persona rule (distinct-month activity)."""
    return G.persona(L.customer_flights_distinct, inclusive=True).groupBy("persona").agg(
        F.count(F.lit(1)).alias("members"))


def _persona_profile_sql(inclusive):
    canc = "avg(cancelled) * 100.0" if inclusive else "avg(cancelled)"
    return f"""SELECT persona, CAST(count(*) AS BIGINT) AS members, {RA('clv')} AS avg_clv,
  avg(total_flights) AS avg_flights, {RA('redemption_rate')} AS avg_redemption, avg(active_months) AS avg_active_months,
  {canc} AS cancelled_rate, count(*) * 100.0 / (SELECT count(*) FROM persona_t) AS member_pct
FROM persona_t GROUP BY persona"""


@register("persona_profile", query(_persona_profile_sql(False), _persona_sql(False)),
          doubles="avg_clv avg_flights avg_redemption avg_active_months cancelled_rate member_pct", digits=4)
def persona_profile(L):
    """Strict persona profile."""
    return G.persona_profile(G.persona(L.customer_flights))


@register("persona_profile_incl", query(_persona_profile_sql(True), _CFD, _persona_sql(True)),
          doubles="avg_clv avg_flights avg_redemption avg_active_months cancelled_rate member_pct", digits=4)
def persona_profile_incl(L):
    """Inclusive persona profile (cancellation in %)."""
    return G.persona_profile(G.persona(L.customer_flights_distinct, inclusive=True), inclusive=True)


# ---------------------------------------------------------------- H1-H16 ---

_FEAT_ROWS = """feat_rows AS (
  SELECT m.*,
    CASE WHEN CAST(year AS BIGINT) - enrollment_year < 0 THEN 0 ELSE CAST(year AS BIGINT) - enrollment_year END AS tenure,
    CASE WHEN (CAST(year AS BIGINT) * 12 + month) - (enrollment_year * 12 + enrollment_month) < 0 THEN 0
      ELSE (CAST(year AS BIGINT) * 12 + month) - (enrollment_year * 12 + enrollment_month) END AS membership_age_months,
    points_redeemed / (points_accumulated + 1) AS redemption_ratio,
    distance / (total_flights + 1) AS avg_distance_per_flight,
    points_accumulated / (total_flights + 1) AS points_per_flight,
    dollar_cost_points_redeemed / (points_redeemed + 1) AS redeemed_cost_per_point,
    CAST(loyalty_card IN ('Aurora', 'Nova') AS BIGINT) AS premium_customer,
    CASE WHEN total_flights <= 2 THEN 'Low' WHEN total_flights <= 6 THEN 'Medium' ELSE 'High' END AS flight_segment,
    CASE WHEN clv <= (SELECT quantile_cont(clv, 0.25) FROM master) THEN 'Low'
      WHEN clv <= (SELECT quantile_cont(clv, 0.5) FROM master) THEN 'Medium'
      WHEN clv <= (SELECT quantile_cont(clv, 0.75) FROM master) THEN 'High' WHEN clv IS NOT NULL THEN 'VIP' END
      AS clv_segment
  FROM master m)"""

ROW_FEATS = ["tenure", "membership_age_months", "redemption_ratio", "avg_distance_per_flight", "points_per_flight",
             "redeemed_cost_per_point", "premium_customer", "flight_segment", "clv_segment"]


@register("feat_row", query("SELECT member_id, year, month, " + ", ".join(ROW_FEATS) + " FROM feat_rows", _FEAT_ROWS),
          doubles="redemption_ratio avg_distance_per_flight points_per_flight redeemed_cost_per_point")
def feat_row(L):
    """Row features of the member-month table."""
    return FE.row_features(L.master).select("member_id", "year", "month", *ROW_FEATS)


def _scale_sql(c):
    s = (f"(1.0 / CASE WHEN (SELECT max(CAST({c} AS DOUBLE)) - min(CAST({c} AS DOUBLE)) FROM feat_rows) = 0 THEN 1.0 "
         f"ELSE (SELECT max(CAST({c} AS DOUBLE)) - min(CAST({c} AS DOUBLE)) FROM feat_rows) END)")
    return f"CAST({c} AS DOUBLE) * {s} + (-(SELECT min(CAST({c} AS DOUBLE)) FROM feat_rows) * {s})"


_FEAT_SCALED = f"""feat_scaled AS (
  SELECT member_id, year, month, tenure, points_redeemed, clv, {_scale_sql('total_flights')} AS total_flights,
    {_scale_sql('distance')} AS distance, {_scale_sql('redemption_ratio')} AS redemption_ratio FROM feat_rows)"""


@register("feat_scaled", query("""
SELECT member_id, year, month, total_flights, distance, redemption_ratio,
  0.4 * total_flights + 0.3 * distance + 0.3 * redemption_ratio AS engagement_score,
  distance / (tenure + 1) AS travel_intensity, points_redeemed / (clv + 1) AS reward_dependency,
  clv / (total_flights + 1) AS loyalty_efficiency FROM feat_scaled""", _FEAT_ROWS, _FEAT_SCALED),
    doubles="total_flights distance redemption_ratio engagement_score travel_intensity reward_dependency "
            "loyalty_efficiency")
def feat_scaled(L):
    """H6-H7: min-max scaled columns and the composite scores built on them."""
    return FE.scaled_features(FE.row_features(L.master)).select(
        "member_id", "year", "month", "total_flights", "distance", "redemption_ratio", "engagement_score",
        "travel_intensity", "reward_dependency", "loyalty_efficiency")


@register("freq_encode", query("""
SELECT member_id, year, month, city, province, country,
  count(*) OVER (PARTITION BY city) / CAST((SELECT count(*) FROM master) AS DOUBLE) AS city_fe,
  count(*) OVER (PARTITION BY province) / CAST((SELECT count(*) FROM master) AS DOUBLE) AS province_fe,
  count(*) OVER (PARTITION BY country) / CAST((SELECT count(*) FROM master) AS DOUBLE) AS country_fe
FROM master"""), doubles="city_fe province_fe country_fe")
def freq_encode(L):
    """H8: frequency encoding of city, province, country."""
    return FE.frequency_encode(L.master.select("member_id", "year", "month", "city", "province", "country"),
                               ["city", "province", "country"])


_DUMMIES = [(c, v) for c, lv in FE.ONE_HOT_LEVELS.items() for v in lv[1:]]


@register("one_hot", query("SELECT member_id, year, month, " + ", ".join(
    f"CAST({c} = '{v}' AS BIGINT) AS \"{FE.dummy_name(c, v)}\"" for c, v in _DUMMIES) + " FROM feat_rows", _FEAT_ROWS))
def one_hot(L):
    """H9: one-hot columns with the first level dropped."""
    rows = FE.row_features(L.master).select("member_id", "year", "month", *FE.ONE_HOT_LEVELS)
    return FE.one_hot_drop_first(rows)


@register("feature_table")
def feature_table(L):
    """H1-H9: the complete engineered member-month table."""
    return FE.feature_table(L.master)


@register("engagement_score", query("""
SELECT member_id, year, month, flight_frequency_index, redemption_rate, engagement_score, loyalty_efficiency_score
FROM activity"""), doubles="flight_frequency_index redemption_rate engagement_score loyalty_efficiency_score")
def engagement_score(L):
    """Dashboard engagement and efficiency scores per member-month."""
    return L.activity.select("member_id", "year", "month", "flight_frequency_index", "redemption_rate",
                             "engagement_score", "loyalty_efficiency_score")


@register("churn_risk_score", query("""
SELECT member_id, revenue_per_customer, redemption_rate, churn_risk_score FROM customers"""),
    doubles="revenue_per_customer redemption_rate churn_risk_score")
def churn_risk_score(L):
    """Member ratios and the rule-based churn risk score."""
    return L.customers.select("member_id", "revenue_per_customer", "redemption_rate", "churn_risk_score")


def _ls_part(c):
    return (f"(CAST({c} AS DOUBLE) - (SELECT min(CAST({c} AS DOUBLE)) FROM activity)) / "
            f"(CASE WHEN (SELECT max(CAST({c} AS DOUBLE)) - min(CAST({c} AS DOUBLE)) FROM activity) = 0 THEN 1.0 "
            f"ELSE (SELECT max(CAST({c} AS DOUBLE)) - min(CAST({c} AS DOUBLE)) FROM activity) END)")


@register("loyalty_score", query("SELECT member_id, year, month, round((" + " + ".join(
    _ls_part(c) for c in ["total_flights", "distance", "points_accumulated", "clv"]) + ") / 4 * 100, 2) AS loyalty_score "
    "FROM activity"), doubles="loyalty_score")
def loyalty_score(L):
    """0..100 loyalty score (mean of four min-max columns)."""
    return FE.loyalty_score(L.activity).select("member_id", "year", "month", "loyalty_score")


# ---------------------------------------------------------------- J1-J3 ----

@register("treemap_rollup", query(f"""
SELECT 'Canada' AS root, province, loyalty_card,
  2 - (CASE WHEN GROUPING(province) = 1 THEN 1 ELSE 0 END) - (CASE WHEN GROUPING(loyalty_card) = 1 THEN 1 ELSE 0 END)
    AS depth, {RS('total_revenue')} AS revenue, CAST(count(*) AS BIGINT) AS customers
FROM customers GROUP BY ROLLUP (province, loyalty_card)"""), doubles="revenue", digits=4)
def treemap_rollup(L):
    """All -> province -> tier revenue and customers."""
    return H.rollup_totals(L.customers, ["province", "loyalty_card"], root="Canada")


def _sunburst_sql(first):
    return f"""SELECT 'All' AS root, {first}, loyalty_card,
  2 - (CASE WHEN GROUPING({first}) = 1 THEN 1 ELSE 0 END) - (CASE WHEN GROUPING(loyalty_card) = 1 THEN 1 ELSE 0 END)
    AS depth, {RS('total_revenue')} AS revenue
FROM customers GROUP BY ROLLUP ({first}, loyalty_card)"""


@register("sunburst_education", query(_sunburst_sql("education")), doubles="revenue", digits=4)
def sunburst_education(L):
    """Education -> tier revenue."""
    return H.rollup_totals(L.customers, ["education", "loyalty_card"], with_customers=False)


@register("sunburst_marital", query(_sunburst_sql("marital_status")), doubles="revenue", digits=4)
def sunburst_marital(L):
    """Marital status -> tier revenue."""
    return H.rollup_totals(L.customers, ["marital_status", "loyalty_card"], with_customers=False)


@register("sankey_edges", query("""
WITH nodes AS (
  SELECT node, grp, CAST(row_number() OVER (ORDER BY grp, node) - 1 AS INTEGER) AS node_id FROM (
    SELECT DISTINCT education AS node, 0 AS grp FROM customers WHERE education IS NOT NULL
    UNION SELECT DISTINCT loyalty_card, 1 FROM customers WHERE loyalty_card IS NOT NULL
    UNION SELECT 'Active', 2 UNION SELECT 'Cancelled', 3)),
edges AS (
  SELECT 1 AS layer, education AS source, loyalty_card AS target, CAST(count(*) AS BIGINT) AS value, 0 AS sg, 1 AS tg
  FROM customers GROUP BY education, loyalty_card
  UNION ALL
  SELECT 2, loyalty_card, CASE WHEN cancelled = 1 THEN 'Cancelled' ELSE 'Active' END, CAST(count(*) AS BIGINT), 1,
    CASE WHEN cancelled = 1 THEN 3 ELSE 2 END
  FROM customers WHERE cancelled IN (0, 1) GROUP BY 2, 3, 6)
SELECT layer, source, target, value, s.node_id AS source_id, t.node_id AS target_id
FROM edges e JOIN nodes s ON s.node = e.source AND s.grp = e.sg JOIN nodes t ON t.node = e.target AND t.grp = e.tg""",
    ).replace("\nWITH nodes AS (", ",\nnodes AS ("))
def sankey_edges(L):
    """Education -> tier -> status flows with node ids."""
    return H.sankey_edges(L.customers)


# ---------------------------------------------------------------- X1-X7 ----

_RFM = """rfm_t AS (
  SELECT member_id, (SELECT max(CAST(year AS INTEGER) * 12 + month) FROM master) - last_active_idx AS recency_months,
    total_flights / CAST(months AS DOUBLE) AS flights_per_month, active_months / CAST(months AS DOUBLE) AS active_ratio,
    clv + dollars AS monetary, clv, loyalty_card
  FROM (SELECT member_id, max(CASE WHEN total_flights > 0 THEN CAST(year AS INTEGER) * 12 + month END) AS last_active_idx,
          sum(total_flights) AS total_flights, count(*) AS months, count_if(total_flights > 0) AS active_months,
          first(clv) AS clv, CAST(sum(CAST(dollar_cost_points_redeemed AS DECIMAL(38,2))) AS DOUBLE) AS dollars,
          first(loyalty_card) AS loyalty_card
        FROM master GROUP BY member_id))"""


@register("rfm", query("SELECT * FROM rfm_t", _RFM), doubles="flights_per_month active_ratio monetary clv")
def rfm(L):
    """Recency, frequency, monetary per member."""
    return FE.rfm(L.master)


@register("activity_growth", query("""
SELECT member_id, CAST(first_flights AS BIGINT) AS first_flights, CAST(last_flights AS BIGINT) AS last_flights,
  (last_flights - first_flights) / CAST(nullif(first_flights, 0) AS DOUBLE) AS activity_growth
FROM (SELECT member_id, sum(CASE WHEN CAST(year AS INTEGER) * 12 + month < lo + 6 THEN total_flights ELSE 0 END) AS first_flights,
        sum(CASE WHEN CAST(year AS INTEGER) * 12 + month > hi - 6 THEN total_flights ELSE 0 END) AS last_flights
      FROM master, (SELECT min(CAST(year AS INTEGER) * 12 + month) AS lo, max(CAST(year AS INTEGER) * 12 + month) AS hi
                    FROM master) b GROUP BY member_id)"""), doubles="activity_growth")
def activity_growth(L):
    """Last-6 vs first-6 month flight growth per member."""
    return FE.activity_growth(L.master)


@register("rolling_activity", query("""
SELECT member_id, year, month, total_flights, CAST(sum(total_flights) OVER (PARTITION BY member_id
  ORDER BY CAST(year AS INTEGER) * 12 + month RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS rolling_3m_flights
FROM master"""))
def rolling_activity(L):
    """Rolling 3-calendar-month flights per member."""
    return FE.rolling_activity(L.master)


@register("seasonal_ratio", query("""
SELECT member_id, CAST(summer_flights AS BIGINT) AS summer_flights, CAST(total_flights AS BIGINT) AS total_flights,
  summer_flights / CAST(nullif(total_flights, 0) AS DOUBLE) AS seasonal_ratio
FROM (SELECT member_id, sum(CASE WHEN month IN (6, 7, 8) THEN total_flights ELSE 0 END) AS summer_flights,
        sum(total_flights) AS total_flights FROM master GROUP BY member_id)"""), doubles="seasonal_ratio")
def seasonal_ratio(L):
    """Summer share of flights per member."""
    return FE.seasonal_ratio(L.master)


@register("interaction_features", query("""
SELECT r.member_id, r.clv * r.recency_months AS clv_x_recency,
  CASE r.loyalty_card WHEN 'Star' THEN 1 WHEN 'Nova' THEN 2 WHEN 'Aurora' THEN 3 END * r.flights_per_month
    AS card_x_frequency,
  CAST(p.acc > (SELECT median(acc) FROM pts) AND p.red = 0 AS BIGINT) AS hoarding_flag
FROM rfm_t r JOIN pts p ON p.member_id = r.member_id""", _RFM,
    "pts AS (SELECT member_id, sum(points_accumulated) AS acc, sum(points_redeemed) AS red FROM master GROUP BY 1)"),
    doubles="clv_x_recency card_x_frequency")
def interaction_features(L):
    """CLV x recency, tier x frequency, points-hoarding flag."""
    return FE.interaction_features(L.master)


# ---------------------------------------------------- C17-C21, A3 ----------

@register("filter_customers", query("""
SELECT * FROM customers
WHERE loyalty_card IN ('Star', 'Nova', 'Aurora') AND gender IN ('Female', 'Male')
  AND education IN ('High School or Below', 'College', 'Bachelor', 'Master', 'Doctor')
  AND province IN (SELECT province FROM customers GROUP BY province ORDER BY count(*) DESC, province LIMIT 5)
  AND clv BETWEEN (SELECT min(clv) FROM customers) AND (SELECT max(clv) FROM customers)
  AND salary BETWEEN (SELECT min(salary) FROM customers) AND (SELECT max(salary) FROM customers)"""),
    doubles="total_revenue clv salary engagement efficiency revenue_per_customer redemption_rate churn_risk_score")
def filter_customers(L):
    """C17: the six-way sidebar filter with its defaults (all tiers, genders,
    educations, top-5 provinces by members, full CLV and salary ranges)."""
    from ..operators.filters import customer_filter
    return customer_filter(L.customers)


@register("customer_lookup", query("""
SELECT * FROM customers WHERE member_id = (SELECT min(member_id) FROM customers WHERE loyalty_card = 'Aurora')"""),
    doubles="total_revenue clv salary engagement efficiency revenue_per_customer redemption_rate churn_risk_score")
def customer_lookup(L):
    """Single-member lookup (the first Aurora member)."""
    first = L.customers.filter(F.col("loyalty_card") == "Aurora").select(F.min("member_id")).scalar()
    return L.customers.filter(F.col("member_id") == first)


@register("winsorize", query("""
SELECT member_id, CAST(least(greatest(total_flights, 0), 60) AS BIGINT) AS flights_0_60,
  least(greatest(CAST(total_distance AS DOUBLE), (SELECT quantile_cont(total_distance, 0.01) FROM cust_flights)),
        (SELECT quantile_cont(total_distance, 0.99) FROM cust_flights)) AS distance_p1_p99
FROM cust_flights"""), doubles="distance_p1_p99")
def winsorize(L):
    """Clip to a fixed range (0..60) and to the column's own p1..p99."""
    cf = L.customer_flights
    from ..functions.ranking import quantile_array
    q = quantile_array(cf, "total_distance", [0.01, 0.99])
    return cf.select("member_id", F.least(F.greatest(F.col("total_flights"), F.lit(0)), F.lit(60))
                     .alias("flights_0_60"),
                     F.least(F.greatest(F.col("total_distance").cast("double"), q[0]), q[1]).alias("distance_p1_p99"))


@register("tier_number", query("""
SELECT member_id, loyalty_card, CASE loyalty_card WHEN 'Star' THEN 1 WHEN 'Nova' THEN 2 WHEN 'Aurora' THEN 3 END
  AS card_num FROM members"""))
def tier_number_q(L):
    """C20: tier as an ordinal number."""
    return L.members.select("member_id", "loyalty_card", tier_number("loyalty_card").alias("card_num"))


_CUSTOMER_DOUBLES = "total_revenue clv salary engagement efficiency revenue_per_customer redemption_rate churn_risk_score"
_FILTERED = """
SELECT * FROM customers
WHERE loyalty_card IN ('Star', 'Nova', 'Aurora') AND gender IN ('Female', 'Male')
  AND education IN ('High School or Below', 'College', 'Bachelor', 'Master', 'Doctor')
  AND province IN (SELECT province FROM customers GROUP BY province ORDER BY count(*) DESC, province LIMIT 5)
  AND clv BETWEEN (SELECT min(clv) FROM customers) AND (SELECT max(clv) FROM customers)
  AND salary BETWEEN (SELECT min(salary) FROM customers) AND (SELECT max(salary) FROM customers)"""


def _as_one_file(df, name, order):
    """``df`` written as one CSV file and read back."""
    from ..sources import files
    path = files.write_one_csv(df, files.scratch_dir(df.sparkSession, name) + f"/{name}.csv", order)
    return df.sparkSession.read.schema(df.schema).option("header", True).csv(path)


@register("extract_customer_summary", query("SELECT * FROM customers"), doubles=_CUSTOMER_DOUBLES)
def extract_customer_summary(L):
    """A3: the customer summary, all columns, as one CSV file by member, read back."""
    return _as_one_file(L.customers, "customer_summary", ["member_id"])


@register("extract_filtered_customers", query(_FILTERED), doubles=_CUSTOMER_DOUBLES)
def extract_filtered_customers(L):
    """A3: the customers that the sidebar filter keeps, as one CSV file by member, read back."""
    from ..operators.filters import customer_filter
    return _as_one_file(customer_filter(L.customers).select(*L.customers.columns), "filtered_customers", ["member_id"])


@register("extract_revenue_summary", query(f"""
SELECT province, loyalty_card, {RS('total_revenue')} AS revenue, CAST(count(*) AS BIGINT) AS customers
FROM customers GROUP BY province, loyalty_card"""), doubles="revenue")
def extract_revenue_summary(L):
    """A3: revenue summary written as CSV to the shared folder and read back."""
    from ..sources import files
    df = L.customers.groupBy("province", "loyalty_card").agg(esum("total_revenue").alias("revenue"),
                                                             F.count(F.lit(1)).alias("customers"))
    path = files.scratch_dir(L.spark, "revenue_summary")
    files.write_csv(df, path)
    return L.spark.read.schema("province string, loyalty_card string, revenue double, customers long") \
        .option("header", True).csv(path)

