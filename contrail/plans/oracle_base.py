"""Independent SQL definition of the base layers, for the DuckDB oracle.

Written from the semantics (not generated from the Spark plans) so the two
engines cross-check each other.  ``base(*extra)`` returns a ``WITH`` prefix
holding every layer; each oracle query appends its own CTEs and SELECT.
"""

from __future__ import annotations

ADAPTER = """
ord AS (
  SELECT o_custkey,
    CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE)/100 AS clv,
    min(o_orderdate) AS first_dt, max(o_orderdate) AS last_dt
  FROM orders GROUP BY o_custkey),
members_raw AS (
  SELECT c.c_custkey AS member_id, r.r_name AS country, n.n_name AS province,
    concat(n.n_name,'_C',CAST(c.c_custkey % 3 AS VARCHAR)) AS city,
    CASE WHEN c.c_custkey % 2 = 0 THEN ' female' ELSE 'MALE ' END AS gender,
    CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 'High School or Below' WHEN 'BUILDING' THEN 'College'
      WHEN 'FURNITURE' THEN 'Bachelor' WHEN 'HOUSEHOLD' THEN 'Master' ELSE 'Doctor' END AS education,
    CASE WHEN c.c_mktsegment = 'BUILDING' THEN NULL
      ELSE CAST(CAST(c.c_acctbal AS DECIMAL(18,2))*12 AS DOUBLE) END AS salary,
    CASE c.c_custkey % 3 WHEN 0 THEN 'Married' WHEN 1 THEN 'Single' ELSE 'Divorced' END AS marital_status,
    CASE WHEN c.c_acctbal >= 7500 THEN 'Aurora' WHEN c.c_acctbal >= 4000 THEN 'Nova' ELSE 'Star' END AS loyalty_card,
    o.clv AS clv,
    CAST(year(o.first_dt) + CASE WHEN c.c_custkey % 4 = 0 THEN 1 ELSE 0 END AS BIGINT) AS enrollment_year,
    CAST(month(o.first_dt) AS BIGINT) AS enrollment_month,
    CAST(CASE WHEN o.last_dt < TIMESTAMP '2000-07-01 00:00:00' THEN year(o.last_dt) END AS BIGINT) AS cancellation_year,
    CAST(CASE WHEN o.last_dt < TIMESTAMP '2000-07-01 00:00:00' THEN month(o.last_dt) END AS BIGINT) AS cancellation_month
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
    JOIN region r ON n.n_regionkey = r.r_regionkey LEFT JOIN ord o ON o.o_custkey = c.c_custkey),
li AS (
  SELECT l_orderkey, count(*) AS n, CAST(sum(l_quantity)*10 AS BIGINT) AS dist,
    sum(CAST(floor(l_extendedprice/100) AS BIGINT)) AS acc,
    sum(CASE WHEN l_returnflag='R' AND l_linestatus='F'
      THEN 2*CAST(floor(l_extendedprice/100) AS BIGINT) ELSE 0 END) AS red
  FROM lineitem GROUP BY l_orderkey),
act AS (
  SELECT o.o_custkey AS member_id, CAST(year(o.o_orderdate) AS INTEGER) AS year,
    CAST(month(o.o_orderdate) AS INTEGER) AS month,
    CAST(coalesce(l.n,0) AS BIGINT) AS total_flights, CAST(coalesce(l.dist,0) AS BIGINT) AS distance,
    CAST(coalesce(l.acc,0) AS BIGINT) AS points_accumulated, CAST(coalesce(l.red,0) AS BIGINT) AS points_redeemed,
    CAST(coalesce(l.red,0) AS DOUBLE)/100 AS dollar_cost_points_redeemed
  FROM orders o LEFT JOIN li l ON l.l_orderkey = o.o_orderkey),
activity_raw AS (SELECT * FROM act UNION ALL SELECT * FROM act WHERE member_id % 50 = 0)"""

CLEAN = """
members_clean AS (
  SELECT member_id, trim(country) AS country, trim(province) AS province, trim(city) AS city,
    concat(upper(substr(trim(gender),1,1)), lower(substr(trim(gender),2))) AS gender,
    trim(education) AS education,
    abs(nullif(CASE WHEN education = 'College' AND salary IS NULL THEN 0.0 ELSE salary END, 0.0)) AS salary,
    CAST(salary IS NULL AS BIGINT) AS salary_college,
    trim(marital_status) AS marital_status, trim(loyalty_card) AS loyalty_card, clv,
    enrollment_year, enrollment_month, cancellation_year, cancellation_month,
    CAST(cancellation_year IS NOT NULL AND cancellation_month IS NOT NULL AS BIGINT) AS cancelled
  FROM members_raw),
members AS (
  SELECT member_id, country, province, city, gender, education, salary, salary_college, marital_status,
    loyalty_card, clv, enrollment_year, enrollment_month, cancelled FROM members_clean),
activity_dedup AS (SELECT DISTINCT * FROM activity_raw),
activity_monthly AS (
  SELECT member_id, year, month,
    CAST(sum(total_flights) AS BIGINT) AS total_flights, CAST(sum(distance) AS BIGINT) AS distance,
    CAST(sum(points_accumulated) AS BIGINT) AS points_accumulated,
    CAST(sum(points_redeemed) AS BIGINT) AS points_redeemed,
    CAST(sum(CAST(dollar_cost_points_redeemed AS DECIMAL(18,2))) AS DOUBLE) AS dollar_cost_points_redeemed
  FROM activity_dedup GROUP BY member_id, year, month),
activity_final AS (
  SELECT member_id, CAST(year AS SMALLINT) AS year, CAST(month AS TINYINT) AS month, total_flights, distance,
    points_accumulated, points_redeemed, dollar_cost_points_redeemed FROM activity_monthly),
master AS (
  SELECT a.member_id, a.year, a.month, a.total_flights, a.distance, a.points_accumulated, a.points_redeemed,
    a.dollar_cost_points_redeemed, m.country, m.province, m.city, m.gender, m.education,
    coalesce(m.salary, 0.0) AS salary, m.salary_college, m.marital_status, m.loyalty_card, m.clv,
    m.enrollment_year, m.enrollment_month, m.cancelled
  FROM activity_final a LEFT JOIN members m ON a.member_id = m.member_id),
act_kept AS (SELECT * FROM master WHERE clv IS NOT NULL AND member_id IS NOT NULL AND salary IS NOT NULL),
act_max AS (SELECT max(points_accumulated) AS mx FROM act_kept),
act_rr AS (
  SELECT k.*,
    CASE WHEN points_accumulated > 0 THEN points_redeemed / points_accumulated ELSE 0.0 END AS rr0,
    ln(1 + total_flights) AS ffi,
    CAST((CAST(year AS BIGINT) - enrollment_year) * 12 + (CAST(month AS BIGINT) - enrollment_month) AS BIGINT) AS dur
  FROM act_kept k),
activity AS (
  SELECT member_id, year, month, total_flights, distance, points_accumulated, points_redeemed,
    dollar_cost_points_redeemed, country, province, city, gender, education, salary, salary_college,
    marital_status, loyalty_card, clv, enrollment_year, enrollment_month, cancelled,
    make_date(CAST(year AS BIGINT), CAST(month AS BIGINT), 1) AS date,
    clv / 12 + dollar_cost_points_redeemed AS revenue,
    points_accumulated - points_redeemed AS points_balance,
    CASE WHEN rr0 < 0 THEN 0.0 WHEN rr0 > 1 THEN 1.0 ELSE rr0 END AS redemption_rate,
    ffi AS flight_frequency_index,
    round(0.4 * ffi + 0.3 * ((CASE WHEN rr0 < 0 THEN 0.0 WHEN rr0 > 1 THEN 1.0 ELSE rr0 END) * 10)
      + 0.3 * (points_accumulated / CAST(coalesce(nullif((SELECT mx FROM act_max), 0), 1) AS DOUBLE) * 10), 2)
      AS engagement_score,
    round(points_accumulated / CAST(coalesce(nullif(distance, 0), 1) AS DOUBLE), 4) AS loyalty_efficiency_score,
    CASE WHEN dur < 0 THEN 0 ELSE dur END AS enrollment_duration,
    CASE WHEN salary >= 0 AND salary < 40000 THEN '< $40K'
      WHEN salary >= 40000 AND salary < 70000 THEN '$40K–$70K'
      WHEN salary >= 70000 AND salary < 100000 THEN '$70K–$100K'
      WHEN salary >= 100000 AND salary < 150000 THEN '$100K–$150K'
      WHEN salary >= 150000 AND salary < 1000000 THEN '$150K+' END AS salary_group,
    CASE WHEN cancelled = 1 THEN 'Cancelled' ELSE 'Active' END AS status
  FROM act_rr),
cs_grp AS (
  SELECT member_id,
    CAST(sum(total_flights) AS BIGINT) AS total_flights, CAST(sum(distance) AS BIGINT) AS total_distance,
    CAST(sum(points_accumulated) AS BIGINT) AS total_points, CAST(sum(points_redeemed) AS BIGINT) AS points_redeemed,
    CAST(sum(CAST(revenue AS DECIMAL(38,10))) AS DOUBLE) AS total_revenue,
    CAST(sum(CAST(clv AS DECIMAL(38,4))) AS DOUBLE) / count(clv) AS clv,
    CAST(sum(CAST(salary AS DECIMAL(38,2))) AS DOUBLE) / count(salary) AS salary,
    CAST(sum(CAST(engagement_score AS DECIMAL(38,2))) AS DOUBLE) / count(engagement_score) AS engagement,
    CAST(sum(CAST(loyalty_efficiency_score AS DECIMAL(38,4))) AS DOUBLE) / count(loyalty_efficiency_score) AS efficiency,
    first(gender) AS gender, first(education) AS education, first(province) AS province, first(city) AS city,
    first(loyalty_card) AS loyalty_card, first(marital_status) AS marital_status,
    first(salary_group) AS salary_group, first(enrollment_year) AS enrollment_yr,
    max(cancelled) AS cancelled, max(enrollment_duration) AS months_active
  FROM activity GROUP BY member_id),
cs_rates AS (
  SELECT g.*,
    total_revenue / CASE WHEN total_flights = 0 THEN 1 ELSE total_flights END AS revenue_per_customer,
    CASE WHEN points_redeemed / CASE WHEN total_points = 0 THEN 1 ELSE total_points END > 1 THEN 1.0
      WHEN points_redeemed / CASE WHEN total_points = 0 THEN 1 ELSE total_points END < 0 THEN 0.0
      ELSE points_redeemed / CASE WHEN total_points = 0 THEN 1 ELSE total_points END END AS redemption_rate
  FROM cs_grp g),
cs_risk AS (
  SELECT r.*,
    (1 - redemption_rate) * 0.4
      + (1 - CAST(total_flights AS DOUBLE) / nullif((SELECT max(total_flights) FROM cs_rates), 0)) * 0.35
      + cancelled * 0.25 AS risk0
  FROM cs_rates r),
cs_edges AS (
  SELECT quantile_cont(clv, 0.25) AS q1, quantile_cont(clv, 0.5) AS q2, quantile_cont(clv, 0.75) AS q3
  FROM cs_risk),
customers AS (
  SELECT member_id, total_flights, total_distance, total_points, points_redeemed, total_revenue, clv, salary,
    engagement, efficiency, gender, education, province, city, loyalty_card, marital_status, salary_group,
    enrollment_yr, cancelled, months_active, revenue_per_customer, redemption_rate,
    round(CASE WHEN risk0 < 0 THEN 0.0 WHEN risk0 > 1 THEN 1.0 ELSE risk0 END, 4) AS churn_risk_score,
    CASE WHEN clv <= (SELECT q1 FROM cs_edges) THEN 'Bronze' WHEN clv <= (SELECT q2 FROM cs_edges) THEN 'Silver'
      WHEN clv <= (SELECT q3 FROM cs_edges) THEN 'Gold' WHEN clv IS NOT NULL THEN 'Platinum' END AS clv_segment
  FROM cs_risk),
cust_flights AS (
  SELECT t.*, m.loyalty_card, m.clv, m.cancelled,
    CASE WHEN t.total_points > 0 THEN least(greatest(t.points_redeemed / t.total_points, 0.0), 1.0) ELSE 0.0 END
      AS redemption_rate
  FROM (SELECT member_id, CAST(sum(total_flights) AS BIGINT) AS total_flights,
          CAST(sum(distance) AS BIGINT) AS total_distance, CAST(sum(points_accumulated) AS BIGINT) AS total_points,
          CAST(sum(points_redeemed) AS BIGINT) AS points_redeemed,
          CAST(count_if(total_flights > 0) AS BIGINT) AS active_months
        FROM master GROUP BY member_id) t
  JOIN members m ON m.member_id = t.member_id),
member_vars AS (
  SELECT coalesce(m.member_id, t.member_id) AS member_id, m.clv, m.salary, t.total_flights, t.distance,
    t.points_accumulated, t.points_redeemed, t.dollar_cost_points_redeemed
  FROM members m FULL JOIN (
    SELECT member_id, CAST(sum(total_flights) AS DOUBLE) AS total_flights, CAST(sum(distance) AS DOUBLE) AS distance,
      CAST(sum(points_accumulated) AS DOUBLE) AS points_accumulated,
      CAST(sum(points_redeemed) AS DOUBLE) AS points_redeemed,
      CAST(sum(CAST(dollar_cost_points_redeemed AS DECIMAL(38,2))) AS DOUBLE) AS dollar_cost_points_redeemed
    FROM master GROUP BY member_id) t ON m.member_id = t.member_id),
member_vars_long AS (
  SELECT 'clv' AS "column", CAST(clv AS DOUBLE) AS value FROM member_vars WHERE clv IS NOT NULL
  UNION ALL SELECT 'salary', salary FROM member_vars WHERE salary IS NOT NULL
  UNION ALL SELECT 'total_flights', total_flights FROM member_vars WHERE total_flights IS NOT NULL
  UNION ALL SELECT 'distance', distance FROM member_vars WHERE distance IS NOT NULL
  UNION ALL SELECT 'points_accumulated', points_accumulated FROM member_vars WHERE points_accumulated IS NOT NULL
  UNION ALL SELECT 'points_redeemed', points_redeemed FROM member_vars WHERE points_redeemed IS NOT NULL
  UNION ALL SELECT 'dollar_cost_points_redeemed', dollar_cost_points_redeemed FROM member_vars
    WHERE dollar_cost_points_redeemed IS NOT NULL)"""


def base(*extra: str) -> str:
    """``WITH`` clause holding every base layer plus the caller's CTEs."""
    parts = [ADAPTER.strip(), CLEAN.strip()] + [e.strip() for e in extra if e.strip()]
    return "WITH " + ",\n".join(parts) + "\n"


def query(select: str, *ctes: str) -> str:
    return base(*ctes) + select.strip()
