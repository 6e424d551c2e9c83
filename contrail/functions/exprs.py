"""Column expressions shared by the operators.

Everything here returns a ``Column`` built from ``pyspark.sql.functions`` so
it stays inside whole-stage codegen.  No Python UDFs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the analysed programme's definitions.
# ---------------------------------------------------------------------------
TIER_ORDER = ["Star", "Nova", "Aurora"]
EDUCATION_ORDER = ["High School or Below", "College", "Bachelor", "Master", "Doctor"]
PREMIUM_CARDS = ["Aurora", "Nova"]
SALARY_BANDS = [  # left-closed [lo, hi)
    (0, 40_000, "< $40K"),
    (40_000, 70_000, "$40K–$70K"),
    (70_000, 100_000, "$70K–$100K"),
    (100_000, 150_000, "$100K–$150K"),
    (150_000, 1_000_000, "$150K+"),
]
AGE_BANDS = [  # left-closed [lo, hi)
    (0, 25, "18-25"),
    (25, 35, "26-35"),
    (35, 45, "36-45"),
    (45, 55, "46-55"),
    (55, 65, "56-65"),
    (65, 120, "65+"),
]
RISK_LEVELS = ["Low", "Medium", "High"]  # p < 0.40, p < 0.70, else
POINT_COST_DOLLARS = 0.01
SEGMENT_NAMES = {
    0: "Inactive Customers",
    1: "Frequent Flyers",
    2: "Premium Customers",
    3: "Reward Seekers",
    4: "High Value At-Risk",
}
CLV_MEMBER_QUARTILES = ["Bronze", "Silver", "Gold", "Platinum"]
CLV_ROW_QUARTILES = ["Low", "Medium", "High", "VIP"]


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num, den) -> Column:
    """num / den, null when den is 0 or null (ANSI mode raises on / 0)."""
    return F.try_divide(col(num).cast("double"), col(den))


def clip(c, lower=None, upper=None) -> Column:
    """pandas ``clip``: bounds applied, null stays null."""
    c = col(c)
    out = c
    if lower is not None:
        out = F.when(out < F.lit(lower), F.lit(lower)).otherwise(out)
    if upper is not None:
        out = F.when(out > F.lit(upper), F.lit(upper)).otherwise(out)
    return out


def title_strip(c) -> Column:
    """``str.title().str.strip()`` for one-word values."""
    return F.initcap(F.trim(col(c)))


def money_sum(c, scale: int = 2) -> Column:
    """Exact sum of a money column: decimal accumulation, double result.

    A double sum depends on the order partials are merged in; a decimal sum
    does not, so reruns and other engines agree to the cent.
    """
    return F.sum(col(c).cast(f"decimal(38,{scale})")).cast("double")


def money_avg(c, scale: int = 2) -> Column:
    return F.try_divide(money_sum(c, scale), F.count(col(c)).cast("double"))


def rnd(c, digits: int = 6) -> Column:
    """Round half away from zero on the binary value (``round(x*10^d)/10^d``),
    as numpy/pandas and DuckDB do; Spark's ``round`` rounds the decimal text,
    which differs on values such as 1.34875."""
    scale = float(10 ** digits)
    # "+ 0.0" turns -0.0 into 0.0
    return F.round(col(c).cast("double") * scale, 0) / scale + 0.0


def pct(num, den, digits: int = 2) -> Column:
    return rnd(F.try_divide(col(num).cast("double") * 100.0, col(den)), digits)


def band(c, bands) -> Column:
    """Left-closed bins ``[lo, hi)`` -> label; outside all bins -> null."""
    c = col(c)
    expr = None
    for lo, hi, label in bands:
        cond = (c >= F.lit(lo)) & (c < F.lit(hi))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(None).cast("string"))


def salary_band(c) -> Column:
    return band(c, SALARY_BANDS)


def age_band(c) -> Column:
    return band(c, AGE_BANDS)


def order_rank(c, levels) -> Column:
    """Position of a categorical value in a fixed order (1-based), null if absent."""
    c = col(c)
    expr = None
    for i, v in enumerate(levels, start=1):
        expr = F.when(c == F.lit(v), F.lit(i)) if expr is None else expr.when(c == F.lit(v), F.lit(i))
    return expr.otherwise(F.lit(None).cast("int"))


def tier_number(c) -> Column:
    return order_rank(c, TIER_ORDER)


def risk_label(p) -> Column:
    p = col(p)
    return (F.when(p < 0.40, "Low").when(p < 0.70, "Medium")
            .when(p.isNotNull(), "High").otherwise(F.lit(None).cast("string")))


def flight_segment(c) -> Column:
    c = col(c)
    return F.when(c <= 2, "Low").when(c <= 6, "Medium").when(c.isNotNull(), "High")


def quantile_label(c, edges: Column, labels) -> Column:
    """pandas ``qcut`` labelling given the edge array (min, q1, .., max).

    Bins are right-closed with the lowest edge included, so a value equal to an
    inner edge falls in the lower bin.  ``edges`` is an array column holding
    the inner edges.
    """
    c = col(c)
    expr = None
    for i, label in enumerate(labels[:-1]):
        cond = c <= edges[i]
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.when(c.isNotNull(), F.lit(labels[-1])).otherwise(F.lit(None).cast("string"))


def scalar(df: DataFrame) -> Column:
    """One-row, one-column DataFrame as a scalar subquery (run once, no join)."""
    return df.scalar()


def month_index(year="year", month="month") -> Column:
    return col(year).cast("int") * 12 + col(month).cast("int")


def bias_adjusted_skew(n, m2, m3) -> Column:
    """Sample skewness (pandas / DuckDB) from count and central moments sums.

    ``m2``/``m3`` are population central moments; g1 = m3 / m2^1.5 and
    G1 = g1 * sqrt(n(n-1)) / (n-2).
    """
    n = col(n).cast("double")
    g1 = F.try_divide(col(m3), F.pow(col(m2), 1.5))
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def bias_adjusted_kurtosis(n, m2, m4) -> Column:
    """Excess kurtosis with the small-sample correction used by pandas."""
    n = col(n).cast("double")
    g2 = F.try_divide(col(m4), F.pow(col(m2), 2)) - 3.0
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6.0))
