"""Customer filters (C17, C18): one composed predicate, pushed below the
member rollup by Catalyst where the columns allow it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import EDUCATION_ORDER, TIER_ORDER


def top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    """The n most frequent values of a column (ties by value), n rows."""
    return (df.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
            .orderBy(F.desc("_n"), column).limit(n).select(column))


def customer_filter(cdf: DataFrame, tiers=None, genders=None, educations=None, provinces=None,
                    clv_range=None, salary_range=None, default_provinces: int = 5) -> DataFrame:
    """Sidebar filter: four ``isin`` lists and two inclusive ranges.

    Defaults follow the dashboard: every tier / gender / education, the five
    provinces with most members, the full CLV and salary ranges."""
    tiers = tiers or TIER_ORDER
    genders = genders or ["Female", "Male"]
    educations = educations or EDUCATION_ORDER
    cond = (F.col("loyalty_card").isin(list(tiers)) & F.col("gender").isin(list(genders))
            & F.col("education").isin(list(educations)))
    for col, rng in (("clv", clv_range), ("salary", salary_range)):
        if rng is None:
            mm = cdf.agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
            lo, hi = mm.select("lo").scalar(), mm.select("hi").scalar()
        else:
            lo, hi = F.lit(rng[0]), F.lit(rng[1])
        cond = cond & F.col(col).between(lo, hi)
    out = cdf.filter(cond)
    if provinces is None:
        # five rows: a bounded broadcast for the semi join
        return out.join(F.broadcast(top_values(cdf, "province", default_provinces)), "province", "left_semi")
    return out.filter(F.col("province").isin(list(provinces)))
