"""Statistics (S1-S11): summaries, correlation, tests, regression lines.

Moments, correlations and regression come from single-pass aggregates
(``avg``/``stddev``/``skewness``/``corr``/``regr_*``), partial-aggregated per
task.  Rank statistics use the bucketed global order of
``functions.ranking`` (never a single-task window).  p-values are column
expressions (``functions.special``) over the one-row-per-test result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import money_sum
from ..functions.ranking import exact_quantiles, ordered_cumsum

SUMMARY_VARS = ["clv", "salary", "total_flights", "distance", "points_accumulated", "points_redeemed",
                "dollar_cost_points_redeemed"]


def member_variables(L) -> DataFrame:
    """The seven univariate variables: CLV and salary per member (member
    table), activity totals per member (master)."""
    totals = (L.master.groupBy("member_id")
              .agg(*[F.sum(c).cast("double").alias(c)
                     for c in ("total_flights", "distance", "points_accumulated", "points_redeemed")],
                   money_sum("dollar_cost_points_redeemed", 2).alias("dollar_cost_points_redeemed")))
    return L.members.select("member_id", "clv", "salary").join(totals, "member_id", "full")


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    return (df.select(*[F.col(c).cast("double").alias(c) for c in columns])
            .unpivot([], columns, "column", "value").filter(F.col("value").isNotNull()))


def sample_skew(x: str = "value"):
    """Bias-adjusted skewness from Spark's population skewness."""
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(x: str = "value"):
    """Bias-adjusted excess kurtosis from Spark's population kurtosis."""
    n = F.count(x).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6.0))


def numeric_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, median, std, min, max, skew, kurtosis, IQR, outlier share."""
    long = _long(df, columns)
    g = (long.groupBy("column")
         .agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
              F.min("value").alias("min"), F.max("value").alias("max"),
              sample_skew().alias("skewness"), sample_kurtosis().alias("kurtosis")))
    q = exact_quantiles(long, "value", [0.01, 0.25, 0.5, 0.75, 0.99], by=["column"])
    g = g.join(q, "column").withColumn("median", F.col("q2")).withColumn("iqr", F.col("q3") - F.col("q1"))
    bounds = g.select("column", F.col("q0").alias("p_lo"), F.col("q4").alias("p_hi"))
    share = (long.join(F.broadcast(bounds), "column")  # one row per column
             .groupBy("column")
             .agg(F.avg(((F.col("value") < F.col("p_lo")) | (F.col("value") > F.col("p_hi"))).cast("double"))
                  .alias("outlier_share")))
    return g.drop("q0", "q1", "q2", "q3", "q4").join(share, "column")


def skew_rank(df: DataFrame, columns: list[str]) -> DataFrame:
    """Skewness per column, most skewed first."""
    return (_long(df, columns).groupBy("column").agg(sample_skew().alias("skewness"))
            .orderBy(F.desc("skewness"), "column"))


def _corr_matrix(df: DataFrame, columns: list[str], value, gaps: list[str] | None = None) -> DataFrame:
    """(x, y, r) of all pairs from one aggregate of co-moments; ``value(a, b)`` is what
    stands for column a beside b, rows where either is null do not count.  With ``gaps``,
    the only columns that hold nulls, a column beside one without has one variance."""
    # the matrix is symmetric: aggregate the upper triangle and mirror it
    upper = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]

    def variance(x, y, other):
        return F.var_pop(x if gaps is not None and other not in gaps else F.when(x.isNotNull() & y.isNotNull(), x))

    def r(a, b):
        x, y = value(a, b), value(b, a)
        return F.try_divide(F.covar_pop(x, y), F.sqrt(variance(x, y, b) * variance(y, x, a)))

    agg = df.agg(*[r(a, b).alias(f"{a}|{b}") for a, b in upper])
    long = agg.unpivot([], [f"{a}|{b}" for a, b in upper], "pair", "r").select(
        F.split("pair", r"\|")[0].alias("x"), F.split("pair", r"\|")[1].alias("y"), "r")
    mirror = long.filter(F.col("x") != F.col("y")).select(F.col("y").alias("x"), F.col("x").alias("y"), "r")
    return long.unionByName(mirror)


def pearson_matrix(df: DataFrame, columns: list[str], gaps: list[str] | None = None) -> DataFrame:
    """S3: all pairwise Pearson r in one aggregate, each over the rows where both are
    known; null where one does not vary.  ``gaps``: the columns with nulls, where known
    (``null_counts`` of a stored table): far fewer aggregates."""
    return _corr_matrix(df, columns, lambda a, _: F.col(a).cast("double"), gaps)


def null_counts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Rows without a value, of each column (one row)."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first().asDict()


def spearman_matrix(df: DataFrame, columns: list[str], key: str = "member_id") -> DataFrame:
    """Spearman of every pair over the rows where both are known: Pearson of
    tie-averaged ranks that are taken among those rows.

    A column's ranks among the rows that know another column differ from its own
    only where the other one has nulls, so it is ranked once, and once more for
    each other column with nulls.  All rankings are one pass: long format, distinct
    (ranking, value) counts, the range order per ranking, then one pivot back to a
    row per key.  ``key`` is unique."""
    nulls = null_counts(df, columns)
    gaps = [c for c in columns if nulls[c]]
    names = {(c, g): f"r{i}" for i, (c, g) in enumerate((c, g) for c in columns for g in [None, *[x for x in gaps if x != c]])}
    known = df.select(key, *[F.col(c).cast("double").alias(c) for c in columns])
    wide = known.select(key, *[(F.col(c) if g is None else F.when(F.col(g).isNotNull(), F.col(c))).alias(n)
                               for (c, g), n in names.items()])
    long = wide.unpivot([key], list(names.values()), "column", "value").filter(F.col("value").isNotNull())
    vc = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    cum = ordered_cumsum(vc, "value", ["n"], by=["column"])
    ranks = cum.select("column", "value", (F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2.0).alias("rank"))
    ranked = (long.join(ranks, ["column", "value"])
              .groupBy(key).pivot("column", list(names.values())).agg(F.first("rank")))

    def ranks_of(c: str, other: str):
        return F.col(names[c, other if other in gaps and other != c else None])

    return _corr_matrix(ranked, columns, ranks_of)


def target_correlates(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Pearson r of each column with the target, ranked by |r|."""
    agg = df.agg(*[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(c) for c in columns])
    return (agg.unpivot([], columns, "feature", "r")
            .withColumn("abs_r", F.abs("r"))
            .withColumn("direction", F.when(F.col("r") > 0, "up").otherwise("down"))
            .orderBy(F.desc("abs_r"), "feature"))


def two_group_moments(df: DataFrame, columns: list[str], group: str, a_value=0, b_value=1) -> DataFrame:
    """Per column: n, mean, sample variance of group a and group b (one pass)."""
    long = (df.select(F.col(group).alias("_g"), *[F.col(c).cast("double").alias(c) for c in columns])
            .unpivot(["_g"], columns, "feature", "value").filter(F.col("value").isNotNull()))
    ga, gb = F.col("_g") == a_value, F.col("_g") == b_value
    va, vb = F.when(ga, F.col("value")), F.when(gb, F.col("value"))
    return (long.groupBy("feature")
            .agg(F.count(va).alias("n_a"), F.avg(va).alias("mean_a"), F.var_samp(va).alias("var_a"),
                 F.count(vb).alias("n_b"), F.avg(vb).alias("mean_b"), F.var_samp(vb).alias("var_b")))


def welch_t(df: DataFrame, columns: list[str], group: str, a_value=0, b_value=1) -> DataFrame:
    """Welch t statistic and Welch-Satterthwaite df per column, diff %."""
    m = two_group_moments(df, columns, group, a_value, b_value)
    sa = F.col("var_a") / F.col("n_a")
    sb = F.col("var_b") / F.col("n_b")
    return m.select(
        "feature", "n_a", "n_b", "mean_a", "mean_b",
        F.try_divide((F.col("mean_a") - F.col("mean_b")) * 100.0, F.col("mean_a")).alias("diff_pct"),
        F.try_divide(F.col("mean_a") - F.col("mean_b"), F.sqrt(sa + sb)).alias("t_stat"),
        F.try_divide(F.pow(sa + sb, 2),
                     F.pow(sa, 2) / (F.col("n_a") - 1) + F.pow(sb, 2) / (F.col("n_b") - 1)).alias("dof"))


def mann_whitney(df: DataFrame, columns: list[str], group: str, a_value=0, b_value=1) -> DataFrame:
    """Mann-Whitney U of group a, tie-corrected normal z with continuity
    correction (two-sided).  The pooled ranks of all features come from one range
    order of the long format; the rank sums are aggregates over distinct values."""
    long = (df.filter(F.col(group).isin(a_value, b_value))
            .select(F.col(group).alias("_g"), *[F.col(c).cast("double").alias(c) for c in columns])
            .unpivot(["_g"], columns, "feature", "value").filter(F.col("value").isNotNull()))
    vc = (long.groupBy("feature", "value")
          .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_g") == a_value).alias("n_a")))
    cum = ordered_cumsum(vc, "value", ["n"], by=["feature"])
    rank = F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2.0
    s = cum.groupBy("feature").agg(F.sum(F.col("n_a") * rank).alias("r_a"), F.sum("n_a").alias("n_a"), F.sum("n").alias("n"),
                                   F.sum(F.pow(F.col("n").cast("double"), 3) - F.col("n")).alias("ties"))
    na, n = F.col("n_a").cast("double"), F.col("n").cast("double")
    nb = n - na
    u = F.col("r_a") - na * (na + 1) / 2.0
    sigma = F.sqrt(na * nb / 12.0 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    return s.select("feature", u.alias("u_stat"), F.try_divide(F.greatest(u, na * nb - u) - na * nb / 2.0 - 0.5, sigma).alias("z"))


def chi_square(df: DataFrame, columns: list[str], target: str, target_levels=(0, 1)) -> DataFrame:
    """Chi-square of each categorical column vs the target; Yates
    correction when the table has one degree of freedom (2x2).

    The contingency table is completed with zero cells by pivoting on the
    target levels (no cross join); margins are windows over that small table."""
    from pyspark.sql import Window
    levels = list(target_levels)
    out = []
    for c in columns:
        cells = (df.filter(F.col(c).isNotNull() & F.col(target).isNotNull())
                 .groupBy(F.col(c).alias("r")).pivot(target, levels).count().fillna(0))
        grid = cells.unpivot(["r"], [str(v) for v in levels], "k", "o")
        present = grid.withColumn("ct", F.sum("o").over(Window.partitionBy("k")))
        grid = (present.filter(F.col("ct") > 0)
                .withColumn("rt", F.sum("o").over(Window.partitionBy("r")))
                .withColumn("n", F.sum("o").over(Window.partitionBy()))
                .withColumn("n_r", F.size(F.collect_set("r").over(Window.partitionBy())))
                .withColumn("n_c", F.size(F.collect_set("k").over(Window.partitionBy()))))
        e = F.col("rt") * F.col("ct") / F.col("n")
        dof = (F.col("n_r") - 1) * (F.col("n_c") - 1)
        diff = F.abs(F.col("o") - e)
        yates = F.when(dof == 1, F.least(F.lit(0.5), diff)).otherwise(F.lit(0.0))
        out.append(grid.agg(F.sum(F.pow(diff - yates, 2) / e).alias("chi2"), F.max(dof).alias("dof"))
                   .select(F.lit(c).alias("feature"), "chi2", F.col("dof").cast("bigint").alias("dof")))
    return reduce(lambda a, b: a.unionByName(b), out)


def linear_trend(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Slope, intercept and r of y on x (nulls as 0, as the plot does)."""
    out = []
    for x, y in pairs:
        xv, yv = F.coalesce(F.col(x).cast("double"), F.lit(0.0)), F.coalesce(F.col(y).cast("double"), F.lit(0.0))
        out.append(df.agg(F.regr_slope(yv, xv).alias("slope"), F.regr_intercept(yv, xv).alias("intercept"),
                          F.corr(xv, yv).alias("r"))
                   .select(F.lit(x).alias("x"), F.lit(y).alias("y"), "slope", "intercept", "r"))
    return reduce(lambda a, b: a.unionByName(b), out)
