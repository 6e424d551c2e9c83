"""Exact global order statistics without a single-partition window.

A window ordered over a whole table (``Window.orderBy(x)`` with no partition)
runs in ONE task.  Lorenz curves, Spearman ranks, Mann-Whitney and ROC/AUC all
need a running total in global order, so they use ``ordered_cumsum``:

1. collapse to one row per distinct order value (map-side combined, so a hot
   value is one row however many rows carry it);
2. a range exchange on (group, value): each task gets one stretch of the order,
   a group takes as many tasks as its share asks, and dealing out a value costs
   the same whatever the number of tasks.  The result is written with the
   task's number, which all later steps read (a lineage cut: the stretches are
   the same for everyone and outlive executors);
3. totals per (group, stretch), at most one row for each task and group, and
   their exclusive prefix;
4. running sum inside each stretch with ``partitionBy(group, stretch)``.

The result is exact: the exchange only decides which task a value lands in,
never its total.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def in_stretches(df: DataFrame, by: list[str], col: str, stretches: int | None = None, out: str = "_bkt") -> DataFrame:
    """``df`` dealt out by ranges of (``by``, ``col``) and stored, with the number of the
    stretch: equal values share one, and inside a group numbers grow with the value
    (null first).  Without ``stretches`` their number follows the size of the data."""
    keys = [*by, col]
    dealt = df.repartitionByRange(stretches, *keys) if stretches else df.repartitionByRange(*keys)
    return stored(dealt.withColumn(out, F.spark_partition_id()), "order")


def ordered_cumsum(vc: DataFrame, order_col: str, weights: list[str], descending: bool = False,
                   buckets: int | None = None, by: list[str] | None = None) -> DataFrame:
    """Inclusive running sums ``cum_<w>`` of ``weights`` in ``order_col`` order,
    restarting for every ``by`` group.

    ``vc`` must hold one row per distinct (``by``, ``order_col``) (use
    ``value_counts`` first).  Returns vc's columns plus ``cum_<w>`` and the
    group's total ``all_<w>``, both from the totals of the stretches.
    """
    by = list(by or [])
    b = in_stretches(vc, by, order_col, buckets)
    if descending:
        b = b.withColumn("_bkt", -F.col("_bkt"))
    totals = b.groupBy(*by, "_bkt").agg(*[F.sum(w).alias(f"_t_{w}") for w in weights])
    # a row per task that holds rows of the group
    before = Window.partitionBy(*by).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*by)
    offsets = totals.select(*by, "_bkt", *[F.coalesce(F.sum(f"_t_{w}").over(before), F.lit(0)).alias(f"_o_{w}")
                                           for w in weights],
                            *[F.sum(f"_t_{w}").over(group).alias(f"all_{w}") for w in weights])
    key = F.col(order_col).desc() if descending else F.col(order_col).asc()
    within = Window.partitionBy(*by, "_bkt").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    # AQE decides from the measured size of the offsets
    out = b.join(offsets, [*by, "_bkt"])
    return out.select(*vc.columns, *[(F.col(f"_o_{w}") + F.sum(w).over(within)).alias(f"cum_{w}")
                                     for w in weights], *[f"all_{w}" for w in weights])


def exact_quantiles(df: DataFrame, col: str, probs: list[float], by: list[str] | None = None,
                    buckets: int | None = None) -> DataFrame:
    """Linear-interpolated quantiles (numpy / pandas 'linear', Spark
    ``percentile``, DuckDB ``quantile_cont``) without holding a group's values
    in one task: distinct values are counted, put in global order by
    ``ordered_cumsum`` and the order statistics at (n-1)p are picked with one
    aggregate.  Returns one row per group with columns ``q0, q1, ...``."""
    by = list(by or [])
    vc = df.filter(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("n"))
    cum = ordered_cumsum(vc, col, ["n"], buckets=buckets, by=by)
    aggs = []
    v = F.col(col).cast("double")
    for i, p in enumerate(probs):
        h = (F.col("all_n") - 1) * p
        lo = F.floor(h)
        x_lo = F.min(F.when(F.col("cum_n") > lo, v))
        x_hi = F.min(F.when(F.col("cum_n") > lo + 1, v))
        frac = F.first(h - lo)
        aggs.append((x_lo + frac * (F.coalesce(x_hi, x_lo) - x_lo)).alias(f"q{i}"))
    return cum.groupBy(*by).agg(*aggs)


def quantile_array(df: DataFrame, col: str, probs: list[float]):
    """Scalar array of exact global quantiles (see ``exact_quantiles``)."""
    q = exact_quantiles(df, col, list(probs))
    return q.select(F.array(*[F.col(f"q{i}") for i in range(len(probs))])).scalar()


def quantile_values(df: DataFrame, spec: dict[str, list[float]]) -> dict[str, list[float | None]]:
    """Exact quantiles of several columns in ONE distributed pass (long format,
    grouped by column), as numbers: {column: [value per prob]}, None without values."""
    cols = list(spec)
    probs = sorted({p for ps in spec.values() for p in ps})
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "column", "value")
    # one row per column (bounded by len(spec))
    rows = {r["column"]: r for r in exact_quantiles(long, "value", probs, by=["column"]).collect()}
    return {c: [rows[c][f"q{probs.index(p)}"] if c in rows else None for p in spec[c]] for c in cols}


def column_quantiles(df: DataFrame, spec: dict[str, list[float]]) -> dict:
    """``quantile_values`` as literals: {column: [scalar Column per prob]}."""
    return {c: [F.lit(v).cast("double") for v in vs] for c, vs in quantile_values(df, spec).items()}


def value_counts(df: DataFrame, col: str, weights: dict | None = None) -> DataFrame:
    """One row per distinct non-null value: ``n`` rows plus optional weight sums."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for name, expr in (weights or {}).items():
        aggs.append(F.sum(expr).alias(name))
    return df.filter(F.col(col).isNotNull()).groupBy(col).agg(*aggs)


def average_ranks(df: DataFrame, col: str, buckets: int | None = None) -> DataFrame:
    """(value, n, rank): 1-based rank with ties averaged (pandas ``rank()``)."""
    vc = value_counts(df, col)
    cum = ordered_cumsum(vc, col, ["n"], buckets=buckets)
    return cum.select(col, "n", (F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2.0).alias("rank"))
