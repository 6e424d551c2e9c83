"""Hierarchy totals and flows (J1-J3): ``rollup`` with ``grouping_id`` and
unioned edge counts (one ``groupBy`` each, no loops over category pairs)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kpis import esum


def rollup_totals(cdf: DataFrame, levels: list[str], root: str = "All", with_customers: bool = True) -> DataFrame:
    """Totals at every prefix of ``levels`` (root, level 1, level 1+2)."""
    aggs = [esum("total_revenue").alias("revenue")]
    if with_customers:
        aggs.append(F.count(F.lit(1)).alias("customers"))
    depth = F.lit(len(levels)) - sum((F.grouping(c) for c in levels), F.lit(0))
    r = cdf.rollup(*levels).agg(*aggs, depth.cast("int").alias("depth"))
    return r.select(F.lit(root).alias("root"), *levels, "depth",
                    *(["revenue", "customers"] if with_customers else ["revenue"]))


def sankey_edges(cdf: DataFrame) -> DataFrame:
    """Education -> tier and tier -> status edge counts (zero edges are
    simply absent); node ids follow sorted educations, sorted tiers, then
    Active / Cancelled."""
    e1 = (cdf.groupBy(F.col("education").alias("source"), F.col("loyalty_card").alias("target"))
          .agg(F.count(F.lit(1)).alias("value")).withColumn("layer", F.lit(1)))
    status = F.when(F.col("cancelled") == 1, "Cancelled").when(F.col("cancelled") == 0, "Active")
    e2 = (cdf.filter(F.col("cancelled").isin(0, 1))
          .groupBy(F.col("loyalty_card").alias("source"), status.alias("target"))
          .agg(F.count(F.lit(1)).alias("value")).withColumn("layer", F.lit(2)))
    edges = e1.unionByName(e2)
    # node table: a few category values, so the ordered window is tiny
    nodes = (cdf.select(F.col("education").alias("node"), F.lit(0).alias("grp"))
             .union(cdf.select(F.col("loyalty_card").alias("node"), F.lit(1).alias("grp")))
             .union(cdf.select(F.lit("Active").alias("node"), F.lit(2).alias("grp")))
             .union(cdf.select(F.lit("Cancelled").alias("node"), F.lit(3).alias("grp")))
             .filter(F.col("node").isNotNull()).distinct())
    ids = nodes.withColumn("node_id", F.row_number().over(Window.orderBy("grp", "node")) - 1)
    src = ids.select(F.col("node").alias("source"), F.col("grp").alias("sg"), F.col("node_id").alias("source_id"))
    tgt = ids.select(F.col("node").alias("target"), F.col("grp").alias("tg"), F.col("node_id").alias("target_id"))
    e = edges.withColumn("sg", F.when(F.col("layer") == 1, 0).otherwise(1)) \
        .withColumn("tg", F.when(F.col("layer") == 1, 1).when(F.col("target") == "Active", 2).otherwise(3))
    return (e.join(F.broadcast(src), ["source", "sg"]).join(F.broadcast(tgt), ["target", "tg"])
            .select("layer", "source", "target", "value", "source_id", "target_id"))
