"""Distances that the metric tree computes per point, on scaled lineitem figures.

usage: python tools/neighbour_work.py [rows ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from contrail.operators import neighbours as N  # noqa: E402
from contrail.session import get_spark, stored  # noqa: E402

COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def main():
    spark = get_spark("local[8]", 16)
    spark.sparkContext.setLogLevel("ERROR")
    items = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet")
    stats = items.agg(*[f(c).alias(f"{n}_{c}") for c in COLS for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    ship = (F.datediff("l_shipdate", F.lit("1995-06-17")) / 700.0).cast("double")
    v = F.array(*[((F.col(c) - float(stats[f"m_{c}"])) / float(stats[f"s_{c}"])).cast("double") for c in COLS], ship)
    named = items.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("u"), v.alias("v")).dropDuplicates(["v"])
    for rows in map(int, sys.argv[1:] or ["10000", "100000", "600000"]):
        t = time.time()
        points = stored(named.orderBy(F.xxhash64("u")).limit(rows).select("u", F.col("u").alias("first"), "v"), "points")
        n = points.count()
        tree = N.build(points)
        schema = "u string, w string, first string, d double"
        own = stored(N._together(tree.leaves.select("node", "u", "v"), tree.leaves, N._nearest_in_leaf(5), schema), "own")
        sizes = tree.leaves.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
        opened = N.asks_of(tree, own, 5)
        asks = opened.groupBy("node").agg(F.sum("n").alias("asks")) if opened is not None else sizes.limit(0).withColumnRenamed("n", "asks")
        own_pairs = sizes.agg(F.sum(F.col("n") * F.col("n"))).first()[0]
        more, leaves_asked = asks.join(sizes, "node").agg(F.sum(F.col("n") * F.col("asks")), F.sum("asks")).first()
        print(f"{n} points, {sizes.count()} leaves, {len(tree.levels)} levels: {(own_pairs + (more or 0)) / n:.0f} distances a point "
              f"({100 * (own_pairs + (more or 0)) / n / n:.2f} % of all), {(leaves_asked or 0) / n:.1f} further leaves a point, {time.time() - t:.0f} s", flush=True)


if __name__ == "__main__":
    main()
