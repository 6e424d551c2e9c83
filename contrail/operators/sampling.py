"""Seeded, repeatable sampling.

``seeded_sample`` keeps the n rows with the smallest MD5 order of (key, seed):
the same seed gives the same rows on any cluster layout and on re-execution
(``sample()`` depends on partitioning).  It plans as a top-n
(``TakeOrderedAndProject``): each task keeps n rows, so memory is bounded by
n x tasks, never by the table size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample_order(key, seed: int = 42):
    """60 bits of the MD5 of the whole-number keys and the seed (any SQL engine has it)."""
    keys = [key] if isinstance(key, str) else list(key)
    text = F.concat_ws("|", *[F.col(k).cast("bigint").cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def sample_order_sql(keys, seed: int = 42) -> str:
    """The same order as DuckDB text."""
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(keys)}, {seed})), 1, 15) AS BIGINT)"


def seeded_sample(df: DataFrame, key, n: int, seed: int = 42) -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    return (df.withColumn("_h", sample_order(keys, seed))
            .orderBy("_h", *keys).limit(n).drop("_h"))
