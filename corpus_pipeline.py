"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs; all but the last return the columns
of documents.  A stage keeps null and empty texts unless its rule says otherwise
(the quality model scores them as empty texts), takes no rows as no rows, and
ignores further columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.llm import decontamination, line_dedup, lsh_forest, packing, quality
from contrail.llm.textkit import documents, stored

#: Words of a shingle and percent of likeness of near duplicates.
SHINGLE, PERCENT = 5, 80


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled model scores 0.7 at least."""
    return quality.keep_good(docs, quality.fit(docs, documents(spark, sf_dir, "labels")))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that stand on many sites (but for where they stand first);
    a document of which nothing is left goes.  n_chars is counted again."""
    out = line_dedup.drop_boilerplate(docs)
    out = out.where((F.col("n_removed") == 0) | (F.trim("text", F.lit(" \t\r\n\x0b\x0c")) != ""))
    count = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", count).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near duplicates; of the group's
    rows with that id one."""
    found = lsh_forest.near_duplicates(docs, SHINGLE, PERCENT).where("kept")
    # unrelated texts of one id are groups of their own
    group = F.struct("root", F.when(F.col("root").isNull(), F.col("text_hash")))
    ids = found.groupBy(F.col("doc_id").alias("_id"), group.alias("_group")).agg(F.min("text_hash").alias("_hash"), F.count("*").alias("_n")).drop("_group")
    # rows without an id have nothing in common but that: their texts tell them apart
    ids = ids.where("_id IS NOT NULL").unionByName(found.where("doc_id IS NULL").groupBy("text_hash").agg(F.count("*").alias("_n")).select(
        F.lit(None).cast("long").alias("_id"), F.col("text_hash").alias("_hash"), "_n"))
    ids = stored(ids, "kept-ids")
    keyed = docs.withColumn("_key", F.xxhash64(F.col("text").cast("string")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_hash"))
    once = keyed.join(ids.where("_n = 1"), same, "left_semi")
    repeated = keyed.join(ids.where("_n > 1"), same, "left_semi").dropDuplicates(["doc_id", "_key"])
    return once.unionByName(repeated).select(*docs.columns)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    found = decontamination.contamination(docs, documents(spark, sf_dir, "benchmark"))
    bad = stored(found.where("contaminated").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "contaminated")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_hash"))
    return docs.join(bad, same, "left_anti")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.digest(packing.pack(docs, packing.vocabulary()))


STAGES = [
    ("quality", good_quality),
    ("lines", without_boilerplate),
    ("near_copies", without_near_copies),
    ("benchmarks", without_benchmarks),
    ("packing", packed),
]

#: The quality model, the signatures and the tokenizer cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
