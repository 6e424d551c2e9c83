"""CSV / Parquet sources and sinks with declared schemas (A1, A2, A3, A5).

CSV is only the edge format: reads use a declared ``StructType`` (no schema
inference pass over the data), writes are partitioned Parquet or CSV.  Output
folders must be on storage every executor sees (the cluster's shared folder);
``scratch_dir`` derives one from ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import checkpoint_dir

# Field descriptions of the two raw feeds.
FIELD_DOCS = {
    "member_id": "Customer's unique loyalty number",
    "year": "Year of the period",
    "month": "Month of the period",
    "total_flights": "Sum of Flights Booked (all tickets purchased in the period)",
    "distance": "Flight distance traveled in the period (km)",
    "points_accumulated": "Loyalty points accumulated in the period",
    "points_redeemed": "Loyalty points redeemed in the period",
    "dollar_cost_points_redeemed": "Dollar equivalent for points redeemed in the period in CDN",
    "country": "Country of residence",
    "province": "Province of residence",
    "city": "City of residence",
    "postal_code": "Postal code of residence",
    "gender": "Gender",
    "education": "Highest education level (High school or lower > College > Bachelor > Master > Doctor)",
    "salary": "Annual income",
    "marital_status": "Marital status (Single, Married, Divorced)",
    "loyalty_card": "Loyalty card status (Star > Nova > Aurora)",
    "clv": "Customer lifetime value - total invoice value for all flights ever booked by member",
    "enrollment_type": "Enrollment type (Standard / 2018 Promotion)",
    "enrollment_year": "Year Member enrolled in membership program",
    "enrollment_month": "Month Member enrolled in membership program",
    "cancellation_year": "Year Member cancelled their membership",
    "cancellation_month": "Month Member cancelled their membership",
}
ACTIVITY_TABLE = "Customer Flight Activity"
MEMBER_TABLE = "Customer Loyalty History"

ACTIVITY_SCHEMA = T.StructType([
    T.StructField("member_id", T.LongType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("total_flights", T.LongType()),
    T.StructField("distance", T.LongType()),
    T.StructField("points_accumulated", T.LongType()),
    T.StructField("points_redeemed", T.LongType()),
    T.StructField("dollar_cost_points_redeemed", T.DoubleType()),
])

MEMBER_SCHEMA = T.StructType([
    T.StructField("member_id", T.LongType()),
    T.StructField("country", T.StringType()),
    T.StructField("province", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("gender", T.StringType()),
    T.StructField("education", T.StringType()),
    T.StructField("salary", T.DoubleType()),
    T.StructField("marital_status", T.StringType()),
    T.StructField("loyalty_card", T.StringType()),
    T.StructField("clv", T.DoubleType()),
    T.StructField("enrollment_year", T.LongType()),
    T.StructField("enrollment_month", T.LongType()),
    T.StructField("cancellation_year", T.LongType()),
    T.StructField("cancellation_month", T.LongType()),
])


def with_docs(schema: T.StructType) -> T.StructType:
    """A5: attach the data-dictionary text to each field as metadata."""
    return T.StructType([
        T.StructField(f.name, f.dataType, f.nullable,
                      {**(f.metadata or {}), "comment": FIELD_DOCS.get(f.name, "")})
        for f in schema.fields])


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A1: header CSV with a declared schema; malformed numbers become null."""
    return (spark.read.schema(with_docs(schema)).option("header", True)
            .option("mode", "PERMISSIVE").csv(path))


def read_activity_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, ACTIVITY_SCHEMA)


def read_members_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, MEMBER_SCHEMA)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location."""
    root = checkpoint_dir(spark)
    return os.path.join(root, "contrail-out", f"{name}-{uuid.uuid4().hex[:12]}")


def write_csv(df: DataFrame, path: str, partition_by: list[str] | None = None,
              mode: str = "overwrite") -> str:
    """A2 / A3: header CSV, no index column, one folder of part files."""
    w = (df.write.mode(mode).option("header", True)
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)
    return path


def _part_files(fs, folder) -> list:
    """The part files of a written folder, in the order of their tasks."""
    found = [f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")]
    return sorted(found, key=lambda p: p.getName())


def write_one_csv(df: DataFrame, path: str, order_by: list[str] | None = None) -> str:
    """A3: ``df`` as one CSV file with one header, at exactly ``path``.

    Tasks write their parts (in ``order_by`` order, where given) without headers;
    the commit copies them one after the other through the file system, in pieces of
    64 KB, into a file beside ``path`` and renames it, so a reader never sees half
    a file.  An earlier file at ``path`` is replaced.  No rows give the header alone."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop
    parts = f"{path}._parts_{uuid.uuid4().hex[:12]}"
    ordered = df.orderBy(*order_by) if order_by else df
    ordered.write.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(parts)
    folder, target, half = (hadoop.fs.Path(p) for p in (parts, path, f"{parts}.csv"))
    fs = folder.getFileSystem(conf)
    out = fs.create(half, True)
    try:
        out.write(bytearray((",".join(_quoted(c) for c in df.columns) + "\n").encode()))
        for part in _part_files(fs, folder):
            source = fs.open(part)
            try:
                hadoop.io.IOUtils.copyBytes(source, out, 1 << 16, False)
            finally:
                source.close()
    finally:
        out.close()
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(half, target):
        raise OSError(f"cannot move {half} to {target}")
    fs.delete(folder, True)
    return path


def _quoted(name: str) -> str:
    """A header field: in quotes (those inside escaped, as the CSV sink does) where it has to be."""
    if not any(c in name for c in ',"\n\r\\'):
        return name
    inside = name.replace("\\", "\\\\").replace('"', '\\"')
    return f'"{inside}"'


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None,
                  mode: str = "overwrite") -> str:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def dictionary_rows(spark: SparkSession) -> DataFrame:
    """A5 as a table: (table, field, description, type) for both raw feeds."""
    rows = []
    for table, schema in ((ACTIVITY_TABLE, ACTIVITY_SCHEMA), (MEMBER_TABLE, MEMBER_SCHEMA)):
        for f in with_docs(schema).fields:
            rows.append((table, f.name, f.metadata.get("comment", ""), f.dataType.simpleString()))
    return spark.createDataFrame(rows, "table string, field string, description string, type string")
