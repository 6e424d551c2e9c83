"""Spark session with the settings the library is tuned for.

Cluster jobs pass their own session; these defaults only fill in what is unset.
"""

from __future__ import annotations

import hashlib
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job in this package relies on.  AQE re-plans joins from the
# real shuffle sizes (a broadcast happens only when the measured side is below
# the threshold), coalesces small partitions and splits skewed ones.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "128MB",
    "spark.ui.showConsoleProgress": "false",
}
# Only used when this module starts the JVM itself (local runs and tests).
LOCAL_CONF = {"spark.driver.memory": "12g"}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "contrail", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if master and master.startswith("local"):
        conf.update(LOCAL_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# Local runs only (no cluster folder configured): a fixed scratch root, so
# saved models can be reused by later processes on the same machine.
LOCAL_CHECKPOINT_ROOT = os.path.join(os.environ.get("TMPDIR", "/tmp"), "contrail-checkpoints")


def _configured_dir(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)


def _local_root(spark: SparkSession) -> str:
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return LOCAL_CHECKPOINT_ROOT


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts.

    Uses the directory the cluster names in ``spark.checkpoint.dir``; only
    when none is configured (local runs, tests) a local scratch root is used.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    sc.setCheckpointDir(_configured_dir(spark) or _local_root(spark))
    return sc.getCheckpointDir()


def checkpoint_root(spark: SparkSession) -> str:
    """The checkpoint folder itself (Spark writes RDD checkpoints into a
    per-application sub-folder of it); used for artefacts shared between
    applications, such as fitted models."""
    configured = _configured_dir(spark)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return os.path.dirname(current.rstrip("/"))
    return _local_root(spark)


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def fingerprint(spark: SparkSession, folder: str) -> str:
    """Hash of the names, sizes and times of all files below ``folder``, by any
    file system that Spark reads: changed data has another one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = p.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(p, True)
    seen = []
    while files.hasNext():
        f = files.next()
        seen.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha1("\n".join(sorted(seen)).encode()).hexdigest()[:16]


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to a new folder of the shared location and read
    back: a lineage cut that outlives executors, and later scans are pruned and
    pushed down."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/contrail-layers/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
