"""SparkSession construction and cluster-shared folders.

Everything the library does runs on a session the caller owns; this module
only builds one for tests, the bench and the command line, with the settings
the operators rely on (UTC session time zone, adaptive execution on).
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings every session of ours carries.  AQE re-plans joins from runtime
# sizes (a dimension that turns out small becomes a broadcast join, a big one
# stays sort-merge), coalesces small shuffle partitions and splits skewed ones.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # top-n per key (tails, ring buffers) keeps its pre-shuffle limit for n
    # up to this size (Spark's default stops at 1000)
    "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
}


# Settings for a large cluster reading ~100 TB (merged over BASE_CONF by
# ``build_session(cluster=True)``).  Shuffles start wide and AQE coalesces
# them to ~256 MB partitions; scans split files into 512 MB tasks; a
# partition five times the median and over 1 GB counts as skewed and is
# split in sort-merge joins; small sides up to 64 MB become broadcasts at
# run time.  Partial aggregation handles hot keys in aggregates.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64m",
    "spark.sql.files.maxPartitionBytes": "512m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1g",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(master: str | None = None, app_name: str = "tickflow",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None, cluster: bool = False) -> SparkSession:
    """Return a session with the library's settings.

    ``master`` and ``shuffle_partitions`` are for local runs; on a cluster
    the launcher sets them and both stay ``None``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if cluster:
        conf.update(CLUSTER_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if spark.conf.get("spark.checkpoint.dir", None):
        ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables: ``spark.checkpoint.dir``.

    A session without that setting is refused: a machine-local folder would
    be lost with its executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def own_folder_if_local(spark: SparkSession) -> None:
    """For entry code: name a folder of our own where none is set and one process is the whole cluster."""
    if not spark.conf.get("spark.checkpoint.dir", None) and re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tickflow-ckpt-"))


def materialize(df):
    """Compute ``df`` once and cut its lineage: a reliable checkpoint into the
    shared ``spark.checkpoint.dir`` (never a local one).

    For a small intermediate read by several branches of one job (bars built
    from the raw tables, fitted coefficients): without it every branch would
    re-scan and re-aggregate the raw input, because branches that prune
    different columns do not share exchanges.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A path under the shared checkpoint folder (for written tables)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    return os.path.join(base, *parts) if "://" not in base else "/".join([base.rstrip("/"), *parts])


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is there; any other failure to look is the caller's error, never "no"."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)
