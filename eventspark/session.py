"""Session settings and the shared work folder.

The library pins the session time zone to UTC (all tables hold instants and
the bucket arithmetic is done in UTC). Lineage is cut only through
``spark.checkpoint.dir``: on a cluster that is the shared folder the cluster
names; a local folder is created only for local-mode sessions that have none.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.filterPushdown": "true",
    # reliable checkpoints of finished micro-batches are removed once unused
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, app_name: str = "eventspark",
                  shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    conf["spark.ui.enabled"] = "false"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    prepare(spark)
    return spark


#: Groups that a task aggregates in memory before it sorts instead. A group of
#: the 10-second metrics holds two maps of at most its distinct latencies, some
#: 90 KB at 1,000 of them, so this is at most 400 MB of a task's heap.
GROUPS_IN_MEMORY = 4096

#: Bytecode of a generated method that the JVM still compiles. Generated code
#: with a longer one (decoding a message: 23,396) would be interpreted for every
#: row; such a stage runs operator by operator, in short methods, instead.
LONGEST_METHOD = 8000

#: Tasks that list folders which are read together (Spark's default is a task
#: for each: thousands for a delivery of thousands of hours).
LISTING_TASKS = 64


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on to any session."""
    spark.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", str(GROUPS_IN_MEMORY))
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", str(LONGEST_METHOD))
    spark.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(LISTING_TASKS))
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    # a delivery that is kept has as many partitions as its bytes ask for
    spark.conf.set("spark.sql.optimizer.canChangeCachedPlanOutputPartitioning", "true")
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Set from a fresh local folder only when the session has none and runs in
    local mode (tests); a cluster session without the setting is an error,
    because a machine-local folder does not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key
            configured = None
    if not configured:
        if not _is_local(spark):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="eventspark-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder below the checkpoint folder for tables of one job."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/eventspark-work/{name}-{uuid.uuid4().hex[:12]}"
