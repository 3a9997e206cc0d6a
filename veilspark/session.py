"""Session helpers: checkpoint folder and input spreading."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster.

    ``spark.checkpoint.dir`` is read from the session. Only a local session without one gets a temporary
    folder; a cluster without one is an error, since a machine-local folder does not survive executor loss.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="veilspark-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def once(value: Column) -> Column:
    """``value`` by way of an expression on the partition id, which changes nothing and holds filters above it.

    A filter that slides below a projection takes the projection's expressions along, and they are computed twice.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def spread(df: DataFrame, key: str = "path", always: bool = False) -> DataFrame:
    """Hash-spread a bare scan that has fewer splits than the cluster has cores.

    A wide input (the normal case at scale) is returned as it is, without a shuffle. Hashing the key keeps
    the placement the same when a lost task is run again. Use on scans, not on plans with shuffles: asking
    an adaptive plan for its partitions would run it. ``always`` is for narrow rows that much work will be made of: their
    file has splits without rows, which the number of splits doesn't tell, and there are as many parts as a shuffle has.

    A filter above would slide below the shuffle, back into the few input splits. One column passes through
    an expression on the partition id, which changes nothing and holds filters where the cores are.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if always:
        cores = max(cores, int(spark.conf.get("spark.sql.shuffle.partitions")))
    elif df.isStreaming or df.rdd.getNumPartitions() >= cores:
        return df
    held = next((c for c in df.columns if c != key), None)
    wide = df.repartition(cores, key)
    if held is None:
        return wide
    return wide.withColumn(held, once(F.col(held)))
