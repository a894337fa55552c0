"""Session helpers: the shared work folder and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_LIMIT_BYTES = 16 * 1024 * 1024  # of estimated, compressed size; several times that in memory

SPREAD_BYTES = 2 * 1024 * 1024  # of a table's files for a task: some 100,000 rows of few columns


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster in ``spark.checkpoint.dir``.

    A local session without that setting (a test) gets a folder of its own; elsewhere its absence is an error, for
    executors cannot see the driver's disk.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="jobmill-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder; nothing is ever reused or cleared."""
    return f"{shared_dir(spark)}/jobmill/{name}-{uuid.uuid4().hex}"


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Hint a broadcast only when the optimizer's size estimate is below ``limit``.

    Beyond it the frame is returned unhinted, so the join shuffles (and adaptive execution may
    still split skewed keys).
    """
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(df) if int(str(size)) <= limit else df


def spread(df: DataFrame, narrow: bool = False, most_bytes: int = SPREAD_BYTES) -> DataFrame:
    """Enough tasks for a costly row-wise stage: all cores, and no more than ``most_bytes`` of the table's files in one.

    For a table just opened: counting its splits and sizing its files runs nothing.  Tables with a split for every core pass unchanged
    and are not shuffled, unless they are ``narrow``: then the number of tasks grows with the table, so that the longest one does not.
    """
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    wanted = max(cores, -(-int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // most_bytes))
    return df.repartition(wanted) if splits < (wanted if narrow else cores) else df


def where_spread(df: DataFrame, condition: Column) -> DataFrame:
    """The rows that pass a costly test, tested in the tasks that hold them here.

    A plain filter moves below ``spread`` and joins, into the few tasks that read the table, and runs Python on rows that a join
    would drop; the outer form of explode keeps it in its place.
    """
    return df.select("*", F.explode_outer(F.array(condition)).alias("_passes")).where("_passes").drop("_passes")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage into the shared folder, so a lost executor does not replay the plan."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
