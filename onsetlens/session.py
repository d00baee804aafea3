"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import posixpath
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


FIRST_PARTITIONS = 1024
PARTITION_BYTES = "8m"  # of a shuffle as compressed, which sorts and hash maps hold many times over


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("onsetlens")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the session names; a private one only in local mode."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="onsetlens-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    return posixpath.join(checkpoint_folder(spark), "onsetlens", f"{name}-{uuid.uuid4().hex}")


def materialise(df: DataFrame, name: str = "table", compression: str = "snappy") -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and go on from it.

    The copy outlives lost executors, and later readers prune its columns.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpoint_tasks(df: DataFrame) -> DataFrame:
    """A reliable checkpoint that keeps the tasks of ``df``, for a stage bound by computing."""
    checkpoint_folder(df.sparkSession)
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)  # otherwise the last stage would run twice
    done = kept.checkpoint()
    kept.unpersist()
    return done


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings the joins count on: a hot person's tests are split over tasks.

    Without ``forceOptimizeSkewedJoin`` a join that feeds an aggregate by the same key is left
    unsplit.  Shuffles start with many partitions, which are coalesced to a size: the memory of
    a task that sorts and counts them follows from that size, not from the tables.
    """
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    first = max(FIRST_PARTITIONS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(first))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", PARTITION_BYTES)
    return spark


def parallel_tasks(spark: SparkSession) -> int:
    """Tasks for a stage bound by computing, whose few bytes would be coalesced into one."""
    return 4 * spark.sparkContext.defaultParallelism
