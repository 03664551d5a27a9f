"""Session set-up and the one place that cuts lineage."""

from __future__ import annotations

import gc
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, memory: str = "12g", app: str = "holdfast") -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; invent one only on a local master."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        shared = tempfile.mkdtemp(prefix="holdfast-checkpoint-")
    sc.setCheckpointDir(shared)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and continue from there.

    Used where a result depends on sampled range boundaries or is read several times by an
    iterative job: the stored copy survives the loss of an executor.
    """
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    out._holdfast_stored = True
    return out


def is_stored(df: DataFrame) -> bool:
    """Whether ``materialise`` made exactly this DataFrame."""
    return getattr(df, "_holdfast_stored", False)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files that no DataFrame refers to any more.

    It learns of them when the driver's JVM collects garbage, which a driver with little to do may not do for half an hour.
    """
    gc.collect()
    spark._jvm.System.gc()


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_SHIPPED = "spark.holdfast.shipped"


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once for each application."""
    sc = spark.sparkContext
    if spark.conf.get(_SHIPPED, "") != sc.applicationId:
        root = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp(prefix="holdfast-package-")  # the driver's own; Spark hands the file out
        sc.addPyFile(shutil.make_archive(f"{folder}/holdfast", "zip", root, "holdfast"))
        spark.conf.set(_SHIPPED, sc.applicationId)
