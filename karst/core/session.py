"""Session helpers: table loading, shared-folder persistence, stable hashing."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "karst", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; `master` only for local runs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory.

    A union may claim the partitioning its children share; when adaptive execution then
    coalesces the children differently, rows of one key end up in several partitions and
    an aggregation counts them apart. The claim is switched off for the session.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it.

    `spark.checkpoint.dir` of the session wins. Only where it is unset (single-JVM
    tests) a folder of this machine is used.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get(CHECKPOINT_KEY) or spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        return configured
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "karst-checkpoints")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(spark))


def cut(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared folder and read it back without its lineage.

    `checkpoint()` keeps the files until the frame is garbage collected (with
    `spark.cleaner.referenceTracking.cleanCheckpoints`), survives the loss of any
    executor, and lets a later plan start from a file scan.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SCRATCH: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; `clear_scratch`, at the latest the driver's end, deletes it."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _SCRATCH:
        atexit.register(clear_scratch)
    _SCRATCH.append((spark, path))
    return path


def clear_scratch() -> None:
    """Delete all written intermediate results; frames that read them are of no use afterwards."""
    while _SCRATCH:
        spark, path = _SCRATCH.pop()
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended: what lies on this machine can still go
            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def staged(df: DataFrame, *partition_by: str) -> DataFrame:
    """Like `cut`, as parquet: column pruning and statistics survive. The files go with `clear_scratch`."""
    spark = df.sparkSession
    path = scratch(spark, "stage")
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
