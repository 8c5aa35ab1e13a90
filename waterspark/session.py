"""Session helpers: a tuned local builder, and the folder shared by all executors."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Spark takes the size of a compressed file for that of its rows, some tenth of the truth,
#: and would send tables of hundreds of megabytes through the driver to broadcast them.
SIZE_CONF, ROWS_TO_FILE = "spark.sql.sources.fileCompressionFactor", "10.0"
BATCH_CONF, TEXT_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"


def local_session(cores: str | int = "*", app: str = "waterspark", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the local bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("WATERSPARK_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the Python workers, once per application.

    Spark serves the archive from the driver to every executor; an application that was
    submitted with the package already on its path needs no call, and one more does no harm.
    """
    context = spark.sparkContext
    if getattr(context, "_waterspark_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='waterspark-')}/waterspark-package", "zip", root.parent, root.name)
    context.addPyFile(archive)
    context._waterspark_shipped = True


def real_sizes(spark: SparkSession) -> None:
    """Have tables judged by the size of their rows, unless the session has its own factor."""
    if float(spark.conf.get(SIZE_CONF)) == 1.0:
        spark.conf.set(SIZE_CONF, ROWS_TO_FILE)


def small_batches(spark: SparkSession) -> None:
    """Hand rows of whole texts to Python in smaller batches, unless the session has its own
    size: 10,000 of them are some 25 MB, held several times over in the JVM and the worker."""
    if spark.conf.get(BATCH_CONF) == "10000":
        spark.conf.set(BATCH_CONF, TEXT_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's checkpoint folder.

    Only a local session without one gets a temporary folder of its own.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="waterspark-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors, unlike a local one."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)
