"""Session settings shared by every entry point."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

#: Settings that results depend on, or that every plan is written for.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str = "*", memory: str = "4g", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ledgerloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only on one machine (tests, the benchmark) is a temporary one made where none is named; on a
    cluster that raises, as each executor would write to a disk of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        atexit.register(shutil.rmtree, named.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def temporary_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, which is deleted when the application ends."""
    made = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(made)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return made


def table(spark: SparkSession, folder: str, name: str):
    """The Parquet table ``name`` of ``folder``."""
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def fingerprint(spark: SparkSession, folder: str, name: str) -> tuple:
    """What changes when a table is written anew: its path, files, bytes and time."""
    path = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(folder, f"{name}.parquet"))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    size = fs.getContentSummary(path)
    return path.toString(), size.getFileCount(), size.getLength(), fs.getFileStatus(path).getModificationTime()


def spread(rows, scan=None):
    """``rows`` dealt over all cores where the files of ``scan``, a plain scan (``rows`` itself if none is named), give it fewer partitions than half of them.

    A single file that can't be divided would otherwise keep one core busy and the others idle. A
    table of many files comes back as it is, without a shuffle.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if 2 * (rows if scan is None else scan).rdd.getNumPartitions() > cores else rows.repartition(cores)
