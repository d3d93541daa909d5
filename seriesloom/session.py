"""Session construction and the shared folder used for staged tables."""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "seriesloom") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``.

    Only a local session, whose tasks all run on this machine, may leave it unset; its folder is in the warehouse.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = spark.conf.get("spark.sql.warehouse.dir") + "/seriesloom-stage"
    return named.rstrip("/")


_STAGED: list[str] = []


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, so that runs never overwrite each other.

    It is removed when the driver ends.
    """
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not _STAGED:
        atexit.register(clear_staged)
    _STAGED.append(path)
    return path


def clear_staged() -> None:
    """Remove what this driver has staged, if its session still runs; results that read it end here."""
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _STAGED:
        path = jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        path.getFileSystem(conf).delete(path, True)
