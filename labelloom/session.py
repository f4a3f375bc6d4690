"""Session construction for local use, and the reliable lineage cut."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  driver_memory: str = "8g") -> SparkSession:
    """A small-machine session; on a cluster the submitter's settings are used as they are."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName("labelloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.labelloom.spread", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Without that setting a session on one machine gets a temporary folder; a cluster, whose
    executors could not read each other's files there, gets an error.
    """
    active = spark.sparkContext.getCheckpointDir()
    if active is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
            configured = tempfile.mkdtemp(prefix="labelloom-")
        spark.sparkContext.setCheckpointDir(configured)
        active = spark.sparkContext.getCheckpointDir()
    return active


def materialise(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into a table in the shared folder and read it from there afterwards.

    Used where several jobs read one expensive result. Unlike a cache the table outlives
    the executors that wrote it, and unlike a checkpointed row stream its readers prune
    columns, push filters down and know its size.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete everything this session has stored in the shared folder.

    For the end of a plan, when its results are written and no frame built on stored tables
    will be read again.
    """
    active = spark.sparkContext.getCheckpointDir()
    if active is not None:
        folder = spark._jvm.org.apache.hadoop.fs.Path(active)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        for found in files.listStatus(folder):
            files.delete(found.getPath(), True)
