"""Session helpers: a local session for tests, shared work folders, lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", name: str = "factloom", **conf: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.factloom.textPartitions", str(cores if isinstance(cores, int) or cores.isdigit() else os.cpu_count()))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, as the cluster names it.

    A local session without the setting gets a temporary folder, as driver and tasks are one process
    there; on a cluster the setting must be given.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="factloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh_folder(spark: SparkSession, purpose: str) -> str:
    """A new sub-folder name under the shared folder; never reused."""
    return f"{shared_folder(spark).rstrip(os.sep)}/{purpose}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, purpose: str = "table", partition_by: str | None = None, compression: str | None = None) -> DataFrame:
    """Write a table once into the shared folder and go on from there.

    What several consumers or rounds read is computed once, survives lost executors, and stays
    columnar, so readers still prune columns and push filters down. See :func:`release`.
    """
    spark = df.sparkSession
    path = fresh_folder(spark, purpose)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    (writer.option("compression", compression) if compression else writer).parquet(path)
    _written(spark).append(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def _written(spark: SparkSession) -> list[str]:
    if not hasattr(spark, "_factloom_written"):
        spark._factloom_written = []
    return spark._factloom_written


def release(spark: SparkSession) -> None:
    """Delete the tables written by :func:`cut_lineage` in this session; their readers end with it."""
    paths, spark._factloom_written = _written(spark), []
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in paths:
        target = hadoop.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
