"""Session construction shared by tests, bench and command-line use."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "asofgraph", cores: int | None = None, **conf: str) -> SparkSession:
    """A local session with the settings that every operator here assumes.

    Only the UTC time zone and adaptive execution matter for results and plans; a cluster
    sets its own master, memory, shuffle partitions and ``spark.checkpoint.dir``.
    """
    cores = cores or os.cpu_count() or 4
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, set for checkpoint() too. Where none is configured, one under /tmp if all run on this machine, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    found = (found or "/tmp/checkpoints").rstrip("/")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def stored(rows: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet into the shared folder and read back, until the driver's JVM ends.

    For tables that a query reads several times: lineage ends there, and their size is known to the planner.
    """
    spark = rows.sparkSession
    path = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    rows.write.parquet(path)
    found = spark.read.schema(rows.schema).parquet(path)
    found.stored_at = path
    return found
