"""Session helpers: local sessions for tests and bench, and the cluster's shared folder."""

import os
import tempfile
import uuid

from pyspark.conf import SparkConf
from pyspark.sql import DataFrame, SparkSession


def _configured() -> bool:
    """Whether Spark's default settings name the shared folder."""
    return SparkConf().get("spark.checkpoint.dir") is not None


def local_session(cpus: str | int = "*", shuffle_partitions: int = 8, name: str = "docloom") -> SparkSession:
    """A session of one process. Its shared folder is a temporary one, unless Spark's defaults name another."""
    builder = SparkSession.builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="docloom-")) if not _configured() else SparkSession.builder
    return (
        builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # The JVM does not compile larger methods; Spark then generates smaller ones.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.driver.memory", os.environ.get("DOCLOOM_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, as the cluster names it in spark.checkpoint.dir."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return configured.rstrip("/")


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/docloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a result to the shared folder and read it back.

    Cuts the lineage so that several consumers do not compute it again, survives the loss of executors, and
    gives the planner the true size for its choice of join.
    """
    path = run_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
