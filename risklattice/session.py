"""Session helpers. A cluster brings its own session; these only fill what is unset."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", name: str = "risklattice", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    ``spark.checkpoint.dir`` names it on a cluster, or a checkpoint folder set before. Where neither is, a session on one
    machine gets a fresh temporary folder; on a cluster, whose executors would each write to a disk of their own, this raises.
    """
    ctx = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or ctx.getConf().get("spark.checkpoint.dir")
    if root is None:
        root = ctx.getCheckpointDir()
    if root is None:
        if not ctx.master.startswith("local[") and ctx.master != "local":
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {ctx.master} share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if ctx.getCheckpointDir() is None:
        ctx.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a result feeds several later branches and recomputing it would be wasteful or,
    for a sampled or order-dependent result, inconsistent. Survives the loss of executors.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
