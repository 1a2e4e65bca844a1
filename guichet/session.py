"""Session settings shared by tests, the benchmark and the driver entry points."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def build_session(app: str = "guichet", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Session with the settings the jobs rely on (UTC, AQE); the cluster's own values win elsewhere."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = (
            builder.master(master)
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.driver.memory", "12g")
        )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    The cluster names it in `spark.checkpoint.dir`; a private folder is set only where that is
    missing (tests, a laptop), because executors of a cluster could not reach it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    current = spark.sparkContext.getCheckpointDir()
    if named:
        if current is None:
            spark.sparkContext.setCheckpointDir(named)
        return named.rstrip("/")
    if current is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")
