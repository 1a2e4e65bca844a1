"""Parquet tables as job inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use every core on a small input that is CPU-heavy per row.

    A file with a single row group is read by one task. When the whole input is smaller than one
    scan partition per core, moving its rows costs little and the text work runs on all cores. A
    larger input already has enough scan partitions and is returned as it is (no shuffle).
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores) if int(str(size)) < cores * split else df


def _bytes(value: str) -> int:
    value = value.strip().lower().rstrip("b")
    units = {"k": 2**10, "m": 2**20, "g": 2**30}
    return int(value[:-1]) * units[value[-1]] if value and value[-1] in units else int(value)
