"""Tables, shared folders and small plan helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from guichet.session import checkpoint_root


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """What is written inside gives the disk of its exchanges back when it is stored, not when the driver collects garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, and any executor can read it again."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    with freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a table that nothing reads any more, by the file system of its folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spare(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of the table bears it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def parts(spark: SparkSession) -> int:
    """Number of buckets of an exchange: the cluster's own shuffle setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo `modulus`; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def records(columns: dict[str, list], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Record batches of at most `size` rows from plain lists."""
    count = len(next(iter(columns.values())))
    for i in range(0, count, size):
        yield pa.record_batch([pa.array(columns[f.name][i : i + size], f.type) for f in schema], schema=schema)


def handed_back(run: Callable) -> Callable:
    """`run` for mapInArrow; a worker that is done with a partition and waits gives the memory it has freed back to the system."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc alone
            trim(0)

    return runs


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.names.index(name))


