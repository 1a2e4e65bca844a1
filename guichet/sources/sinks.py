"""Table sinks: full rebuild of the index, append of the request log, evaluation reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guichet.operators.dense import check_vectors

REQUEST_LOG = (
    "request_id string, ts timestamp, route string, rule string, mode string, q_masked string, client_id string, "
    "confidence double, latency_ms int, llm_calls int, prompt_tokens int, completion_tokens int, cost_eur double, "
    "model string, retrieval_mode string, pii_types array<string>, needs_validation boolean, error string"
)


def write_chunks(chunks: DataFrame, folder: str) -> DataFrame:
    """Rebuild `chunks`; returns them read back."""
    chunks.write.mode("overwrite").parquet(f"{folder}/chunks")
    return chunks.sparkSession.read.parquet(f"{folder}/chunks")


def write_manifest(chunks: DataFrame, folder: str, settings: dict[str, str]) -> DataFrame:
    """Publish a rebuilt index: one row with its counts, settings and time, written after everything else."""
    manifest = chunks.agg(F.countDistinct("doc").alias("docs"), F.count("*").alias("chunks")).withColumn("created", F.current_timestamp())
    for name, value in settings.items():
        manifest = manifest.withColumn(name, F.lit(value))
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    return chunks.sparkSession.read.parquet(f"{folder}/manifest")


def write_vectors(vectors: DataFrame, folder: str, dim: int) -> None:
    """Replace all vectors; a vector of another size is refused before anything is replaced."""
    if not vectors.where(F.coalesce(F.size("embedding"), F.lit(-1)) != dim).isEmpty():
        raise ValueError(f"vector size differs from {dim}")
    check_vectors(vectors, dim).select("chunk_id", "client_id", "embedding").write.mode("overwrite").parquet(f"{folder}/vectors")


def append_log(responses: DataFrame, folder: str) -> None:
    """Append masked rows to the request log; an unknown column or a raw text is refused."""
    schema = responses.sparkSession.createDataFrame([], REQUEST_LOG).schema
    unknown = set(responses.columns) - set(schema.names)
    if unknown:
        raise ValueError(f"columns not in the request log: {sorted(unknown)}")
    columns = [
        (F.col(f.name) if f.name in responses.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields
    ]
    rows = responses.select(*columns).withColumn("day", F.to_date("ts"))
    # a day's rows meet in few files; a day that holds most of them is split
    rows.hint("rebalance", "day").write.mode("append").partitionBy("day").parquet(folder)


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def report_name(retrieval_mode: str, with_model: bool) -> str:
    return retrieval_mode + ("-llm" if with_model else "")


def write_report(summary: DataFrame, results: DataFrame, folder: str, retrieval_mode: str, with_model: bool = False) -> None:
    target = f"{folder}/{report_name(retrieval_mode, with_model)}"
    summary.write.mode("overwrite").json(f"{target}/summary")
    results.write.mode("overwrite").json(f"{target}/results")


def write_candidates(cases: DataFrame, folder: str) -> None:
    cases.write.mode("overwrite").json(folder)
