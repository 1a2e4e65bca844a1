"""Reference data: clients and SLA matrix, labelled cases, thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLIENTS_SCHEMA = (
    "clients array<struct<client_id: string, nom: string, formule: string, date_debut: date, date_fin: date, "
    "astreinte_weekend: boolean, sites: array<string>>>, sla_heures map<string, map<string, int>>"
)
CASES_SCHEMA = (
    "id string, split string, category string, tags array<string>, "
    "input struct<q: string, client_id: string, montant: double>, expected_route string, expected_final_route string, "
    "expected_docs array<string>, forbidden_docs array<string>, expected_facts array<string>, "
    "forbidden_facts array<string>, expected_pii array<string>, note string"
)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def read_clients(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(clients, sla) of the reference file; a missing file gives empty tables, a malformed one fails the job."""
    if _exists(spark, path):
        raw = spark.read.schema(CLIENTS_SCHEMA).json(path, multiLine=True, mode="FAILFAST")
    else:
        raw = spark.createDataFrame([], CLIENTS_SCHEMA)
    clients = raw.select(F.inline("clients"))
    sla = raw.select(F.explode("sla_heures").alias("formule", "p")).select("formule", F.explode("p").alias("priority", "hours"))
    return clients, sla


def read_cases(spark: SparkSession, path: str, split: str = "all") -> DataFrame:
    cases = spark.read.schema(CASES_SCHEMA).json(path, multiLine=True, mode="FAILFAST")
    return cases if split == "all" else cases.where(F.col("split") == split)


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    """(metric, kind, bound); a missing file gates nothing."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "metric string, kind string, bound double")
    raw = spark.read.schema("min map<string, double>, max map<string, double>").json(path, multiLine=True, mode="FAILFAST")
    kinds = F.create_map(F.lit("min"), F.col("min"), F.lit("max"), F.col("max"))
    return raw.select(F.explode(kinds).alias("kind", "m")).where(F.col("m").isNotNull()).select(
        F.explode("m").alias("metric", "bound"), "kind"
    ).select("metric", "kind", "bound")
