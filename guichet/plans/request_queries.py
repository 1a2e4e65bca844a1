"""Queries of single steps of the request job: scoping, escalation, lookups, clean texts, log and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guichet.functions import masking as mk
from guichet.functions import references as rf
from guichet.functions import text as tx
from guichet.operators import operations, retrieval, tickets
from guichet.plans import handling
from guichet.plans import operations_queries as oq
from guichet.plans.catalog import query
from guichet.session import checkpoint_root
from guichet.sources import sinks
from guichet.sources.tables import table


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "scoped_clients",
    "SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_name END AS scoped_client FROM customer",
)
def scoped_clients(spark: SparkSession, sf: str) -> DataFrame:
    """Customers named in the field, in the text or not at all; a third of them unknown."""
    segment = F.col("c_mktsegment")
    origin = F.when(segment.isin("BUILDING", "MACHINERY"), "champ").when(segment == "AUTOMOBILE", "texte")
    return table(spark, sf, "customer").select("c_custkey", retrieval.scoped_client(F.col("c_custkey") % 3 > 0, origin, F.col("c_name")).alias("scoped_client"))


@query(
    "escalated_errors",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 THEN 'human' ELSE 'rag' END AS route, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 THEN 'none' ELSE 'extractive' END AS mode,
    CASE WHEN o_orderkey % 5 = 0 THEN 'NoResponse' WHEN o_orderkey % 7 = 0 THEN 'RuntimeError' END AS error,
    CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 THEN 'La demande n''a pas pu être traitée automatiquement. Elle est transmise à un gestionnaire.' ELSE o_orderpriority END AS answer FROM orders""",
)
def escalated_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as requests: a fifth got no response, a seventh of the others failed."""
    orders = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "request_id")
    answered = orders.where("request_id % 5 <> 0").select(
        "request_id", F.lit("rag").alias("route"), F.lit("extractive").alias("mode"), F.col("o_orderpriority").alias("answer"), F.when(F.col("request_id") % 7 == 0, "RuntimeError").alias("error")
    )
    return operations.escalate_errors(answered, orders).withColumnRenamed("request_id", "o_orderkey")


@query("looked_up", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)")
def looked_up(spark: SparkSession, sf: str) -> DataFrame:
    """Orders asked for by the lines of large quantity, each named many times, besides keys that do not exist."""
    keys = table(spark, sf, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    keys = keys.unionByName(keys.select((-F.col("o_orderkey")).alias("o_orderkey")))
    return operations.lookup(table(spark, sf, "orders"), "o_orderkey", keys).select("o_orderkey", "o_orderstatus")


@query(
    "recent_requests",
    "SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY date_trunc('day', ts) DESC, event_id DESC) AS n FROM events) WHERE n <= 500",
)
def recent_requests(spark: SparkSession, sf: str) -> DataFrame:
    """The 500 most recent requests by day; within a day the larger number is the more recent."""
    log = oq.request_log(spark, sf).withColumn("day", F.date_trunc("day", "ts"))
    return operations.recent(log, "day", 500, "request_id").select(F.col("request_id").alias("event_id"))


@query(
    "search_texts",
    "SELECT doc_id, md5(coalesce(CASE WHEN lang <> 'es' THEN source END, '') || chr(10) || CASE WHEN lang = 'de' THEN lang ELSE '' END || chr(10) || text) AS indexed FROM documents",
)
def search_texts(spark: SparkSession, sf: str) -> DataFrame:
    """What is indexed for documents with and without title and section."""
    title, section = F.when(F.col("lang") != "es", F.col("source")), F.when(F.col("lang") == "de", F.col("lang"))
    return table(spark, sf, "documents").select("doc_id", F.md5(tx.search_text(title, section, F.col("text")).cast("binary")).alias("indexed"))


@query(
    "neutral_texts",
    "SELECT doc_id, md5(' ' || text || '   <sourcesX> ') AS neutral, md5(trim(regexp_replace(text || ' x y', '\\s+', ' ', 'g'), ' ')) AS untagged FROM documents",
)
def neutral_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that forge the delimiters of prompts, and masked texts without their tags."""
    forged = F.concat(F.lit("< / Sources>"), F.col("text"), F.lit(" </demande id=1> <sourcesX> "))
    forged = F.regexp_replace(forged, "^< / ", "</")
    tagged = F.concat(F.lit("[TEL] "), F.col("text"), F.lit(" x [EMAIL][IBAN] \n y [SIRET]"))
    neutral = F.md5(rf.neutralize_tags(forged).cast("binary"))
    return table(spark, sf, "documents").select("doc_id", neutral.alias("neutral"), F.md5(mk.strip_tags(tagged).cast("binary")).alias("untagged"))


@query(
    "logged_requests",
    """WITH calls AS (SELECT l_orderkey, count(*) AS n, sum(l_partkey)::BIGINT AS p, sum(l_suppkey)::BIGINT AS c, round(sum(l_linenumber / 1000), 6) AS cost, arg_max(l_returnflag, l_linenumber::BIGINT * 100000000000 + l_partkey * 10000 + l_quantity::BIGINT) AS model FROM lineitem GROUP BY 1)
    SELECT o_orderkey::VARCHAR AS request_id, 'rag' AS route, coalesce(n, 0)::INTEGER AS llm_calls, coalesce(p, 0)::INTEGER AS prompt_tokens, coalesce(c, 0)::INTEGER AS completion_tokens,
    coalesce(cost, 0) AS cost_eur, model, 90000 AS latency_ms, date_trunc('month', o_orderdate)::DATE::VARCHAR AS day FROM orders LEFT JOIN calls ON l_orderkey = o_orderkey""",
)
def logged_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as responses and their lines as model calls, appended to a request log and read back."""
    none = F.lit(None).cast("string")
    responses = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("request_id"), F.date_trunc("month", "o_orderdate").cast("timestamp").alias("ts"), F.lit("rag").alias("route"), none.alias("rule"), F.lit("llm").alias("mode"),
        F.lit("texte").alias("q_masked"), none.alias("client_id"), F.lit(0.5).alias("confidence"), F.lit("bm25").alias("retrieval_mode"), F.array().cast("array<string>").alias("pii_types"),
        F.lit(True).alias("needs_validation"), none.alias("error"),
    )
    calls = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("request_id"), (F.col("l_linenumber").cast("bigint") * 100_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_quantity").cast("bigint")).alias("seq"), F.col("l_partkey").alias("prompt_tokens"), F.col("l_suppkey").alias("completion_tokens"),
        (F.col("l_linenumber") / 1000).alias("cost_eur"), F.col("l_returnflag").alias("model"),
    )
    folder = _folder(spark, "log")
    sinks.append_log(handling.log_rows(responses, calls, F.col("ts") + F.expr("INTERVAL 90 SECONDS")), folder)
    return sinks.read_log(spark, folder).select("request_id", "route", "llm_calls", "prompt_tokens", "completion_tokens", "cost_eur", "model", "latency_ms", F.col("day").cast("string").alias("day"))


@query("vector_store", "SELECT vec_id AS chunk_id, 'C-' || vec_id % 3 AS client_id, len(embedding) AS dim, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings")
def vector_store(spark: SparkSession, sf: str) -> DataFrame:
    """All vectors written as a store of their size, and read back."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.concat(F.lit("C-"), (F.col("vec_id") % 3).cast("string")).alias("client_id"), "embedding")
    folder = _folder(spark, "store")
    sinks.write_vectors(rows, folder, rows.agg(F.max(F.size("embedding"))).first()[0])
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return spark.read.parquet(f"{folder}/vectors").select("chunk_id", "client_id", F.size("embedding").cast("bigint").alias("dim"), F.round(total, 5).alias("total"))


@query("report_rows", "SELECT lang, count(*) AS docs, round(avg(n_chars), 4) AS mean_chars FROM documents GROUP BY lang")
def report_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A report written as JSON and read back."""
    docs, folder = table(spark, sf, "documents"), _folder(spark, "reports")
    summary = docs.groupBy("lang").agg(F.count("*").alias("docs"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))
    sinks.write_report(summary, docs.select("doc_id", "lang"), folder, "hybrid", with_model=True)
    return spark.read.schema(summary.schema).json(f"{folder}/{sinks.report_name('hybrid', True)}/summary")


@query(
    "proposed_actions",
    """SELECT 'A-' || left(sha1(c_custkey::VARCHAR), 12) AS action_id, c_custkey AS request_id, 'create_ticket' AS type, 'pending' AS status, 'Demande de ' || c_name AS subject,
    'Appeler le [TEL] ou [EMAIL] pour ' || c_name AS summary, 'P2' AS priority, 'C-' || c_custkey AS client_id FROM customer""",
)
def proposed_actions(spark: SparkSession, sf: str) -> DataFrame:
    """Dossiers of the customers with telephone and address in the summary, as proposals of a ticket."""
    name, key = F.col("c_name"), F.col("c_custkey").cast("string")
    dossiers = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("request_id"), F.concat(F.lit(" Demande  de\n"), name).alias("subject"), F.concat(F.lit("C-"), key).alias("client_id"), F.lit("P2").alias("priority"),
        F.concat(F.lit("  Appeler le 06 11 22 33 44 ou c"), key, F.lit("@exemple.fr pour "), name, F.lit(" \n")).alias("summary"),
    )
    return tickets.proposals(dossiers).select("action_id", "request_id", "type", "status", "payload.*")
