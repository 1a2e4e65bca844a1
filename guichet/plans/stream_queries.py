"""The batch rules run as streams over the files of a table, compared with the same SQL as their batch twin."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guichet.plans import operations_queries as oq
from guichet.plans import text_queries as tq
from guichet.plans.catalog import ORACLES, query
from guichet.session import checkpoint_root
from guichet.sources.tables import table
from guichet.streaming import jobs


def stream_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table's files as a stream: the table is one file or a folder of files of any name."""
    # a pattern with one match: a stream of a plain path must be a folder
    return spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{name}.[p]arquet")


def run(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """Drain the stream into a table of the shared checkpoint folder and read it back."""
    target = f"{checkpoint_root(spark)}/streams/{uuid.uuid4().hex}"
    started = jobs.write(stream, f"{target}/rows", f"{target}/checkpoint", mode)
    started.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{target}/rows")


@query("stream_dedupe", ORACLES["dispute_dedupe"].replace("a[2] AS ticket_request, event_id <> a[2] AS reused", "a[2] AS ticket_request"))
def stream_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    sent = stream_table(spark, sf, "events").select(
        F.col("event_id").alias("request_id"), "ts",
        F.sha1(F.concat_ws("|", F.col("user_id").cast("string"), "event_type").cast("binary")).alias("dedupe_key"),
    )
    return run(spark, jobs.dedupe_stream(sent)).select("request_id", "dedupe_key", "ticket_request")


@query("stream_admission", "SELECT event_id, admitted FROM (" + ORACLES["admission_audit"] + ")")
def stream_admission(spark: SparkSession, sf: str) -> DataFrame:
    rows = stream_table(spark, sf, "events").select(F.col("user_id").alias("caller"), "ts", F.col("event_id").alias("seq"))
    return run(spark, jobs.admission_stream(rows, 3, 86_400)).select(F.col("seq").alias("event_id"), "admitted")


@query(
    "stream_figures",
    f"""WITH {oq._LOG} SELECT strftime(d, '%Y-%m-%d') AS day, count(*) AS requests, quantile_disc(latency_ms, 0.5)::BIGINT AS latency_ms_p50,
    quantile_disc(latency_ms, 0.95)::BIGINT AS latency_ms_p95, round(sum(cost_eur), 6) AS cost_eur_total, round(avg(cost_eur), 6) AS cost_eur_avg,
    round(sum((NOT free)::INT) / count(*), 4) AS llm_call_share, round(sum((route = 'human')::INT) / count(*), 4) AS escalation_rate,
    sum(failed::INT)::BIGINT AS errors, any_value(coalesce(n, 0)) AS pending_actions
    FROM (SELECT *, date_trunc('day', ts) AS d FROM recent) LEFT JOIN (SELECT date_trunc('day', ts) AS d, count(*) AS n FROM events WHERE event_type = 'signup' GROUP BY 1) USING (d) GROUP BY d""",
)
def stream_figures(spark: SparkSession, sf: str) -> DataFrame:
    """Operating figures of every day, the open one included."""
    events = stream_table(spark, sf, "events")
    folder = f"{checkpoint_root(spark)}/streams/{uuid.uuid4().hex}"
    sink = jobs.batch_tables(folder, {"figures": lambda batch: batch})
    jobs.write_batches(jobs.window_figures(oq.request_log(spark, sf, events)), sink, f"{folder}/checkpoint", "update").awaitTermination()
    pending = table(spark, sf, "events").where(F.col("event_type") == "signup")
    return jobs.latest_figures(spark, folder, pending).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd")).withColumnRenamed("window_start", "day")


@query(
    "stream_intake_tables",
    "SELECT conv_id || '-' || turn AS request_id, is_valid AS accepted, CASE WHEN is_valid THEN '' ELSE reasons END AS reasons FROM (" + ORACLES["intake_validation"] + ")",
)
def stream_intake_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as requests, into a table of accepted and one of refused ones; every batch is written twice, as after a failure."""
    sent = tq.turn_requests(stream_table(spark, sf, "conversations")).withColumn("request_id", F.concat_ws("-", "conv_id", "turn")).withColumn("ts", F.current_timestamp())
    folder = f"{checkpoint_root(spark)}/streams/{uuid.uuid4().hex}"
    sink = jobs.intake_tables(tq.known_clients(spark, sf), folder)
    jobs.write_batches(sent, lambda batch, number: [sink(batch, number) for _ in range(2)] and None, f"{folder}/checkpoint").awaitTermination()
    accepted = spark.read.parquet(f"{folder}/accepted").select("request_id", F.lit(True).alias("accepted"), F.lit("").alias("reasons"))
    return accepted.unionByName(spark.read.parquet(f"{folder}/refused").select("request_id", F.lit(False).alias("accepted"), F.array_join("reasons", ",").alias("reasons")))


# A window is complete, and written, once the watermark (latest event less one hour) has passed its end.
@query(
    "stream_metrics",
    """WITH log AS (SELECT date_trunc('day', ts) AS d, ts, CASE WHEN event_type = 'error' THEN 'human' ELSE event_type END AS route, floor(value)::BIGINT AS ms, event_type = 'error' AS failed FROM events)
    SELECT strftime(d, '%Y-%m-%d') AS day, route, count(*) AS requests, sum(ms)::BIGINT AS latency_ms_total, sum(failed::INT)::BIGINT AS errors FROM log
    WHERE d + INTERVAL 1 DAY <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM log) GROUP BY ALL""",
)
def stream_metrics(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    log = stream_table(spark, sf, "events").select(
        "ts", F.when(kind == "error", "human").otherwise(kind).alias("route"), F.floor("value").cast("bigint").alias("latency_ms"),
        F.when(kind == "error", "RuntimeError").alias("error"),
    )
    rows = run(spark, jobs.rolling_metrics(log))
    return rows.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "route", "requests", "latency_ms_total", "errors")


@query("stream_intake", f"WITH {tq.ROUTED} SELECT request_id, rule, client_id FROM ruled")
def stream_intake(spark: SparkSession, sf: str) -> DataFrame:
    sent = tq.requests(spark, sf, stream_table(spark, sf, "orders"))
    return run(spark, jobs.intake_stream(sent, tq.known_clients(spark, sf))).select("request_id", "rule", "client_id")


