"""Operating figures, feedback, listings and usage over the operational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guichet.params import DEFAULTS, Params


def share(condition: Column) -> Column:
    """Rate of a condition, four decimals, NULL over nothing."""
    return F.round(F.count_if(condition) / F.nullif(F.count("*"), F.lit(0)), 4)


def recent(log: DataFrame, ts: str = "ts", n: int | None = None, tie: str | None = None, params: Params = DEFAULTS) -> DataFrame:
    """The whole log, or its `n` most recent rows where a number is asked for (a top-k: a task keeps at most `n`)."""
    n = n or params.recent_requests
    if n is None:
        return log
    order = [F.col(ts).desc(), *([F.col(tie).desc()] if tie else [])]
    return log.orderBy(*order).limit(n)


def listing(table: DataFrame, newest: Column, limit: int = 50, since: Column | None = None, status: str | None = None) -> DataFrame:
    """Newest first, with optional inclusive lower bound and status."""
    if since is not None:
        table = table.where(since)
    if status is not None:
        table = table.where(F.col("status") == status)
    return table.orderBy(newest.desc()).limit(limit)


def lookup(table: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows of the given keys; unknown or malformed keys give nothing."""
    return table.join(keys.select(key).distinct(), key, "left_semi")


def figures() -> list[Column]:
    """Aggregates over logged requests, whole or by group."""
    return [
        F.count("*").alias("requests"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY latency_ms)").cast("bigint").alias("latency_ms_p50"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms)").cast("bigint").alias("latency_ms_p95"),
        F.round(F.coalesce(F.sum("cost_eur"), F.lit(0.0)), 6).alias("cost_eur_total"),
        F.round(F.avg("cost_eur"), 6).alias("cost_eur_avg"),
        share(F.col("llm_calls") > 0).alias("llm_call_share"),
        share(F.col("route") == "human").alias("escalation_rate"),
        F.count_if(F.col("error").isNotNull() & (F.col("error") != "")).alias("errors"),
    ]


def operating_metrics(log: DataFrame, pending: DataFrame, params: Params = DEFAULTS, tie: str | None = None) -> DataFrame:
    """One row of figures over the requests (all, or the most recent)."""
    rows = recent(log, tie=tie, params=params)
    result = rows.agg(*figures())
    waiting = pending.agg(F.count("*").alias("pending_actions"))
    return result.crossJoin(F.broadcast(waiting))


def counts_by(log: DataFrame, *dimensions: str, params: Params = DEFAULTS, tie: str | None = None) -> DataFrame:
    """Counts of requests per value of every dimension, and overall: (dimension, value, n)."""
    rows = recent(log, tie=tie, params=params).select(*dimensions)
    name = F.lit("all")
    value = F.lit(None).cast("string")
    grouped = rows.groupingSets([(), *((d,) for d in dimensions)], *dimensions).agg(
        F.count("*").alias("n"), *[F.grouping(d).alias(f"g_{d}") for d in dimensions]
    )
    for d in dimensions:
        name = F.when(F.col(f"g_{d}") == 0, d).otherwise(name)
        value = F.when(F.col(f"g_{d}") == 0, F.col(d)).otherwise(value)
    return grouped.select(name.alias("dimension"), value.alias("value"), "n")


def feedback_stats(feedback: DataFrame, log: DataFrame) -> DataFrame:
    """(route, n, ok, ok_rate) per route of the rated request; the NULL route is the total."""
    rated = feedback.select("request_id", "ok").join(log.select("request_id", "route"), "request_id")
    return (
        rated.rollup("route")
        .agg(F.count("*").alias("n"), F.count_if("ok").alias("ok"))
        .withColumn("ok_rate", F.round(F.col("ok") / F.col("n"), 4))
    )


def split_feedback(feedback: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(feedback on a logged request, refused feedback)."""
    known = log.select("request_id")
    return feedback.join(known, "request_id", "left_semi"), feedback.join(known, "request_id", "left_anti")


def candidate_cases(feedback: DataFrame, log: DataFrame) -> DataFrame:
    """Requests rated KO, oldest first, with empty expectations for a person to fill in."""
    none = F.lit(None).cast("string")
    empty = F.array().cast("array<string>")
    return (
        feedback.where(~F.col("ok"))
        .select("request_id", "comment", F.col("ts").alias("rated_at"))
        .join(log, "request_id")
        .select(
            "request_id",
            F.struct(F.col("q_masked").alias("q"), F.col("client_id"), F.lit(None).cast("double").alias("montant")).alias("input"),
            F.col("route").alias("observed_route"), F.col("mode").alias("observed_mode"), F.col("comment").alias("handler_comment"),
            none.alias("expected_route"), none.alias("expected_final_route"), empty.alias("expected_docs"), empty.alias("expected_facts"),
            F.lit("À compléter par un gestionnaire avant ajout au jeu de référence.").alias("note"), "rated_at",
        )
        .orderBy("rated_at", "request_id")
    )


def usage_rollup(calls: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Per request: calls, tokens, cost (6 decimals), last model named, and whether the cost is above budget."""
    return (
        calls.groupBy("request_id")
        .agg(
            F.count("*").alias("llm_calls"),
            F.sum("prompt_tokens").alias("prompt_tokens"),
            F.sum("completion_tokens").alias("completion_tokens"),
            F.round(F.sum("cost_eur"), 6).alias("cost_eur"),
            F.max_by("model", F.when(F.coalesce(F.col("model"), F.lit("")) != "", F.col("seq"))).alias("model"),
        )
        .withColumn("over_budget", F.col("cost_eur") > params.budget_eur)
    )


def escalate_errors(responses: DataFrame, requests: DataFrame) -> DataFrame:
    """One response per request: a request without response, or with an error, becomes a human escalation."""
    answer = "La demande n'a pas pu être traitée automatiquement. Elle est transmise à un gestionnaire."
    failed = F.col("route").isNull() | F.col("error").isNotNull()
    return (
        requests.select("request_id")
        .join(responses, "request_id", "left")
        .withColumn("error", F.coalesce("error", F.when(F.col("route").isNull(), "NoResponse")))
        .withColumn("mode", F.when(failed, "none").otherwise(F.col("mode")))
        .withColumn("answer", F.when(failed, answer).otherwise(F.col("answer")))
        .withColumn("route", F.when(failed, "human").otherwise(F.col("route")))
    )
