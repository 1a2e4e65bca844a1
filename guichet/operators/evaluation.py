"""Scoring of labelled cases: checks, summary per split, confusion, gate and failing cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guichet.functions import references as rf
from guichet.operators.ordering import nearest_rank
from guichet.session import checkpoint_root

# Check behind each reported rate.
RATES = {
    "routing_accuracy": "routing",
    "final_route_accuracy": "final_route",
    "retrieval_hit_rate": "retrieval",
    "citation_hit_rate": "citation",
    "fact_accuracy": "facts",
    "pii_accuracy": "pii",
}
VIOLATIONS = {"forbidden_doc_violations": "forbidden_docs", "forbidden_fact_violations": "forbidden_facts"}


def hit(expected: Column, found: Column) -> Column:
    return F.arrays_overlap(expected, found)


def reciprocal_rank(expected: Column, found: Column) -> Column:
    """1 / rank of the first expected document of a ranked list, 0 when absent."""
    ranked = F.transform(found, lambda d, i: F.when(F.array_contains(expected, d), F.lit(1.0) / (i + 1)).otherwise(0.0))
    return F.coalesce(F.array_max(ranked), F.lit(0.0))


def first_hit_ranks(expected: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, hit, reciprocal_rank) for expected pairs (query_id, doc) against ranked hits (query_id, doc, rank)."""
    # `expected` is read once, and is reduced to one row for each question before anything else
    ranked = expected.join(hits.select("query_id", "doc", "rank"), ["query_id", "doc"], "left").groupBy("query_id").agg(F.min("rank").alias("first"))
    return ranked.select("query_id", F.col("first").isNotNull().alias("hit"), F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"))


def checks(cases: DataFrame, results: DataFrame) -> DataFrame:
    """Every check that applies to each case, as `checks` MAP<STRING, BOOLEAN>, with the reasons of the failures.

    cases: id, split, category, expected_route, expected_final_route, expected_docs, forbidden_docs,
    expected_facts, forbidden_facts, expected_pii. results: id, route, final_route, pii, retrieved, cited, answer.
    """
    c = F.col
    joined = cases.join(results, "id", "left")
    answered = c("expected_final_route").isin("rag", "agent")
    has_docs = F.size("expected_docs") > 0
    leaked = F.array_sort(F.array_intersect(F.array_distinct("forbidden_docs"), F.array_union("retrieved", "cited")))
    scored = (
        joined.withColumn("leaked", leaked)
        .withColumn("missing", rf.missing_facts(c("answer"), c("expected_facts")))
        .withColumn("present", rf.present_facts(c("answer"), c("forbidden_facts")))
        .withColumn("wanted_pii", F.array_sort("expected_pii"))
    )
    rules = [
        ("routing", F.lit(True), c("route").eqNullSafe(c("expected_route")), F.concat(F.lit("route "), c("route"), F.lit(", attendue "), c("expected_route"))),
        (
            "final_route", F.lit(True), c("final_route").eqNullSafe(c("expected_final_route")),
            F.concat(F.lit("route finale "), c("final_route"), F.lit(", attendue "), c("expected_final_route")),
        ),
        ("pii", F.lit(True), F.array_sort("pii").eqNullSafe(c("wanted_pii")), F.concat(F.lit("données masquées "), F.array_join("pii", ", "), F.lit(", attendues "), F.array_join("wanted_pii", ", "))),
        ("retrieval", has_docs, hit(c("expected_docs"), c("retrieved")), F.lit("aucun document attendu dans les sources")),
        ("citation", has_docs & answered, hit(c("expected_docs"), c("cited")), F.lit("aucun document attendu cité")),
        ("forbidden_docs", F.size("forbidden_docs") > 0, F.size("leaked") == 0, F.concat(F.lit("document interdit atteint : "), F.array_join("leaked", ", "))),
        ("facts", F.size("expected_facts") > 0, F.size("missing") == 0, F.concat(F.lit("faits absents de la réponse : "), F.array_join("missing", ", "))),
        ("forbidden_facts", F.size("forbidden_facts") > 0, F.size("present") == 0, F.concat(F.lit("faits interdits dans la réponse : "), F.array_join("present", ", "))),
    ]
    entries = F.array_compact(F.array(*[F.when(applies, F.struct(F.lit(name), F.coalesce(ok, F.lit(False)))) for name, applies, ok, _ in rules]))
    reasons = F.array_compact(F.array(*[F.when(applies & ~F.coalesce(ok, F.lit(False)), F.coalesce(why, F.lit(name))) for name, applies, ok, why in rules]))
    return (
        scored.withColumn("checks", F.map_from_entries(entries))
        .withColumn("failures", unfaithful(reasons, c("faithful")) if "faithful" in joined.columns else reasons)
        .withColumn("reciprocal_rank", F.when(has_docs, reciprocal_rank(c("expected_docs"), c("retrieved"))))
        .drop("leaked", "missing", "present", "wanted_pii")
    )


def unfaithful(reasons: Column, faithful: Column) -> Column:
    """Reasons, with one more where an answer was judged and found unfaithful."""
    return F.when(faithful.eqNullSafe(F.lit(False)), F.array_append(reasons, F.lit("réponse non fidèle aux sources"))).otherwise(reasons)


def summarise(results: DataFrame) -> DataFrame:
    """Metrics per split and overall ("all"): rates, MRR, violations, faithfulness, latency, cost.

    `results` carries split, checks, reciprocal_rank, faithful, latency_ms, cost_eur.
    """
    def outcome(name: str) -> Column:
        return F.col("checks")[name]

    def rate(flag: Column) -> Column:
        return F.round(F.avg(flag.cast("double")), 4)

    measures = [
        F.count("*").alias("cases"),
        *[rate(outcome(check)).alias(metric) for metric, check in RATES.items()],
        F.round(F.avg("reciprocal_rank"), 4).alias("retrieval_mrr"),
        *[F.count_if(~outcome(check)).alias(metric) for metric, check in VIOLATIONS.items()],
        rate(F.col("faithful")).alias("faithfulness"),
        F.count("faithful").alias("judged_answers"),
        F.round(F.avg("latency_ms")).cast("bigint").alias("latency_ms_mean"),
        F.round(F.sum("cost_eur"), 6).alias("cost_eur_total"),
        F.round(F.avg("cost_eur"), 6).alias("cost_eur_mean"),
    ]
    checkpoint_root(results.sparkSession)
    # read by the rates and twice by the percentile: the cases are answered and checked once
    results = results.select("split", "checks", "reciprocal_rank", "faithful", "latency_ms", "cost_eur").checkpoint()
    figures = results.rollup("split").agg(*measures).withColumn("split", F.coalesce("split", F.lit("all")))
    p95 = nearest_rank(results, "latency_ms", {"latency_ms_p95": 95}, "split").unionByName(
        nearest_rank(results.withColumn("split", F.lit("all")), "latency_ms", {"latency_ms_p95": 95}, "split")
    )
    return figures.join(F.broadcast(p95), "split", "left")  # one row per split


def confusion(pairs: DataFrame, expected: str, actual: str) -> DataFrame:
    return pairs.groupBy(F.col(expected).alias("expected"), F.col(actual).alias("actual")).agg(F.count("*").alias("n"))


def long_metrics(summary: DataFrame, *metrics: str) -> DataFrame:
    """One row of metrics as (metric, value)."""
    return summary.select(
        F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("m")
    ).select("m.*")


def gate(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(metric, kind, bound, value, passed): a missing value misses its bound."""
    value = F.col("value")
    ok = F.when(F.col("kind") == "min", value >= F.col("bound")).otherwise(value <= F.col("bound"))
    return thresholds.join(metrics, "metric", "left").select("metric", "kind", "bound", "value", F.coalesce(ok, F.lit(False)).alias("passed"))


def failing(results: DataFrame) -> DataFrame:
    return results.where(F.size("failures") > 0).select("id", "split", "category", F.col("failures").alias("reasons"))
