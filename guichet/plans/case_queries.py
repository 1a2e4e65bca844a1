"""Evaluation queries: every benchmark passage found in a document is a labelled case, answered by the lexical search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guichet.functions import text as tx
from guichet.operators import evaluation, retrieval
from guichet.plans import retrieval_queries as rq
from guichet.plans import sql as S
from guichet.plans.catalog import query
from guichet.sources.tables import table

_EMPTY = "array<string>"


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Cases: the documents holding a passage are expected, the document numbered like the passage is forbidden."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "lang")
    expected = rq.containment(spark, sf).join(docs, "doc").groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.col("doc").cast("string"))).alias("expected_docs"), F.min_by("lang", "doc").alias("expected_route")
    )
    words = F.filter(tx.plain_words(F.col("text")), lambda w: F.length(w) >= 5)
    fact = tx.strip_latin(F.get(words, F.lit(0)))
    passage = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.when(F.char_length("text") < 200, "dev").otherwise("test").alias("split"),
        F.when(F.contains("text", F.lit("\n")), "multi").otherwise("single").alias("category"),
        F.array(fact).alias("expected_facts"), F.array(F.lit(r"\btoken\b")).alias("forbidden_facts"),
    )
    return expected.join(passage, "query_id").select(
        F.col("query_id").cast("string").alias("id"), "split", "category", "expected_route", F.lit("rag").alias("expected_final_route"),
        "expected_docs", F.array(F.col("query_id").cast("string")).alias("forbidden_docs"), "expected_facts", "forbidden_facts",
        F.array().cast(_EMPTY).alias("expected_pii"),
    )


def answered(spark: SparkSession, sf: str) -> DataFrame:
    """What the search did with each passage: route of the best document, two cited documents, its text as the answer."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "lang", "text", "n_chars")
    asked = rq.questions(spark, sf)
    hits = retrieval.attach_chunks(rq.lexical_hits(spark, sf, 4), docs, asked)
    ordered = F.array_sort(F.collect_list(F.struct("rank", F.col("chunk_id").cast("string").alias("doc"))))
    return hits.groupBy("query_id").agg(  # at most four rows per question
        F.transform(ordered, lambda h: h["doc"]).alias("retrieved"), F.min_by("lang", "rank").alias("route"),
        F.min_by("text", "rank").alias("answer"), F.max("score").alias("best"), F.min_by("n_chars", "rank").alias("latency_ms"),
    ).select(
        F.col("query_id").cast("string").alias("id"), "route", F.when(F.col("best") >= 60, "rag").otherwise("human").alias("final_route"),
        F.array().cast(_EMPTY).alias("pii"), "retrieved", F.slice("retrieved", 1, 2).alias("cited"), "answer",
        F.when(F.col("latency_ms") % 3 > 0, F.col("latency_ms") % 3 == 1).alias("faithful"), F.col("latency_ms").cast("int").alias("latency_ms"),
        (F.col("latency_ms") / 1000000).alias("cost_eur"),
    )


def case_results(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.checks(labelled(spark, sf), answered(spark, sf))


_RESULTS = f"""{S.scores()}, {rq._GOLDEN},
hits AS (SELECT r.item_id, r.doc_id, score, rnk, d.lang, d.text, d.n_chars FROM ranked r JOIN documents d USING (doc_id) WHERE rnk <= 4),
found AS (SELECT item_id, list(doc_id ORDER BY rnk) AS retrieved, arg_min(lang, rnk) AS route, arg_min(text, rnk) AS answer, max(score) AS best, arg_min(n_chars, rnk) AS ms FROM hits GROUP BY item_id),
cases AS (SELECT g.item_id, list(g.doc_id) AS expected, arg_min(d.lang, g.doc_id) AS expected_route FROM golden g JOIN documents d USING (doc_id) GROUP BY g.item_id),
results AS (
  SELECT c.item_id, CASE WHEN length(b.text) < 200 THEN 'dev' ELSE 'test' END AS split, CASE WHEN contains(b.text, chr(10)) THEN 'multi' ELSE 'single' END AS category,
    expected_route, route, route = expected_route AS routing, best >= 60 AS final_route,
    len(list_intersect(expected, retrieved)) > 0 AS retrieval, len(list_intersect(expected, retrieved[1:2])) > 0 AS citation,
    NOT list_contains(retrieved, c.item_id) AS forbidden_docs,
    contains(strip_accents(lower(answer)), strip_accents(list_filter({S.words('b.text')}, lambda w: length(w) >= 5)[1])) AS facts,
    NOT regexp_matches(strip_accents(lower(answer)), '(^|[^0-9a-z_])token($|[^0-9a-z_])') AS forbidden_facts,
    coalesce(list_max(list_transform(range(1, len(retrieved) + 1), lambda i: CASE WHEN list_contains(expected, retrieved[i]) THEN 1.0::DOUBLE / i ELSE 0 END)), 0) AS rr,
    CASE WHEN ms % 3 > 0 THEN ms % 3 = 1 END AS faithful, ms, ms / 1000000 AS cost
  FROM cases c JOIN benchmark b USING (item_id) LEFT JOIN found USING (item_id))"""


@query(
    "eval_cases",
    f"""WITH {_RESULTS} SELECT item_id::VARCHAR AS id, split, category, routing, final_route, retrieval, citation, facts, forbidden_docs, forbidden_facts,
    round(rr, 6) AS reciprocal_rank FROM results""",
)
def eval_cases(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("checks")
    names = ("routing", "final_route", "retrieval", "citation", "facts", "forbidden_docs", "forbidden_facts")
    return case_results(spark, sf).select(
        "id", "split", "category", *[c[n].alias(n) for n in names], F.round("reciprocal_rank", 6).alias("reciprocal_rank")
    )


_RATE = "round(avg({0}::INT), 4) AS {1}"
_SUMMARY = f"""summary AS (SELECT coalesce(split, 'all') AS split, count(*) AS cases, {_RATE.format('routing', 'routing_accuracy')},
  {_RATE.format('final_route', 'final_route_accuracy')}, {_RATE.format('retrieval', 'retrieval_hit_rate')}, {_RATE.format('citation', 'citation_hit_rate')},
  {_RATE.format('facts', 'fact_accuracy')}, 1.0::DOUBLE AS pii_accuracy, round(avg(rr), 4) AS retrieval_mrr,
  sum((NOT forbidden_docs)::INT)::BIGINT AS forbidden_doc_violations, sum((NOT forbidden_facts)::INT)::BIGINT AS forbidden_fact_violations,
  round(avg(faithful::INT), 4) AS faithfulness, count(faithful) AS judged_answers, round(avg(ms))::BIGINT AS latency_ms_mean,
  quantile_disc(ms, 0.95)::INTEGER AS latency_ms_p95, round(sum(cost), 6) AS cost_eur_total, round(avg(cost), 6) AS cost_eur_mean
  FROM results GROUP BY ROLLUP (split))"""


@query("eval_summary", f"WITH {_RESULTS}, {_SUMMARY} SELECT * FROM summary")
def eval_summary(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.summarise(case_results(spark, sf))


# Bounds of the regression gate.
THRESHOLDS = [
    ("routing_accuracy", "min", 0.98), ("final_route_accuracy", "min", 0.89), ("retrieval_hit_rate", "min", 0.97),
    ("retrieval_mrr", "min", 0.84), ("citation_hit_rate", "min", 0.87), ("fact_accuracy", "min", 0.86), ("pii_accuracy", "min", 1.0),
    ("forbidden_doc_violations", "max", 0.0), ("forbidden_fact_violations", "max", 0.0),
]


@query(
    "eval_gate",
    f"""WITH {_RESULTS}, {_SUMMARY}, t(metric, kind, bound) AS (VALUES {', '.join(f"('{m}', '{k}', {b}::DOUBLE)" for m, k, b in THRESHOLDS)}),
    m AS (SELECT metric, value FROM (SELECT routing_accuracy::DOUBLE AS routing_accuracy, final_route_accuracy::DOUBLE AS final_route_accuracy,
      retrieval_hit_rate::DOUBLE AS retrieval_hit_rate, retrieval_mrr::DOUBLE AS retrieval_mrr, citation_hit_rate::DOUBLE AS citation_hit_rate,
      fact_accuracy::DOUBLE AS fact_accuracy, pii_accuracy::DOUBLE AS pii_accuracy, forbidden_doc_violations::DOUBLE AS forbidden_doc_violations,
      forbidden_fact_violations::DOUBLE AS forbidden_fact_violations FROM summary WHERE split = 'all') UNPIVOT (value FOR metric IN (COLUMNS(*))))
    SELECT metric, kind, bound, value, CASE kind WHEN 'min' THEN value >= bound ELSE value <= bound END AS passed FROM t LEFT JOIN m USING (metric)""",
)
def eval_gate(spark: SparkSession, sf: str) -> DataFrame:
    overall = evaluation.summarise(case_results(spark, sf)).where(F.col("split") == "all")
    metrics = evaluation.long_metrics(overall, *[m for m, _, _ in THRESHOLDS])
    return evaluation.gate(metrics, spark.createDataFrame(THRESHOLDS, "metric string, kind string, bound double"))


@query(
    "eval_failing",
    f"""WITH {_RESULTS} SELECT item_id::VARCHAR AS id, split, category, len(list_filter([NOT routing, NOT final_route, NOT retrieval, NOT citation, NOT facts,
    NOT forbidden_docs, NOT forbidden_facts, coalesce(NOT faithful, FALSE)], lambda x: x))::INTEGER AS failed FROM results
    WHERE NOT (routing AND final_route AND retrieval AND citation AND facts AND forbidden_docs AND forbidden_facts AND coalesce(faithful, TRUE))""",
)
def eval_failing(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.failing(case_results(spark, sf)).select("id", "split", "category", F.size("reasons").alias("failed"))


@query("eval_confusion", f"WITH {_RESULTS} SELECT expected_route AS expected, route AS actual, count(*) AS n FROM results GROUP BY ALL")
def eval_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.confusion(case_results(spark, sf), "expected_route", "route")


@query("confusion", "SELECT quality AS expected, toxic AS actual, count(*) AS n FROM labels GROUP BY ALL")
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.confusion(table(spark, sf, "labels"), "quality", "toxic")
