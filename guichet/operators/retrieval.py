"""Fusion of the lexical and dense lists, visibility, index compatibility and retrieval confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guichet.functions.text import tokenize
from guichet.operators.dense import cosine_topk
from guichet.operators.lexical import bm25_topk, top_n
from guichet.operators.sizing import fits
from guichet.params import DEFAULTS, Params


def scoped_client(known: Column, origin: Column, client_id: Column) -> Column:
    """Only a known client given in the field (not merely written in the text) opens its own rows."""
    return F.when(known & (origin == "champ"), client_id)


def visible(chunks: DataFrame, requests: DataFrame) -> DataFrame:
    """(request x chunk) visibility as two equi-joins: public rows per request are left to the search itself.

    Returns the owned chunks each request may read, one row per (query_id, chunk_id).
    """
    return requests.where(F.col("client_id").isNotNull()).select("query_id", "client_id").join(
        chunks.where(F.col("client_id").isNotNull()).select("chunk_id", "client_id"), "client_id"
    )


def fuse(lexical: DataFrame, dense: DataFrame, k: int = DEFAULTS.top_k, params: Params = DEFAULTS) -> DataFrame:
    """Reciprocal rank fusion: sum of 1 / (60 + rank) over both lists, cut to `k` after the fusion."""

    def side(hits: DataFrame, name: str) -> DataFrame:
        other = "dense" if name == "bm25" else "bm25"
        return hits.select(
            "query_id", "chunk_id", "pos",
            F.col("rank").alias(f"{name}_rank"), F.col("score").alias(f"{name}_score"),
            F.lit(None).cast("int").alias(f"{other}_rank"), F.lit(None).cast("double").alias(f"{other}_score"),
        )

    merged = (
        side(lexical, "bm25").unionByName(side(dense, "dense"))
        .groupBy("query_id", "chunk_id", "pos")
        .agg(*[F.max(c).alias(c) for c in ("bm25_rank", "bm25_score", "dense_rank", "dense_score")])
    )

    def share(rank: str) -> Column:
        return F.coalesce(F.lit(1.0) / (F.lit(params.rrf_k) + F.col(rank)), F.lit(0.0))

    return top_n(merged.withColumn("score", F.round(share("bm25_rank") + share("dense_rank"), 12)), k)


def lexical_only(lexical: DataFrame, k: int = DEFAULTS.top_k) -> DataFrame:
    """The lexical list cut to `k`, in the shape of the fused one."""
    return lexical.where(F.col("rank") <= k).select(
        "query_id", "chunk_id", "pos", F.col("rank").alias("bm25_rank"), F.col("score").alias("bm25_score"),
        F.lit(None).cast("int").alias("dense_rank"), F.lit(None).cast("double").alias("dense_score"),
        "score", "rank",
    )


def compatible(manifest: DataFrame, settings: dict[str, str]) -> bool:
    """Whether the vectors were built in hybrid mode with the backend, model and store asked for now."""
    row = manifest.first()
    built = row.asDict() if row else {}
    return built.get("retrieval_mode") == "hybrid" and all(built.get(k) == v for k, v in settings.items())


def search(
    chunks: DataFrame,
    queries: DataFrame,
    vectors: DataFrame | None = None,
    k: int = DEFAULTS.top_k,
    params: Params = DEFAULTS,
) -> DataFrame:
    """Hybrid search when vectors are given, lexical search otherwise. One row per (query, hit).

    `chunks` and `queries` carry `tokens`; for the hybrid form `queries` also carries `embedding`.
    """
    lexical = bm25_topk(chunks, queries, params.candidate_k, params)
    if vectors is None:
        return lexical_only(lexical, k)
    return fuse(lexical, cosine_topk(vectors, queries, params.candidate_k, params), k, params)


def attach_chunks(hits: DataFrame, chunks: DataFrame, asked: DataFrame, k: int = DEFAULTS.top_k, params: Params = DEFAULTS) -> DataFrame:
    """Hits with the columns of their chunk. Hits number at most k per query of `asked`, so the size of
    `asked` decides whether they are broadcast to the corpus (the search itself is not run for that)."""
    columns = [c for c in chunks.columns if c not in ("pos", "tokens")]
    small = fits(asked.select("query_id"), params.broadcast_rows // k)
    return chunks.select(*columns).join(F.broadcast(hits) if small else hits, "chunk_id")


def confidence(queries: DataFrame, hits: DataFrame, stem: bool = True, params: Params = DEFAULTS) -> DataFrame:
    """(query_id, n_sources, coverage, dense, confidence): how well the hits can answer each query.

    `hits` carries title, section and text. A query without token or without hit has confidence 0.
    """
    columns = [F.coalesce(F.col(c), F.lit("")) for c in ("title", "section", "text")]
    source = hits.withColumn("__text", F.concat_ws(" ", *columns)).select("query_id", "dense_score", "__text")
    asked = queries.select("query_id", F.array_distinct("tokens").alias("asked"))
    found = (
        source.withColumn("__tokens", tokenize(F.col("__text"), stem=stem))
        .join(asked, "query_id")
        .select("query_id", "dense_score", F.array_intersect("asked", "__tokens").alias("found"))
        .groupBy("query_id")  # at most k rows per query
        .agg(
            F.count("*").alias("n_sources"),
            F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"),
            F.max("dense_score").alias("best"),
        )
    )
    coverage = F.when(F.size("asked") > 0, F.size("found") / F.size("asked"))
    dense = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("best") - params.dense_floor) / params.dense_span))
    weight = params.coverage_weight
    return (
        asked.join(found, "query_id", "left")
        .withColumn("coverage", F.coalesce(coverage, F.lit(0.0)))
        .withColumn("dense", F.when(F.col("best").isNotNull(), dense))
        .withColumn(
            "confidence",
            F.when(F.col("coverage").isNull() | (F.size("asked") == 0) | F.col("n_sources").isNull(), 0.0)
            .when(F.col("best").isNull(), F.col("coverage"))
            .otherwise(weight * F.col("coverage") + (1 - weight) * F.col("dense")),
        )
        .select("query_id", F.coalesce("n_sources", F.lit(0)).alias("n_sources"), "coverage", "dense", "confidence")
    )
