"""BM25 over tables: term statistics, postings and top-n documents for a table of queries.

Input tables
    documents  chunk_id, pos (corpus order, the tie-breaker), tokens ARRAY<STRING> [, client_id]
    queries    query_id, tokens ARRAY<STRING> [, client_id]
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from guichet.functions.text import tokenize
from guichet.operators.sizing import broadcast_if_small, fits
from guichet.params import DEFAULTS, Params

# `explode_outer` is used on computed arrays throughout: for a plain `explode` the optimizer infers a
# filter on the array's size and would evaluate the whole tokenization once more per reference.
_MARKER = ""  # one extra token per document: carries the document count and the lengths


def analyze(df: DataFrame, text: str, stem: bool = True, out: str = "tokens", composed: bool = False) -> DataFrame:
    return df.withColumn(out, tokenize(F.col(text), stem=stem, composed=composed))


def idf(n: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def postings(documents: DataFrame) -> DataFrame:
    """(term, chunk_id, pos, client_id, tf, len): the inverted index, aggregated on the map side first."""
    rows = documents.select(*_document_columns(documents), F.size("tokens").alias("len"), F.explode_outer("tokens").alias("term"))
    return rows.where(F.col("term").isNotNull()).groupBy("term", "chunk_id", "pos", "client_id", "len").agg(F.count("*").alias("tf"))


def corpus_stats(documents: DataFrame) -> DataFrame:
    """One row: number of documents and average length."""
    return documents.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avg_len"))


def term_stats(documents: DataFrame, *by: str) -> DataFrame:
    """Document frequency, total frequency and idf of every term, optionally per group of documents."""
    sizes = documents.groupBy(*by).agg(F.count("*").alias("n"))

    def rows(tokens: Column, df: int, cf: int) -> Column:
        return F.transform(tokens, lambda t: F.struct(t.alias("term"), F.lit(df).alias("df"), F.lit(cf).alias("cf")))

    # A document lists its tokens for the total and its distinct tokens for the document frequency, so
    # one sum per term, combined on the map side, gives both: no exchange by document.
    both = F.concat(rows(F.col("tokens"), 0, 1), rows(F.array_distinct("tokens"), 1, 0))
    listed = documents.select(*by, F.explode_outer(both).alias("t")).where(F.col("t").isNotNull())
    totals = listed.groupBy(*by, F.col("t.term").alias("term")).agg(F.sum("t.df").alias("df"), F.sum("t.cf").alias("cf"))
    # The sizes hold one row per group, or a single row.
    joined = totals.join(broadcast_if_small(sizes), list(by)) if by else totals.crossJoin(F.broadcast(sizes))
    return joined.withColumn("idf", idf(F.col("n"), F.col("df")))


def bm25_topk(documents: DataFrame, queries: DataFrame, n: int = DEFAULTS.candidate_k, params: Params = DEFAULTS) -> DataFrame:
    """Best `n` documents of every query: (query_id, chunk_id, pos, score, rank).

    Statistics are those of the whole corpus even when visibility filters the candidates. Scores
    are rounded to nine decimals before ranking, so the order does not depend on the order in
    which a shuffle delivers the terms; ties follow the corpus order. A document of null tokens is an empty one.
    """
    terms = query_terms(queries)
    documents = documents.withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))
    scored = _score_broadcast(documents, terms, params) if fits(terms, params.broadcast_rows, params.broadcast_bytes) \
        else _score_shuffled(documents, terms, params)
    return top_n(scored.withColumn("score", F.round("score", 9)), n)


def top_n(scored: DataFrame, n: int) -> DataFrame:
    """Top-n per query; Spark limits each task to `n` rows per query before the exchange."""
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("pos"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def _document_columns(documents: DataFrame) -> list[Column]:
    owner = F.col("client_id") if "client_id" in documents.columns else F.lit(None).cast("string")
    return [F.col("chunk_id"), F.col("pos"), owner.alias("client_id")]


def query_terms(queries: DataFrame) -> DataFrame:
    client = F.col("client_id") if "client_id" in queries.columns else F.lit(None).cast("string")
    return queries.select("query_id", client.alias("asking"), F.explode_outer(F.array_distinct("tokens")).alias("term")).where(F.col("term").isNotNull())


def _visible() -> Column:
    return F.col("client_id").isNull() | (F.col("client_id") == F.col("asking"))


def saturation(params: Params, avg_len: Column) -> Column:
    """What a term's count in a document weighs, before its idf."""
    k1, b = F.lit(params.bm25_k1), F.lit(params.bm25_b)
    return F.col("tf") * (k1 + F.lit(1.0)) / (F.col("tf") + k1 * (F.lit(1.0) - b + b * F.col("len") / avg_len))


def _gain(params: Params) -> Column:
    return F.col("idf") * saturation(params, F.col("avg_len"))


def _score_broadcast(documents: DataFrame, terms: DataFrame, params: Params) -> DataFrame:
    """Query terms proven small: one exchange of the matching tokens, hashed by document.

    Every document also emits a marker token, so the same exchange yields the document count, the
    lengths and the document frequencies (its second reader reuses it). Scores are then summed per
    (document, query) without another exchange, and only top-n rows per task leave for the ranking.
    """
    numbered = (
        terms.select("term").distinct()
        .withColumn("term_id", F.row_number().over(W.orderBy("term")))
        .unionByName(documents.sparkSession.range(1).select(F.lit(_MARKER).alias("term"), F.lit(0).alias("term_id")))
    )
    tokens = documents.select(
        *_document_columns(documents),
        F.size("tokens").alias("len"),
        F.explode_outer(F.concat("tokens", F.array(F.lit(_MARKER)))).alias("term"),
    )
    found = (
        tokens.join(F.broadcast(numbered), "term").drop("term")
        .repartition("chunk_id")
        .groupBy("chunk_id", "pos", "client_id", "len", "term_id").agg(F.count("*").alias("tf"))
    )
    counts = found.groupBy("term_id").agg(F.count("*").alias("df"), F.sum("len").alias("total_len"))
    # Conditional aggregates, not filters: a filter would be pushed below the exchange and stop its reuse.
    marker = F.col("term_id") == 0
    corpus = counts.agg(
        F.max(F.when(marker, F.col("df"))).alias("n"),
        F.max(F.when(marker, F.col("total_len") / F.col("df"))).alias("avg_len"),
    )
    weights = counts.crossJoin(F.broadcast(corpus)).select("term_id", "avg_len", idf(F.col("n"), F.col("df")).alias("idf"))
    asked = terms.join(F.broadcast(numbered), "term").drop("term")
    # Both tables below hold at most one row per (query, term): the side whose size was checked.
    weighted = found.join(F.broadcast(weights), "term_id").withColumn("gain", _gain(params))
    return (
        weighted.join(F.broadcast(asked), "term_id").where(_visible())
        .groupBy("chunk_id", "pos", "query_id").agg(F.sum("gain").alias("score"))
    )


def _score_shuffled(documents: DataFrame, terms: DataFrame, params: Params) -> DataFrame:
    """Query sets of any size: sort-merge join on the term.

    Terms shared by many queries and many documents are salted: the postings of a term spread over
    its salts, and the (small) query side of that term is repeated once per salt.
    """
    lists = postings(documents)
    frequencies = lists.groupBy("term").agg(F.count("*").alias("df"))
    salts = F.ceil(F.col("df") / params.hot_key_rows)  # at most `hot_key_rows` postings of a term in a task
    asked = (
        terms.join(frequencies, "term")
        .withColumn("salts", salts)
        .crossJoin(F.broadcast(corpus_stats(documents)))
        .withColumn("idf", idf(F.col("n"), F.col("df")))
        .withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
        .select("query_id", "asking", "term", "salt", "avg_len", "idf")
    )
    salted = (
        lists.join(frequencies, "term")
        .withColumn("salt", F.pmod(F.xxhash64("chunk_id"), salts))
        .drop("df")
    )
    return (
        salted.join(asked, ["term", "salt"]).where(_visible())
        .groupBy("chunk_id", "pos", "query_id").agg(F.sum(_gain(params)).alias("score"))
    )


__all__ = ["analyze", "bm25_topk", "broadcast_if_small", "corpus_stats", "idf", "postings", "term_stats", "top_n"]
