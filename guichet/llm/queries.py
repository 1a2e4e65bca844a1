"""Named queries of the training-data operators, each with its SQL counterpart where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guichet.llm import ann, langid, lines, lm, mixing, sql, surrogates, toxicity, url_filter
from guichet.llm.common import remainder
from guichet.llm.decontaminate import contamination, is_contaminated
from guichet.llm.ngram_join import jaccard_classes
from guichet.llm.prefix_trie import prefix_trie
from guichet.llm.repeats import remove_repeats
from guichet.llm.spelling import variants
from guichet.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    return dict(_SQL)


def _query(text: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        _QUERIES[function.__name__] = function
        if text:
            _SQL[function.__name__] = text
        return function

    return register


@_query(sql.NGRAM_JOIN)
def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near-copies of `documents`: shingles of five words, similarity of 0.75 or more."""
    return jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@_query(sql.DECONTAMINATION)
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of `documents` inside windows of 13 words of `benchmark`."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "items").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), is_contaminated().alias("contaminated"))


@_query()
def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of `documents` outside strings of 400 bytes that occur more than once."""
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@_query()
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text of `documents`, learned from `labels` outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 4) != 2)
    scored = toxicity.score(docs, toxicity.fit(docs, labels), "doc_id")
    return scored.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"))


@_query()
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text of `documents`, learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(remainder("doc_id", 5) != 0).select("doc_id", "text", "lang"))
    found = langid.identify(docs, model)
    return found.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")


@_query()
def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of every text of `documents` under a model learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (remainder("doc_id", 7) != 2).alias("trains"))
    found = lm.score(docs).withColumn("held_out", ~F.col("trains"))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


@_query()
def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every vector of `embeddings` whose id is divisible by 100."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@_query(sql.LINE_DEDUP)
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` without lines on more than a twentieth of the pages of their source."""
    kept = lines.drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return kept.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("kept_md5"))


@_query(sql.MIXING)
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of `documents` mixed by temperature to 0.97 of the largest entropy, no source more than four times."""
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


@_query()
def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` with personal data replaced by keyed surrogates."""
    done = surrogates.replace(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.col("_entities").alias("n_entities"), F.col("_kinds").alias("kinds"), "text")


@_query(sql.PREFIX_TRIE)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix trie of `conversations`, each with up to three first turns of the conversation at its multiple of 20."""
    conversations = table(spark, sf_dir, "conversations")
    ids = conversations.where("conv_id is not null").select("conv_id").distinct()
    heads = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 20).alias("base"), remainder("conv_id", 4).alias("shared"))
    return prefix_trie(conversations, heads)


@_query(sql.URL_FILTER)
def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of `pages` against five rules and the list of the unwanted sites among all hosts of the table."""
    pages = table(spark, sf_dir, "pages")
    rules = spark.createDataFrame(sql.URL_RULES, "verdict string, host string, path string").withColumn("rule", F.lit(True))
    sites = pages.select(F.regexp_extract(url_filter.host_of(F.col("url")), sql.UNWANTED, 1).alias("host")).where("host <> ''").distinct()
    listed = sites.select(F.lit("block").alias("verdict"), "host", F.lit("").alias("path"), F.lit(False).alias("rule"))
    return url_filter.judge(pages, rules.union(listed))


@_query(sql.SPELLING)
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of `documents`; one word of about 97 in each document loses a letter first."""
    docs = table(spark, sf_dir, "documents")
    runs = F.regexp_extract_all(F.translate("text", sql.UPPER, sql.LOWER), F.lit("[a-z\u00C0-\u00FF]+"), F.lit(0))
    rows = docs.select("doc_id", F.explode(runs).alias("run"))
    mark = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    gone = (mark % F.length("run")).cast("int")
    shorter = F.concat(F.substring(F.col("run"), F.lit(1), gone), F.substring(F.col("run"), gone + 2, F.length("run")))
    return variants(rows.select(F.when(mark % 97 == 0, shorter).otherwise(F.col("run")).alias("word")))
