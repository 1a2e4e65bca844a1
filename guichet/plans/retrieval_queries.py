"""Retrieval queries: `documents` as the corpus, `benchmark` as the questions, `embeddings` as the vectors."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guichet.functions import references as rf
from guichet.functions.vectors import hash_vectors
from guichet.operators import dense, lexical, passages, postings, retrieval
from guichet.operators.evaluation import first_hit_ranks
from guichet.operators.ordering import first_seen_numbers
from guichet.operators.sizing import broadcast_if_small, fits
from guichet.params import DEFAULTS as P
from guichet.plans import sql as S
from guichet.plans.catalog import ORACLES, query
from guichet.session import checkpoint_root
from guichet.sources.tables import spread, table


def chunk_texts(spark: SparkSession, sf: str, scoped: bool = False) -> DataFrame:
    """Documents as chunks; with `scoped`, a document that is not in English belongs to its source."""
    owner = F.when(F.col("lang") != "en", F.col("source")) if scoped else F.lit(None).cast("string")
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("pos"), owner.alias("client_id"),
        F.col("source").alias("doc"), F.col("lang").alias("title"), F.lit("").alias("section"), F.lit(1).alias("page"), "text",
    )


def corpus(spark: SparkSession, sf: str, scoped: bool = False) -> DataFrame:
    """Chunks with their tokens."""
    return lexical.analyze(spread(chunk_texts(spark, sf, scoped)), "text", stem=False, composed=True)


def questions(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return lexical.analyze(asked, "text", stem=False, composed=True)


def vectors(spark: SparkSession, sf: str, scoped: bool = False) -> DataFrame:
    """Vectors of known documents (a vector without a document is no candidate)."""
    known = table(spark, sf, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("pos"),
        (F.when(F.col("lang") != "en", F.col("source")) if scoped else F.lit(None).cast("string")).alias("client_id"),
    )
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return rows.join(known, "chunk_id")


def question_vectors(spark: SparkSession, sf: str) -> DataFrame:
    asked = questions(spark, sf)
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return asked.join(rows, "query_id")


def hybrid_hits(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.fuse(lexical_hits(spark, sf, P.candidate_k), dense.cosine_topk(vectors(spark, sf), question_vectors(spark, sf), P.candidate_k, normalize=True))


def bm25_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Top-k of the lexical list with the text of each chunk."""
    hits = retrieval.lexical_only(lexical_hits(spark, sf, P.top_k))
    return retrieval.attach_chunks(hits, chunk_texts(spark, sf), questions(spark, sf))


@query(
    "bm25_topk",
    f"WITH {S.scores()} SELECT item_id, doc_id, round(score, 6) AS score, rnk AS rank FROM ranked WHERE rnk <= {P.top_k}",
)
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    hits = lexical_hits(spark, sf, P.top_k)
    return hits.select(
        F.col("query_id").alias("item_id"), F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"),
        F.col("rank").cast("bigint").alias("rank"),
    )


_INDEXES: dict[tuple, postings.Index] = {}


def stored_index(spark: SparkSession, sf: str) -> postings.Index:
    """The index of the documents, stored in the shared folder when it is asked for first, and again when their files change."""
    files = table(spark, sf, "documents").select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("changed"))
    state = files.agg(F.count("*"), F.count_distinct("path"), F.max("changed")).first()
    key = (spark.sparkContext.applicationId, sf, *state)
    if key not in _INDEXES:
        _INDEXES[key] = postings.build(corpus(spark, sf, scoped=True), f"{checkpoint_root(spark)}/index-{uuid.uuid4().hex}")
    return _INDEXES[key]


def lexical_hits(spark: SparkSession, sf: str, n: int, asked: DataFrame | None = None) -> DataFrame:
    """Best documents of the questions from the stored index; `asked` with clients sees only what they may."""
    scoped = asked is not None
    return postings.bm25_index(stored_index(spark, sf), asked if scoped else questions(spark, sf), n, scoped)


@query("index_bm25_topk", ORACLES["bm25_topk"])
def index_bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The same ranking in two passes: blocks are bounded, and those that cannot reach the best are not opened."""
    hits = postings.bm25_index(stored_index(spark, sf), questions(spark, sf), P.top_k, scoped=False, params=replace(P, bounded_from=0))
    return hits.select(
        F.col("query_id").alias("item_id"), F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"),
        F.col("rank").cast("bigint").alias("rank"),
    )


@query(
    "index_postings",
    f"""WITH {S.DOCS} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, min(doc_id) AS first_doc, max(len)::INTEGER AS longest
    FROM (SELECT doc_id, term, len, count(*) AS tf FROM (SELECT doc_id, len(toks) AS len, unnest(toks) AS term FROM docs) GROUP BY ALL) GROUP BY term""",
)
def index_postings(spark: SparkSession, sf: str) -> DataFrame:
    """The stored blocks and term table, summed by term."""
    index = stored_index(spark, sf)
    first, longest = F.array_min("entries.number"), F.array_max("entries.len")
    lists = index.blocks.groupBy("term").agg(F.min(first).alias("first_doc"), F.max(longest).alias("longest"))
    return index.terms.select("term", "df", "cf").join(lists, "term")


_BLOCK_TOPS = f"""lens AS (SELECT doc_id, len(toks) AS dl FROM docs),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens),
post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM docs) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
qterms AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(qtoks) AS term FROM asked)),
tops AS (SELECT term, floor(doc_id / {P.block_width})::BIGINT AS block, max(tf * ({P.bm25_k1} + 1) / (tf + {P.bm25_k1} * (1 - {P.bm25_b} + {P.bm25_b} * dl / avgdl))) AS top
         FROM post JOIN lens USING (doc_id) CROSS JOIN stats GROUP BY ALL)"""


@query(
    "index_block_bounds",
    f"""WITH {S.DOCS}, {S.ASKED}, {_BLOCK_TOPS}
    SELECT item_id, block, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * top), 6) AS bound
    FROM qterms JOIN tops USING (term) JOIN dfs USING (term) CROSS JOIN stats GROUP BY ALL""",
)
def index_block_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """What each block of documents can score at most for each question."""
    index = stored_index(spark, sf)
    asked = lexical.query_terms(questions(spark, sf)).join(index.terms.select("term", "idf"), "term")
    return postings.block_bounds(index, asked).select(F.col("query_id").alias("item_id"), "block", F.round("bound", 6).alias("bound"))


@query(
    "bm25_term_stats",
    f"""WITH {S.DOCS}, sizes AS (SELECT lang, count(*) AS n FROM docs GROUP BY lang),
    pairs AS (SELECT lang, doc_id, term, count(*) AS tf FROM (SELECT lang, doc_id, unnest(toks) AS term FROM docs) GROUP BY ALL),
    totals AS (SELECT lang, term, count(*) AS df, sum(tf)::BIGINT AS cf FROM pairs GROUP BY ALL)
    SELECT lang, term, df, cf, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM totals JOIN sizes USING (lang)""",
)
def bm25_term_stats(spark: SparkSession, sf: str) -> DataFrame:
    docs = corpus(spark, sf).withColumnRenamed("title", "lang")
    return lexical.term_stats(docs, "lang").select("lang", "term", "df", "cf", F.round("idf", 6).alias("idf"))


@query(
    "corpus_stats",
    f"WITH {S.DOCS} SELECT lang, count(*) AS n, round(avg(len(toks)), 6) AS avg_len FROM docs GROUP BY lang",
)
def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    docs = corpus(spark, sf)
    return docs.groupBy(F.col("title").alias("lang")).agg(F.count("*").alias("n"), F.round(F.avg(F.size("tokens")), 6).alias("avg_len"))


@query(
    "cosine_topk",
    f"WITH {S.dense(known='')} SELECT item_id, doc_id, round(cos, 6) AS cosine, rnk AS rank FROM near WHERE rnk <= {P.candidate_k}",
)
def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    """All of `embeddings`, in several blocks on either side."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("pos"), "embedding")
    hits = dense.cosine_topk(rows, question_vectors(spark, sf), P.candidate_k, replace(P, query_block=64), normalize=True)
    return hits.select(
        F.col("query_id").alias("item_id"), F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("cosine"),
        F.col("rank").cast("bigint").alias("rank"),
    )


_HITS = "item_id, doc_id, bm25_rank::BIGINT AS bm25_rank, dense_rank::BIGINT AS dense_rank, round(score, 9) AS score, rank"


def _hit_columns(hits: DataFrame) -> DataFrame:
    return hits.select(
        F.col("query_id").alias("item_id"), F.col("chunk_id").alias("doc_id"), F.col("bm25_rank").cast("bigint").alias("bm25_rank"),
        F.col("dense_rank").cast("bigint").alias("dense_rank"), F.round("score", 9).alias("score"), F.col("rank").cast("bigint").alias("rank"),
    )


@query("hybrid_rrf", f"WITH {S.scores()}, {S.dense()}, {S.FUSED} SELECT {_HITS} FROM top")
def hybrid_rrf(spark: SparkSession, sf: str) -> DataFrame:
    return _hit_columns(hybrid_hits(spark, sf))


@query("hybrid_other_size", f"WITH {S.scores()}, {S.dense('FALSE')}, {S.FUSED} SELECT {_HITS} FROM top")
def hybrid_other_size(spark: SparkSession, sf: str) -> DataFrame:
    """Questions whose vectors have half the size of the corpus's: what the lexical list finds is left."""
    halves = question_vectors(spark, sf).withColumn("embedding", F.slice("embedding", 1, F.size("embedding") / 2))
    near = dense.cosine_topk(vectors(spark, sf), halves, P.candidate_k, normalize=True)
    return _hit_columns(retrieval.fuse(lexical_hits(spark, sf, P.candidate_k), near))


@query(
    "vector_quarantine",
    """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN NULL WHEN vec_id % 7 = 1 THEN embedding[2:] WHEN vec_id % 7 = 2 THEN list_append(embedding[2:], NULL)
      WHEN vec_id % 7 = 3 THEN list_append(embedding[2:], 'inf'::FLOAT) ELSE embedding END AS e FROM embeddings)
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 'missing' WHEN vec_id % 7 = 1 THEN 'size' WHEN vec_id % 7 = 2 THEN 'null component' WHEN vec_id % 7 = 3 THEN 'not finite' END AS reason,
    len(e) AS size FROM v""",
)
def vector_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of which four in seven are damaged, each in its own way: the sound ones and the refused ones."""
    rest, way = F.slice("embedding", 2, F.size("embedding") - 1), F.col("vec_id") % 7
    damaged = F.when(way == 0, None).when(way == 1, rest).when(way == 2, F.concat(rest, F.array(F.lit(None).cast("float")))).when(way == 3, F.concat(rest, F.array(F.lit(float("inf")).cast("float"))))
    rows = table(spark, sf, "embeddings").select("vec_id", F.when(way < 4, damaged).otherwise(F.col("embedding")).alias("embedding"))
    dim = table(spark, sf, "embeddings").agg(F.max(F.size("embedding"))).first()[0]
    sound, refused = dense.split_vectors(rows, dim)
    both = sound.withColumn("reason", F.lit(None).cast("string")).unionByName(refused)
    return both.select("vec_id", "reason", F.size("embedding").cast("bigint").alias("size"))


_OWNED = "(own.lang = 'en' OR own.source = asker.source)"


@query(
    "hybrid_scoped",
    f"""WITH {S.scores(_OWNED, "JOIN documents own ON own.doc_id = p.doc_id JOIN documents asker ON asker.doc_id = q.item_id")},
    {S.dense("(d.lang = 'en' OR d.source = asker.source)", "JOIN documents asker ON asker.doc_id = b.item_id")},
    {S.FUSED} SELECT {_HITS} FROM top""",
)
def hybrid_scoped(spark: SparkSession, sf: str) -> DataFrame:
    """The client of a question is the source of the document with the same number; owned documents open to it only."""
    asker = table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), F.col("source").alias("client_id"))
    asked = questions(spark, sf).join(asker, "query_id")
    dense_hits = dense.cosine_topk(
        vectors(spark, sf, scoped=True), question_vectors(spark, sf).join(asker, "query_id"), P.candidate_k, normalize=True
    )
    return _hit_columns(retrieval.fuse(lexical_hits(spark, sf, P.candidate_k, asked), dense_hits))


@query(
    "retrieval_confidence",
    f"""WITH {S.scores()}, {S.dense()}, {S.FUSED},
    found AS (SELECT t.item_id, count(*) AS n_sources, max(dense_score) AS best,
                     list_distinct(flatten(list(toks))) AS stoks
              FROM top t JOIN docs USING (doc_id) GROUP BY t.item_id),
    cov AS (SELECT a.item_id, n_sources, best,
                   CASE WHEN len(list_distinct(qtoks)) = 0 THEN 0
                        ELSE len(list_intersect(list_distinct(qtoks), stoks)) / len(list_distinct(qtoks)) END AS coverage
            FROM asked a LEFT JOIN found USING (item_id))
    SELECT item_id, coalesce(n_sources, 0) AS n_sources, round(coalesce(coverage, 0), 6) AS coverage,
           round(CASE WHEN n_sources IS NULL THEN 0 WHEN best IS NULL THEN coverage
                ELSE 0.6 * coverage + 0.4 * least(1, greatest(0, (best - 0.25) / 0.45)) END, 6) AS confidence FROM cov""",
)
def retrieval_confidence(spark: SparkSession, sf: str) -> DataFrame:
    hits = retrieval.attach_chunks(hybrid_hits(spark, sf), table(spark, sf, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.lit("").alias("title"), F.lit("").alias("section"), "text"), questions(spark, sf))
    scored = retrieval.confidence(questions(spark, sf), hits, stem=False)
    return scored.select(
        F.col("query_id").alias("item_id"), F.col("n_sources").cast("bigint").alias("n_sources"),
        F.round("coverage", 6).alias("coverage"), F.round("confidence", 6).alias("confidence"),
    )


# Sentences of the plain documents: a line break, or white space between final punctuation and a capital or digit.
_PASSAGES = f"""hits AS (SELECT item_id, rnk AS ref, doc_id FROM ranked WHERE rnk <= {P.top_k}),
sentences AS (
  SELECT item_id, ref, unnest(parts) AS passage, unnest(range(len(parts))) AS n
  FROM (SELECT item_id, ref, list_filter(list_transform(
          regexp_split_to_array(regexp_replace(text, '([.!?])\\s+([A-ZÀ-Ü0-9])', '\\1' || chr(10) || '\\2', 'g'), '\\n+'),
          lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))), lambda s: s <> '') AS parts
        FROM hits JOIN docs USING (doc_id))),
toked AS (SELECT *, list_distinct({S.tokens('passage')}) AS own FROM sentences),
uniq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, passage ORDER BY ref, n) AS copy
                        FROM toked WHERE len(own) >= 2) WHERE copy = 1),
points AS (SELECT u.item_id, ref, n, passage, len(list_intersect(list_distinct(qtoks), own)) AS score,
                  least(2, len(list_distinct(qtoks))) AS needed,
                  list_distinct(qtoks) AS q, own FROM uniq u JOIN asked USING (item_id)),
-- the language code is the title: one token that a longer word of the question never starts with
ok AS (SELECT * FROM points JOIN (SELECT h.item_id, h.ref, d.lang FROM hits h JOIN docs d USING (doc_id)) t USING (item_id, ref)
       WHERE score > 0 AND score + CASE WHEN list_contains(q, t.lang) AND NOT list_contains(own, t.lang)
             AND NOT list_contains(['en', 'es', 'fr', 'de'], t.lang) THEN 1 ELSE 0 END
             + CASE WHEN t.lang = 'fr' AND list_contains(q, 'fr') AND NOT list_contains(own, 'fr') THEN 1 ELSE 0 END >= needed),
quotes AS (SELECT item_id, ref, passage, score, quote_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, ref, n) AS quote_rank,
         max(score) OVER (PARTITION BY item_id) AS best FROM ok)
  WHERE quote_rank <= {P.max_quotes} AND score >= {P.min_score_share} * best)"""


def _untitled(hits: DataFrame) -> DataFrame:
    return hits.withColumn("ref", F.col("rank").cast("int"))


@query("best_passages", f"WITH {S.scores()}, {_PASSAGES} SELECT item_id, ref::INTEGER AS ref, passage, score, quote_rank FROM quotes")
def best_passages(spark: SparkSession, sf: str) -> DataFrame:
    quotes = passages.best_passages(questions(spark, sf), _untitled(bm25_hits(spark, sf)), stem=False)
    return quotes.select(
        F.col("query_id").alias("item_id"), "ref", "passage", F.col("score").cast("bigint").alias("score"),
        F.col("quote_rank").cast("bigint").alias("quote_rank"),
    )


@query(
    "extractive_answers",
    f"""WITH {S.scores()}, {_PASSAGES},
    found AS (SELECT h.item_id, list_distinct(flatten(list(list_append(toks, lang)))) AS stoks FROM hits h JOIN docs USING (doc_id) GROUP BY h.item_id),
    conf AS (SELECT a.item_id, stoks IS NOT NULL AS any_source,
                    len(list_intersect(list_distinct(qtoks), coalesce(stoks, []))) / len(list_distinct(qtoks)) AS c
             FROM asked a LEFT JOIN found USING (item_id)),
    lines AS (SELECT item_id, string_agg('- ' || passage || ' [' || ref || ']', chr(10) ORDER BY quote_rank) AS body,
                     string_agg(ref::VARCHAR, ',' ORDER BY quote_rank) AS refs FROM quotes GROUP BY item_id)
    SELECT item_id, CASE WHEN any_source AND c >= 0.35 AND body IS NOT NULL THEN 'rag' ELSE 'human' END AS route,
           CASE WHEN any_source AND c >= 0.35 AND body IS NOT NULL THEN 'extractive' ELSE 'none' END AS mode,
           CASE WHEN any_source AND c >= 0.35 AND body IS NOT NULL THEN '{passages.EXTRACT_NOTICE.replace("'", "''")}' || chr(10) || body
                WHEN NOT any_source OR c < 0.35 THEN '{passages.NO_SOURCE.replace("'", "''")}'
                ELSE '{passages.NOT_ANSWERABLE.replace("'", "''")}' END AS answer
    FROM conf LEFT JOIN lines USING (item_id)""",
)
def extractive_answers(spark: SparkSession, sf: str) -> DataFrame:
    checkpoint_root(spark)
    asked, hits = questions(spark, sf), bm25_hits(spark, sf).checkpoint()  # read by the confidence and by the passages
    answers = passages.extractive_answers(asked, hits, retrieval.confidence(asked, hits, stem=False), stem=False)
    return answers.select(F.col("query_id").alias("item_id"), "route", "mode", "answer")


@query(
    "citations",
    f"""WITH {S.scores()}, top AS (SELECT item_id, doc_id, score, rnk FROM ranked WHERE rnk <= {P.top_k})
    SELECT item_id, rnk::INTEGER AS ref, d.source AS doc, doc_id,
           left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 300) AS excerpt, round(score, 4) AS score
    FROM top JOIN docs d USING (doc_id) WHERE rnk IN (1, 2, 3)""",
)
def citations(spark: SparkSession, sf: str) -> DataFrame:
    """Replies citing [2], [3, 1] and a missing [9] for every question."""
    hits = bm25_hits(spark, sf)
    replies = hits.groupBy("query_id").agg(F.count("*").cast("int").alias("n")).withColumn(
        "answer", F.concat(F.lit("Voir [2] puis [3, 1], [2] et [9] sous "), F.col("n").cast("string"))
    )
    answers = replies.select("query_id", rf.valid_refs(F.col("answer"), F.col("n")).alias("refs"))
    return passages.citations(answers, hits).select(
        F.col("query_id").alias("item_id"), "ref", "doc", F.col("chunk_id").alias("doc_id"), "excerpt", "score"
    )


@query(
    "source_blocks",
    f"""WITH {S.scores()}, top AS (SELECT item_id, doc_id, rnk FROM ranked WHERE rnk <= {P.top_k})
    SELECT item_id, string_agg('[' || rnk || '] ' || lang || ' — ' || d.source || ', p. 1' || chr(10) || trim(text, ' ' || chr(10)),
                               chr(10) || chr(10) ORDER BY rnk) AS sources
    FROM top JOIN docs d USING (doc_id) GROUP BY item_id""",
)
def source_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return passages.source_block(bm25_hits(spark, sf)).select(F.col("query_id").alias("item_id"), "sources")


@query(
    "source_numbers",
    """WITH found AS (SELECT user_id, props::JSON->>'k' AS source, ts, event_id FROM events),
    firsts AS (SELECT user_id, source, min((ts, event_id)) AS f FROM found GROUP BY ALL)
    SELECT user_id, source, dense_rank() OVER (PARTITION BY user_id ORDER BY f) AS number FROM firsts""",
)
def source_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Sources of a dossier (user) numbered by first appearance over its searches (events)."""
    found = table(spark, sf, "events").select("user_id", F.get_json_object("props", "$.k").alias("source"), "ts", "event_id")
    numbers = first_seen_numbers(found, "user_id", "source", "ts", "event_id")
    return numbers.select("user_id", "source", F.col("number").cast("bigint").alias("number"))


_GOLDEN = "golden AS (SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


#: Passages whose longest words are held against every document in one row.
_CARRIED = 5000


def containment(spark: SparkSession, sf: str, carried: int = _CARRIED) -> DataFrame:
    """(query_id, doc): documents that hold a benchmark passage word for word.

    A passage can only be in a document that holds its inner words, so only a document that holds the
    longest of them is tested, where it is read: no text is exchanged. Passages with more different such
    words than a row may carry are joined by word instead. Passages of one or two words have no inner
    word; they are tested in the rows of the documents, some hundred at a time.
    """
    passages = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage")).where(F.col("passage").isNotNull())
    short = F.size(F.split("passage", r"\W+")) <= 2
    asked = passages.where(~short)
    longest = F.array_max(F.transform(
        # A word cut by the edge of the passage may be part of a longer word in the document.
        F.slice(F.split("passage", r"\W+"), 2, F.greatest(F.size(F.split("passage", r"\W+")) - 2, F.lit(1))),
        lambda w: F.struct(F.length(w).alias("n"), w.alias("word")),
    ))["word"]
    keyed = asked.withColumn("word", longest)
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text")
    found = _tested_in_place(docs, keyed) if fits(keyed, carried) else _tested_by_word(docs, keyed)
    return found.unionByName(_short_containment(docs, passages.where(short)))


def _tested_in_place(docs: DataFrame, keyed: DataFrame) -> DataFrame:
    """Few words sought: one row of them meets every document, which goes on once for each that it holds."""
    sought = keyed.agg(F.collect_set("word").alias("sought"))
    held = docs.crossJoin(F.broadcast(sought)).select("doc", "text", F.explode_outer(F.array_intersect(F.split("text", r"\W+"), "sought")).alias("word"))
    return held.join(F.broadcast(keyed), "word").where(F.contains("text", F.col("passage"))).select("query_id", "doc")


def _tested_by_word(docs: DataFrame, keyed: DataFrame) -> DataFrame:
    """Any number of words sought: documents and passages meet by word, then by document."""
    holding = docs.select("doc", F.explode_outer(F.array_distinct(F.split("text", r"\W+"))).alias("word")).join(broadcast_if_small(keyed), "word")
    return holding.join(docs, "doc").where(F.contains("text", F.col("passage"))).select("query_id", "doc")


def _short_containment(docs: DataFrame, passages: DataFrame, block: int = 256) -> DataFrame:
    """Containment of passages without a word to join on: arrays of at most about `block` passages meet every document."""
    blocks = F.ceil(F.count("*") / block).alias("blocks")
    numbered = passages.crossJoin(F.broadcast(passages.agg(blocks)))  # one row
    arrays = numbered.groupBy(F.pmod(F.xxhash64("query_id"), F.greatest("blocks", F.lit(1))).alias("block")).agg(F.collect_list(F.struct("query_id", "passage")).alias("asked"))
    held = docs.crossJoin(broadcast_if_small(arrays)).select("doc", F.explode(F.filter("asked", lambda a: F.contains(F.col("text"), a["passage"]))).alias("hit"))
    return held.select(F.col("hit.query_id").alias("query_id"), "doc")


@query(
    "eval_hit_mrr",
    f"""WITH {S.scores()}, {_GOLDEN},
    best AS (SELECT g.item_id, min(rnk) AS first FROM golden g LEFT JOIN (SELECT * FROM ranked WHERE rnk <= {P.top_k}) r
             ON r.item_id = g.item_id AND r.doc_id = g.doc_id GROUP BY g.item_id)
    SELECT item_id, first IS NOT NULL AS hit, coalesce(round(1.0 / first, 6), 0)::DOUBLE AS reciprocal_rank FROM best""",
)
def eval_hit_mrr(spark: SparkSession, sf: str) -> DataFrame:
    hits = lexical_hits(spark, sf, P.top_k).select("query_id", F.col("chunk_id").alias("doc"), "rank")
    scored = first_hit_ranks(containment(spark, sf), hits)
    return scored.select(F.col("query_id").alias("item_id"), "hit", F.round("reciprocal_rank", 6).alias("reciprocal_rank"))


# CRC-32 (the reflected 0xEDB88320 polynomial), byte by byte over the distinct tokens.
_CRC = f"""WITH RECURSIVE {S.DOCS},
toks AS (SELECT DISTINCT token FROM (SELECT unnest(toks) AS token FROM docs)),
entry AS (SELECT i, list_reduce(range(8), lambda c, _k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) AS v FROM range(256) t(i)),
tab AS (SELECT list(v ORDER BY i) AS t FROM entry),
walk AS (
  SELECT token, hex(encode(token)) AS h, 4294967295::BIGINT AS c, 0 AS pos FROM toks
  UNION ALL
  SELECT token, h, xor(t[(xor(c, ('0x' || substr(h, 2 * pos + 1, 2))::BIGINT) & 255) + 1], c >> 8), pos + 1
  FROM walk, tab WHERE 2 * pos < length(h)),
crc AS (SELECT token, xor(c, 4294967295::BIGINT) % 256 AS bucket FROM walk WHERE 2 * pos = length(h)),
counts AS (SELECT doc_id, bucket, count(*) AS n FROM (SELECT doc_id, unnest(toks) AS token FROM docs) JOIN crc USING (token) GROUP BY ALL)
SELECT doc_id, bucket::INTEGER AS bucket, round((n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)))::FLOAT::DOUBLE, 5) AS weight FROM counts"""


@query("hash_vectors", _CRC)
def hash_embedding(spark: SparkSession, sf: str) -> DataFrame:
    """Hashed vectors of the documents, as their non-zero coordinates."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    rows = hash_vectors(docs, "text", stem=False, composed=True)
    return (
        rows.select("doc_id", F.posexplode_outer("embedding").alias("bucket", "weight")).where(F.col("weight") > 0)
        .select("doc_id", "bucket", F.round(F.col("weight").cast("double"), 5).alias("weight"))
    )
