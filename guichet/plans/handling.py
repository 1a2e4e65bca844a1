"""Whole-table jobs: handle a table of requests, build an index from a folder, evaluate labelled cases."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from guichet.functions.masking import strip_tags
from guichet.functions.text import search_text
from guichet.functions.vectors import hash_vectors
from guichet.operators import chunking, dossier, intake, lexical, operations, passages, postings, retrieval, tickets
from guichet.operators import triage as tr
from guichet.operators.dense import cosine_topk
from guichet.params import DEFAULTS, Params
from guichet.session import checkpoint_root
from guichet.sources import documents as sd
from guichet.sources import sinks

# Fixed value: answer of the requests a person must handle.
SENSITIVE_ANSWER = (
    "Cette demande relève d'un sujet qui doit être traité par un gestionnaire. "
    "Elle lui est transmise sans réponse automatique."
)


_SOURCES = "array<struct<number:int,title:string,section:string>>"


@dataclass(frozen=True)
class Handled:
    responses: DataFrame
    tickets: DataFrame
    actions: DataFrame
    quarantine: DataFrame
    citations: DataFrame


@dataclass(frozen=True)
class Stored:
    """An ingested index as the search uses it; `warning` says why it does less than was asked for."""

    chunks: DataFrame
    index: postings.Index
    vectors: DataFrame | None
    mode: str
    warning: str | None


def open_stored(spark: SparkSession, folder: str, settings: dict[str, str]) -> Stored:
    """A stored index under the settings asked for; vectors that were built for other settings are left alone, and the search is lexical."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    chunks, index = spark.read.parquet(f"{folder}/chunks"), postings.open_index(spark, f"{folder}/lexical")
    if settings.get("retrieval_mode") != "hybrid":
        return Stored(chunks, index, None, "bm25", None)
    if not retrieval.compatible(manifest, settings):
        return Stored(chunks, index, None, "bm25", "the stored vectors were built for other settings")
    numbered = index.forward.select("chunk_id", F.col("number").alias("pos"))
    return Stored(chunks, index, spark.read.parquet(f"{folder}/vectors").join(numbered, "chunk_id"), "hybrid", None)


def search_stored(stored: Stored, asked: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Hits of the stored index: no chunk is tokenized and no vector computed but those of the questions."""
    lexical_hits = postings.bm25_index(stored.index, asked, params.candidate_k, params=params).drop("pos").withColumnRenamed("number", "pos")
    if stored.vectors is None:
        return retrieval.lexical_only(lexical_hits, params.top_k)
    return retrieval.fuse(lexical_hits, cosine_topk(stored.vectors, asked, params.candidate_k, params), params.top_k, params)


def ordered_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks with their corpus order as one sortable key (document, page, number) and their tokens."""
    number = F.regexp_extract("chunk_id", r"-(\d+)$", 1).cast("int")
    indexed = search_text(F.col("title"), F.col("section"), F.col("text"))
    return lexical.analyze(
        chunks.withColumn("pos", F.struct("doc", "page", number.alias("number"))).withColumn("__indexed", indexed), "__indexed"
    ).drop("__indexed")


def handle_requests(
    requests: DataFrame, clients: DataFrame, sla: DataFrame, chunks: DataFrame | Stored, vectors: bool = False, params: Params = DEFAULTS
) -> Handled:
    """Mask, triage and answer every request (request_id, ts, q, client_id, montant): one response per valid request.

    The routed requests are written once to the checkpoint folder and read by the four branches.
    `chunks` is a stored index, which is searched as it is, or a table of chunks, which is indexed for this run; then
    searches are hybrid on hashed vectors with `vectors`, otherwise lexical.
    """
    checkpoint_root(requests.sparkSession)
    accepted, quarantine = intake.split_valid(requests)
    routed = tr.triage(intake.mask_requests(accepted), clients, params).drop("q").checkpoint()
    branch = {route: routed.where(F.col("route") == route) for route in ("automation", "rag", "agent", "human")}

    new_tickets, automated = tickets.automate(branch["automation"], params=params)
    searched = branch["rag"].unionByName(branch["agent"]).select(
        F.col("request_id").alias("query_id"), F.col("scoped_client").alias("client_id"), "route", strip_tags(F.col("q_masked")).alias("question")
    )
    asked = lexical.analyze(searched, "question").checkpoint()
    stored = chunks if isinstance(chunks, Stored) else None
    if stored is not None:
        corpus, vectors = stored.chunks, stored.vectors is not None
        asked = hash_vectors(asked, "question", dim=params.hash_dim).checkpoint() if vectors else asked
        found = search_stored(stored, asked, params)
    else:
        corpus = ordered_chunks(chunks)
    if stored is None and vectors:
        indexed = search_text(F.col("title"), F.col("section"), F.col("text"))
        store = hash_vectors(corpus.withColumn("__indexed", indexed), "__indexed", dim=params.hash_dim).select("chunk_id", "pos", "client_id", "embedding")
        asked = hash_vectors(asked, "question", dim=params.hash_dim).checkpoint()
        found = hybrid_search(corpus, asked, store, params)
    elif stored is None:
        found = retrieval.search(corpus, asked, k=params.top_k, params=params)
    hits = retrieval.attach_chunks(found.drop("pos"), corpus, asked, params.top_k, params).checkpoint()

    questions = asked.where(F.col("route") == "rag")
    sure = retrieval.confidence(questions, hits.join(questions.select("query_id"), "query_id", "left_semi"), params=params)
    documentary = passages.extractive_answers(questions, hits, sure, params=params)

    sources = hits.groupBy(F.col("query_id").alias("request_id")).agg(
        F.collect_list(F.struct(F.col("rank").cast("int").alias("number"), "title", "section")).alias("sources")
    )
    prepared = dossier.prepare(branch["agent"].select("request_id", "ts", "q_masked", "scoped_client"), clients, sla, sources, params)
    actions = tickets.proposals(
        prepared.select("request_id", "subject", "summary", "priority", F.col("contract_client").alias("client_id"))
    )
    mode = "hybrid" if vectors else "bm25"
    answers = (
        automated.select("request_id", F.lit("automation").alias("route"), F.lit("rule").alias("mode"), "answer", "ticket_id", F.lit(False).alias("needs_validation"), F.lit("none").alias("retrieval_mode"))
        .unionByName(
            documentary.select(
                F.col("query_id").alias("request_id"), "route", "mode", "answer", "confidence", "refs", F.lit(True).alias("needs_validation"), F.lit(mode).alias("retrieval_mode")
            ),
            allowMissingColumns=True,
        )
        .unionByName(
            prepared.select(
                "request_id", F.lit("agent").alias("route"), F.lit("deterministic").alias("mode"), F.col("draft").alias("answer"), F.lit(True).alias("needs_validation"),
                F.when(F.size("sources") > 0, mode).otherwise("none").alias("retrieval_mode"),
            ),
            allowMissingColumns=True,
        )
        .unionByName(
            branch["human"].select("request_id", F.lit("human").alias("route"), F.lit("none").alias("mode"), F.lit(SENSITIVE_ANSWER).alias("answer"), F.lit(False).alias("needs_validation"), F.lit("none").alias("retrieval_mode")),
            allowMissingColumns=True,
        )
        .withColumn("error", F.lit(None).cast("string"))
    )
    complete = operations.escalate_errors(answers, routed).join(
        routed.select("request_id", "ts", "rule", F.col("route").alias("triage_route"), "reasons", "q_masked", F.col("resolved_client").alias("client_id"), "pii_types"), "request_id"
    )
    # an extract cites its quotes; a draft is shown with every source that was consulted
    cited = documentary.select("query_id", "refs").unionByName(
        prepared.select(F.col("request_id").alias("query_id"), F.transform(F.array_sort(F.coalesce("sources", F.array().cast(_SOURCES))), lambda s: s["number"]).alias("refs"))
    )
    citations = passages.citations(cited, hits, params).withColumnRenamed("query_id", "request_id")
    return Handled(complete, new_tickets, actions, quarantine, citations)


def hybrid_search(corpus: DataFrame, asked: DataFrame, store: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Hybrid search when the corpus order is a struct: positions are replaced by their numbers first."""
    from guichet.operators.ordering import number_rows

    numbers = number_rows(corpus.select("chunk_id", F.col("pos").alias("__order")), F.col("__order"), out="pos").select("chunk_id", "pos")
    return retrieval.search(
        corpus.drop("pos").join(numbers, "chunk_id"), asked, store.drop("pos").join(numbers, "chunk_id"), params.top_k, params
    )


def log_rows(responses: DataFrame, calls: DataFrame | None = None, answered_at: Column | None = None, params: Params = DEFAULTS) -> DataFrame:
    """Request-log rows of responses (masked text only).

    `calls(request_id, seq, prompt_tokens, completion_tokens, cost_eur, model)` are the model calls made for them; a request
    without any cost nothing. The latency runs from the request's time to `answered_at`, by default now.
    """
    waited = F.unix_millis((answered_at if answered_at is not None else F.current_timestamp()).cast("timestamp")) - F.unix_millis(F.col("ts").cast("timestamp"))
    rows = responses.select(
        "request_id", "ts", "route", "rule", "mode", "q_masked", "client_id", "confidence", "retrieval_mode", "pii_types", "needs_validation", "error",
        F.greatest(F.lit(0), F.least(waited, F.lit(2**31 - 1))).cast("int").alias("latency_ms"),
    )
    counted = ("llm_calls", "prompt_tokens", "completion_tokens", "cost_eur")
    if calls is None:
        return rows.withColumns({c: F.lit(0) for c in counted}).withColumn("model", F.lit(None).cast("string"))
    used = operations.usage_rollup(calls, params).drop("over_budget")
    return rows.join(used, "request_id", "left").fillna(0, list(counted))


def ingest_folder(spark: SparkSession, folder: str, index: str, settings: dict[str, str], params: Params = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """Rebuild the index of a folder of text documents: (manifest row, warnings).

    Chunks, their inverted index and, in hybrid mode, their hashed vectors are stored; the manifest comes last.
    """
    kept, skipped = sd.scan_folder(spark, folder)
    files = sd.text_files(kept)
    has_manifest = spark.read.format("binaryFile").load(folder).where(F.col("path").endswith("/" + sd.MANIFEST)).limit(1).count() > 0
    manifest = sd.read_manifest(spark, f"{folder}/{sd.MANIFEST}") if has_manifest else None
    loaded = sd.load_texts(files, manifest)
    chunks = sinks.write_chunks(chunking.chunk_documents(loaded, params), index)
    postings.build(ordered_chunks(chunks), f"{index}/lexical", params=params)
    if settings.get("retrieval_mode") == "hybrid":
        indexed = search_text(F.col("title"), F.col("section"), F.col("text"))
        sinks.write_vectors(hash_vectors(chunks.withColumn("__indexed", indexed), "__indexed", dim=params.hash_dim), index, params.hash_dim)
        settings = settings | {"embedding_dim": str(params.hash_dim)}
    written = sinks.write_manifest(chunks, index, settings)
    warnings = skipped.select("doc", "reason").unionByName(
        kept.where(~F.col("doc").rlike(sd.TEXT_FILES)).select("doc", F.lit("needs extracted text").alias("reason"))
    ).unionByName(loaded.where(F.size("pages") == 0).select("doc", F.lit("no text").alias("reason")))
    if manifest is not None:
        warnings = warnings.unionByName(sd.manifest_orphans(manifest, kept).select("doc", F.lit("manifest entry without file").alias("reason")))
    return written, warnings
