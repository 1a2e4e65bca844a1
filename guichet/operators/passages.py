"""Quotable passages of retrieved chunks, extractive answers, citations and the generated-answer gate.

Everything here works on hits (queries x k rows) joined to their chunk, never on the corpus, so the
windows below hold the lines of at most k chunks per query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from guichet.functions import references as rf
from guichet.functions import text as tx
from guichet.params import DEFAULTS, Params

# Shapes of lines and texts of the answers.
LIST_MARKER = r"(?U)^(?:[-*•]|\d+\.)\s+"
TABLE_SEPARATOR = r"(?U)^\|[\s:|-]+\|$"
NO_SOURCE = (
    "Aucune source fiable n'a été trouvée dans la documentation pour répondre à cette "
    "demande. Elle est transmise à un gestionnaire."
)
NOT_ANSWERABLE = (
    "La documentation disponible ne permet pas de répondre à cette demande de façon "
    "vérifiable. Elle est transmise à un gestionnaire."
)
EXTRACT_NOTICE = (
    "Extraits de la documentation, cités tels quels (réponse sans reformulation par un "
    "modèle de langage) :"
)


def is_heading(line: Column) -> Column:
    """Markdown heading, or numbered title without final punctuation."""
    numbered = line.rlike(r"(?U)^\d") & line.rlike(LIST_MARKER) & ~line.rlike(r"[.!?]$")
    return line.startswith("#") | numbered


def cells(row: Column) -> Column:
    """Cells of a Markdown table row."""
    return F.transform(F.split(F.regexp_replace(row, r"^\|+|\|+$", ""), r"\|"), tx.trim_all)


def row_text(header: Column, values: Column) -> Column:
    """"name : cell ; ...", or the cells alone when the header is missing or of another length."""
    named = F.zip_with(header, values, lambda h, v: F.concat(h, F.lit(" : "), v))
    usable = header.isNotNull() & (F.size(header) == F.size(values))
    return F.array_join(F.when(usable, named).otherwise(values), " ; ")


def passages(hits: DataFrame, keys: tuple[str, ...] = ("query_id", "ref")) -> DataFrame:
    """One row per sentence, list item or table row: keys, line_no, part, passage, source, header, heading, title.

    `source` is the text whose tokens belong to the passage; `header` holds the column names of a
    table row and `heading` the heading in force above the line.
    """
    lines = hits.select(
        *keys, F.coalesce("title", F.lit("")).alias("title"), F.coalesce("section", F.lit("")).alias("section"),
        F.posexplode_outer(F.transform(tx.split_lines(F.col("text")), tx.trim_all)).alias("line_no", "line"),
    ).where(F.col("line").isNotNull())
    order = W.partitionBy(*keys).orderBy("line_no")
    running = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    line, table = F.col("line"), F.col("table")
    separator = line.rlike(TABLE_SEPARATOR)
    marked = (
        lines.withColumn("table", line.startswith("|"))
        .withColumn("separator", separator)
        .withColumn("next", F.coalesce(F.lead("line").over(order), F.lit("")))
        .withColumn("is_header", table & ~F.col("separator") & F.col("next").rlike(TABLE_SEPARATOR))
        .withColumn("is_title", ~table & is_heading(line))
        .withColumn("block", F.sum(F.when(table, 0).otherwise(1)).over(running))
        .withColumn("heading", F.coalesce(F.last(F.when(F.col("is_title"), line), True).over(running), "section"))
        .withColumn("cells", F.when(table, cells(line)))
    )
    inside = W.partitionBy(*keys, "block").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    carried = marked.withColumn("header", F.last(F.when(F.col("is_header"), F.col("cells")), True).over(inside))
    quotable = carried.where(~F.col("separator") & ~F.col("is_header") & ~F.col("is_title"))
    parts = F.when(table, F.array(row_text(F.col("header"), F.col("cells")))).otherwise(
        tx.split_sentences(F.regexp_replace(line, LIST_MARKER, ""))
    )
    return quotable.select(
        *keys, "line_no", "title", "heading", "table", "line",
        F.when(table, F.array_join("header", " ")).alias("header"),
        F.posexplode_outer(parts).alias("part", "passage"),
    ).where(F.col("passage").isNotNull()).withColumn("source", F.when(table, line).otherwise(F.col("passage")))


def best_passages(queries: DataFrame, hits: DataFrame, stem: bool = True, params: Params = DEFAULTS) -> DataFrame:
    """The one to three passages sharing most tokens with each query: (query_id, ref, passage, score, quote_rank)."""
    asked = queries.select("query_id", F.array_distinct("tokens").alias("asked"))

    def tokens(name: str) -> Column:
        return tx.tokenize(F.coalesce(F.col(name), F.lit("")), stem=stem)

    scored = (
        passages(hits)
        .withColumns({"own": tokens("source"), "context": tokens("header"), "above": tokens("heading"), "named": tokens("title")})
        .where(F.col("table") | (F.size(F.array_distinct("own")) >= 2))
        .withColumn(
            "copy",
            F.row_number().over(W.partitionBy("query_id", "passage").orderBy("ref", "line_no", "part")),
        )
        .where(F.col("copy") == 1)
        .join(asked, "query_id")
        .withColumn("shared", F.size(F.array_intersect("asked", "own")))
        .where(F.col("shared") > 0)
        .withColumn("score", F.col("shared") + F.size(F.array_intersect("asked", F.array_except("context", "own"))))
        .withColumn("titles", F.array_except(F.array_union("named", "above"), F.col("own")))
        .withColumn("rest", F.array_except("asked", "own"))
    )
    qualified = scored.withColumn("support", F.size(F.filter("rest", lambda t: F.exists("titles", lambda h: same_family(t, h))))).where(
        F.col("score") + F.col("support") >= F.least(F.lit(2), F.size("asked"))
    )
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "ref", "line_no", "part")
    return (
        qualified.withColumn("quote_rank", F.row_number().over(order))
        .where(F.col("quote_rank") <= params.max_quotes)
        .withColumn("best", F.max("score").over(W.partitionBy("query_id")))
        .where(F.col("score") >= F.col("best") * params.min_score_share)
        .select("query_id", "ref", "passage", "score", "quote_rank")
    )


def same_family(a: Column, b: Column) -> Column:
    """Equal tokens, or one of at least five letters that starts the other."""
    return (
        (a == b)
        | ((F.length(a) >= 5) & (F.length(a) <= F.length(b)) & F.startswith(b, a))
        | ((F.length(b) >= 5) & (F.length(b) <= F.length(a)) & F.startswith(a, b))
    )


def citations(answers: DataFrame, hits: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """One row per cited source of each answer (query_id, refs ARRAY<INT>), in order of citation."""
    cited = answers.select("query_id", F.posexplode(F.array_distinct("refs")).alias("position", "ref"))
    sources = hits.select(
        "query_id", F.col("rank").cast("int").alias("ref"), "doc", "title", "page", F.coalesce("section", F.lit("")).alias("section"),
        "chunk_id", rf.excerpt(F.col("text"), params.excerpt_chars).alias("excerpt"), F.round("score", 4).alias("score"),
    )
    return cited.join(sources, ["query_id", "ref"])


def source_block(hits: DataFrame, number: str = "rank") -> DataFrame:
    """Numbered sources of each query as one text, in number order."""
    section = F.when(F.coalesce(F.col("section"), F.lit("")) != "", F.concat(F.lit(", "), F.col("section"))).otherwise("")
    block = F.concat(
        F.lit("["), F.col(number).cast("string"), F.lit("] "), F.col("title"), F.lit(" — "), F.col("doc"), F.lit(", p. "),
        F.col("page").cast("string"), section, F.lit("\n"), tx.trim_all(rf.neutralize_tags(F.col("text"))),
    )
    ordered = F.array_sort(F.collect_list(F.struct(F.col(number).alias("n"), block.alias("block"))))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda b: b["block"]), "\n\n").alias("sources"))


def extractive_answers(
    queries: DataFrame, hits: DataFrame, confidence: DataFrame, stem: bool = True, params: Params = DEFAULTS
) -> DataFrame:
    """Route, mode, answer and refs of every documentary query; escalated to a person when sources do not support it."""
    quotes = (
        best_passages(queries, hits.withColumn("ref", F.col("rank").cast("int")), stem, params)
        .groupBy("query_id")  # at most three rows per query
        .agg(F.array_sort(F.collect_list(F.struct("quote_rank", "ref", "passage"))).alias("quotes"))
    )
    lines = F.transform(
        "quotes", lambda q: F.concat(F.lit("- "), q["passage"], F.lit(" ["), q["ref"].cast("string"), F.lit("]"))
    )
    unsure = (F.col("n_sources") == 0) | (F.col("confidence") < params.min_confidence)
    quoted = ~unsure & F.col("quotes").isNotNull()
    return (
        queries.select("query_id")
        .join(confidence, "query_id", "left")
        .join(quotes, "query_id", "left")
        .select(
            "query_id",
            F.when(quoted, "rag").otherwise("human").alias("route"),
            F.when(quoted, "extractive").otherwise("none").alias("mode"),
            F.round("confidence", 2).alias("confidence"),
            F.when(quoted, F.concat(F.lit(EXTRACT_NOTICE + "\n"), F.array_join(lines, "\n")))
            .when(unsure, NO_SOURCE)
            .otherwise(NOT_ANSWERABLE)
            .alias("answer"),
            F.when(quoted, F.array_distinct(F.transform("quotes", lambda q: q["ref"])))
            .otherwise(F.array().cast("array<int>"))
            .alias("refs"),
        )
    )


def gate_replies(replies: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Outcome of model replies (reply, finish_reason, n_sources, cost_eur).

    Truncated -> fall back to extracts; "insuffisant..." or no valid citation -> human; otherwise the
    reply is the answer, references to missing sources are flagged, and a cost above budget is flagged.
    """
    text = tx.trim_all(F.col("reply"))
    return (
        replies.withColumn("refs", rf.valid_refs(text, F.col("n_sources")))
        .withColumn(
            "unknown_refs",
            F.transform(F.filter(rf.extract_refs(text), lambda r: (r < 1) | (r > F.col("n_sources"))), lambda r: r.cast("string")),
        )
        .withColumn(
            "outcome",
            F.when(F.col("finish_reason") == "length", "extractive")
            .when(F.lower(text).startswith("insuffisant"), "human")
            .when(F.size("refs") == 0, "human")
            .otherwise("rag"),
        )
        .withColumn("over_budget", ~F.col("finish_reason").eqNullSafe(F.lit("length")) & (F.col("cost_eur") > params.budget_eur))
    )
