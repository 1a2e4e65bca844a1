"""Structure-aware chunking of documents and the index tables built from the chunks.

A document is one row, so packing is a projection of built-in functions: its pages become an array of measured lines, one
fold over the lines decides where chunks start and end, and the spans are exploded. There is no shuffle.

A chunk is a span of lines of one page. It grows by whole paragraphs; it ends before a heading, or where the next
paragraph would not fit. Then the next one starts with the last lines of it that fit the overlap and leave room. Headings
never stand alone: a paragraph that does not fit behind them joins line by line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guichet.functions.text import once, rtrim_all, split_lines
from guichet.params import DEFAULTS, Params

# What a heading and a sentence end look like.
_HEADING = r"(?dmU)^(#{1,6}[^\S\n]+[^\n]*\S)$"
_TITLE = r"(?U)\A#{1,6}[^\S\n]+([^\n]*\S)\z"
_SENTENCE_END = r"(?U)(?<=[.!?;:])\s+"

_SPANS = "array<struct<page:int,number:int,section:string,start:int,stop:int>>"
_LINES = "array<struct<page:int,text:string,size:int,gap:int,more:int,rest:int,title:string>>"


def _wrapped(sentence: Column, size: int) -> Column:
    """Pieces of a sentence longer than `size`, cut between words; a longer word fills up the line before it is cut. A tab counts as one blank."""
    between = rf"(?>.{{0,{size - 1}}}[^ ](?=[ ]|$))(?=$|[ ]+[^ ]{{1,{size}}}(?:[ ]|$))"
    spaced = F.translate(sentence, "\t\n\u000b\u000c\r", "     ")
    return F.regexp_extract_all(spaced, F.lit(rf"(?:(?!\A)[ ]+)?({between}|.{{1,{size}}})"), F.lit(1))


def _pieces(line: Column, size: int) -> Column:
    """A line that is too long, cut at sentence ends and between words."""
    sentences = F.transform(F.split(line, _SENTENCE_END), lambda s: F.when(F.length(s) <= size, F.array(s)).otherwise(_wrapped(s, size)))
    return F.when(F.length(line) <= size, F.array(line)).otherwise(F.flatten(sentences))


def _unit_lines(unit: Column, page: Column, size: int) -> Column:
    """Measured lines of a heading or paragraph. `more` counts the lines that stay together from here, `rest` their characters."""
    together = F.length(unit) <= size
    heading = F.regexp_extract(unit, _TITLE, 1)
    title = F.when(heading != "", heading)
    lines = F.split(unit, "\n")
    cut = F.when(together | title.isNotNull(), lines).otherwise(F.flatten(F.transform(lines, lambda x: _pieces(x, size))))

    def measured(all_: Column) -> Column:
        def line(x: Column, i: Column) -> Column:
            rest = F.aggregate(F.slice(all_, i + 1, F.size(all_)), F.lit(0), lambda n, y: n + F.length(y) + 1)
            return F.struct(
                page.cast("int").alias("page"), x.alias("text"), F.length(x).alias("size"), F.when(i == 0, 1).otherwise(0).alias("gap"),
                F.when(together & title.isNull(), F.size(all_) - i).otherwise(F.lit(1)).alias("more"),
                F.when(together & title.isNull(), rest).otherwise(F.length(x) + 1).alias("rest"), title.alias("title"),
            )

        return F.transform(all_, line)

    return once(cut, measured)


def page_lines(pages: Column, size: int) -> Column:
    """Measured lines of all pages, in order. Headings are set apart, and blank lines part what is left into paragraphs."""

    def of_page(page: Column) -> Column:
        joined = F.array_join(F.transform(split_lines(F.coalesce(page["text"], F.lit(""))), rtrim_all), "\n")
        units = F.split(F.regexp_replace(joined, _HEADING, "\n\n$1\n\n"), "\n\n+")
        units = F.filter(F.transform(units, lambda u: F.btrim(u, F.lit("\n"))), lambda u: u != "")
        return F.flatten(F.transform(units, lambda u: _unit_lines(u, page["number"], size)))

    return F.coalesce(F.flatten(F.transform(pages, of_page)), F.array().cast(_LINES))


def _spans(lines: Column, size: int, overlap: int) -> Column:
    """Spans of lines, packed by one fold. The state is small: besides the spans it holds the lines that an overlap can reach back to."""

    def step(a: Column, x: Column) -> Column:
        turned = a["page"].isNull() | (a["page"] != x["page"])  # a new page: close what is open
        passing = ~turned & (a["skip"] > 0)  # a line of the paragraph that was taken whole
        before = a["end"] + x["gap"]  # characters before the line itself
        heading = x["title"].isNotNull()
        held = ~turned & (a["start"] < a["at"])

        def decided(whole_over: Column) -> Column:
            # headings alone before a paragraph that does not fit: it joins line by line
            loosen = whole_over & ~a["body"] & (x["more"] > 1) & (a["at"] >= a["loose"])
            single = loosen | (a["at"] < a["loose"])
            stop = before + F.when(single, x["size"] + 1).otherwise(x["rest"])
            return F.struct(loosen.alias("loosen"), F.when(single, 1).otherwise(x["more"]).alias("take"), stop.alias("stop"))

        def packed(d: Column) -> Column:
            full = held & ~heading & (d["stop"] - 1 - a["from"] > size)
            cut = ~passing & ((turned & (a["start"] < a["at"])) | (held & heading & a["body"]) | full)
            reach = F.filter(a["tail"], lambda t: (t["before"] >= d["stop"] - 1 - size) & ~turned)
            again = F.when(full & (F.size(reach) > 0), F.get(reach, F.lit(0))).otherwise(F.struct(a["at"].alias("at"), before.alias("before")))
            number = F.when(turned, 0).otherwise(a["number"])
            span = F.struct(a["page"].alias("page"), (a["number"] + 1).alias("number"), a["section"].alias("section"), a["start"].alias("start"), a["at"].alias("stop"))
            end = before + x["size"] + 1
            tail = F.concat(F.filter(a["tail"], lambda t: ~turned), F.array(F.struct(a["at"].alias("at"), before.alias("before"))))
            moved = cut | turned
            return F.struct(
                x["page"].alias("page"), F.when(cut & ~turned, a["number"] + 1).otherwise(number).alias("number"),
                F.when(heading, x["title"]).otherwise(a["section"]).alias("section"), (a["at"] + 1).alias("at"), end.alias("end"),
                F.when(moved, again["at"]).otherwise(a["start"]).alias("start"), F.when(moved, again["before"]).otherwise(a["from"]).alias("from"),
                F.when(passing, a["skip"] - 1).when(heading, 0).otherwise(d["take"] - 1).alias("skip"),
                F.when(d["loosen"] & ~passing & ~heading, a["at"] + x["more"]).otherwise(a["loose"]).alias("loose"),
                F.when(passing, a["body"]).otherwise(~heading).alias("body"),
                F.filter(tail, lambda t: end - 1 - t["before"] <= overlap).alias("tail"),
                F.when(cut, F.concat(a["spans"], F.array(span))).otherwise(a["spans"]).alias("spans"),
            )

        return once(once(held & (before + x["rest"] - 1 - a["from"] > size), decided), packed)

    def finish(a: Column) -> Column:
        last = F.struct(a["page"].alias("page"), (a["number"] + 1).alias("number"), a["section"].alias("section"), a["start"].alias("start"), a["at"].alias("stop"))
        return F.when(a["start"] < a["at"], F.concat(a["spans"], F.array(last))).otherwise(a["spans"])

    first = F.struct(
        F.lit(None).cast("int").alias("page"), F.lit(0).alias("number"), F.lit("").alias("section"), F.lit(0).alias("at"), F.lit(0).alias("end"), F.lit(0).alias("start"), F.lit(0).alias("from"),
        F.lit(0).alias("skip"), F.lit(0).alias("loose"), F.lit(False).alias("body"), F.array().cast("array<struct<at:int,before:int>>").alias("tail"), F.array().cast(_SPANS).alias("spans"),
    )
    return F.aggregate(lines, first, step, finish)


def pack(pages: Column, size: int, overlap: int) -> Column:
    """Chunks of the pages ARRAY<STRUCT<number, text>> of a document: ARRAY<STRUCT<page, number, section, text>>."""

    def rendered(lines: Column) -> Column:
        def chunk(s: Column) -> Column:
            held = F.slice(lines, s["start"] + 1, s["stop"] - s["start"])
            text = F.array_join(F.transform(held, lambda x, i: F.when((i > 0) & (x["gap"] == 1), F.concat(F.lit("\n"), x["text"])).otherwise(x["text"])), "\n")
            return F.struct(s["page"].alias("page"), s["number"].alias("number"), s["section"].alias("section"), text.alias("text"))

        return F.transform(_spans(lines, size, overlap), chunk)

    return once(page_lines(pages, size), rendered)


def chunk_documents(documents: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Chunks of documents (doc, title, doc_type, client_id, pages ARRAY<STRUCT<number, text>>).

    Ids are `<doc>#p<page>-<n>`, numbered per page; the section is carried from page to page.
    """
    size, overlap = params.chunk_size, params.chunk_overlap
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("chunk size must be positive and overlap in [0, size)")
    packed = documents.withColumn("piece", F.explode_outer(pack(F.col("pages"), size, overlap))).where(F.col("piece").isNotNull())
    return packed.select(
        F.concat("doc", F.lit("#p"), F.col("piece.page").cast("string"), F.lit("-"), F.col("piece.number").cast("string")).alias("chunk_id"),
        "doc", "title", "doc_type", F.col("piece.page").alias("page"), F.col("piece.number").alias("number"),
        F.col("piece.section").alias("section"), F.col("piece.text").alias("text"), "client_id",
    )


def index_summary(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: documents, documents without chunk, chunks, longest chunk."""
    with_text = chunks.agg(
        F.countDistinct("doc").alias("docs_with_chunks"), F.count("*").alias("chunks"),
        F.max(F.char_length("text")).alias("longest_chunk"),
    )
    return documents.agg(F.count("*").alias("docs")).crossJoin(with_text)
