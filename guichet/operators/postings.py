"""A stored inverted index in blocks, and BM25 over it without reading a text.

    forward   chunk_id, pos, number, client_id, len, runs ARRAY<STRUCT<term, tf>>      one row for each document
    blocks    term, block, n, cf, top, entries ARRAY<STRUCT<number, tf, len, client_id>>
    terms     term, df, cf, idf
    manifest  one row, written last: an index without it is not complete

Documents are numbered in corpus order, and all terms share the same cuts: a block holds the postings of one term in
`block_width` consecutive numbers, so no row grows with the corpus, and a frequent term is many rows. `top` is the
largest gain (without idf) in the block. For a question, the sum of idf * top over its terms bounds every score in the block;
blocks whose bound stays below the n-th best score found in the most promising blocks are never opened. The manifest
decides: bounds need the settings they were made with, and pay only where a question meets very many blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, zip_longest

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guichet.operators.lexical import idf, query_terms, saturation, top_n
from guichet.operators.ordering import number_rows
from guichet.operators.sizing import fits
from guichet.params import DEFAULTS, Params

#: Scores are sums of rounded doubles; a bound must be lower by more than this to shut a block out.
_SLACK = 1e-6


#: Pairs of a document and a question that a task of the search may score.
_PAIRS = 1_000_000


@dataclass(frozen=True)
class Index:
    """Tables of a complete index and the settings it was built with."""

    forward: DataFrame
    blocks: DataFrame
    terms: DataFrame
    manifest: dict

    def bounded(self, params: Params) -> bool:
        """Whether the stored tops hold for these settings and are worth their pass; if not, every block of the terms is opened."""
        return (self.manifest["k1"], self.manifest["b"]) == (params.bm25_k1, params.bm25_b) and self.manifest["n"] >= params.bounded_from


@F.arrow_udf(T.ArrayType(T.StructType().add("term", "string").add("tf", "integer")))
def runs(tokens: pa.Array) -> pa.Array:
    """Distinct tokens of every row with their counts, in order."""
    sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    names, codes = _numbered(tokens.flatten())
    keys, counts = np.unique(np.repeat(np.arange(len(sizes)), sizes) * max(1, len(names)) + codes, return_counts=True)
    rows, codes = np.divmod(keys, max(1, len(names)))
    counted = pa.StructArray.from_arrays([names.take(pa.array(codes)), pa.array(counts, pa.int32())], ["term", "tf"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(len(sizes) + 1)), pa.int32()), counted)


def _numbered(terms: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct terms in order, and the place of every term among them."""
    coded = terms.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    return coded.dictionary.take(order), place[coded.indices.to_numpy(zero_copy_only=False)]


_BLOCKS = "term string, block bigint, n bigint, cf bigint, top double, entries array<struct<number:bigint,tf:int,len:int,client_id:string>>"

#: Stands for a missing number where rows are ordered.
_NONE = np.iinfo(np.int64).min


def _long(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column.cast(pa.int64()), _NONE).to_numpy(zero_copy_only=False)


def _inverted(rows: pa.RecordBatch, k1: float, b: float, avg_len: float) -> pa.RecordBatch:
    """Rows of `_BLOCKS` of whole blocks of documents (number, len, client_id, block, runs), by block and term."""
    sizes = pc.fill_null(pc.list_value_length(rows["runs"]), 0).to_numpy(zero_copy_only=False)
    terms, tf = rows["runs"].flatten().flatten()
    names, codes = _numbered(terms)
    doc, block = np.repeat(np.arange(len(sizes)), sizes), _long(rows["block"])
    order = np.lexsort((_long(rows["number"])[doc], codes, block[doc]))
    doc, codes, block, tf = doc[order], codes[order], block[doc][order], tf.take(pa.array(order))
    starts = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (codes[1:] != codes[:-1])])
    length, count = rows["len"].to_numpy()[doc], tf.to_numpy()
    gain = count * (k1 + 1.0) / (count + k1 * (1.0 - b + b * length / avg_len))  # as `saturation`
    at = pa.array(doc)
    entries = pa.StructArray.from_arrays([rows["number"].take(at), tf, rows["len"].take(at), rows["client_id"].take(at)], ["number", "tf", "len", "client_id"])
    edges = np.r_[starts, len(doc)]
    return pa.RecordBatch.from_arrays([
        names.take(pa.array(codes[starts])), pa.array(block[starts], mask=block[starts] == _NONE), pa.array(np.diff(edges), pa.int64()),
        pa.array(np.add.reduceat(count.astype(np.int64), starts)), pa.array(np.maximum.reduceat(gain, starts)),
        pa.ListArray.from_arrays(pa.array(edges, pa.int32()), entries),
    ], ["term", "block", "n", "cf", "top", "entries"])


#: Postings that a task inverts at once (more only in a single block), and postings of a partition of the build.
_SLICE, _PARTITION = 500_000, 2_000_000


def _inverter(k1: float, b: float, avg_len: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Inverts documents that come ordered by block; blocks are cut nowhere."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in chain(batches, [None]):
            rows = held if batch is None else batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            if rows is None or not rows.num_rows:
                continue
            block, held = _long(rows["block"]), None
            cuts = np.flatnonzero(block[1:] != block[:-1]) + 1  # where blocks begin
            stops = [*cuts] if batch is not None else [*cuts, rows.num_rows]  # the last block may go on in the next batch
            after = np.cumsum(pc.fill_null(pc.list_value_length(rows["runs"]), 0).to_numpy(zero_copy_only=False))
            start = done = 0
            for stop, following in zip_longest(stops, stops[1:]):
                if following is None or after[following - 1] - done > _SLICE:
                    if after[stop - 1] > done:
                        yield _inverted(rows.slice(start, stop - start), k1, b, avg_len)
                    start, done = stop, after[stop - 1]
            held = rows.slice(start) if batch is not None else None

    return pack


def build(documents: DataFrame, folder: str, settings: dict[str, str] | None = None, params: Params = DEFAULTS) -> Index:
    """Store the index of `documents` (chunk_id, pos, tokens [, client_id]); each is tokenized once, and postings are exchanged once."""
    spark = documents.sparkSession
    owner = F.col("client_id") if "client_id" in documents.columns else F.lit(None).cast("string")
    plain = isinstance(documents.schema["pos"].dataType, (T.IntegerType, T.LongType))
    documents = documents.withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))
    numbered = documents.withColumn("number", F.col("pos").cast("long")) if plain else documents
    row = numbered.select("chunk_id", "pos", *(["number"] if plain else []), owner.alias("client_id"), F.size("tokens").alias("len"), runs(F.col("tokens")).alias("runs"))
    if not plain:  # positions of another kind (document, page, number) are numbered in their order
        row.write.mode("overwrite").parquet(f"{folder}/unnumbered")
        row = spark.read.parquet(f"{folder}/unnumbered")
        row = row.join(number_rows(row.select("chunk_id", "pos"), F.col("pos"), out="number").select("chunk_id", "number"), "chunk_id")
    row.write.mode("overwrite").parquet(f"{folder}/forward")
    forward = spark.read.parquet(f"{folder}/forward")
    size = forward.agg(F.count("*").alias("n"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("avg_len"), F.coalesce(F.sum(F.size("runs")), F.lit(0)).alias("postings")).first()

    # documents move once, by block and with their counts packed; a task inverts whole blocks, some at a time
    block = F.floor(F.col("number") / params.block_width).alias("block")
    partitions = max(spark.sparkContext.defaultParallelism, math.ceil(size["postings"] / _PARTITION))
    placed = forward.select("number", "len", "client_id", block, "runs").repartition(partitions, "block").sortWithinPartitions("block")
    placed.mapInArrow(_inverter(params.bm25_k1, params.bm25_b, size["avg_len"]), _BLOCKS).write.mode("overwrite").parquet(f"{folder}/blocks")
    counts = spark.read.parquet(f"{folder}/blocks").groupBy("term").agg(F.sum("n").alias("df"), F.sum("cf").alias("cf"))
    counts.withColumn("idf", idf(F.lit(size["n"]), F.col("df"))).write.mode("overwrite").parquet(f"{folder}/terms")
    manifest = {"n": size["n"], "avg_len": size["avg_len"], "k1": params.bm25_k1, "b": params.bm25_b, "width": params.block_width, **(settings or {})}
    spark.createDataFrame([manifest]).coalesce(1).withColumn("created", F.current_timestamp()).write.mode("overwrite").parquet(f"{folder}/manifest")
    return open_index(spark, folder)


def open_index(spark: SparkSession, folder: str) -> Index:
    """A stored index; without a manifest there is none."""
    tables = {name: spark.read.parquet(f"{folder}/{name}") for name in ("manifest", "forward", "blocks", "terms")}
    return Index(tables["forward"], tables["blocks"], tables["terms"], tables["manifest"].first().asDict())


def block_bounds(index: Index, asked: DataFrame) -> DataFrame:
    """(query_id, block, bound, turn): what a document of the block can score at most, the best block of a question first."""
    bounds = index.blocks.select("term", "block", "top").join(asked, "term").groupBy("query_id", "block").agg(F.sum(F.col("idf") * F.col("top")).alias("bound"))
    return bounds.withColumn("turn", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("bound").desc(), "block")))


def _opened(index: Index, asked: DataFrame, pairs: DataFrame | None, scoped: bool, small: bool, partitions: int, params: Params) -> DataFrame:
    """(query_id, number, pos, score) of the visible documents in the (question, block) pairs, or in all blocks.

    Postings move once, by block, whatever the number of questions; scores are summed where they are.
    """
    hint = F.broadcast if small else lambda df: df
    lists = index.blocks.select("term", "block", "entries").join(hint(asked.select("term").distinct()), "term", "left_semi")
    # every document may meet every question: the number of tasks follows these pairs, so that a task's sums stay in its memory
    moved = lists.repartition(partitions, "block") if small else lists
    if pairs is None:
        met = moved.join(asked, "term")
    elif small:  # the postings are where their block is; the questions that open it come there as one row, without a sort
        wanted = pairs.groupBy("block").agg(F.collect_list("query_id").alias("wanted")).hint("shuffle_hash")
        met = moved.join(wanted, "block").join(asked, "term").where(F.array_contains("wanted", F.col("query_id")))
    else:
        met = moved.join(pairs.select("query_id", "block").join(asked, "query_id"), ["term", "block"])
    entries = met.select("query_id", "asking", "idf", "block", F.explode("entries").alias("entry")).select("query_id", "asking", "idf", "block", "entry.*")
    seen = entries.where(F.col("client_id").isNull() | (F.col("client_id") == F.col("asking"))) if scoped else entries
    gain = F.col("idf") * saturation(params, F.lit(index.manifest["avg_len"]))
    scored = seen.groupBy("block", "query_id", "number").agg(F.round(F.sum(gain), 9).alias("score"))
    return scored.select("query_id", "number", F.col("number").alias("pos"), "score")


def bm25_index(index: Index, queries: DataFrame, n: int = DEFAULTS.candidate_k, scoped: bool = True, params: Params = DEFAULTS) -> DataFrame:
    """Best `n` documents of every query: (query_id, chunk_id, pos, number, score, rank), as `lexical.bm25_topk` finds them.

    A first pass opens the `first_blocks` blocks of each question with the highest bounds; the n-th best score there is
    a floor, and of the others only blocks that can reach it are opened. Where the manifest speaks against that
    (see `Index.bounded`) one pass opens all blocks of the terms. Without `scoped` owners do not matter.
    """
    terms = query_terms(queries)
    small = fits(terms, params.broadcast_rows, params.broadcast_bytes)
    asked = terms.join(index.terms.select("term", "idf"), "term")
    asked = F.broadcast(asked) if small else asked  # at most the rows of `terms`
    pairs = index.manifest["n"] * queries.count() if small else 0
    partitions = max(queries.sparkSession.sparkContext.defaultParallelism, math.ceil(pairs / _PAIRS))
    if index.bounded(params):
        bounds = block_bounds(index, asked)
        first = _opened(index, asked, bounds.where(F.col("turn") <= params.first_blocks), scoped, small, partitions, params)
        floor = top_n(first, n).groupBy("query_id").agg(F.min("score").alias("floor"), F.count("*").alias("held")).where(F.col("held") == n)
        reach = bounds.where(F.col("turn") > params.first_blocks).join(floor, "query_id", "left").where(F.col("floor").isNull() | (F.col("bound") + _SLACK >= F.col("floor")))
        scored = first.unionByName(_opened(index, asked, reach, scoped, small, partitions, params))
    else:
        scored = _opened(index, asked, None, scoped, small, partitions, params)
    hits = top_n(scored, n).drop("pos")
    few = fits(queries.select("query_id"), params.broadcast_rows // max(1, n))
    return index.forward.select("number", "chunk_id", "pos").join(F.broadcast(hits) if few else hits, "number").select("query_id", "chunk_id", "pos", "number", "score", "rank")
