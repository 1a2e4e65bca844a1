"""Exact cosine search of a table of query vectors in a table of vectors, block by block.

    vectors  chunk_id, pos, embedding ARRAY<FLOAT> [, client_id]
    queries  query_id, embedding ARRAY<FLOAT> [, client_id]

Both sides are packed into matrix blocks of at most so many rows, without an exchange. Every corpus block meets every query
block; a pair is one matrix product, and only its best rows for each query leave it. Query blocks are broadcast after a
check of their size; beyond it Spark deals pairs of partitions out to the tasks. Vectors of different sizes never meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guichet.operators.lexical import top_n
from guichet.operators.sizing import fits
from guichet.params import DEFAULTS, Params


def cosine_topk(vectors: DataFrame, queries: DataFrame, n: int = DEFAULTS.candidate_k, params: Params = DEFAULTS, normalize: bool = False) -> DataFrame:
    """Best `n` visible vectors of every query with a positive similarity: (query_id, chunk_id, pos, score, rank).

    Rows are unit vectors, or made so with `normalize`. A vector that is null or has a null component matches nothing
    (see `split_vectors`), nor does one of another size than the query's.
    """
    corpus = vector_blocks(vectors, "chunk_id", "pos", params.corpus_block, normalize)
    asked = vector_blocks(queries.withColumn("pos", F.lit(0).cast("long")), "query_id", "pos", params.query_block, normalize)
    asked = asked.select(F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("owners").alias("q_owners"), F.col("matrix").alias("q_matrix"))
    few = fits(queries.select("query_id", "embedding"), params.broadcast_rows, params.broadcast_bytes)
    pairs = corpus.crossJoin(F.broadcast(asked) if few else asked).where("dim = q_dim")
    ids = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("chunk_id", vectors.schema["chunk_id"].dataType)])
    return top_n(pairs.mapInArrow(_best(n), ids.add("pos", "long").add("score", "double")), n)


def split_vectors(vectors: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """(vectors that can be searched, the others with the `reason`)."""
    reason = (
        F.when(F.col("embedding").isNull(), "missing").when(F.size("embedding") != dim, "size")
        .when(F.exists("embedding", lambda x: x.isNull()), "null component")
        .when(F.exists("embedding", lambda x: F.isnan(x) | (F.abs(x) == float("inf"))), "not finite")
    )
    judged = vectors.withColumn("reason", reason)
    return judged.where(F.col("reason").isNull()).drop("reason"), judged.where(F.col("reason").isNotNull())


def check_vectors(vectors: DataFrame, dim: int) -> DataFrame:
    """Fail the job on a vector of another size."""
    return vectors.withColumn(
        "embedding", F.when(F.assert_true(F.size("embedding") == dim, F.lit("vector size")).isNull(), F.col("embedding"))
    )


def vector_blocks(rows: DataFrame, key: str, pos: str, size: int, normalize: bool) -> DataFrame:
    """(dim, ids, poss, owners, matrix): rows of one dimension as one matrix of at most `size` rows."""
    owner = F.col("client_id") if "client_id" in rows.columns else F.lit(None)
    picked = rows.select(F.col(key).alias("id"), F.col(pos).cast("long").alias("pos"), owner.cast("string").alias("owner"), F.col("embedding").cast("array<double>").alias("embedding"))
    kind = picked.schema["id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column("embedding")
            lengths = pc.fill_null(pc.list_value_length(listed), -1).to_numpy(zero_copy_only=False)
            holes = np.zeros(len(lengths), bool)
            if listed.flatten().null_count:
                rows_of = np.repeat(np.arange(len(lengths)), np.maximum(lengths, 0))
                holes[rows_of[listed.flatten().is_null().to_numpy(zero_copy_only=False)]] = True
            for dim in np.unique(lengths[lengths > 0]):
                fine = np.flatnonzero((lengths == dim) & ~holes)
                for start in range(0, len(fine), size):
                    part = batch.take(pa.array(fine[start : start + size]))
                    matrix = part.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dim)
                    if normalize:
                        norm = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
                        matrix = matrix / np.where(norm > 0, norm, 1.0)
                    packed = [[dim], [part.column("id").to_pylist()], [part.column("pos").to_pylist()], [part.column("owner").to_pylist()], [matrix.tobytes()]]
                    types = [pa.int32(), pa.list_(part.column("id").type), pa.list_(pa.int64()), pa.list_(pa.string()), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(packed, types, strict=True)], names=["dim", "ids", "poss", "owners", "matrix"])

    return picked.mapInArrow(pack, f"dim int, ids array<{kind}>, poss array<bigint>, owners array<string>, matrix binary")


def _best(n: int):
    """The best `n` rows of each pair of blocks, for each query; ties go to the smaller position."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                dim = row["dim"].as_py()
                corpus, asked = (np.frombuffer(row[m].as_buffer(), np.float64).reshape(-1, dim) for m in ("matrix", "q_matrix"))
                scores = np.round(asked @ corpus.T, 9)
                owners, asking = np.array(row["owners"].as_py(), object), np.array(row["q_owners"].as_py(), object)
                public = owners == None  # noqa: E711  (element-wise)
                if not public.all():
                    scores[~(public[None, :] | (owners[None, :] == asking[:, None]))] = 0
                poss = row["poss"].values.to_numpy(zero_copy_only=False)
                if scores.shape[1] > n:
                    floor = -np.partition(-scores, n - 1, axis=1)[:, n - 1]
                    q, c = np.nonzero((scores > 0) & (scores >= floor[:, None]))
                else:
                    q, c = np.nonzero(scores > 0)
                order = np.lexsort((poss[c], -scores[q, c], q))
                q, c = q[order], c[order]
                first = np.searchsorted(q, q, side="left")
                kept = np.arange(len(q)) - first < n
                q, c = q[kept], c[kept]
                yield pa.RecordBatch.from_arrays(
                    [row["q_ids"].values.take(pa.array(q)), row["ids"].values.take(pa.array(c)), pa.array(poss[c]), pa.array(scores[q, c])],
                    names=["query_id", "chunk_id", "pos", "score"],
                )

    return best
