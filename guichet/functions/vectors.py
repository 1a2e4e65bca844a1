"""Vectors: hashed bag of tokens and cosine of unit rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guichet.functions.text import tokenize


def hash_buckets(tokens: Column, dim: int = 256) -> Column:
    """CRC-32 bucket of every token (the same in every process)."""
    return F.transform(tokens, lambda t: (F.crc32(t.cast("binary")) % dim).cast("int"))


def _dense_udf(dim: int):
    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def dense(buckets: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(buckets), 0).to_numpy(zero_copy_only=False)
        flat = buckets.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        rows = np.repeat(np.arange(len(sizes)), sizes)
        matrix = np.bincount(rows * dim + flat, minlength=len(sizes) * dim).reshape(len(sizes), dim).astype(np.float64)
        norms = np.linalg.norm(matrix, axis=1, keepdims=True)
        norms[norms == 0] = 1.0
        values = pa.array((matrix / norms).astype(np.float32).ravel(), pa.float32())
        offsets = pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * dim)
        return pa.ListArray.from_arrays(offsets, values)

    return dense


def hash_vectors(df: DataFrame, text: str, out: str = "embedding", dim: int = 256, stem: bool = True, composed: bool = False) -> DataFrame:
    """Unit vector of token counts per hash bucket; a text without token gives a zero vector. No shuffle."""
    buckets = hash_buckets(tokenize(F.col(text), stem=stem, composed=composed), dim)
    return df.withColumn(out, _dense_udf(dim)(buckets))


def unit(vector: Column) -> Column:
    """Vector scaled to unit length in double precision; a zero vector stays zero."""
    wide = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.when(norm > 0, F.transform(wide, lambda x: x / norm)).otherwise(wide)


def cosine(a: Column, b: Column) -> Column:
    """Dot product of two unit rows, in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)
