"""Size checks that decide, before a plan runs, whether a side may be broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guichet.params import DEFAULTS, Params


def fits(df: DataFrame, max_rows: int = DEFAULTS.broadcast_rows, max_bytes: int = DEFAULTS.broadcast_bytes) -> bool:
    """Whether a table is proven to stay under both bounds.

    The check reads at most `max_rows + 1` rows and never brings them to the driver.
    """
    width = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    row = df.limit(max_rows + 1).agg(F.count("*").alias("n"), F.sum(width).alias("bytes")).first()
    return row["n"] <= max_rows and (row["bytes"] or 0) <= max_bytes


def broadcast_if_small(df: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Broadcast hint for a table proven small; otherwise the table as it is (sort-merge join, AQE skew handling)."""
    return F.broadcast(df) if fits(df, params.broadcast_rows, params.broadcast_bytes) else df
