"""Audit of a fixed-window request limit per caller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from guichet.operators.anchors import micros, sliced_windows
from guichet.params import DEFAULTS, Params


def admission_audit(
    events: DataFrame, limit: int | None = None, window_s: int | None = None, params: Params = DEFAULTS, windows_per_slice: int = 64
) -> DataFrame:
    """Add window_start, position, admitted and retry_after_s to events (caller, ts, seq).

    A window opens with the caller's first request and restarts at the first request at least
    `window_s` later; the first `limit` requests of a window are admitted. A limit of 0 admits all.
    """
    limit = params.rate_limit if limit is None else limit
    window_us = (params.rate_window_s if window_s is None else window_s) * 1_000_000
    placed = sliced_windows(events.withColumn("__at", micros(F.col("ts"))), "caller", "__at", "seq", window_us, windows_per_slice)
    # One window of one caller: seconds of traffic, never a whole key.
    order = W.partitionBy("caller", "anchor_at").orderBy("__at", "seq")
    left = (F.col("anchor_at") + window_us - F.col("__at")) / F.lit(1_000_000)
    return (
        placed.withColumn("position", F.row_number().over(order))
        .withColumn("admitted", (F.col("position") <= limit) if limit > 0 else F.lit(True))
        .withColumn("retry_after_s", F.when(~F.col("admitted"), F.greatest(F.lit(1), F.ceil(left))).cast("bigint"))
        .withColumn("window_start", F.timestamp_micros("anchor_at"))
        .drop("__at", "anchor_at")
    )
