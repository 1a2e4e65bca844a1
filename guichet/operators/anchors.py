"""Windows anchored on events: the first event of a key opens a window, later ones fall into it, and
the first event beyond it opens the next. The anchor depends on the previous anchor, so this is
neither a `lag` nor a session window.

Two exact plans, both safe for a key that holds a large share of the rows:

`anchored_windows`  few windows per key (days of data, windows of days). Ordinary keys are folded in a
                    sorted pass; a hot key is never sent to one task: its anchors are found one
                    window at a time by a `min`, which combines on the map side.
`sliced_windows`    many windows per key (months of data, windows of seconds). Time is cut into
                    slices of several windows, every (key, slice) is summarised independently, and
                    only the summaries are walked in order.
"""

from __future__ import annotations


from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guichet.operators.sizing import broadcast_if_small
from guichet.params import DEFAULTS, Params
from guichet.session import checkpoint_root


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def anchored_windows(
    events: DataFrame, key: str, at: str, ident: str, width_us: int, params: Params = DEFAULTS
) -> DataFrame:
    """Add `anchor_at` and `anchor_id`; an event exactly `width_us` after its anchor still belongs to it.

    `at` is a BIGINT of microseconds and (at, ident) orders the events of a key.
    """
    checkpoint_root(events.sparkSession)
    # At most rows / hot_key_rows keys can be hot.
    hot = events.groupBy(key).count().where(F.col("count") > params.hot_key_rows).select(key).checkpoint()
    if hot.isEmpty():
        return _folded(events, key, at, ident, width_us)
    marked = broadcast_if_small(hot, params)
    return _folded(events.join(marked, key, "left_anti"), key, at, ident, width_us).unionByName(
        _by_rounds(events.join(marked, key, "left_semi"), key, at, ident, width_us, params)
    )


def _folded(events: DataFrame, key: str, at: str, ident: str, width_us: int) -> DataFrame:
    """Keys fold in one sorted pass per task: constant memory whatever the size of a key."""
    return _sorted_pass(events, [key], at, [at, ident], width_us, inclusive=True, ident=ident)


def _sorted_pass(
    events: DataFrame, group: list[str], at: str, order: list[str], width_us: int, inclusive: bool,
    ident: str | None = None, carry: str | None = None,
) -> DataFrame:
    """Label every event with its anchor in one pass over rows clustered by `group` and sorted by `order`.

    With `carry`, a group starts inside a window opened earlier (the anchor in that column, if any).
    """
    schema = [*events.schema.fields, T.StructField("anchor_at", T.LongType())]
    if ident is not None:
        schema.append(T.StructField("anchor_id", events.schema[ident].dataType))
    names = [f.name for f in events.schema.fields]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: tuple = ()
        anchor, owner = 0, None
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(names)}
            keys = list(zip(*[column[g].to_pylist() for g in group], strict=True))
            times = column[at].to_pylist()
            idents = column[ident].to_pylist() if ident else times
            carried = column[carry].to_pylist() if carry else None
            anchors, owners = [], []
            for i, k in enumerate(keys):
                t = times[i]
                fresh = k != current
                if fresh:
                    current = k
                    if carried is not None and carried[i] is not None:
                        anchor, fresh = carried[i], False
                if fresh or t - anchor > width_us or (not inclusive and t - anchor == width_us):
                    anchor, owner = t, idents[i]
                anchors.append(anchor)
                owners.append(owner)
            arrays = [*batch.columns, pa.array(anchors, pa.int64())]
            if ident:
                arrays.append(pa.array(owners, column[ident].type))
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema])

    clustered = events.repartition(*group).sortWithinPartitions(*group, *order)
    return clustered.mapInArrow(walk, T.StructType(schema))


def _by_rounds(events: DataFrame, key: str, at: str, ident: str, width_us: int, params: Params) -> DataFrame:
    first = F.min(F.struct(F.col(at).alias("anchor_at"), F.col(ident).alias("anchor_id"))).alias("a")
    current = events.groupBy(key).agg(first).select(key, "a.*").checkpoint()
    anchors = current
    while not current.isEmpty():
        later = events.join(broadcast_if_small(current.select(key, F.col("anchor_at").alias("__from")), params), key)
        current = (
            later.where(F.col(at) > F.col("__from") + width_us).groupBy(key).agg(first).select(key, "a.*").checkpoint()
        )
        anchors = anchors.unionByName(current)
    # An anchor covers its window, that is two buckets of the window's width: an equi-join finds it.
    width = F.lit(width_us)
    buckets = anchors.withColumn(
        "__bucket",
        F.explode(F.sequence(F.floor(F.col("anchor_at") / width), F.floor((F.col("anchor_at") + width) / width))),
    )
    return (
        events.withColumn("__bucket", F.floor(F.col(at) / width))
        .join(broadcast_if_small(buckets, params), [key, "__bucket"])
        .where((F.col(at) >= F.col("anchor_at")) & (F.col(at) <= F.col("anchor_at") + width))
        .select(*events.columns, "anchor_at", "anchor_id")
    )


def sliced_windows(events: DataFrame, key: str, at: str, ident: str, width_us: int, windows_per_slice: int = 64) -> DataFrame:
    """Add `anchor_at`; the window restarts at the first event at least `width_us` after it opened."""
    slice_us = width_us * windows_per_slice
    sliced = events.withColumn("__slice", F.floor(F.col(at) / F.lit(slice_us)))
    # A slice holds the traffic of one key over a few windows; its distinct times fit one row.
    times = sliced.groupBy(key, "__slice").agg(F.sort_array(F.collect_set(at)).alias("__times"))
    steps = times.withColumn("__steps", _summarise(width_us, slice_us)(F.col("__times"), F.col("__slice"))).drop("__times")
    # Per key: one short row per slice, whatever the number of events.
    entries = F.sort_array(F.collect_list(F.struct("__slice", "__steps")))
    carries = (
        steps.groupBy(key).agg(entries.alias("__entries"))
        .select(key, F.inline(_stitch(width_us)(F.col("__entries"))))
    )
    entered = sliced.join(carries, [key, "__slice"])
    return _sorted_pass(
        entered, [key, "__slice"], at, [at, ident], width_us, inclusive=False, carry="__carry"
    ).drop("__slice", "__carry")


_STEPS = "struct<upto: array<bigint>, leave: array<bigint>>"


def _summarise(width_us: int, slice_us: int):
    """Where a window entering a slice at threshold x leaves it, as steps: the first `upto` >= x decides."""

    @F.arrow_udf(_STEPS)
    def summarise(times: pa.Array, slices: pa.Array) -> pa.Array:
        out = []
        for listed, index in zip(times.to_pylist(), slices.to_pylist(), strict=True):
            t = np.array(listed, dtype=np.int64)
            following = np.searchsorted(t, t + width_us, side="left")
            reach = np.where(following < len(t), following, np.arange(len(t)))
            while not np.array_equal(reach, reach[reach]):
                reach = reach[reach]
            entries = min(int(np.searchsorted(t, index * slice_us + width_us, side="left")) + 1, len(t))
            leave = t[reach[:entries]]
            ends = np.flatnonzero(np.append(leave[1:] != leave[:-1], True))
            out.append({"upto": t[ends].tolist(), "leave": leave[ends].tolist()})
        kind = pa.struct([("upto", pa.list_(pa.int64())), ("leave", pa.list_(pa.int64()))])
        return pa.array(out, kind)

    return summarise


def _stitch(width_us: int):
    """Anchor in force when each slice of a key begins, from the steps of its slices in order."""

    @F.arrow_udf("array<struct<__slice: bigint, __carry: bigint>>")
    def stitch(entries: pa.Array) -> pa.Array:
        out = []
        for slices in entries.to_pylist():
            anchor, rows = None, []
            for entry in slices:
                rows.append({"__slice": entry["__slice"], "__carry": anchor})
                upto, leave = entry["__steps"]["upto"], entry["__steps"]["leave"]
                at = 0 if anchor is None else bisect_left(upto, anchor + width_us)
                if at < len(upto):
                    anchor = leave[at]
            out.append(rows)
        return pa.array(out, pa.list_(pa.struct([("__slice", pa.int64()), ("__carry", pa.int64())])))

    return stitch


__all__ = ["anchored_windows", "micros", "sliced_windows"]
