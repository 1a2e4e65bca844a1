"""Structured Streaming jobs: intake, duplicate disputes, admission audit, rolling metrics.

Stateful rules keep one small entry per key (the current anchor, a window and its count) until an event-time timer
drops it: once the watermark has passed the end of a window, no row on time can fall into it. Rows of a micro-batch are
taken in as times and ids only and sorted inside their key before they meet the state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from guichet.operators import intake, operations, triage
from guichet.operators.anchors import micros
from guichet.params import DEFAULTS, Params


def use_rocksdb(spark: SparkSession) -> None:
    """State larger than memory, with incremental checkpoints; what arbitrary state needs."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def write(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run what is available now into a parquet table."""
    return (
        stream.writeStream.format("parquet").outputMode(mode).option("path", folder).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def intake_stream(requests: DataFrame, clients: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Canonical, valid, masked and triaged requests, without the raw text: ready to append to the log.

    What is refused goes to `refused_stream`; the two together hold every row.
    """
    valid = intake.validate(intake.canonicalise(requests)).where("is_valid").drop("is_valid", "reasons")
    routed = triage.triage(intake.mask_requests(valid), clients, params)
    return routed.select(
        "request_id", "ts", "route", "rule", "reasons", "q_masked", F.col("resolved_client").alias("client_id"),
        F.col("resolved_amount").alias("montant"), "pii_types",
    )


def refused_stream(requests: DataFrame) -> DataFrame:
    """Refused requests with their reasons, masked like the others: the quarantine of the intake."""
    refused = intake.validate(intake.canonicalise(requests)).where("not coalesce(is_valid, false)")
    return intake.mask_requests(refused.withColumnRenamed("reasons", "refusals")).select("request_id", "ts", F.col("refusals").alias("reasons"), "q_masked")


def write_batches(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run what is available now through a `foreachBatch` function."""
    return stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def batch_tables(folder: str, parts: dict[str, Callable[[DataFrame], DataFrame]]) -> Callable[[DataFrame, int], None]:
    """`foreachBatch` function that writes several tables from one batch, each into its own folder of the batch's number.

    A batch that is replayed after a failure overwrites what it wrote before, so no row is there twice.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        try:
            for name, part in parts.items():
                part(held).write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch_id}")
        finally:
            held.unpersist()

    return sink


def intake_tables(clients: DataFrame, folder: str, params: Params = DEFAULTS) -> Callable[[DataFrame, int], None]:
    """Intake with two outputs: `accepted` (triaged, as `intake_stream`) and `refused` (with the reasons); a row is in one of them, once."""
    return batch_tables(folder, {"accepted": lambda batch: intake_stream(batch, clients, params), "refused": refused_stream})


def window_figures(log: DataFrame, window: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """The operating figures of every tumbling window, for update mode: open windows show, and change as rows come in.

    The state of a window holds how often each latency occurred, which merges like counts, so the percentiles are exact.
    """
    timed = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return timed.groupBy(F.window("ts", window).alias("w")).agg(*operations.figures()).select(F.col("w.start").alias("window_start"), "*").drop("w")


def latest_figures(spark: SparkSession, folder: str, pending: DataFrame, window: str = "1 day") -> DataFrame:
    """What `window_figures` last said of each window (written with `batch_tables` as `figures`), with the actions pending since then."""
    said = spark.read.parquet(f"{folder}/figures")
    names = [c for c in said.columns if c not in ("window_start", "batch")]
    last = said.groupBy("window_start").agg(F.max_by(F.struct(*names), "batch").alias("f")).select("window_start", "f.*")
    opened = pending.groupBy(F.window(F.col("ts").cast("timestamp"), window)["start"].alias("window_start")).agg(F.count("*").alias("pending_actions"))
    return last.join(opened, "window_start", "left").fillna({"pending_actions": 0})


def rolling_metrics(log: DataFrame, window: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """Figures per tumbling window and route; rows later than the watermark are dropped."""
    timed = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return timed.groupBy(F.window("ts", window).alias("w"), "route").agg(
        F.count("*").alias("requests"), F.sum("latency_ms").alias("latency_ms_total"), F.count_if(F.col("error").isNotNull()).alias("errors")
    ).select(F.col("w.start").alias("window_start"), "route", "requests", "latency_ms_total", "errors")


#: Groups that the keys of the disputes are dealt into; the state is stored by group, so a running stream keeps this number.
_GROUPS = 4096


class _Anchored(StatefulProcessor):
    """State of a group of keys: the ticket (key, time, request) in force for each, until its window has passed.

    The state of a group is read and written as a whole, with one timer for the window that ends first, since a call to
    the state for each key would cost far more than the rule itself.
    """

    def __init__(self, width_us: int, id_type: str) -> None:
        self.width_us, self.id_type = width_us, id_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.anchor = handle.getListState("anchor", f"dedupe_key string, at bigint, request_id {self.id_type}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        codes: dict[str | None, int] = {}
        pieces = []
        for piece in rows:  # of the keys only a number for each row is held
            code, own = pd.factorize(piece["dedupe_key"], use_na_sentinel=False)
            place = np.array([codes.setdefault(name if isinstance(name, str) else None, len(codes)) for name in own], np.int32)
            pieces.append((place[code], piece["at"].to_numpy(np.int64), piece["request_id"].to_numpy()))
        code, at, ids = (np.concatenate(c) for c in zip(*pieces, strict=True))
        order = np.lexsort((ids, at, code)) if ids.dtype != object else np.array(sorted(range(len(at)), key=lambda i: (code[i], at[i], ids[i])))
        code, at, ids = code[order], at[order], ids[order]
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = {name: (since, request) for name, since, request in self.anchor.get()}
        before, changed = self._first_end(held), False
        owners, late = np.empty(len(at), object), np.zeros(len(at), bool)
        edges = np.searchsorted(code, np.arange(len(codes) + 1)).tolist()
        for name, i, end in zip(codes, edges[:-1], edges[1:], strict=True):
            state = known = held.get(name)
            while i < end:
                if state is None or at[i] - state[0] > self.width_us:
                    if at[i] < passed:  # its window may have been open and is gone
                        late[i] = True
                        i += 1
                        continue
                    state = (int(at[i]), ids[i].item() if hasattr(ids[i], "item") else ids[i])
                stop = i + int(np.searchsorted(at[i:end], state[0] + self.width_us, side="right"))
                owners[i:stop] = state[1]
                i = stop
            if state is not None and state != known:
                held[name], changed = state, True
        if changed:
            self._keep(held, before)
        names = np.array(list(codes), object)
        for start in range(0, len(at), _PIECE):
            part = slice(start, start + _PIECE)
            yield pd.DataFrame({"request_id": ids[part], "dedupe_key": names[code[part]], "ticket_request": owners[part], "late": late[part]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = max(timerValues.getCurrentWatermarkInMs() - 1, expiredTimerInfo.getExpiryTimeInMs())
        self._keep({name: state for name, state in ((n, (since, request)) for n, since, request in self.anchor.get()) if self._end(state) > passed}, None)
        return iter(())

    def _end(self, state: tuple) -> int:
        return (state[0] + self.width_us) // 1000 + 1

    def _first_end(self, held: dict) -> int | None:
        return min(map(self._end, held.values()), default=None)

    def _keep(self, held: dict, timed: int | None) -> None:
        """Store the tickets in force; `timed` is when the group's timer goes off, if it has one."""
        if held:
            self.anchor.put([(name, *state) for name, state in held.items()])
        else:
            self.anchor.clear()
        first = self._first_end(held)
        if first != timed:
            if timed is not None:
                self.handle.deleteTimer(timed)
            if first is not None:
                self.handle.registerTimer(first)

    def close(self) -> None:
        pass


#: Rows of a piece that a stateful rule gives out at once.
_PIECE = 100_000


def _timed(rows: DataFrame, lateness: str) -> DataFrame:
    """Rows with the watermark of `ts`, which is dropped afterwards: late rows reach the rule, and the rule says what they are."""
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness).withColumn("at", micros(F.col("ts"))).drop("ts")


def dedupe_stream(disputes: DataFrame, params: Params = DEFAULTS, lateness: str = "1 hour") -> DataFrame:
    """Ticket of every dispute (request_id, ts, dedupe_key) as it arrives: (request_id, dedupe_key, ticket_request, late).

    A row behind the watermark still joins the ticket in force; where none covers its time, the one it belonged to may be
    forgotten: it is `late`, without ticket (see `dedupe_tables`).
    """
    use_rocksdb(disputes.sparkSession)
    rows = _timed(disputes.select("dedupe_key", "ts", "request_id"), lateness)
    id_type = rows.schema["request_id"].dataType.simpleString()
    return rows.withColumn("group", F.pmod(F.xxhash64("dedupe_key"), F.lit(_GROUPS)).cast("int")).groupBy("group").transformWithStateInPandas(
        statefulProcessor=_Anchored(params.dedupe_days * 86_400_000_000, id_type),
        outputStructType=f"request_id {id_type}, dedupe_key string, ticket_request {id_type}, late boolean",
        outputMode="Append", timeMode="EventTime",
    )


def dedupe_tables(folder: str) -> Callable[[DataFrame, int], None]:
    """Output of `dedupe_stream` as two tables: `tickets`, and the `late` rows a person must look at."""
    return batch_tables(folder, {"tickets": lambda b: b.where("not late").drop("late"), "late": lambda b: b.where("late").select("request_id", "dedupe_key")})


class _Admission(StatefulProcessor):
    """State: when the caller's window opened and how many requests it admitted, until the window has passed."""

    def __init__(self, limit: int, window_us: int) -> None:
        self.limit, self.window_us = limit, window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "opened bigint, admitted bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pieces = [(piece["at"].to_numpy(np.int64), piece["seq"].to_numpy(np.int64)) for piece in rows]
        at, seq = (np.concatenate(c) for c in zip(*pieces, strict=True))
        order = np.lexsort((seq, at))
        at, seq = at[order], seq[order]
        opened, admitted = self.window.get() if self.window.exists() else (None, 0)
        verdicts, i = np.zeros(len(at), bool), 0
        while i < len(at):  # one round for each window
            if opened is None or at[i] - opened >= self.window_us:
                opened, admitted = int(at[i]), 0
            stop = int(np.searchsorted(at, opened + self.window_us, side="left"))
            room = stop - i if self.limit <= 0 else min(stop - i, max(0, self.limit - admitted))  # no limit admits everything
            verdicts[i : i + room] = True
            admitted, i = admitted + room, stop
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.window.update((opened, admitted))
        self.handle.registerTimer((opened + self.window_us) // 1000 + 1)
        for start in range(0, len(at), _PIECE):
            part = slice(start, start + _PIECE)
            yield pd.DataFrame({"seq": seq[part], "caller": key[0], "admitted": verdicts[part]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.window.clear()
        return iter(())

    def close(self) -> None:
        pass


def admission_stream(events: DataFrame, limit: int, window_s: int, lateness: str = "10 minutes") -> DataFrame:
    """Admission verdict of every request (caller, ts, seq) as it arrives.

    A caller's rows of a micro-batch take 16 bytes each; the state goes when its window has passed the watermark.
    """
    use_rocksdb(events.sparkSession)
    rows = _timed(events.select(F.col("caller").cast("string").alias("caller"), "ts", F.col("seq").cast("bigint").alias("seq")), lateness)
    return rows.groupBy("caller").transformWithStateInPandas(
        statefulProcessor=_Admission(limit, window_s * 1_000_000),
        outputStructType="seq bigint, caller string, admitted boolean", outputMode="Append", timeMode="EventTime",
    )
