"""Streams in several micro-batches give what the batch rule gives on all rows."""

import datetime as dt


from guichet.operators import admission, tickets
from guichet.streaming import jobs

T0 = dt.datetime(2026, 1, 1)


def feed(spark, folder, data, schema, parts):
    """One file per micro-batch, in event order."""
    step = -(-len(data) // parts)
    for i in range(parts):
        spark.createDataFrame(data[i * step : (i + 1) * step], schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))


def drain(stream, folder):
    query = jobs.write(stream, str(folder / "out"), str(folder / "checkpoint"))
    query.awaitTermination()
    assert query.exception() is None
    return stream.sparkSession.read.schema(stream.schema).parquet(str(folder / "out"))


def test_duplicates_over_micro_batches(spark, tmp_path):
    data = [(i, T0 + dt.timedelta(hours=13 * i), f"k{i % 3}") for i in range(60)]
    schema = "request_id bigint, ts timestamp_ntz, dedupe_key string"
    streamed = drain(jobs.dedupe_stream(feed(spark, tmp_path, data, schema, 3)), tmp_path)
    whole = tickets.deduplicate(spark.createDataFrame(data, schema))
    assert {tuple(r) for r in streamed.select("request_id", "ticket_request").collect()} == {tuple(r) for r in whole.select("request_id", "ticket_request").collect()}


def test_admission_over_micro_batches(spark, tmp_path):
    data = [(f"c{i % 2}", T0 + dt.timedelta(seconds=7 * i), i) for i in range(60)]
    schema = "caller string, ts timestamp_ntz, seq bigint"
    streamed = drain(jobs.admission_stream(feed(spark, tmp_path, data, schema, 3), 3, 60), tmp_path)
    whole = admission.admission_audit(spark.createDataFrame(data, schema), limit=3, window_s=60)
    assert {tuple(r) for r in streamed.select("seq", "admitted").collect()} == {tuple(r) for r in whole.select("seq", "admitted").collect()}


def test_late_rows_are_dropped_and_intake_hides_the_raw_text(spark, tmp_path):
    log = [(T0 + dt.timedelta(hours=h), "rag", 5, None) for h in (1, 30, 60)] + [(T0 + dt.timedelta(hours=2), "rag", 7, None), (T0 + dt.timedelta(hours=90), "rag", 1, None)]
    schema = "ts timestamp_ntz, route string, latency_ms int, error string"
    rows = drain(jobs.rolling_metrics(feed(spark, tmp_path, log, schema, 5)), tmp_path).orderBy("window_start").collect()
    assert [(r["window_start"].day, r["requests"], r["latency_ms_total"]) for r in rows] == [(1, 1, 5), (2, 1, 5), (3, 1, 5)]


SENT = "request_id int, ts timestamp_ntz, q string, client_id string, montant double"


def test_intake_writes_accepted_and_refused_once_each(spark, tmp_path):
    data = [(1, T0, "Appelez le 0611223344, pompe en panne", None, None), (2, T0, "x", None, None), (3, T0, None, "C-1", 5.0), (4, T0, "Quel est le délai ?", "c-1", None)]
    clients = spark.createDataFrame([("C-1",)], "client_id string")
    sink = jobs.intake_tables(clients, str(tmp_path / "tables"))
    for number in (0, 0, 1):  # batch 0 is replayed
        sink(spark.createDataFrame(data if number == 0 else [(5, T0, "y", None, None)], SENT), number)
    accepted = spark.read.parquet(str(tmp_path / "tables" / "accepted"))
    refused = spark.read.parquet(str(tmp_path / "tables" / "refused"))
    assert sorted((r["request_id"], r["rule"], r["q_masked"]) for r in accepted.collect())[0] == (1, "RG-05", "Appelez le [TEL], pompe en panne")
    assert sorted(r["request_id"] for r in accepted.collect()) == [1, 4] and "q" not in accepted.columns
    assert sorted((r["request_id"], r["reasons"][0]) for r in refused.collect()) == [(2, "text_too_short"), (3, "text_missing"), (5, "text_too_short")]


def hours(*numbers):
    return [T0 + dt.timedelta(hours=h) for h in numbers]


def states(spark, folder):
    """Keys whose state is still held."""
    return spark.read.format("statestore").option("stateVarName", "anchor").load(str(folder / "checkpoint")).count()


def test_ticket_state_expires_and_late_rows_have_a_table_of_their_own(spark, tmp_path):
    """Keys a and b at the start; c moves the watermark weeks ahead; then a row of a comes weeks late, and one of c an hour behind its ticket."""
    schema = "request_id bigint, ts timestamp_ntz, dedupe_key string"
    times = hours(0, 10, 24 * 30, 24 * 30 + 1, 20, 24 * 30 + 2)
    data = list(zip([1, 2, 3, 4, 5, 6], times, ["a", "b", "c", "d", "a", "c"], strict=True))
    stream = jobs.dedupe_stream(feed(spark, tmp_path, data, schema, 6))
    jobs.write_batches(stream, jobs.dedupe_tables(str(tmp_path / "tables")), str(tmp_path / "checkpoint")).awaitTermination()
    kept = {r["request_id"]: r["ticket_request"] for r in spark.read.parquet(str(tmp_path / "tables" / "tickets")).collect()}
    assert kept == {1: 1, 2: 2, 3: 3, 4: 4, 6: 3}
    assert [r["request_id"] for r in spark.read.parquet(str(tmp_path / "tables" / "late")).collect()] == [5]
    assert states(spark, tmp_path) == 2  # c and d; a and b are gone


def test_a_restarted_stream_goes_on_from_its_state(spark, tmp_path):
    schema = "request_id bigint, ts timestamp_ntz, dedupe_key string"
    drain(jobs.dedupe_stream(feed(spark, tmp_path, [(1, T0, "a"), (2, *hours(5), "b")], schema, 1)), tmp_path)
    again = drain(jobs.dedupe_stream(feed(spark, tmp_path, [(3, *hours(30), "a"), (4, *hours(24 * 8), "a")], schema, 1)), tmp_path)
    assert sorted((r["request_id"], r["ticket_request"]) for r in again.collect()) == [(1, 1), (2, 2), (3, 1), (4, 4)]


def test_a_caller_with_very_many_rows_in_one_batch(spark, tmp_path):
    """More rows than one piece holds; every tenth of a second one request, and a limit of 5 a minute."""
    n = 400_000
    spark.range(n).selectExpr("'c' AS caller", "timestamp_ntz '2026-01-01' + make_dt_interval(0, 0, 0, id / 10) AS ts", "id AS seq").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("caller string, ts timestamp_ntz, seq bigint").parquet(str(tmp_path / "in"))
    rows = drain(jobs.admission_stream(stream, 5, 60), tmp_path)
    assert rows.count() == n and rows.where("admitted <> (seq % 600 < 5)").isEmpty()


def test_figures_of_open_windows_change_with_every_batch(spark, tmp_path):
    schema = "ts timestamp_ntz, route string, latency_ms int, cost_eur double, llm_calls int, error string"
    data = [(*hours(h), "human" if h % 2 else "rag", ms, 0.5, h % 3, None) for h, ms in [(1, 10), (2, 30), (3, 20), (25, 7), (4, 40), (26, 9)]]
    sink = jobs.batch_tables(str(tmp_path / "t"), {"figures": lambda b: b})
    jobs.write_batches(jobs.window_figures(feed(spark, tmp_path, data, schema, 3), lateness="2 days"), sink, str(tmp_path / "checkpoint"), "update").awaitTermination()
    pending = spark.createDataFrame([(*hours(2),)], "ts timestamp_ntz")
    found = [tuple(r) for r in jobs.latest_figures(spark, str(tmp_path / "t"), pending).orderBy("window_start").drop("window_start").collect()]
    assert found == [(4, 20, 40, 2.0, 0.5, 0.75, 0.5, 0, 1), (2, 7, 9, 1.0, 0.5, 1.0, 0.5, 0, 0)]
    first = spark.read.parquet(str(tmp_path / "t" / "figures")).where("batch = 0").first()
    assert (first["requests"], first["latency_ms_p50"]) == (2, 10)


def test_keys_share_a_state_and_are_dropped_each_in_its_time(spark, tmp_path, monkeypatch):
    """Many keys in few groups, a null one among them: the same tickets as in batch, one call to the state for a group, and only open tickets held."""
    monkeypatch.setattr(jobs, "_GROUPS", 2)
    schema = "request_id bigint, ts timestamp_ntz, dedupe_key string"
    data = [(i, T0 + dt.timedelta(hours=5 * i), None if i % 29 == 0 else f"k{i % 29}") for i in range(200)]
    streamed = drain(jobs.dedupe_stream(feed(spark, tmp_path, data, schema, 4)), tmp_path)
    wanted, now = set(), {}
    for number, ts, key in data:
        since, owner = now.get(key, (None, None))
        now[key] = (since, owner) if since is not None and ts - since <= dt.timedelta(days=7) else (ts, number)
        wanted.add((number, key, now[key][1], False))
    assert {tuple(r) for r in streamed.collect()} == wanted
    until = data[-1][1] - dt.timedelta(hours=1)
    assert states(spark, tmp_path) == sum(since + dt.timedelta(days=7) >= until for since, _ in now.values())
    groups = spark.read.format("statestore").option("stateVarName", "anchor").load(str(tmp_path / "checkpoint")).select("key").distinct()
    assert groups.count() <= 2
