"""Passages, chunking, anchored windows, tickets, decisions, figures, sources and the whole request job."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from guichet.operators import admission, anchors, chunking, dossier, evaluation, lexical, operations, ordering, passages, tickets
from guichet.params import Params
from guichet.plans import handling
from guichet.sources import documents as sd
from guichet.sources import reference as ref
from guichet.sources import sinks
from tests.plain_chunks import pack_page

DAY = dt.timedelta(days=1)
T0 = dt.datetime(2026, 1, 1, 8)
TEXT = """# Procédure
intro

## Délais
| Formule | P1 |
|---|:-:|
| Premium | 2 h |
| Confort | 4 h |

- Le rappel a lieu sous 20 minutes. Il est gratuit.
7. Report
3. Prévenir le client.
"""


# --- passages -----------------------------------------------------------------------------------


def hit(spark, text=TEXT):
    return spark.createDataFrame([(0, 1, "c", "Guide SAV", "", text)], "query_id int, ref int, chunk_id string, title string, section string, text string")


def test_passages_carry_headers_and_headings(spark):
    got = [(r["passage"], r["header"], r["heading"]) for r in passages.passages(hit(spark)).orderBy("line_no", "part").collect()]
    assert got == [
        ("intro", None, "# Procédure"),
        ("Formule : Premium ; P1 : 2 h", "Formule P1", "## Délais"),
        ("Formule : Confort ; P1 : 4 h", "Formule P1", "## Délais"),
        ("Le rappel a lieu sous 20 minutes.", None, "## Délais"),
        ("Il est gratuit.", None, "## Délais"),
        ("Prévenir le client.", None, "7. Report"),
    ]


@pytest.mark.parametrize(
    ("question", "expected"),
    [
        ("délai P1 formule Confort", ["Formule : Confort ; P1 : 4 h"]),
        ("quel délai de rappel ?", ["Le rappel a lieu sous 20 minutes."]),
        ("recette de tarte aux pommes", []),
    ],
)
def test_best_passages(spark, question, expected):
    asked = lexical.analyze(spark.createDataFrame([(0, question)], "query_id int, t string"), "t")
    got = [r["passage"] for r in passages.best_passages(asked, hit(spark)).orderBy("quote_rank").collect()]
    assert got == expected


def test_row_without_header_and_repeated_text(spark):
    asked = lexical.analyze(spark.createDataFrame([(0, "tarif nuit")], "query_id int, t string"), "t")
    two = hit(spark, "| tarif | nuit |\nLe tarif de nuit double.").unionByName(hit(spark, "Le tarif de nuit double.").withColumn("ref", F.lit(2)))
    got = passages.best_passages(asked, two).orderBy("quote_rank").collect()
    assert [(r["ref"], r["passage"]) for r in got] == [(1, "tarif ; nuit"), (1, "Le tarif de nuit double.")]


# --- chunking -----------------------------------------------------------------------------------


@pytest.mark.parametrize(("size", "overlap"), [(60, 0), (100, 30), (160, 60), (400, 100), (900, 150)])
def test_chunks_keep_every_line_and_stay_small(size, overlap):
    text = TEXT + "\n".join(f"ligne {i} " + "mot " * (i % 9) for i in range(40)) + "\n\n# Fin\n## Annexe\n" + "phrase courte. " * 12
    packed, section = pack_page(text, "", size, overlap)
    assert section == "Annexe" and all(0 < len(t) <= size for _, t in packed)
    glued = "\n".join(t for _, t in packed)
    assert all(line.strip() in glued for line in text.splitlines() if len(line) <= size)
    body = [t for _, t in packed if any(line and not line.startswith("#") for line in t.splitlines())]
    assert len(body) == len(packed)  # no chunk made of headings alone


def test_overlap_stays_inside_a_section():
    lines = "\n\n".join(f"paragraphe {i} avec du texte" for i in range(4))
    packed, _ = pack_page(f"# A\n{lines}\n\n# B\nfin", "", 70, 40)
    assert [s for s, _ in packed][-1] == "B" and packed[-1][1] == "# B\n\nfin"
    assert packed[1][1].startswith(packed[0][1].splitlines()[-1])


def test_section_and_numbers_over_pages(spark):
    doc = spark.createDataFrame(
        [("d.pdf", "D", "note", None, [(1, "# S\n" + "mot " * 60), (3, "suite")]), ("vide", "V", "note", None, [])],
        "doc string, title string, doc_type string, client_id string, pages array<struct<number:int,text:string>>",
    )
    got = chunking.chunk_documents(doc, Params(chunk_size=100, chunk_overlap=0)).orderBy("page", "number").collect()
    assert [r["chunk_id"] for r in got] == ["d.pdf#p1-1", "d.pdf#p1-2", "d.pdf#p1-3", "d.pdf#p1-4", "d.pdf#p3-1"]
    assert {r["section"] for r in got if r["number"] > 1 or r["page"] == 3} == {"S"}


def test_approving_twice_makes_one_ticket_and_rewrites_changed_partitions_only(spark, tmp_path):
    rows = [(f"A-{i}", i, ("s", "b", "P2", f"C-{i}")) for i in range(40)]
    actions = spark.createDataFrame(rows, "action_id string, request_id int, payload struct<subject:string,summary:string,priority:string,client_id:string>")
    says = lambda *d: spark.createDataFrame([(a, w, "v", p, r, T0 + DAY * k, k) for k, (a, w, p, r) in enumerate(d)], "action_id string, decision string, validator string, priority string, reason string, ts timestamp, seq int")
    first = [("A-3", "approved", None, "appeler le 0611223344"), ("A-1", "rejected", None, None), ("A-1", "approved", "P1", None), ("A-9", "approved", "P1", None), ("unknown", "approved", None, None)]
    folder = str(tmp_path / "tickets")
    merge = lambda d: {r["action_id"]: (r["ticket_id"], r["priority"], r["reason"]) for r in tickets.merge_tickets(tickets.approved_tickets(actions, says(*d)), folder).collect()}
    want = {"A-3": ("T-000001", "P2", "appeler le [TEL]"), "A-9": ("T-000002", "P1", None)}
    assert merge(first) == want
    files = {str(f): f.stat().st_mtime_ns for f in (tmp_path / "tickets").rglob("*.parquet")}
    assert merge(first + [("A-9", "approved", "P3", None), ("A-3", "rejected", None, None)]) == want
    assert {str(f): f.stat().st_mtime_ns for f in (tmp_path / "tickets").rglob("*.parquet")} == files  # nothing new, nothing written
    assert merge(first + [("A-7", "approved", None, None)]) == want | {"A-7": ("T-000003", "P2", None)}
    kept = [f for f in (tmp_path / "tickets").rglob("*.parquet") if str(f) in files]
    assert kept and all(f.stat().st_mtime_ns == files[str(f)] for f in kept)


# --- anchored windows ---------------------------------------------------------------------------


def brute_windows(events, width, inclusive):
    out, state = {}, {}
    for key, at, ident in sorted(events):
        anchor = state.get(key)
        if anchor is None or at - anchor[0] > width or (not inclusive and at - anchor[0] == width):
            state[key] = (at, ident)
        out[ident] = state[key]
    return out


def random_events(seed):
    rng = np.random.default_rng(seed)
    keys = np.where(rng.random(600) < 0.4, 0, rng.integers(1, 30, 600))  # one key holds over a third
    return [(int(k), int(t), i) for i, (k, t) in enumerate(zip(keys, rng.integers(0, 400, 600)))]


@pytest.mark.parametrize("hot", [1_000_000, 60])
def test_anchored_windows_with_and_without_hot_keys(spark, hot):
    events = random_events(1)
    df = spark.createDataFrame(events, "k int, at bigint, i int")
    got = {r["i"]: (r["anchor_at"], r["anchor_id"]) for r in anchors.anchored_windows(df, "k", "at", "i", 50, Params(hot_key_rows=hot)).collect()}
    assert got == brute_windows(events, 50, True)


@pytest.mark.parametrize(("width", "per_slice"), [(10, 1), (10, 4), (7, 3), (150, 2)])
def test_sliced_windows(spark, width, per_slice):
    events = random_events(2)
    df = spark.createDataFrame(events, "k int, at bigint, i int")
    got = {r["i"]: r["anchor_at"] for r in anchors.sliced_windows(df, "k", "at", "i", width, per_slice).collect()}
    assert got == {i: a for i, (a, _) in brute_windows(events, width, False).items()}


def test_admission_limit_and_retry(spark):
    moments = [0, 1, 2, 59, 60, 61]
    df = spark.createDataFrame([("a", T0 + dt.timedelta(seconds=s), i) for i, s in enumerate(moments)] + [("b", T0, 9)], "caller string, ts timestamp_ntz, seq int")
    got = {r["seq"]: (r["admitted"], r["retry_after_s"]) for r in admission.admission_audit(df, limit=2).collect()}
    assert got == {0: (True, None), 1: (True, None), 2: (False, 58), 3: (False, 1), 4: (True, None), 5: (True, None), 9: (True, None)}
    assert admission.admission_audit(df, limit=0).where("NOT admitted").count() == 0


# --- tickets ------------------------------------------------------------------------------------


def test_dispute_window_does_not_slide_and_existing_tickets_count(spark):
    days = [0, 6, 8, 14, 15]
    data = [(i, T0 + d * DAY, "C-12", 120.0, "Je conteste la facture de mai." if d % 2 else "La facture de mai, je la conteste !") for i, d in enumerate(days)]
    sent = spark.createDataFrame(data, "request_id int, ts timestamp_ntz, resolved_client string, resolved_amount double, q_masked string")
    opened, answers = tickets.automate(sent)
    assert [(r["ticket_id"], r["request_id"]) for r in opened.orderBy("ticket_no").collect()] == [("T-000001", 0), ("T-000002", 2)]
    got = {r["request_id"]: (r["ticket_id"], r["reused"]) for r in answers.collect()}
    assert got == {0: ("T-000001", False), 1: ("T-000001", True), 2: ("T-000002", False), 3: ("T-000002", True), 4: ("T-000002", True)}
    key = opened.first()["dedupe_key"]
    existing = spark.createDataFrame([(90, T0 - 2 * DAY, key, 41)], "request_id int, created_at timestamp_ntz, dedupe_key string, ticket_no int")
    later, answers = tickets.automate(sent, existing)
    assert {r["request_id"]: r["ticket_id"] for r in answers.collect()} == {0: "T-000041", 1: "T-000042", 2: "T-000042", 3: "T-000043", 4: "T-000043"}
    assert min(r["ticket_no"] for r in later.collect()) == 42


def test_other_amount_client_or_words_give_other_keys(spark):
    df = spark.createDataFrame([("C-1", 10.0, ["a", "b"]), ("C-1", 10.0, ["b", "a"]), ("C-1", 10.01, ["a", "b"]), ("C-2", 10.0, ["a", "b"]), ("C-1", 10.0, ["a"])], "c string, a double, t array<string>")
    keys = [r[0] for r in df.select(tickets.dedupe_key(F.col("c"), F.col("a"), F.col("t"))).collect()]
    assert keys[0] == keys[1] and len(set(keys)) == 4


def test_first_decision_wins(spark):
    data = [("x", 3, 1, "rejected", "v3", None), ("x", 1, 1, "approved", "v1", "P1"), ("x", 2, 1, "approved", "v2", "P3"), ("y", 1, 2, "rejected", "w", None), ("ghost", 1, 1, "approved", "z", None)]
    decisions = spark.createDataFrame([(a, T0 + t * DAY, s, d, v, p) for a, t, s, d, v, p in data], "action_id string, ts timestamp_ntz, seq int, decision string, validator string, priority string")
    got = sorted((r["action_id"], r["ts"].day, r["outcome"]) for r in tickets.settle(decisions).collect())
    assert got == [("ghost", 2, "applied"), ("x", 2, "applied"), ("x", 3, "noop"), ("x", 4, "conflict"), ("y", 2, "applied")]
    actions = spark.createDataFrame([("x", "P2"), ("y", "P2"), ("z", "P2")], "action_id string, priority string")
    states = {r["action_id"]: (r["status"], r["ticket_priority"]) for r in tickets.decided_actions(actions, decisions).collect()}
    assert states == {"x": ("approved", "P1"), "y": ("rejected", None), "z": ("pending", None)}
    assert [r["action_id"] for r in tickets.unknown_actions(decisions, actions).collect()] == ["ghost"]


def test_numbers_lookup_and_percentiles(spark):
    rng = np.random.default_rng(4)
    values = [(int(v), i) for i, v in enumerate(rng.integers(0, 50, 300))]
    df = spark.createDataFrame(values, "v int, i int")
    got = sorted((r["n"], r["i"]) for r in ordering.number_rows(df, F.col("v"), F.col("i"), out="n", start=10).collect())
    assert got == [(11 + n, i) for n, (_, i) in enumerate(sorted(values))]
    ranks = ordering.nearest_rank(df, "v", {"p10": 10, "p95": 95}).first()
    ordered = sorted(v for v, _ in values)
    assert (ranks["p10"], ranks["p95"]) == (ordered[29], ordered[284])
    labels = spark.createDataFrame([(" t-000012 ",), ("T-1234567890",), ("12",)], "t string").select(tickets.ticket_number(F.col("t")).alias("n"))
    assert [r["n"] for r in labels.collect()] == [12, None, None]


def test_latest_ticket_before(spark):
    rng = np.random.default_rng(6)
    right = [(int(k), int(t), i) for i, (k, t) in enumerate(zip(rng.integers(0, 4, 80), rng.integers(0, 500, 80)))]
    left = [(int(k), int(t), 1000 + i) for i, (k, t) in enumerate(zip(rng.integers(0, 5, 80), rng.integers(0, 500, 80)))]
    a = spark.createDataFrame(left, "k int, at bigint, q int")
    b = spark.createDataFrame(right, "k int, at bigint, n int")
    got = {r["q"]: r["right_at"] for r in ordering.latest_before(a, b, "k", "at", "n", 60, 25).collect()}
    for k, t, q in left:
        near = [rt for rk, rt, _ in right if rk == k and t - 60 <= rt <= t]
        assert got[q] == (max(near) if near else None)


# --- figures ------------------------------------------------------------------------------------


def test_figures_feedback_and_usage(spark):
    log = spark.createDataFrame(
        [(1, T0, "rag", 100, 0.004, 1, None), (2, T0 + DAY, "human", 300, 0.006, 2, "E"), (3, T0 - DAY, "rag", 5, 0.0, 0, None)],
        "request_id int, ts timestamp_ntz, route string, latency_ms int, cost_eur double, llm_calls int, error string",
    )
    row = operations.operating_metrics(log, log.where("request_id = 1")).first().asDict()
    assert row == {
        "requests": 3, "latency_ms_p50": 100, "latency_ms_p95": 300, "cost_eur_total": 0.01, "cost_eur_avg": 0.003333, "llm_call_share": 0.6667,
        "escalation_rate": 0.3333, "errors": 1, "pending_actions": 1,
    }
    empty = operations.operating_metrics(log.where("false"), log.where("false")).first()
    assert (empty["requests"], empty["latency_ms_p50"], empty["llm_call_share"]) == (0, None, None)
    rated = spark.createDataFrame([(1, True), (3, False), (3, False), (2, True), (99, True)], "request_id int, ok boolean")
    stats = {r["route"]: (r["n"], r["ok"], r["ok_rate"]) for r in operations.feedback_stats(rated, log).collect()}
    assert stats == {None: (4, 2, 0.5), "rag": (3, 1, 0.3333), "human": (1, 1, 1.0)}
    calls = spark.createDataFrame([(1, 1, "m", 10, 5, 0.015), (1, 2, "", 1, 1, 0.009)], "request_id int, seq int, model string, prompt_tokens int, completion_tokens int, cost_eur double")
    used = operations.usage_rollup(calls).first()
    assert (used["llm_calls"], used["prompt_tokens"], used["cost_eur"], used["model"], used["over_budget"]) == (2, 11, 0.024, "m", True)


def test_failed_requests_are_escalated(spark):
    asked = spark.createDataFrame([(1,), (2,), (3,)], "request_id int")
    done = spark.createDataFrame([(1, "rag", "extractive", "ok", None), (2, "agent", "deterministic", "x", "KeyError")], "request_id int, route string, mode string, answer string, error string")
    got = {r["request_id"]: (r["route"], r["mode"], r["error"]) for r in operations.escalate_errors(done, asked).collect()}
    assert got == {1: ("rag", "extractive", None), 2: ("human", "none", "KeyError"), 3: ("human", "none", "NoResponse")}


def test_gate_misses_a_missing_metric(spark):
    metrics = spark.createDataFrame([("a", 0.9), ("b", 1.0), ("c", None)], "metric string, value double")
    bounds = spark.createDataFrame([("a", "min", 0.9), ("b", "max", 0.0), ("c", "min", 0.1), ("d", "max", 1.0)], "metric string, kind string, bound double")
    assert {r["metric"]: r["passed"] for r in evaluation.gate(metrics, bounds).collect()} == {"a": True, "b": False, "c": False, "d": False}


# --- sources and the whole job -------------------------------------------------------------------


CLIENTS = {
    "clients": [
        {"client_id": "C-12", "nom": "Syndic", "formule": "Confort", "date_debut": "2025-01-01", "date_fin": "2028-12-31", "astreinte_weekend": False, "sites": ["Bron"]},
        {"client_id": "C-34", "nom": "Atelier", "formule": "Essentiel", "date_debut": "2024-01-01", "date_fin": "2025-06-30", "astreinte_weekend": False, "sites": []},
    ],
    "sla_heures": {"Confort": {"P1": 4, "P2": 8}, "Essentiel": {"P1": 8}},
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("docs")
    (root / "guide.md").write_text("---\ntitre: Guide des délais\ntype: procedure\n---\n" + TEXT, encoding="utf-8")
    (root / "contrat.TXT").write_text("# Contrat Bron\nLe tarif de nuit est doublé pour Bron.", encoding="utf-8")
    (root / "libre.md").write_text("---\nLe tarif de base est de 89 €.", encoding="utf-8")
    (root / "plan.docx").write_text("x", encoding="utf-8")
    (root / "vide.md").write_text("---\ntitre: Vide\n---\n \n", encoding="utf-8")
    (root / "blanc.txt").write_bytes(b" \n")
    (root / "latin.md").write_bytes("d\xe9lai".encode("latin-1"))
    (root / "manifest.json").write_text(json.dumps({"contrat.TXT": {"client_id": "c-12", "titre": ""}, "absent.pdf": {"titre": "A"}}), encoding="utf-8")
    return root


def test_ingestion_of_a_folder(spark, folder, tmp_path):
    manifest, warnings = handling.ingest_folder(spark, str(folder), str(tmp_path / "index"), {"retrieval_mode": "bm25"})
    assert (manifest.first()["docs"], manifest.first()["retrieval_mode"]) == (3, "bm25") and manifest.first()["created"] is not None
    changed = handling.open_stored(spark, str(tmp_path / "index"), {"retrieval_mode": "hybrid", "backend": "hash"})
    assert changed.mode == "bm25" and changed.vectors is None and "other settings" in changed.warning
    assert sorted((r["doc"], r["reason"]) for r in warnings.collect()) == [
        ("absent.pdf", "manifest entry without file"), ("blanc.txt", "no text"), ("latin.md", "not UTF-8 text"), ("plan.docx", "unsupported file type"), ("vide.md", "no text")
    ]
    chunks = {r["doc"]: (r["title"], r["doc_type"], r["client_id"]) for r in spark.read.parquet(str(tmp_path / "index" / "chunks")).collect()}
    assert chunks == {"guide.md": ("Guide des délais", "procedure", None), "contrat.TXT": ("Contrat Bron", "document", "C-12"), "libre.md": ("libre", "document", None)}


def test_reference_files(spark, tmp_path):
    path = tmp_path / "clients.json"
    path.write_text(json.dumps(CLIENTS), encoding="utf-8")
    clients, sla = ref.read_clients(spark, str(path))
    assert clients.count() == 2 and {(r["formule"], r["priority"], r["hours"]) for r in sla.collect()} == {("Confort", "P1", 4), ("Confort", "P2", 8), ("Essentiel", "P1", 8)}
    assert ref.read_clients(spark, str(tmp_path / "none.json"))[0].count() == 0
    path.write_text('{"clients": [{"client_id": 1', encoding="utf-8")
    with pytest.raises(Exception):  # noqa: B017
        ref.read_clients(spark, str(path))[0].collect()
    bounds = tmp_path / "t.json"
    bounds.write_text('{"min": {"a": 0.5}, "max": {"b": 0}}', encoding="utf-8")
    assert sorted(tuple(r) for r in ref.read_thresholds(spark, str(bounds)).collect()) == [("a", "min", 0.5), ("b", "max", 0.0)]


@pytest.mark.parametrize(("vectors", "stored"), [(False, False), (True, False), (False, True), (True, True)])
def test_every_request_gets_one_response(spark, folder, tmp_path, vectors, stored):
    path = tmp_path / "clients.json"
    path.write_text(json.dumps(CLIENTS), encoding="utf-8")
    clients, sla = ref.read_clients(spark, str(path))
    chunks = chunking.chunk_documents(sd.load_texts(sd.text_files(sd.scan_folder(spark, str(folder))[0]), sd.read_manifest(spark, str(folder / "manifest.json"))))
    now = dt.datetime(2026, 10, 9, 15, 30)  # a Friday, 17:30 in Paris
    asked = [
        (1, "Je conteste la facture de mai, 120 €.", "C-12"), (2, "Quel est le délai P1 de la formule Confort ?", None), (3, "Quel est le tarif de nuit ?", "C-12"),
        (4, "Quel est le tarif de nuit ?", "C-34"), (5, "La pompe est à l'arrêt, appelez le 06 11 22 33 44.", "c-12"), (6, "Mon avocat vous écrira.", "C-12"), (7, "x", None),
    ]
    sent = spark.createDataFrame([(i, now, q, c, None) for i, q, c in asked], "request_id int, ts timestamp, q string, client_id string, montant double")
    if stored:
        settings = {"retrieval_mode": "hybrid" if vectors else "bm25", "backend": "hash"}
        handling.ingest_folder(spark, str(folder), str(tmp_path / "index"), settings)
        chunks = handling.open_stored(spark, str(tmp_path / "index"), settings)
        assert (chunks.mode, chunks.warning) == (settings["retrieval_mode"], None)
    done = handling.handle_requests(sent, clients, sla, chunks, vectors)
    got = {r["request_id"]: r for r in done.responses.collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6]
    assert {i: (r["route"], r["mode"]) for i, r in got.items()} == {
        1: ("automation", "rule"), 2: ("rag", "extractive"), 3: ("rag", "extractive"), 4: ("human", "none"), 5: ("agent", "deterministic"), 6: ("human", "none"),
    }
    assert got[1]["ticket_id"] == "T-000001" and "Formule : Confort ; P1 : 4 h" in got[2]["answer"]
    assert "doublé pour Bron" in got[3]["answer"] and "Bron" not in got[4]["answer"]
    assert "lundi 12/10/2026 à 11 h 30" in got[5]["answer"] and got[5]["pii_types"] == ["TEL"]
    action = done.actions.first()
    assert action["payload"]["subject"] == "Demande d'intervention P1 — C-12" and "[TEL]" in action["payload"]["summary"]
    assert "q" not in done.responses.columns and [r["request_id"] for r in done.quarantine.collect()] == [7]
    cited = {}
    for r in done.citations.collect():
        cited.setdefault(r["request_id"], []).append((r["ref"], r["doc"], r["excerpt"]))
    assert set(cited) == {2, 3} | ({5} if "Documentation consultée" in got[5]["answer"] else set()) and all(0 < len(e) <= 300 for found in cited.values() for _, _, e in found)
    assert {doc for _, doc, _ in cited[3]} == {"contrat.TXT"} and [ref for ref, _, _ in sorted(cited.get(5, []))] == list(range(1, len(cited.get(5, [])) + 1))
    calls = spark.createDataFrame([(2, 1, 100, 10, 0.001, "m"), (2, 2, 50, 5, 0.002, "")], "request_id int, seq int, prompt_tokens int, completion_tokens int, cost_eur double, model string")
    logged = handling.log_rows(done.responses, calls, F.lit(now + dt.timedelta(seconds=2)))
    sinks.append_log(logged, str(tmp_path / "log"))
    rows = {r["request_id"]: r for r in sinks.read_log(spark, str(tmp_path / "log")).collect()}
    assert len(rows) == 6 and {r["latency_ms"] for r in rows.values()} == {2000}
    assert (rows["2"]["llm_calls"], rows["2"]["prompt_tokens"], rows["2"]["cost_eur"], rows["2"]["model"]) == (2, 150, 0.003, "m") and (rows["1"]["llm_calls"], rows["1"]["cost_eur"], rows["1"]["model"]) == (0, 0.0, None)
    assert handling.log_rows(done.responses).where("llm_calls <> 0 or latency_ms < 0").isEmpty()
    with pytest.raises(ValueError, match="columns not in the request log"):
        sinks.append_log(done.responses.withColumn("q", F.lit("raw")), str(tmp_path / "log"))


def test_sources_line_and_wording(spark):
    df = spark.createDataFrame([([(2, "B", ""), (1, "A", "S")],), ([],)], "s array<struct<number:int,title:string,section:string>>")
    assert [r[0] for r in df.select(dossier.sources_line(F.col("s"))).collect()] == [
        "Documentation consultée : A, S [1] ; B [2].", "Aucun extrait de la documentation n'a été trouvé pour cette demande.",
    ]


def test_vector_and_report_sinks(spark, tmp_path):
    vectors = spark.createDataFrame([("a", None, [0.6, 0.8]), ("b", "C-1", [1.0, 0.0])], "chunk_id string, client_id string, embedding array<double>")
    sinks.write_vectors(vectors, str(tmp_path), 2)
    sinks.write_vectors(vectors.where("chunk_id = 'a'"), str(tmp_path), 2)  # replaces all
    assert [r["chunk_id"] for r in spark.read.parquet(str(tmp_path / "vectors")).collect()] == ["a"]
    with pytest.raises(Exception, match="vector size"):
        sinks.write_vectors(vectors, str(tmp_path), 3)
    assert spark.read.parquet(str(tmp_path / "vectors")).count() == 1  # the refused write replaced nothing
    summary = spark.createDataFrame([("all", 1.0)], "split string, routing_accuracy double")
    sinks.write_report(summary, summary, str(tmp_path), "hybrid", with_model=True)
    assert spark.read.json(str(tmp_path / "hybrid-llm" / "summary")).first()["routing_accuracy"] == 1.0
