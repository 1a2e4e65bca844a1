"""Operating queries: `events` as the request log, `labels` as feedback, `orders`/`customer` as tickets and clients."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from guichet.functions import calendar as cal
from guichet.operators import admission, dossier, operations, tickets
from guichet.operators.ordering import nearest_rank, number_rows
from guichet.plans.catalog import query
from guichet.session import checkpoint_root
from guichet.sources.tables import spread, table

_TS = "%Y-%m-%d %H:%M:%S.%f"


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def request_log(spark: SparkSession, sf: str, events: DataFrame | None = None) -> DataFrame:
    """Events as logged requests: the type is the route, the value the latency in ms."""
    kind = F.col("event_type")
    return (table(spark, sf, "events") if events is None else events).select(
        F.col("event_id").alias("request_id"), "ts", F.when(kind == "error", "human").otherwise(kind).alias("route"),
        F.when(kind.isin("click", "view"), "rule").otherwise("llm").alias("mode"),
        F.floor("value").cast("int").alias("latency_ms"), (F.col("value") / 1000).alias("cost_eur"),
        F.when(kind.isin("click", "view"), 0).otherwise(1).alias("llm_calls"),
        F.when(kind == "error", "RuntimeError").alias("error"),
    )


_LOG = """log AS (SELECT event_id, ts, CASE WHEN event_type = 'error' THEN 'human' ELSE event_type END AS route,
  CASE WHEN event_type IN ('click', 'view') THEN 'rule' ELSE 'llm' END AS mode, floor(value)::INTEGER AS latency_ms,
  value / 1000 AS cost_eur, event_type IN ('click', 'view') AS free, event_type = 'error' AS failed FROM events),
recent AS (SELECT * FROM log)"""


@query(
    "ops_metrics",
    f"""WITH {_LOG} SELECT count(*) AS requests, quantile_disc(latency_ms, 0.5)::BIGINT AS latency_ms_p50,
    quantile_disc(latency_ms, 0.95)::BIGINT AS latency_ms_p95, round(sum(cost_eur), 6) AS cost_eur_total,
    round(avg(cost_eur), 6) AS cost_eur_avg, round(sum((NOT free)::INT) / count(*), 4) AS llm_call_share,
    round(sum((route = 'human')::INT) / count(*), 4) AS escalation_rate, sum(failed::INT)::BIGINT AS errors,
    (SELECT count(*) FROM events WHERE event_type = 'signup') AS pending_actions FROM recent""",
)
def ops_metrics(spark: SparkSession, sf: str) -> DataFrame:
    pending = table(spark, sf, "events").where(F.col("event_type") == "signup")
    return operations.operating_metrics(request_log(spark, sf), pending, tie="request_id")


@query(
    "ops_counts",
    f"""WITH {_LOG} SELECT 'all' AS dimension, NULL::VARCHAR AS value, count(*) AS n FROM recent
    UNION ALL SELECT 'route', route, count(*) FROM recent GROUP BY route
    UNION ALL SELECT 'mode', mode, count(*) FROM recent GROUP BY mode""",
)
def ops_counts(spark: SparkSession, sf: str) -> DataFrame:
    return operations.counts_by(request_log(spark, sf), "route", "mode", tie="request_id")


@query(
    "latency_by_route",
    f"""WITH {_LOG} SELECT route, quantile_disc(latency_ms, 0.1) AS p10, quantile_disc(latency_ms, 0.5) AS p50,
    quantile_disc(latency_ms, 0.95) AS p95 FROM log GROUP BY route""",
)
def latency_by_route(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest-rank percentiles over every request, per route."""
    return nearest_rank(request_log(spark, sf), "latency_ms", {"p10": 10, "p50": 50, "p95": 95}, "route")


def feedback(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").select(
        F.col("doc_id").alias("request_id"), (F.col("quality") == 1).alias("ok"),
        F.concat(F.lit("toxic="), F.col("toxic").cast("string")).alias("comment"), F.col("doc_id").alias("ts"),
    )


def rated_log(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("request_id"), F.col("lang").alias("route"), F.lit("extractive").alias("mode"),
        F.col("text").alias("q_masked"), F.col("source").alias("client_id"),
    )


@query(
    "feedback_by_route",
    """SELECT lang AS route, count(*) AS n, sum(quality)::BIGINT AS ok, round(sum(quality) / count(*), 4) AS ok_rate
    FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (lang)""",
)
def feedback_by_route(spark: SparkSession, sf: str) -> DataFrame:
    return operations.feedback_stats(feedback(spark, sf), rated_log(spark, sf))


@query(
    "feedback_orphans",
    """SELECT 'refused' AS side, doc_id AS request_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
    UNION ALL SELECT 'unrated', doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def feedback_orphans(spark: SparkSession, sf: str) -> DataFrame:
    rated, log = feedback(spark, sf), rated_log(spark, sf)
    _, refused = operations.split_feedback(rated, log)
    unrated = log.join(rated.select("request_id"), "request_id", "left_anti")
    return refused.select(F.lit("refused").alias("side"), "request_id").unionByName(unrated.select(F.lit("unrated").alias("side"), "request_id"))


@query(
    "ko_candidates",
    """SELECT doc_id AS request_id, text AS q, source AS client_id, lang AS observed_route, 'extractive' AS observed_mode,
    'toxic=' || toxic AS handler_comment, NULL::VARCHAR AS expected_route,
    'À compléter par un gestionnaire avant ajout au jeu de référence.' AS note
    FROM labels JOIN documents USING (doc_id) WHERE quality = 0""",
)
def ko_candidates(spark: SparkSession, sf: str) -> DataFrame:
    cases = operations.candidate_cases(feedback(spark, sf), rated_log(spark, sf))
    return cases.select(
        "request_id", F.col("input.q").alias("q"), F.col("input.client_id").alias("client_id"), "observed_route", "observed_mode",
        "handler_comment", "expected_route", "note",
    )


@query(
    "usage_rollup",
    """SELECT conv_id AS request_id, count(*) AS llm_calls, sum(CASE WHEN role = 'assistant' THEN 0 ELSE length(text) END)::BIGINT AS prompt_tokens,
    sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS completion_tokens,
    round(sum(length(text)) * 0.00001, 6) AS cost_eur, arg_max(role, turn) AS model, round(sum(length(text)) * 0.00001, 6) > 0.02 AS over_budget
    FROM conversations GROUP BY conv_id""",
)
def usage_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of a conversation as model calls, priced by their length."""
    size = F.char_length("text")
    calls = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("request_id"), F.col("turn").alias("seq"), F.col("role").alias("model"),
        F.when(F.col("role") == "assistant", 0).otherwise(size).alias("prompt_tokens"),
        F.when(F.col("role") == "assistant", size).otherwise(0).alias("completion_tokens"), (size * 0.00001).alias("cost_eur"),
    )
    return operations.usage_rollup(calls)


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Clicks approve and views reject the action of their user."""
    kind = F.col("event_type")
    return table(spark, sf, "events").where(kind.isin("click", "view")).select(
        F.col("user_id").alias("action_id"), "ts", F.col("event_id").alias("seq"),
        F.when(kind == "click", "approved").otherwise("rejected").alias("decision"),
        F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("validator"), F.when(F.col("value") > 50, "P1").alias("priority"),
    )


_DECISIONS = """decisions AS (SELECT user_id AS action_id, ts, event_id AS seq, CASE event_type WHEN 'click' THEN 'approved' ELSE 'rejected' END AS decision,
  'v' || event_id AS validator, CASE WHEN value > 50 THEN 'P1' END AS priority FROM events WHERE event_type IN ('click', 'view')),
ordered AS (SELECT *, row_number() OVER (PARTITION BY action_id ORDER BY ts, seq) AS rn,
  first_value(decision) OVER (PARTITION BY action_id ORDER BY ts, seq) AS status FROM decisions)"""


@query(
    "decisions_first_wins",
    f"""WITH {_DECISIONS} SELECT action_id, seq, decision, status,
    CASE WHEN rn = 1 THEN 'applied' WHEN decision = status THEN 'noop' ELSE 'conflict' END AS outcome FROM ordered""",
)
def decisions_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    return tickets.settle(decisions(spark, sf)).select("action_id", "seq", "decision", "status", "outcome")


@query(
    "action_states",
    f"""WITH {_DECISIONS} SELECT c_custkey AS action_id, coalesce(w.decision, 'pending') AS status, w.validator AS decided_by,
    CASE WHEN w.decision = 'approved' THEN coalesce(w.priority, 'P2') END AS ticket_priority
    FROM customer LEFT JOIN (SELECT * FROM ordered WHERE rn = 1) w ON w.action_id = c_custkey""",
)
def action_states(spark: SparkSession, sf: str) -> DataFrame:
    """One proposed action per customer, decided by the events of the same number."""
    actions = table(spark, sf, "customer").select(F.col("c_custkey").alias("action_id"), F.lit("P2").alias("priority"))
    return tickets.decided_actions(actions, decisions(spark, sf)).select("action_id", "status", "decided_by", "ticket_priority")


@query(
    "approved_tickets",
    f"""WITH {_DECISIONS} SELECT c_custkey AS action_id, printf('T-%06d', row_number() OVER (ORDER BY ts, c_custkey)) AS ticket_id, 'C-' || c_custkey AS client_id,
    'Intervention ' || c_name AS subject, 'intervention' AS kind, coalesce(priority, 'P2') AS priority, validator AS created_by,
    'appeler le [TEL]' AS reason FROM customer JOIN ordered ON rn = 1 AND action_id = c_custkey WHERE decision = 'approved'""",
)
def approved_tickets(spark: SparkSession, sf: str) -> DataFrame:
    """Tickets of the approved actions, merged twice: once for the decisions of the first half of the time, once for all."""
    name = F.concat(F.lit("Intervention "), F.col("c_name"))
    payload = F.struct(name.alias("subject"), F.lit("Voir le dossier").alias("summary"), F.lit("P2").alias("priority"), F.concat(F.lit("C-"), F.col("c_custkey").cast("string")).alias("client_id"))
    actions = table(spark, sf, "customer").select(F.col("c_custkey").alias("action_id"), F.col("c_custkey").alias("request_id"), payload.alias("payload"))
    said = decisions(spark, sf).withColumn("reason", F.lit("appeler le 06 11 22 33 44"))
    bounds = said.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    early = said.where(F.col("ts") < F.lit(bounds["a"] + (bounds["b"] - bounds["a"]) / 2))
    folder = f"{checkpoint_root(spark)}/tickets-{uuid.uuid4().hex}"
    tickets.merge_tickets(tickets.approved_tickets(actions, early), folder)
    merged = tickets.merge_tickets(tickets.approved_tickets(actions, said), folder)
    return merged.select("action_id", "ticket_id", "client_id", "subject", "kind", "priority", "created_by", "reason")


_NUMBERED = "numbered AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS n FROM orders)"


def numbered_orders(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    return number_rows(rows, F.col("o_orderdate"), F.col("o_orderkey"), out="ticket_no")


@query("ticket_numbers", f"WITH {_NUMBERED} SELECT o_orderkey, printf('T-%06d', n) AS ticket_id FROM numbered")
def ticket_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return numbered_orders(spark, sf).select("o_orderkey", tickets.ticket_label(F.col("ticket_no")).alias("ticket_id"))


@query(
    "tickets_latest",
    f"""WITH {_NUMBERED} SELECT printf('T-%06d', n) AS ticket_id, o_orderkey FROM numbered
    WHERE o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '1995-01-01' ORDER BY n DESC LIMIT 50""",
)
def tickets_latest(spark: SparkSession, sf: str) -> DataFrame:
    """Newest open tickets since a date: the listing is a top-k."""
    rows = numbered_orders(spark, sf).withColumnRenamed("o_orderstatus", "status")
    newest = operations.listing(rows, F.col("ticket_no"), 50, F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz"), "O")
    return newest.select(tickets.ticket_label(F.col("ticket_no")).alias("ticket_id"), "o_orderkey")


@query(
    "ticket_links",
    f"""WITH {_NUMBERED}, asked AS (SELECT c_custkey AS action_id, CASE WHEN c_mktsegment = 'BUILDING' THEN c_name
      WHEN c_mktsegment = 'MACHINERY' THEN ' t-' || (c_custkey + 1) || ' ' ELSE printf('T-%06d', c_custkey * 7) END AS ticket_id FROM customer),
    parsed AS (SELECT action_id, try_cast(nullif(regexp_extract(trim(ticket_id), '(?i)^T-([0-9]{{1,9}})$', 1), '') AS INTEGER) AS k FROM asked)
    SELECT action_id, k AS ticket_no, o_orderkey FROM parsed LEFT JOIN numbered ON n = k""",
)
def ticket_links(spark: SparkSession, sf: str) -> DataFrame:
    key, segment = F.col("c_custkey"), F.col("c_mktsegment")
    actions = table(spark, sf, "customer").select(
        key.alias("action_id"),
        F.when(segment == "BUILDING", F.col("c_name"))
        .when(segment == "MACHINERY", F.concat(F.lit(" t-"), (key + 1).cast("string"), F.lit(" ")))
        .otherwise(tickets.ticket_label(key * 7)).alias("ticket_id"),
    )
    rows = numbered_orders(spark, sf).select(F.col("ticket_no").cast("int").alias("ticket_no"), "o_orderkey")
    return tickets.link_tickets(actions, rows).select("action_id", "ticket_no", "o_orderkey")


def disputes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_id").alias("request_id"), "ts",
        F.sha1(F.concat_ws("|", F.col("user_id").cast("string"), "event_type").cast("binary")).alias("dedupe_key"),
    )


_DEDUPE = """WITH RECURSIVE ev AS (SELECT event_id, ts, sha1(user_id || '|' || event_type) AS k FROM events),
anchors AS (
  SELECT k, min((ts, event_id)) AS a FROM ev GROUP BY k
  UNION ALL
  SELECT k, a FROM (SELECT e.k, min((e.ts, e.event_id)) AS a FROM anchors p JOIN ev e ON e.k = p.k AND e.ts > p.a[1] + INTERVAL 7 DAY GROUP BY e.k, p.a)),
linked AS (SELECT e.event_id, e.k, max(a) AS a FROM ev e JOIN anchors USING (k) WHERE (e.ts, e.event_id) >= a GROUP BY e.event_id, e.k)
SELECT event_id AS request_id, k AS dedupe_key, a[2] AS ticket_request, event_id <> a[2] AS reused FROM linked"""


@query("dispute_dedupe", _DEDUPE)
def dispute_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return tickets.deduplicate(disputes(spark, sf)).select("request_id", "dedupe_key", "ticket_request", "reused")


@query(
    "recent_ticket",
    """WITH d AS (SELECT event_id, ts, user_id FROM events WHERE event_type = 'error'),
    t AS (SELECT event_id AS ticket_no, ts, user_id FROM events WHERE event_type = 'purchase')
    SELECT d.event_id AS request_id, max(ticket_no) AS ticket_no FROM d LEFT JOIN t
    ON t.user_id = d.user_id AND t.ts <= d.ts AND t.ts >= d.ts - INTERVAL 7 DAY GROUP BY d.event_id""",
)
def recent_ticket(spark: SparkSession, sf: str) -> DataFrame:
    """Disputes (errors) looked up in the tickets already open (purchases) of the same user."""
    events = table(spark, sf, "events")
    key = F.col("user_id").cast("string").alias("dedupe_key")
    asked = events.where(F.col("event_type") == "error").select(F.col("event_id").alias("request_id"), "ts", key)
    opened = events.where(F.col("event_type") == "purchase").select(F.col("event_id").alias("ticket_no"), F.col("ts").alias("created_at"), key)
    return tickets.recent_ticket(asked, opened).select("request_id", "ticket_no")


_ADMISSION = """WITH RECURSIVE ev AS (SELECT user_id, ts, event_id FROM events),
opens AS (
  SELECT user_id, min(ts) AS o FROM ev GROUP BY user_id
  UNION ALL
  SELECT user_id, o FROM (SELECT e.user_id, min(e.ts) AS o FROM opens p JOIN ev e ON e.user_id = p.user_id AND e.ts >= p.o + INTERVAL 1 DAY GROUP BY e.user_id, p.o)),
placed AS (SELECT e.user_id, e.event_id, e.ts, max(o) AS o FROM ev e JOIN opens USING (user_id) WHERE o <= e.ts GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id, o ORDER BY ts, event_id) AS position FROM placed)
SELECT event_id, position, position <= 3 AS admitted, CASE WHEN position > 3 THEN
  greatest(1, ceil((epoch_us(o) + 86400000000 - epoch_us(ts)) / 1000000))::BIGINT END AS retry_after_s FROM ranked"""


@query("admission_audit", _ADMISSION)
def admission_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Three requests a day per user; the day starts with the user's first request."""
    rows = table(spark, sf, "events").select(F.col("user_id").alias("caller"), "ts", F.col("event_id").alias("seq"))
    audit = admission.admission_audit(rows, limit=3, window_s=86_400, windows_per_slice=8)
    return audit.select(F.col("seq").alias("event_id"), F.col("position").cast("bigint").alias("position"), "admitted", "retry_after_s")


def contracts(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as clients: the contract runs from the first order to a year after the last one."""
    span = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.min("o_orderdate").cast("date").alias("date_debut"), F.max("o_orderdate").cast("date").alias("last")
    )
    plan = F.when(F.col("c_mktsegment") == "BUILDING", "Premium").when(F.col("c_mktsegment") == "MACHINERY", "Confort").otherwise("Essentiel")
    return table(spark, sf, "customer").join(span, F.col("c_custkey") == F.col("o_custkey")).select(
        F.concat(F.lit("C-"), F.col("c_custkey").cast("string")).alias("client_id"), F.col("c_name").alias("nom"), plan.alias("formule"),
        "date_debut", F.date_add("last", -700).alias("date_fin"), (F.col("c_acctbal") > 5000).alias("astreinte_weekend"),
        F.array(F.lit("Siège")).alias("sites"), "c_custkey",
    )


_CONTRACTS = """contracts AS (SELECT c_custkey, 'C-' || c_custkey AS client_id, c_name AS nom,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'Premium' WHEN 'MACHINERY' THEN 'Confort' ELSE 'Essentiel' END AS formule,
  min(o_orderdate)::DATE AS date_debut, max(o_orderdate)::DATE - 700 AS date_fin, any_value(c_acctbal) > 5000 AS always_on
  FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name, c_mktsegment)"""


def _status_sql(day: str) -> str:
    return f"""CASE WHEN {day} BETWEEN date_debut AND date_fin THEN 'contrat actif'
    WHEN {day} > date_fin THEN 'contrat échu (fin de validité le ' || strftime(date_fin, '%d/%m/%Y') || ')'
    ELSE 'contrat non encore en vigueur (début le ' || strftime(date_debut, '%d/%m/%Y') || ')' END"""


@query("contract_status", f"WITH {_CONTRACTS} SELECT client_id, formule, {_status_sql('DATE ' + chr(39) + '1998-01-01' + chr(39))} AS status FROM contracts")
def contract_status(spark: SparkSession, sf: str) -> DataFrame:
    day = F.lit("1998-01-01").cast("date")
    return contracts(spark, sf).select("client_id", "formule", cal.contract_status(day, F.col("date_debut"), F.col("date_fin")).alias("status"))


_SLA_ROWS = [(plan, priority, hours) for plan, row in (("Premium", (2, 4, 24)), ("Confort", (4, 8, 48)), ("Essentiel", (8, 24, 72))) for priority, hours in zip(("P1", "P2", "P3"), row)]
_SLA = "sla(formule, priority, hours) AS (VALUES " + ", ".join(f"('{p}', '{r}', {h})" for p, r, h in _SLA_ROWS) + ")"
# Business days numbered from a calendar: the deadline is an index into it.
_CALENDAR = """days AS (SELECT d::DATE AS d, row_number() OVER (ORDER BY d) - 1 AS i FROM generate_series(TIMESTAMP '2023-12-25', TIMESTAMP '2024-06-30', INTERVAL 1 DAY) g(d) WHERE isodow(d) < 6)"""


def _deadline_sql(source: str) -> str:
    """CTE `due` (all columns of `source` plus deadline) from columns ts_local, hours, always_on."""
    return f"""{_CALENDAR},
begun AS (SELECT s.*, epoch_us(ts_local) - epoch_us(date_trunc('day', ts_local)) AS us FROM {source} s),
opened AS (SELECT b.*, (SELECT min(i) FROM days WHERE d > ts_local::DATE OR (d = ts_local::DATE AND us < 64800000000)) AS i,
  (SELECT count(*) FROM days WHERE d = ts_local::DATE AND us >= 28800000000 AND us < 64800000000) AS inside FROM begun b),
spent AS (SELECT *, CASE WHEN inside = 1 THEN us - 28800000000 ELSE 0 END + hours::BIGINT * 3600000000 AS total FROM opened),
due AS (SELECT s.*, CASE WHEN always_on THEN ts_local + to_hours(hours)
  ELSE (SELECT d::TIMESTAMP FROM days WHERE i = s.i + greatest((total + 35999999999) // 36000000000 - 1, 0)) + INTERVAL 8 HOUR
       + to_microseconds(total - 36000000000 * greatest((total + 35999999999) // 36000000000 - 1, 0)) END AS deadline FROM spent s)"""


def sla_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_SLA_ROWS, "formule string, priority string, hours int")


_EVENT_SLA = f"""{_SLA}, asks AS (SELECT event_id, ts AS ts_local, hours, event_type = 'view' AS always_on FROM events JOIN sla
  ON formule = CASE WHEN value < 20 THEN 'Premium' WHEN value < 60 THEN 'Confort' ELSE 'Essentiel' END
  AND priority = CASE WHEN event_type = 'error' THEN 'P1' WHEN event_type = 'click' THEN 'P2' ELSE 'P3' END)"""


@query("sla_deadlines", f"WITH {_EVENT_SLA}, {_deadline_sql('asks')} SELECT event_id, hours, strftime(deadline, '{_TS}') AS deadline FROM due")
def sla_deadlines(spark: SparkSession, sf: str) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    asks = table(spark, sf, "events").select(
        "event_id", "ts", kind,
        F.when(value < 20, "Premium").when(value < 60, "Confort").otherwise("Essentiel").alias("formule"),
        F.when(kind == "error", "P1").when(kind == "click", "P2").otherwise("P3").alias("priority"),
    )
    joined = asks.join(F.broadcast(sla_table(spark)), ["formule", "priority"])  # nine rows
    return joined.select("event_id", "hours", stamp(cal.sla_deadline(F.col("ts"), F.col("hours"), kind == "view")).alias("deadline"))


_ASK_TEXT = {
    "error": "Arrêt complet de la chaufferie, c'est urgent.",
    "click": "Rien d'urgent, merci de planifier une visite.",
    "view": "La ventilation est en arrêt.",
    "purchase": "Merci de planifier le remplacement du circulateur.",
    "signup": "Danger : odeur anormale près du brûleur.",
}
_WEEKDAY_SQL = "['lundi','mardi','mercredi','jeudi','vendredi','samedi','dimanche'][isodow({0})] || ' ' || strftime({0}, '%d/%m/%Y') || ' à ' || hour({0}) || ' h ' || strftime({0}, '%M')"


def dossiers(spark: SparkSession, sf: str) -> DataFrame:
    """Every event asks something about the customer of its user number, in the words of its type."""
    texts = F.create_map(*[F.lit(x) for pair in _ASK_TEXT.items() for x in pair])
    return spread(table(spark, sf, "events")).select(
        F.col("event_id").alias("request_id"), F.expr("ts + INTERVAL '20' HOUR").alias("now_local"), texts[F.col("event_type")].alias("q_masked"),
        F.when(F.col("event_type") != "signup", F.concat(F.lit("C-"), F.col("user_id").cast("string"))).alias("scoped_client"),
    )


def _current_contracts(spark: SparkSession, sf: str) -> DataFrame:
    """Contracts moved to the years of the events."""
    shift = F.lit(9 * 366)
    return contracts(spark, sf).withColumn("date_debut", F.date_add("date_debut", shift)).withColumn("date_fin", F.date_add("date_fin", shift))


_DOSSIER = f"""{_CONTRACTS}, {_SLA},
moved AS (SELECT * REPLACE (date_debut + 3294 AS date_debut, date_fin + 3294 AS date_fin) FROM contracts),
asked AS (SELECT event_id, ts + INTERVAL 20 HOUR AS ts_local, event_type, CASE WHEN event_type IN ('error', 'view', 'signup') THEN 'P1' ELSE 'P2' END AS priority,
  CASE WHEN event_type <> 'signup' THEN user_id END AS user_id FROM events),
facts AS (SELECT event_id, ts_local, a.priority, m.*, {_status_sql('ts_local::DATE')} AS status, ts_local::DATE BETWEEN date_debut AND date_fin AS active, hours
  FROM asked a LEFT JOIN moved m ON m.c_custkey = a.user_id LEFT JOIN sla s ON s.formule = m.formule AND s.priority = a.priority)"""


@query(
    "dossier_facts",
    f"""WITH {_DOSSIER}, {_deadline_sql('facts')} SELECT event_id AS request_id, priority, client_id,
    CASE WHEN client_id IS NOT NULL THEN status END AS status,
    CASE WHEN client_id IS NULL THEN 'Client non identifié : aucun délai contractuel ne s''applique. Un devis préalable est nécessaire avant toute intervention.'
    WHEN NOT active THEN 'Aucun délai garanti ne s''applique : ' || status || '. Un devis préalable est nécessaire avant toute intervention.'
    ELSE 'Formule ' || formule || ', priorité ' || priority || ' : délai contractuel d''intervention de ' || hours ||
      CASE WHEN always_on THEN ' h (astreinte incluse : décompte 24 h/24 et 7 j/7)' ELSE ' h ouvrées (du lundi au vendredi, de 8 h à 18 h)' END ||
      '. Pour une demande prise en compte le ' || {_WEEKDAY_SQL.format('ts_local')} || ', intervention au plus tard le ' || {_WEEKDAY_SQL.format('deadline')} || '.' END AS deadline_text,
    'Demande d''intervention ' || priority || ' — ' || coalesce(client_id, 'client non identifié') AS subject FROM due""",
)
def dossier_facts(spark: SparkSession, sf: str) -> DataFrame:
    from guichet.operators.triage import guess_priority

    asked = dossiers(spark, sf).withColumn("priority", guess_priority(F.col("q_masked")))
    facts = dossier.with_deadline(dossier.with_contract(asked, _current_contracts(spark, sf), sla_table(spark)))
    return facts.select(
        "request_id", "priority", F.col("contract_client").alias("client_id"), "status", dossier.deadline_text().alias("deadline_text"),
        F.concat(F.lit("Demande d'intervention "), F.col("priority"), F.lit(" — "), F.coalesce("contract_client", F.lit("client non identifié"))).alias("subject"),
    )


@query(
    "automation_tickets",
    """WITH RECURSIVE d AS (SELECT o_orderkey, o_orderdate AS ts, 'C-' || o_custkey AS c, round(o_totalprice / 5000) * 5 AS a FROM orders),
    kept AS (SELECT *, c || '|' || printf('%.2f', a) AS k FROM d WHERE a > 0 AND a < 500),
    anchors AS (SELECT k, min((ts, o_orderkey)) AS x FROM kept GROUP BY k
      UNION ALL SELECT k, x FROM (SELECT e.k, min((e.ts, e.o_orderkey)) AS x FROM anchors p JOIN kept e ON e.k = p.k AND e.ts > p.x[1] + INTERVAL 7 DAY GROUP BY e.k, p.x)),
    opened AS (SELECT k, x, row_number() OVER (ORDER BY x) AS n FROM anchors),
    linked AS (SELECT o_orderkey, any_value(e.c) AS c, any_value(e.a) AS a, max((x, n)) AS t FROM kept e JOIN opened o ON o.k = e.k AND (e.ts, e.o_orderkey) >= o.x GROUP BY o_orderkey)
    SELECT o_orderkey AS request_id, printf('T-%06d', t[2]) AS ticket_id, o_orderkey <> t[1][2] AS reused,
    CASE WHEN o_orderkey <> t[1][2] THEN 'Cette contestation de ' || replace(printf('%.2f', a), '.', ',') || ' € est déjà enregistrée pour le client ' || c || ' : le ticket ' || printf('T-%06d', t[2]) ||
      ' existant est réutilisé, aucun nouveau ticket n''est créé (règle RG-03, litige de facturation inférieur à 500,00 €).'
    ELSE 'Votre contestation de ' || replace(printf('%.2f', a), '.', ',') || ' € est enregistrée : le ticket ' || printf('T-%06d', t[2]) || ' a été créé pour le client ' || c ||
      '. Un litige de facturation inférieur à 500,00 € suit la procédure standard, sans validation préalable (règle RG-03).' END AS answer FROM linked""",
)
def automation_tickets(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as small disputes of their customer, worded in two orders that share one fingerprint."""
    amount = F.round(F.col("o_totalprice") / 5000) * 5
    sent = spread(table(spark, sf, "orders")).select(
        F.col("o_orderkey").alias("request_id"), F.col("o_orderdate").alias("ts"), F.concat(F.lit("C-"), F.col("o_custkey").cast("string")).alias("resolved_client"),
        amount.alias("resolved_amount"),
        F.when(F.col("o_orderstatus") == "O", "Je conteste la facture du mois dernier.").otherwise("La facture du mois dernier, je la conteste !").alias("q_masked"),
    ).where((F.col("resolved_amount") > 0) & (F.col("resolved_amount") < 500))
    _, answers = tickets.automate(sent, stem=False)
    return answers.select("request_id", "ticket_id", "reused", "answer")


