"""Dispute automation, ticket numbers and lookups, human decisions."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guichet.functions import extraction as ex
from guichet.functions import text as tx
from guichet.functions.masking import mask_pii
from guichet.operators.anchors import anchored_windows, micros
from guichet.operators.ordering import latest_before, number_rows
from guichet.operators.sizing import broadcast_if_small
from guichet.params import DEFAULTS, Params

DAY_US = 86_400_000_000


def ticket_label(number: Column) -> Column:
    return F.format_string("T-%06d", number)


def ticket_number(label: Column) -> Column:
    """Number of a public ticket id (`T-000012`, any case, at most nine digits); NULL when malformed."""
    return F.nullif(F.regexp_extract(tx.trim_all(label), r"(?i)^T-(\d{1,9})$", 1), F.lit("")).cast("int")


def dedupe_key(client_id: Column, amount: Column, tokens: Column) -> Column:
    """Fingerprint of a dispute: same client, amount and words in any order."""
    words = F.array_join(F.array_sort(tokens), " ")
    return F.sha1(F.concat_ws("|", client_id, ex.two_decimals(amount), words).cast("binary"))


def deduplicate(disputes: DataFrame, existing: DataFrame | None = None, params: Params = DEFAULTS) -> DataFrame:
    """Add `ticket_request` (request that opened the ticket), `opened_at` and `reused` to disputes.

    `disputes` carries request_id, ts and dedupe_key. Tickets already open (`existing`: request_id,
    created_at, dedupe_key, ticket_no) take part as earlier anchors and are removed afterwards.
    """
    events = disputes.withColumn("__at", micros(F.col("ts"))).withColumn("__open", F.lit(None).cast("bigint"))
    if existing is not None:
        blank = [F.lit(None).cast(disputes.schema[c].dataType).alias(c) for c in disputes.columns if c not in ("request_id", "ts", "dedupe_key")]
        events = events.unionByName(
            existing.select(
                "request_id", F.col("created_at").alias("ts"), "dedupe_key", *blank,
                micros(F.col("created_at")).alias("__at"), F.col("ticket_no").cast("bigint").alias("__open"),
            )
        )
    width = params.dedupe_days * DAY_US
    found = anchored_windows(events, "dedupe_key", "__at", "request_id", width, params)
    return (
        found.where(F.col("__open").isNull())
        .withColumn("ticket_request", F.col("anchor_id"))
        .withColumn("opened_at", F.timestamp_micros("anchor_at"))
        .withColumn("reused", F.col("request_id") != F.col("anchor_id"))
        .drop("__at", "__open", "anchor_at", "anchor_id")
    )


def automate(
    disputes: DataFrame, existing: DataFrame | None = None, params: Params = DEFAULTS, stem: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(new tickets, one answer per dispute) for requests routed to automation.

    `disputes` carries request_id, ts, resolved_client, resolved_amount and q_masked.
    """
    keyed = disputes.withColumn("__tokens", tx.tokenize(F.col("q_masked"), stem=stem)).withColumn(
        "dedupe_key", dedupe_key(F.col("resolved_client"), F.col("resolved_amount"), F.col("__tokens"))
    ).drop("__tokens")
    linked = deduplicate(keyed, existing, params)
    base = existing.agg(F.coalesce(F.max("ticket_no"), F.lit(0)).alias("b")).first()["b"] if existing is not None else 0
    numbered = number_rows(linked.where(~F.col("reused")), F.col("ts"), F.col("request_id"), out="ticket_no", start=int(base))
    tickets = numbered.select(
        "ticket_no", ticket_label(F.col("ticket_no")).alias("ticket_id"), F.col("resolved_client").alias("client_id"),
        F.concat(F.lit("Litige facturation "), ex.two_decimals(F.col("resolved_amount")), F.lit(" € — "), F.col("resolved_client")).alias("subject"),
        F.col("q_masked").alias("body"), F.lit("litige_standard").alias("kind"), F.lit(None).cast("string").alias("priority"),
        F.lit("automation").alias("source"), F.lit("open").alias("status"), F.col("ts").alias("created_at"),
        F.lit("system:RG-03").alias("created_by"), "request_id", "dedupe_key",
    )
    numbers = tickets.select(F.col("request_id").alias("ticket_request"), "ticket_id")
    if existing is not None:
        numbers = numbers.unionByName(
            existing.select(F.col("request_id").alias("ticket_request"), ticket_label(F.col("ticket_no")).alias("ticket_id"))
        )
    answers = linked.join(numbers, "ticket_request", "left").withColumn("answer", _answer(params))
    return tickets, answers.select("request_id", "ticket_id", "reused", "answer")


def _answer(params: Params) -> Column:
    amount = ex.format_amount(F.col("resolved_amount"))
    threshold = ex.format_amount(F.lit(float(params.dispute_threshold)))
    reused = F.concat(
        F.lit("Cette contestation de "), amount, F.lit(" est déjà enregistrée pour le client "), F.col("resolved_client"),
        F.lit(" : le ticket "), F.col("ticket_id"), F.lit(" existant est réutilisé, aucun nouveau ticket n'est créé (règle RG-03, litige de facturation inférieur à "),
        threshold, F.lit(")."),
    )
    created = F.concat(
        F.lit("Votre contestation de "), amount, F.lit(" est enregistrée : le ticket "), F.col("ticket_id"),
        F.lit(" a été créé pour le client "), F.col("resolved_client"), F.lit(". Un litige de facturation inférieur à "), threshold,
        F.lit(" suit la procédure standard, sans validation préalable (règle RG-03)."),
    )
    return F.when(F.col("reused"), reused).otherwise(created)


def recent_ticket(disputes: DataFrame, tickets: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Latest ticket of the same dedupe key opened within the window before each dispute (NULL when none)."""
    left = disputes.withColumn("at", micros(F.col("ts")))
    right = tickets.withColumn("at", micros(F.col("created_at"))).select("dedupe_key", "at", "ticket_no")
    return latest_before(left, right, "dedupe_key", "at", "ticket_no", params.dedupe_days * DAY_US, DAY_US).drop("at")


def settle(decisions: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Label every decision on an action: `applied` (the first one), `noop` (same again) or `conflict` (opposite).

    The first decision is a `min_by`, combined on the map side, so an action with very many decisions
    is never sorted in one task.
    """
    first = decisions.groupBy("action_id").agg(
        F.min_by(F.struct("decision", "ts", "seq"), F.struct("ts", "seq")).alias("first")
    )
    applied = (F.col("ts") == F.col("first.ts")) & (F.col("seq") == F.col("first.seq"))
    return (
        decisions.join(broadcast_if_small(first, params), "action_id")
        .withColumn(
            "outcome",
            F.when(applied, "applied").when(F.col("decision") == F.col("first.decision"), "noop").otherwise("conflict"),
        )
        .withColumn("status", F.col("first.decision"))
        .drop("first")
    )


def decided_actions(actions: DataFrame, decisions: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """State of every action; an approved one carries the priority of its ticket (the validator's wins)."""
    winner = decisions.groupBy("action_id").agg(
        F.min_by(F.struct("decision", "validator", "priority", "ts"), F.struct("ts", "seq")).alias("w")
    )
    return (
        actions.join(broadcast_if_small(winner, params), "action_id", "left")
        .withColumn("status", F.coalesce("w.decision", F.lit("pending")))
        .withColumn("decided_by", F.col("w.validator"))
        .withColumn("decided_at", F.col("w.ts"))
        .withColumn("ticket_priority", F.when(F.col("status") == "approved", F.coalesce("w.priority", "priority")))
        .drop("w")
    )


def unknown_actions(decisions: DataFrame, actions: DataFrame) -> DataFrame:
    """Decisions on an action that does not exist."""
    return decisions.join(actions.select("action_id"), "action_id", "left_anti")


def link_tickets(actions: DataFrame, tickets: DataFrame) -> DataFrame:
    """Action with its ticket by public id; a malformed or unknown id gives NULL."""
    return actions.withColumn("ticket_no", ticket_number(F.col("ticket_id"))).join(tickets, "ticket_no", "left")


def proposals(dossiers: DataFrame) -> DataFrame:
    """Pending action of every dossier (request_id, subject, summary, priority, client_id), masked once more."""
    single = dossiers.withColumn("__subject", tx.squeeze(F.col("subject"))).withColumn("__summary", tx.trim_all(F.col("summary")))
    masked = mask_pii(mask_pii(single, "__subject", "subject", "__t1"), "__summary", "summary", "__t2")
    return masked.select(
        F.concat(F.lit("A-"), F.substring(F.sha1(F.col("request_id").cast("string").cast("binary")), 1, 12)).alias("action_id"),
        "request_id", F.lit("create_ticket").alias("type"), F.lit("pending").alias("status"),
        F.struct("subject", "summary", "priority", "client_id").alias("payload"),
    )


def approved_tickets(actions: DataFrame, decisions: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Ticket rows, still without number, of the approved actions (action_id, request_id, payload).

    The validator's priority, where given, replaces the proposed one; the free-text reason is masked. Decisions on unknown
    actions make no ticket.
    """
    proposed = actions.select("action_id", "request_id", F.col("payload.*"))
    winner = decisions.groupBy("action_id").agg(
        F.min_by(F.struct("decision", "validator", F.col("priority").alias("chosen"), "reason", "ts"), F.struct("ts", "seq")).alias("w")
    )
    won = proposed.join(broadcast_if_small(winner, params), "action_id").where(F.col("w.decision") == "approved")
    rows = won.select(
        "action_id", "request_id", "client_id", "subject", F.col("summary").alias("body"), F.lit("intervention").alias("kind"),
        F.coalesce("w.chosen", "priority").alias("priority"), F.lit("agent").alias("source"), F.col("w.validator").alias("created_by"),
        F.col("w.ts").alias("created_at"), F.col("w.reason").alias("__reason"),
    )
    return mask_pii(rows, "__reason", "reason", "__types").drop("__reason", "__types")


def merge_tickets(rows: DataFrame, folder: str, key: str = "action_id", buckets: int = 64) -> DataFrame:
    """Add the tickets that are not there yet to the table in `folder`, numbered on in order of creation; returns the table.

    The table is partitioned by a hash of the key, and only partitions with new tickets are written, whole: repeating a
    merge, or one that was cut short, adds nothing twice. One merge at a time.
    """
    spark = rows.sparkSession
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    wanted = rows.withColumn("bucket", bucket)
    held = None
    try:
        held = spark.read.parquet(folder)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    fresh = wanted if held is None else wanted.join(held.select(key, "bucket"), [key, "bucket"], "left_anti")
    last = 0 if held is None else held.agg(F.coalesce(F.max("ticket_no"), F.lit(0))).first()[0]
    numbered = number_rows(fresh.dropDuplicates([key]), F.col("created_at"), F.col(key), out="ticket_no", start=last)
    numbered = numbered.withColumn("ticket_id", ticket_label(F.col("ticket_no"))).checkpoint()
    merged = numbered
    if held is not None:
        changed = numbered.select("bucket").distinct()
        merged = numbered.unionByName(held.join(F.broadcast(changed), "bucket", "left_semi")).checkpoint()  # at most `buckets` rows
    if held is None or not numbered.isEmpty():
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)
    return spark.read.schema(merged.schema).parquet(folder)
