"""Dossier facts for requests routed to the agent: contract, SLA deadline, priority, draft and proposed ticket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guichet.functions import calendar as cal
from guichet.operators.sizing import broadcast_if_small
from guichet.operators.triage import client_key, guess_priority, own_key
from guichet.params import DEFAULTS, Params

# Wording of the drafts.
PRIORITY_LABELS = {"P1": "critique", "P2": "majeure", "P3": "mineure"}
_QUOTATION = "Un devis préalable est nécessaire avant toute intervention."


def with_contract(dossiers: DataFrame, clients: DataFrame, sla: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Join the contract of the scoped client, its status on the day, and the SLA hours of (plan, priority)."""
    contract = clients.select(
        client_key(F.col("client_id")).alias("__client"), F.col("client_id").alias("contract_client"),
        "nom", "formule", "date_debut", "date_fin", "astreinte_weekend", "sites",
    )
    hours = sla.select(
        client_key(F.col("formule")).alias("__plan"), client_key(F.col("priority")).alias("__priority"), F.col("hours").alias("sla_hours")
    )
    return (
        dossiers.withColumn("__client", own_key(client_key(F.col("scoped_client")), F.col("request_id")))
        .join(broadcast_if_small(contract, params), "__client", "left")
        .withColumn("__plan", client_key(F.col("formule")))
        .withColumn("__priority", client_key(F.col("priority")))
        .join(broadcast_if_small(hours, params), ["__plan", "__priority"], "left")
        .drop("__client", "__plan", "__priority")
    )


def with_deadline(dossiers: DataFrame) -> DataFrame:
    """Add status, deadline (NULL without client, active contract or SLA) and whether a quote is needed.

    `now_local` is the wall clock of the business when the request was taken into account.
    """
    day = F.col("now_local").cast("date")
    known = F.col("contract_client").isNotNull()
    active = known & cal.is_active(day, F.col("date_debut"), F.col("date_fin"))
    return (
        dossiers.withColumn("status", F.when(known, cal.contract_status(day, F.col("date_debut"), F.col("date_fin"))))
        .withColumn("active", active)
        .withColumn(
            "deadline",
            F.when(active & F.col("sla_hours").isNotNull(), cal.sla_deadline(F.col("now_local"), F.col("sla_hours"), F.col("astreinte_weekend"))),
        )
        .withColumn("needs_quote", ~F.col("active"))
    )


def contract_text() -> Column:
    c, lit = F.col, F.lit
    day = c("now_local").cast("date")
    known = F.concat_ws(
        "\n",
        F.concat(lit("Client "), c("contract_client"), lit(" — "), c("nom")),
        F.concat(lit("Formule : "), c("formule")),
        F.concat(lit("Validité : du "), cal.fr_date(c("date_debut")), lit(" au "), cal.fr_date(c("date_fin"))),
        F.concat(lit("Situation au "), cal.fr_date(day), lit(" : "), c("status")),
        F.concat(lit("Astreinte week-end : "), F.when(c("astreinte_weekend"), "incluse").otherwise("non incluse")),
        F.when(F.size("sites") > 0, F.concat(lit("Sites couverts : "), F.array_join("sites", " ; "))),
    )
    return F.when(c("contract_client").isNull(), "Client non identifié : aucun contrat ne peut être rattaché à ce dossier.").otherwise(known)


def deadline_text() -> Column:
    c, lit = F.col, F.lit
    hours = c("sla_hours").cast("string")
    delay = F.when(
        c("astreinte_weekend"), F.concat(hours, lit(" h (astreinte incluse : décompte 24 h/24 et 7 j/7)"))
    ).otherwise(F.concat(hours, lit(" h ouvrées (du lundi au vendredi, de 8 h à 18 h)")))
    return (
        F.when(c("contract_client").isNull(), f"Client non identifié : aucun délai contractuel ne s'applique. {_QUOTATION}")
        .when(~c("active"), F.concat(lit("Aucun délai garanti ne s'applique : "), c("status"), lit(f". {_QUOTATION}")))
        .when(
            c("sla_hours").isNull(),
            F.concat(lit("Aucun délai n'est défini pour la formule "), c("formule"), lit(" en priorité "), c("priority"), lit(".")),
        )
        .otherwise(
            F.concat(
                lit("Formule "), c("formule"), lit(", priorité "), c("priority"), lit(" : délai contractuel d'intervention de "), delay,
                lit(". Pour une demande prise en compte le "), cal.fr_datetime(c("now_local")),
                lit(", intervention au plus tard le "), cal.fr_datetime(c("deadline")), lit("."),
            )
        )
    )


def sources_line(sources: Column) -> Column:
    """Consulted documents of a dossier: array of (number, title, section), in number order."""
    labels = F.transform(
        F.array_sort(sources),
        lambda s: F.concat(
            s["title"], F.when(F.coalesce(s["section"], F.lit("")) != "", F.concat(F.lit(", "), s["section"])).otherwise(""),
            F.lit(" ["), s["number"].cast("string"), F.lit("]"),
        ),
    )
    return F.when(
        F.coalesce(F.size(sources), F.lit(0)) <= 0, "Aucun extrait de la documentation n'a été trouvé pour cette demande."
    ).otherwise(F.concat(F.lit("Documentation consultée : "), F.array_join(labels, " ; "), F.lit(".")))


def prepare(
    requests: DataFrame, clients: DataFrame, sla: DataFrame, sources: DataFrame | None = None, params: Params = DEFAULTS
) -> DataFrame:
    """Dossier of every agent-routed request (request_id, ts, q_masked, scoped_client): facts, draft, subject.

    `sources` holds one row per request with the array of sources its search returned.
    """
    timed = requests.withColumn("now_local", cal.business_clock(F.col("ts"), params.business_timezone)).withColumn(
        "priority", guess_priority(F.col("q_masked"))
    )
    facts = with_deadline(with_contract(timed, clients, sla, params))
    if sources is not None:
        facts = facts.join(sources.select("request_id", "sources"), "request_id", "left")
    else:
        empty = "array<struct<number:int,title:string,section:string>>"
        facts = facts.withColumn("sources", F.lit(None).cast(empty))
    labels = F.create_map(*[F.lit(x) for pair in PRIORITY_LABELS.items() for x in pair])
    p = F.col("priority")
    return (
        facts.withColumns({"contract_text": contract_text(), "deadline_text": deadline_text(), "sources_line": sources_line(F.col("sources"))})
        .withColumn(
            "draft",
            F.concat(
                F.lit("Brouillon préparé sans LLM à partir des données du dossier, à relire avant envoi.\n\nBonjour,\n\n"),
                F.lit("Nous avons bien reçu votre demande. Elle est qualifiée en priorité "), p, F.lit(" ("), labels[p],
                F.lit("), sous réserve de confirmation par un gestionnaire.\n\nContrat :\n"), F.col("contract_text"),
                F.lit("\n\nDélai d'intervention :\n"), F.col("deadline_text"),
                F.lit("\n\nSuite proposée : un ticket d'intervention en priorité "), p,
                F.lit(" est soumis à la validation d'un gestionnaire. Aucun ticket n'est créé à ce stade.\n\n"),
                F.col("sources_line"),
            ),
        )
        .withColumn(
            "subject",
            F.concat(F.lit("Demande d'intervention "), p, F.lit(" — "), F.coalesce("contract_client", F.lit("client non identifié"))),
        )
        .withColumn("summary", F.col("q_masked"))
    )
