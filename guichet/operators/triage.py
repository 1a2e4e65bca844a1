"""Triage of a request table: one route per request, by business rules evaluated in order.

    RG-04    sensitive subject                                        -> human
    RG-03b   billing subject at or above the threshold                -> human
    RG-03    explicit dispute below the threshold, known client       -> automation
    RG-05    breakdown or action on a dossier                         -> agent
    DEFAULT  documentary question                                     -> rag
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guichet.functions import extraction as ex
from guichet.functions import text as tx
from guichet.functions.stemming import stem_joined
from guichet.operators import vocabulary as vo
from guichet.operators.retrieval import scoped_client
from guichet.operators.sizing import broadcast_if_small
from guichet.params import DEFAULTS, Params


def client_key(client_id: Column) -> Column:
    return F.lower(tx.trim_all(client_id))


def own_key(key: Column, row: Column) -> Column:
    """A join key that matches nothing and spreads over the partitions where the key is null."""
    return F.coalesce(key, F.concat(F.lit("\u0000"), F.xxhash64(row).cast("string")))


def with_client(requests: DataFrame, clients: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Resolve the client (field first, then text) and whether the reference data know it.

    The dimension is broadcast only when its size is proven small. Requests that name no client would all meet on
    one null key beyond it, so each gets a key of its own, which no client has.
    """
    resolved = requests.withColumn("resolved_client", ex.resolved_client(F.col("client_id"), F.col("q"))).withColumn(
        "client_origin", ex.client_origin(F.col("client_id"))
    )
    keys = clients.select(client_key(F.col("client_id")).alias("__key"), F.lit(True).alias("__known")).distinct()
    return (
        resolved.withColumn("__key", own_key(client_key(F.col("resolved_client")), F.col("q")))
        .join(broadcast_if_small(keys, params), "__key", "left")
        .withColumn("client_known", F.coalesce("__known", F.lit(False)))
        .drop("__key", "__known")
    )


def triage(requests: DataFrame, clients: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Add route, rule, reasons, resolved client and amount to canonical requests (request_id, q, client_id, montant)."""
    named = with_client(requests, clients, params)
    views = (
        named.withColumn("__found", ex.distinct_amounts(ex.amounts_in_text(F.col("q"))))
        .withColumn("resolved_amount", ex.resolved_amount(F.col("montant"), F.col("__found")))
        .withColumn("__stems", F.concat(F.lit(" "), F.array_join(tx.tokenize(F.col("q")), " "), F.lit(" ")))
        .withColumn("__sequence", tx.padded_sequence(F.col("q")))
        .withColumn("__question", F.col("resolved_client").isNull() & tx.rtrim_all(F.col("q")).endswith("?"))
    )
    stems, sequence = F.col("__stems"), F.col("__sequence")
    flags = {f"__s{i}": vo.mentions(subject, stems, sequence) for i, subject in enumerate(vo.SENSITIVE)}
    flags |= {
        "__billing": vo.mentions(vo.BILLING, stems, sequence),
        "__explicit": vo.mentions(vo.EXPLICIT_DISPUTE, stems, sequence)
        & ~vo.mentions(vo.DISPUTE_DENIED, stems, sequence),
        "__breakdown": vo.mentions(vo.BREAKDOWN, stems, sequence),
        "__action": vo.mentions(vo.ACTION, stems, sequence),
        "__check": vo.mentions(vo.CHECK, stems, sequence) & vo.mentions(vo.CONTRACT, stems, sequence),
    }
    return decide(views.withColumns(flags), params).drop(
        *flags, "__found", "__stems", "__sequence", "__question"
    )


def decide(flagged: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """The ordered rules over boolean columns; also usable on flags that come from elsewhere."""
    c = F.col
    amount = c("resolved_amount")
    threshold = F.lit(float(params.dispute_threshold))
    sensitive_flags = [c(f"__s{i}") for i in range(len(vo.SENSITIVE))]
    sensitive = F.array_compact(
        F.array(*[F.when(flag, s.label) for flag, s in zip(sensitive_flags, vo.SENSITIVE, strict=True)])
    )
    blocker = (
        F.when(amount.isNull() | (amount <= 0), "pas de montant exploitable")
        .when(~c("client_known"), "pas de client connu")
        .when(~c("__explicit"), "pas de contestation explicite")
        .when(c("__breakdown"), "la demande signale aussi une panne")
    )
    subjects = F.array_compact(
        F.array(
            F.when(c("__breakdown"), vo.BREAKDOWN.label),
            F.when(c("__action"), vo.ACTION.label),
            F.when(c("__check"), "vérification du contrat"),
        )
    )
    staged = flagged.withColumns({"__sensitive": sensitive, "__subjects": subjects}).withColumn(
        "__blocker", F.when(c("__billing"), blocker)
    )
    rule = (
        F.when(F.size("__sensitive") > 0, "RG-04")
        .when(c("__billing") & (amount >= threshold), "RG-03b")
        .when(c("__billing") & c("__blocker").isNull(), "RG-03")
        .when((F.size("__subjects") > 0) & ~c("__question"), "RG-05")
        .otherwise("DEFAULT")
    )
    route = (
        F.when(c("rule").isin("RG-04", "RG-03b"), "human")
        .when(c("rule") == "RG-03", "automation")
        .when(c("rule") == "RG-05", "agent")
        .otherwise("rag")
    )
    return (
        staged.withColumn("rule", rule)
        .withColumn("route", route)
        .withColumn("reasons", _reasons(params))
        .withColumn("scoped_client", scoped_client(c("client_known"), c("client_origin"), c("resolved_client")))
        .drop("__sensitive", "__subjects", "__blocker")
    )


def _reasons(params: Params) -> Column:
    """Decision log: client, amount, then what each rule said. Never quotes the request."""
    c = F.col
    join, lit = F.concat, F.lit
    threshold = ex.format_amount(F.lit(float(params.dispute_threshold)))
    amount = ex.format_amount(c("resolved_amount"))
    known = F.when(c("client_known"), "connu du référentiel").otherwise("inconnu du référentiel")
    client = F.when(c("resolved_client").isNull(), "Client : non renseigné").otherwise(
        join(lit("Client : "), c("resolved_client"), lit(" ("), c("client_origin"), lit("), "), known)
    )
    money = (
        F.when(c("montant").isNotNull(), join(lit("Montant : "), amount, lit(" (champ)")))
        .when(F.size("__found") == 0, "Montant : absent")
        .when(
            F.size("__found") > 1,
            join(lit("Montant : non résolu ("), F.size("__found").cast("string"), lit(" montants différents dans le texte)")),
        )
        .otherwise(join(lit("Montant : "), amount, lit(" (texte)")))
    )
    subjects = F.array_join("__subjects", ", ")
    fallthrough = c("rule").isin("RG-05", "DEFAULT")
    return F.array_compact(
        F.array(
            client,
            money,
            F.when(
                c("rule") == "RG-04",
                join(lit("RG-04 : sujet sensible ("), F.array_join("__sensitive", ", "), lit("), transmis à un gestionnaire")),
            ),
            F.when(
                c("rule") == "RG-03b",
                join(
                    lit("RG-03b : facturation, montant de "), amount, lit(" supérieur ou égal au seuil de "), threshold,
                    lit(" : transmis à un responsable facturation"),
                ),
            ),
            F.when(
                c("rule") == "RG-03",
                join(
                    lit("RG-03 : litige de facturation de "), amount, lit(", inférieur au seuil de "), threshold,
                    lit(", pour un client connu : ticket standard"),
                ),
            ),
            F.when(fallthrough & c("__blocker").isNotNull(), join(lit("Facturation, non automatisé : "), c("__blocker"))),
            F.when(
                (c("rule") == "DEFAULT") & (F.size("__subjects") > 0),
                join(lit("RG-05 non appliquée ("), subjects, lit(") : question sans client identifié")),
            ),
            F.when(c("rule") == "RG-05", join(lit("RG-05 : "), subjects, lit(" : dossier confié à l'agent"))),
            F.when(c("rule") == "DEFAULT", "DEFAULT : aucune règle métier ne s'applique, recherche documentaire"),
        )
    )


def guess_priority(text: Column) -> Column:
    """P1 for an emergency phrase, or an emergency stem that none of the two words before it negates; else P2."""
    sequence = tx.word_sequence(text)
    views = F.struct(sequence.alias("sequence"), stem_joined(sequence).alias("stems"))

    def urgent(view: Column) -> Column:
        words, stems = F.split(view["sequence"], " "), F.split(view["stems"], " ")
        cue = "^(?:" + "|".join(vo.P1_STEMS) + ")"
        negations = F.array(*[F.lit(n) for n in vo.NEGATIONS])

        def counts(i: Column) -> Column:
            before = F.slice(words, F.greatest(i - 2, F.lit(0)) + 1, F.least(i, F.lit(2)))
            return F.get(stems, i).rlike(cue) & ~F.arrays_overlap(before, negations)

        phrase = F.concat(F.lit(" "), view["sequence"], F.lit(" ")).rlike(vo.P1.sequence_pattern())
        return F.when(phrase | F.exists(F.sequence(F.lit(0), F.size(stems) - 1), counts), "P1").otherwise("P2")

    return tx.once(views, urgent)
