"""Rules in order, on requests written for each of them."""

import pytest

from guichet.operators import intake
from guichet.operators.triage import triage

CASES = [
    # text, client field, amount field, route, rule
    ("Nous souhaitons résilier fin mars.", "C-12", None, "human", "RG-04"),
    ("Vos pénalités de retard sont dues.", None, None, "human", "RG-04"),
    ("L'avocat du syndic vous écrira à propos de la facture de 90 €.", "C-12", None, "human", "RG-04"),
    ("Je demande l'effacement de mon dossier.", "C-12", None, "human", "RG-04"),
    ("J'exerce mon droit d’accès.", None, None, "human", "RG-04"),
    ("Merci de mettre fin au contrat.", "C-12", None, "human", "RG-04"),
    ("Nous contestons la facture de mai.", "C-12", 499.99, "automation", "RG-03"),
    ("Nous contestons la facture de mai.", "C-12", 500.0, "human", "RG-03b"),
    ("Nous contestons la facture de mai.", "C-12", 499.999, "human", "RG-03b"),
    ("Litige : 45 € de trop, client c-27.", None, None, "automation", "RG-03"),
    ("Merci pour la facture de 120 €.", "C-12", None, "rag", "DEFAULT"),
    ("Je ne conteste pas la facture de 120 €.", "C-12", None, "rag", "DEFAULT"),
    ("Je conteste la facture de 120 €.", "C-99", None, "rag", "DEFAULT"),
    ("Je conteste 480 € au lieu de 300 €.", "C-12", None, "rag", "DEFAULT"),
    ("La pompe est en panne, je conteste la facture de 80 €.", "C-12", None, "agent", "RG-05"),
    ("Un avoir de 60 € était promis.", "C-12", None, "automation", "RG-03"),
    ("Plus d'eau chaude depuis hier.", "C-12", None, "agent", "RG-05"),
    ("Pouvez-vous planifier une visite ?", "C-12", None, "agent", "RG-05"),
    ("Vérifiez que le contrat couvre la pompe.", "C-12", None, "agent", "RG-05"),
    ("Vérifiez la pression.", "C-12", None, "rag", "DEFAULT"),
    ("Que faire en cas de fuite ?", None, None, "rag", "DEFAULT"),
    ("Où sont les panneaux rayonnants ?", None, None, "rag", "DEFAULT"),
    ("Suivi du processus de facturation ?", None, None, "rag", "DEFAULT"),
]


@pytest.fixture(scope="module")
def decided(spark):
    clients = spark.createDataFrame([("C-12",), ("c-27 ",)], "client_id string")
    data = [(i, q, c, m) for i, (q, c, m, _, _) in enumerate(CASES)]
    sent = spark.createDataFrame(data, "request_id int, q string, client_id string, montant double")
    return {r["request_id"]: r for r in triage(intake.canonicalise(sent), clients).collect()}


def test_routes_and_rules(decided):
    got = [(decided[i]["route"], decided[i]["rule"]) for i in range(len(CASES))]
    assert got == [(route, rule) for *_, route, rule in CASES]


def test_client_from_text_is_known_but_not_scoped(decided):
    row = decided[9]
    assert (row["resolved_client"], row["client_origin"], row["client_known"], row["scoped_client"]) == ("C-27", "texte", True, None)
    assert decided[6]["scoped_client"] == "C-12" and decided[12]["scoped_client"] is None


def test_reasons(decided):
    assert decided[8]["reasons"][1:] == [
        "Montant : 500,00 € (champ)",
        "RG-03b : facturation, montant de 500,00 € supérieur ou égal au seuil de 500,00 € : transmis à un responsable facturation",
    ]
    assert decided[13]["reasons"] == [
        "Client : C-12 (champ), connu du référentiel",
        "Montant : non résolu (2 montants différents dans le texte)",
        "Facturation, non automatisé : pas de montant exploitable",
        "DEFAULT : aucune règle métier ne s'applique, recherche documentaire",
    ]
    assert decided[20]["reasons"][-2] == "RG-05 non appliquée (panne ou dysfonctionnement) : question sans client identifié"


def test_intake_quarantine(spark):
    sent = spark.createDataFrame(
        [(1, "ok ok", "c-1", 5.0), (2, " x ", None, None), (3, "y" * 2001, "C-1", None), (4, "bonjour", "12", 0.0), (5, None, None, None), (6, "abc", None, float("nan"))],
        "request_id int, q string, client_id string, montant double",
    )
    good, bad = intake.split_valid(sent)
    assert [r["request_id"] for r in good.collect()] == [1]
    assert {r["request_id"]: r["reasons"] for r in bad.collect()} == {
        2: ["text_too_short"], 3: ["text_too_long"], 4: ["client_malformed", "amount_out_of_range"], 5: ["text_missing"], 6: ["amount_out_of_range"],
    }


def test_raw_text_is_dropped_before_a_sink(spark):
    from guichet.functions.masking import without_raw

    masked = intake.mask_requests(spark.createDataFrame([("appelez le 0611223344",)], "q string"))
    row = without_raw(masked).first()
    assert row.asDict() == {"q_masked": "appelez le [TEL]", "pii_types": ["TEL"]}


def test_vocabulary_tables_of_any_size(spark, monkeypatch):
    from guichet.operators import vocabulary as vo

    rows = [("a", "stem", "pann"), ("a", "word", "hs"), ("b", "phrase", "en arret total"), ("b", "word", "gaz"), ("c", "stem", "zz")]
    table = spark.createDataFrame(rows, "label string, kind string, value string")
    data = [(1, ["panneau"], " le panneau hs "), (2, ["arret", "total"], " en arret total "), (3, ["gazon"], " gazon en arret "), (4, [], "  ")]
    texts = spark.createDataFrame(data, "id int, tokens array<string>, sequence string")
    small = {tuple(r) for r in vo.match_vocabulary(texts, "id", "tokens", "sequence", table).collect()}
    monkeypatch.setattr(vo, "fits", lambda *_: False)
    large = {tuple(r) for r in vo.match_vocabulary(texts, "id", "tokens", "sequence", table).collect()}
    assert small == large == {(1, "a"), (2, "b")}
