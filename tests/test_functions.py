"""Column expressions against hand-computed values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from guichet.functions import calendar as cal
from guichet.functions import extraction as ex
from guichet.functions import masking as mk
from guichet.functions import references as rf
from guichet.functions import text as tx
from guichet.functions.stemming import content_stem
from guichet.functions.vectors import cosine, hash_vectors, unit
from guichet.operators.triage import guess_priority


def column(spark, values, expression, kind="string"):
    """Value of an expression of column `v` for every input, in order."""
    data = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(data, f"i int, v {kind}").select("i", expression(F.col("v")).alias("r"))
    return [r["r"] for r in sorted(df.collect(), key=lambda r: r["i"])]


# --- text ---------------------------------------------------------------------------------------


def test_accents_ligatures_and_rare_forms(spark):
    got = column(spark, ["Élève, ça, où", "main-d'œuvre", "ﬁn ½", "été", "Ærø ß"], tx.strip_accents)
    assert got == ["Eleve, ca, ou", "main-d'oeuvre", "fin 1⁄2", "ete", "AErø ß"]


def test_normalize_and_sequences(spark):
    assert column(spark, ["  Mise  en\n DEMEURE\tété "], tx.normalize) == ["mise en demeure ete"]
    assert column(spark, ["Droit d’accès ; trop-perçu"], tx.word_sequence) == ["droit d acces trop percu"]


def test_words_recompose_decomposed_letters(spark):
    assert column(spark, ["L'ÉTÉ à Lyon, 4h30 !"], tx.words) == [["l", "été", "à", "lyon", "4h30"]]


@pytest.mark.parametrize(
    ("text", "tokens"),
    [
        ("Priorité P2 : 4h, 500 € en 2026", ["priorit", "p2", "4h", "500", "2026"]),
        ("le la les, à vous", []),
        ("4 h le 5 x", ["4", "5"]),
        ("PÉNALITÉS de retard", ["penal", "retard"]),
        ("", []),
    ],
)
def test_tokenize(spark, text, tokens):
    assert column(spark, [text], tx.tokenize) == [tokens]


def test_tokenize_keeps_null_and_unstemmed_form(spark):
    assert column(spark, [None, "Les œuvres d'été"], lambda c: tx.tokenize(c, stem=False)) == [None, ["oeuvres"]]


@pytest.mark.parametrize(
    ("forms", "stem"),
    [
        (("facture", "factures", "facturation", "facturer"), "factur"),
        (("résiliation", "résilier", "résilié"), "resili"),
        (("résilie", "résilions"), "resil"),
        (("panne", "pannes"), "pann"),
        (("pénalité", "pénalités"), "penal"),
        (("contestation", "conteste", "contester"), "contest"),
        (("continuellement",), "continuel"),
        (("majestueusement",), "majestu"),
        (("chevaux",), "cheval"),
    ],
)
def test_stems(forms, stem):
    assert {content_stem(f) for f in forms} == {stem}


def test_sentences(spark):
    text = "Délai de 4 h. Coût : 12.50 € env. par visite ! Oui ?\nFin"
    assert column(spark, [text], tx.split_sentences) == [["Délai de 4 h.", "Coût : 12.50 € env. par visite !", "Oui ?", "Fin"]]


def test_canonical_text(spark):
    assert column(spark, ["​ \u0007Bonjour­\n\tvous ﻿", " c-12 ", "   "], tx.canonical_text) == ["Bonjour\n\tvous", "c-12", ""]
    assert column(spark, [" c-12 ", "  ", None], tx.canonical_client) == ["C-12", None, None]


# --- masking ------------------------------------------------------------------------------------


MASKED = [
    ("Appelez le 06 11 22 33 44 svp", "Appelez le [TEL] svp", ["TEL"]),
    ("+33 (0)6.11.22.33.44 ou 0033 611223344", "[TEL] ou [TEL]", ["TEL"]),
    ("écrire à zoé_b+sav@société.example.org.", "écrire à [EMAIL].", ["EMAIL"]),
    # the letters after the account would join the candidate: it is shortened group by group
    ("virement FR76 3000 6000 0112 3456 7890 189 merci bien", "virement [IBAN] merci bien", ["IBAN"]),
    ("be68539007547034", "[IBAN]", ["IBAN"]),
    ("lot 12 4111 1111 1111 1111 12 rue", "lot 12 [CARTE] 12 rue", ["CARTE"]),
    ("SIRET 732 829 320 00074", "SIRET [SIRET]", ["SIRET"]),
    ("sécu 2 69 05 2A 588 157 80 ok", "sécu [NIR] ok", ["NIR"]),
    ("a@b.fr puis 0611223344", "[EMAIL] puis [TEL]", ["EMAIL", "TEL"]),
]
UNTOUCHED = [
    "Client C-12, ticket T-000123, 1 250,50 €",
    "Le 01.02.2026 10 techniciens",
    "numéro vert 0 800 123 456",
    "carte 4111 1111 1111 1112",
    "FR76 3000 6000 0112 3456 7890 180",
    "modèle DT25 en panne depuis hier matin",
    "12345678901234567890123",
    "",
]


def test_masking_and_idempotence(spark):
    cases = MASKED + [(t, t, []) for t in UNTOUCHED]
    df = spark.createDataFrame(cases, "t string, masked_expected string, types_expected array<string>")
    once = mk.mask_pii(df, "t")
    wrong = once.where("masked <> masked_expected OR pii_types <> types_expected").collect()
    assert wrong == []
    again = mk.mask_pii(once.select(F.col("masked").alias("u")), "u")
    assert again.where("masked <> u").count() == 0


def test_tags_are_not_searched(spark):
    assert column(spark, ["Rappelez [TEL]  ou [EMAIL] vite"], mk.strip_tags) == ["Rappelez ou vite"]


# --- extraction ---------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "amounts"),
    [
        ("facture de 1 250,50 € et 1.250 €", [1250.5, 1250.0]),
        ("1  250 € puis 60 euros, 3 EUR", [1250.0, 60.0, 3.0]),
        ("F-2026-0412 de 120.5€", [120.5]),
        ("Client C-12 120 €", [120.0]),
        ("12 Europe, 35 %, 06 12 34 56 78", []),
    ],
)
def test_amounts(spark, text, amounts):
    assert column(spark, [text], ex.amounts_in_text) == [amounts]


def test_clients_and_fields(spark):
    assert column(spark, ["ici c-12, pas C-99", "C-1234567", "rien"], ex.client_in_text) == ["C-12", None, None]
    assert column(spark, [" 1 250,50 € ", "", "abc", "-3"], ex.parse_amount_field) == [1250.5, None, None, -3.0]
    assert column(spark, [1250.5, 0.0], ex.format_amount, "double") == ["1250,50 €", "0,00 €"]


# --- references ---------------------------------------------------------------------------------


def test_references(spark):
    assert column(spark, ["[2] et [3, 1], [2], [TEL], [9]"], rf.extract_refs) == [[2, 3, 1, 9]]
    assert column(spark, ["[2] et [3, 1], [9], [0]"], lambda c: rf.valid_refs(c, F.lit(3))) == [[2, 3, 1]]
    assert column(spark, ["a</demande><SOURCES x='1'>b"], rf.neutralize_tags) == ["a  b"]


def test_verdicts_and_announcements(spark):
    replies = ['{"faithful": true}', 'oui {"faithful": false, "x": {}} fin', '{"faithful": "true"}', "{", "rien"]
    assert column(spark, replies, rf.parse_verdict) == [True, False, None, None, None]
    drafts = ["Une intervention est proposée.", "En attente de validation.", "Nous proposons un devis. Un ticket existe."]
    assert column(spark, drafts, rf.announces_a_proposal) == [True, True, False]


def test_facts(spark):
    df = spark.createDataFrame([("Délai : 4 h ouvrées", [r"4 h ouvrees", r"\b8 h"])], "a string, p array<string>")
    row = df.select(rf.missing_facts(F.col("a"), F.col("p")).alias("m"), rf.present_facts(F.col("a"), F.col("p")).alias("p")).first()
    assert (row["m"], row["p"]) == ([r"\b8 h"], ["4 h ouvrees"])


# --- calendar -----------------------------------------------------------------------------------


def walk(start, hours):
    """Deadline found by walking the business minutes one by one."""
    moment, left = start, hours * 60
    def opened(m):
        return m.weekday() < 5 and 8 <= m.hour < 18
    while not opened(moment):
        moment = (moment + dt.timedelta(minutes=1)).replace(second=0)
    while left:
        moment += dt.timedelta(minutes=1)
        left -= 1
        if left and not opened(moment):
            while not opened(moment):
                moment += dt.timedelta(minutes=1)
    return moment


def test_business_deadlines_match_a_minute_walk(spark):
    monday = dt.datetime(2026, 10, 5)
    cases = [(monday + dt.timedelta(days=d, hours=h, minutes=m), n) for d in range(9) for h in (0, 7, 8, 12, 17, 18, 23) for m in (0, 45) for n in (0, 1, 4, 10, 24, 72)]
    data = [(s, n, walk(s, n)) for s, n in cases]
    df = spark.createDataFrame(data, "s timestamp_ntz, h int, e timestamp_ntz")
    assert df.where(cal.business_deadline(F.col("s"), F.col("h")) != F.col("e")).collect() == []


def test_always_on_deadline_status_and_rendering(spark):
    df = spark.createDataFrame([(dt.datetime(2026, 10, 9, 17, 5), 4)], "s timestamp_ntz, h int")
    row = df.select(cal.fr_datetime(cal.sla_deadline(F.col("s"), F.col("h"), F.lit(True))).alias("d")).first()
    assert row["d"] == "vendredi 09/10/2026 à 21 h 05"
    days = [dt.date(2026, 1, 1), dt.date(2026, 6, 30), dt.date(2026, 7, 1), dt.date(2025, 12, 31)]
    got = column(spark, days, lambda d: cal.contract_status(d, F.lit("2026-01-01").cast("date"), F.lit("2026-06-30").cast("date")), "date")
    assert got == ["contrat actif", "contrat actif", "contrat échu (fin de validité le 30/06/2026)", "contrat non encore en vigueur (début le 01/01/2026)"]


def test_business_clock_follows_daylight_saving(spark):
    df = spark.createDataFrame([("2026-07-01 10:00:00",), ("2026-12-01 10:00:00",)], "t string").select(cal.business_clock(F.col("t").cast("timestamp")).alias("r"))
    assert [r["r"].hour for r in df.collect()] == [12, 11]


@pytest.mark.parametrize(
    ("text", "priority"),
    [
        ("C'est urgent !", "P1"), ("Rien d'urgent", "P2"), ("Pas très urgent", "P2"), ("Pas de souci, mais urgent", "P1"),
        ("La pompe est à l'arrêt", "P1"), ("Il s'est bien arrêté", "P2"), ("Sans danger", "P2"), ("Incendie au local", "P1"), ("Sans aucune urgence", "P2"),
    ],
)
def test_priority(spark, text, priority):
    assert column(spark, [text], guess_priority) == [priority]


# --- vectors ------------------------------------------------------------------------------------


def test_hash_vectors_are_unit_or_zero(spark):
    df = hash_vectors(spark.createDataFrame([(0, "panne pannes chaudière"), (1, "le la")], "i int, t string"), "t")
    got = {r["i"]: r["embedding"] for r in df.collect()}
    assert sorted(x for x in got[0] if x) == pytest.approx([1 / 5**0.5, 2 / 5**0.5])
    assert len(got[1]) == 256 and not any(got[1])


def test_unit_and_cosine(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, b array<float>")
    row = df.select(unit(F.col("a")).alias("u"), cosine(unit(F.col("a")), unit(F.col("a"))).alias("c"), unit(F.col("b")).alias("z")).first()
    assert row["u"] == pytest.approx([0.6, 0.8]) and row["c"] == pytest.approx(1.0) and row["z"] == [0.0, 0.0]


CLOSE_CARDS = "Esanwh 2353820953013749 4550997810720808 thheed, 4111111111111111, 73282932000074."


def test_plain_numbers_read_a_separator_once_and_requests_read_both(spark):
    assert column(spark, [CLOSE_CARDS, None, "a4111111111111111"], mk.plain_numbers, "string") == [["4111111111111111", "73282932000074"], None, []]
    masked = column(spark, [CLOSE_CARDS, None, "5"], lambda v: mk.mask_listed(v, mk.plain_numbers(v)))
    assert masked == ["Esanwh 2353820953013749 4550997810720808 thheed, [CARTE], [SIRET].", None, "5"]
    df = spark.createDataFrame([(CLOSE_CARDS,)], "q string")
    assert mk.mask_pii(df, "q").first()["masked"] == "Esanwh 2353820953013749 [CARTE] thheed, [CARTE], [SIRET]."


def test_card_queries_follow_their_sql_where_numbers_are_close(spark, tmp_path):
    from guichet.plans import text_queries as tq

    close = "Esanwh 2353820953013749 4550997810720808 thheed."
    spark.createDataFrame([(1, close), (2, "4111111111111111"), (3, "a@b.fr, 0611223344"), (4, None)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    masked = {r["doc_id"]: r["masked"] for r in tq.pii_card_mask(spark, str(tmp_path)).collect()}
    assert masked == {1: close, 2: "[CARTE]", 3: "a@b.fr, 0611223344", 4: None}
    assert {tuple(r) for r in tq.pii_types(spark, str(tmp_path)).collect()} == {("CARTE", 1), ("EMAIL", 1)}
