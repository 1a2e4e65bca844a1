"""Subjects revealed by the words of a request: stem prefixes, exact words and phrases as tables of patterns.

Each subject becomes at most two regular expressions, one over the padded stems of the text and one
over its padded word sequence, so a text is matched against a whole vocabulary in code-generated
expressions, with no join and no exploded row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guichet.functions.stemming import plain
from guichet.operators.sizing import fits
from guichet.params import DEFAULTS, Params


@dataclass(frozen=True)
class Subject:
    label: str
    stems: tuple[str, ...] = ()
    words: tuple[str, ...] = ()
    phrases: tuple[str, ...] = field(default=())

    def stem_pattern(self) -> str | None:
        return " (?:" + "|".join(self.stems) + ")" if self.stems else None

    def sequence_pattern(self) -> str | None:
        items = [*self.words, *(phrase_key(p) for p in self.phrases)]
        return " (?:" + "|".join(items) + ") " if items else None

    def rows(self) -> list[tuple[str, str, str]]:
        """The subject as rows (label, kind, value) of a vocabulary table."""
        return [
            *((self.label, "stem", s) for s in self.stems),
            *((self.label, "word", w) for w in self.words),
            *((self.label, "phrase", phrase_key(p)) for p in self.phrases),
        ]


def phrase_key(phrase: str) -> str:
    """Accent-free words of a phrase, single-spaced."""
    return " ".join(re.findall("[0-9a-zà-öø-ÿœæ]+", plain(phrase.lower())))


# --- fixed values: vocabulary of the rules --------------------------------------------------------

SENSITIVE = (
    Subject(
        "résiliation",
        stems=("resil", "denonc"),
        phrases=(
            "mettre fin au contrat", "mettre fin à mon contrat", "mettre fin à notre contrat", "mettons fin",
            "rompre le contrat", "rompre l'engagement", "ne renouvellerons pas", "ne pas renouveler",
        ),
    ),
    Subject("pénalités", stems=("penal",)),
    Subject(
        "contentieux",
        stems=(
            "contenti", "avocat", "tribunal", "huissi", "jurid", "judiciair", "assign", "plaint", "justic",
            "poursuit", "mediat",
        ),
        words=("proces", "refere", "dgccrf"),
        phrases=("en demeure",),
    ),
    Subject(
        "données personnelles",
        stems=("rgpd", "cnil", "effac", "rectif", "portab"),
        words=("dpo",),
        phrases=(
            "données personnelles", "donnée personnelle", "caractère personnel", "mes données",
            "informations me concernant", "fuite de données", "violation de données", "droit d'accès",
            "droit à l'oubli", "droit d'opposition", "supprimer mes coordonnées", "r g p d",
        ),
    ),
)
BILLING = Subject(
    "facturation", stems=("factur", "contest", "litig", "avoir", "rembours"), phrases=("trop perçu", "un avoir")
)
EXPLICIT_DISPUTE = Subject(
    "contestation explicite",
    stems=("contest", "litig", "avoir"),
    phrases=(
        "trop perçu", "un avoir", "erreur de facturation", "erreur sur la facture", "erreur sur ma facture",
        "demande de remboursement", "facturé à tort", "facturée à tort", "facturé deux fois", "facturée deux fois",
    ),
)
DISPUTE_DENIED = Subject(
    "contestation niée",
    phrases=("ne conteste pas", "ne contestons pas", "ne conteste aucun", "sans contester"),
)
BREAKDOWN = Subject(
    "panne ou dysfonctionnement",
    stems=("fuit", "defaill", "dysfonction", "inond", "incend"),
    words=("panne", "pannes", "hs"),
    phrases=(
        "ne fonctionne plus", "ne fonctionne pas", "ne marche plus", "ne marche pas", "ne chauffe plus",
        "ne démarre plus", "plus de chauffage", "plus d'eau chaude", "en arrêt", "à l'arrêt", "en défaut",
        "hors service", "h s", "odeur de gaz", "sent le gaz",
    ),
)
ACTION = Subject(
    "action demandée",
    stems=("planif", "programm", "depann"),
    phrases=("créer un ticket", "ouvrir un ticket", "envoyer un technicien", "intervention urgente demandée"),
)
CHECK = Subject("vérification", stems=("verif",))
CONTRACT = Subject("contrat", stems=("contrat",))

P1_STEMS = ("urge", "secur", "dang", "incend", "inond")
P1 = Subject(
    "urgence",
    phrases=(
        "arrêt total", "arrêt complet", "à l'arrêt", "en arrêt", "hors service", "panne totale",
        "ne fonctionne plus", "ne marche plus", "odeur de gaz", "fuite de gaz",
    ),
)
NEGATIONS = ("pas", "rien", "sans", "aucun", "aucune", "non", "ni")

# --- matching --------------------------------------------------------------------------------------


def mentions(subject: Subject, stems: Column, sequence: Column) -> Column:
    """Whether the text names the subject.

    `stems` are its space-joined stems and `sequence` its space-joined words, both padded with spaces.
    """
    tests = []
    if pattern := subject.stem_pattern():
        tests.append(stems.rlike(pattern))
    if pattern := subject.sequence_pattern():
        # Neighbouring matches share a space, which a single search does not mind.
        tests.append(sequence.rlike(pattern))
    if not tests:
        return F.lit(False)
    return tests[0] if len(tests) == 1 else tests[0] | tests[1]


def match_vocabulary(
    texts: DataFrame, key: str, tokens: str, sequence: str, vocabulary: DataFrame, params: Params = DEFAULTS
) -> DataFrame:
    """(key, label) pairs for a vocabulary held in a table (label, kind, value) instead of in code.

    `tokens` are the content tokens of a text and `sequence` its padded word sequence. A vocabulary
    proven small becomes one pattern per label and kind; a larger one is joined on its words.
    """
    vocabulary = vocabulary.where(F.col("kind").isin("stem", "word", "phrase")).select("label", "kind", "value").distinct()
    if fits(vocabulary, 5_000):
        return _match_patterns(texts, key, tokens, sequence, vocabulary)
    return _match_joined(texts, key, tokens, sequence, vocabulary)


def _match_patterns(texts: DataFrame, key: str, tokens: str, sequence: str, vocabulary: DataFrame) -> DataFrame:
    subjects: dict[str, dict[str, list[str]]] = {}
    for row in vocabulary.collect():
        kinds = subjects.setdefault(row["label"], {"stem": [], "word": [], "phrase": []})
        kinds[row["kind"]].append(re.escape(row["value"]))
    stems = F.concat(F.lit(" "), F.array_join(tokens, " "))
    found = [
        F.when(mentions(Subject(label, tuple(k["stem"]), (*k["word"], *k["phrase"])), stems, F.col(sequence)), label)
        for label, k in subjects.items()
    ]
    labels = F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
    return texts.select(key, F.explode_outer(labels).alias("label")).where(F.col("label").isNotNull()).distinct()


def _match_joined(texts: DataFrame, key: str, tokens: str, sequence: str, vocabulary: DataFrame) -> DataFrame:
    """Equi-joins only: a stem on the prefixes of tokens, a word or phrase on its first word, then checked."""
    prefixes = F.flatten(F.transform(tokens, lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda n: F.left(t, n))))
    by_stem = texts.select(key, F.explode_outer(F.array_distinct(prefixes)).alias("value")).join(
        vocabulary.where(F.col("kind") == "stem").select("label", "value"), "value"
    )
    starts = F.array_distinct(F.split(F.trim(F.col(sequence)), " "))
    by_word = (
        texts.select(key, F.explode_outer(starts).alias("start"))
        .join(vocabulary.where(F.col("kind") != "stem").select("label", "value", F.substring_index("value", " ", 1).alias("start")), "start")
        .join(texts.select(key, sequence), key)
        .where(F.contains(F.col(sequence), F.concat(F.lit(" "), F.col("value"), F.lit(" "))))
    )
    return by_stem.select(key, "label").unionByName(by_word.select(key, "label")).distinct()
