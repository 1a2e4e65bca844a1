"""Source references in answers, prompt-tag removal, facts and verdicts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from guichet.functions import text as tx

# Fixed value: delimiters of prompts that a text must not forge.
_PROMPT_TAGS = r"(?iU)</?\s*(?:demande|sources)\b[^>]*>"


def extract_refs(answer: Column) -> Column:
    """Source numbers cited as [1] or [2, 3], first appearance first, without duplicates."""
    groups = F.regexp_extract_all(answer, F.lit(r"(?U)\[(\d+(?:\s*,\s*\d+)*)\]"), F.lit(1))
    numbers = F.flatten(F.transform(groups, lambda g: F.split(F.regexp_replace(g, r"(?U)\s", ""), ",")))
    return F.array_distinct(F.transform(numbers, lambda n: n.try_cast("decimal(38,0)")))


def valid_refs(answer: Column, n_sources: Column) -> Column:
    known = F.filter(extract_refs(answer), lambda r: r.isNotNull() & (r >= 1) & (r <= n_sources))
    return F.transform(known, lambda r: r.cast("int"))


def neutralize_tags(text: Column) -> Column:
    return F.regexp_replace(text, _PROMPT_TAGS, " ")


def excerpt(text: Column, chars: int = 300) -> Column:
    """Single-spaced beginning of a text."""
    return F.left(tx.squeeze(text), F.lit(chars))


def _facts(answer: Column, patterns: Column, present: bool) -> Column:
    """Patterns that match (or do not match) the normalised answer, which is computed once."""
    views = F.struct(tx.normalize(answer).alias("text"), patterns.alias("patterns"))
    return tx.once(views, lambda v: F.filter(v["patterns"], lambda p: F.regexp_like(v["text"], p) == F.lit(present)))


def missing_facts(answer: Column, patterns: Column) -> Column:
    return _facts(answer, patterns, False)


def present_facts(answer: Column, patterns: Column) -> Column:
    return _facts(answer, patterns, True)


def parse_verdict(reply: Column) -> Column:
    """Boolean `faithful` of the JSON object found in a reply; NULL when there is none or it is not a boolean."""
    body = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    value = F.from_json(body, "faithful boolean", {"mode": "PERMISSIVE"})
    return F.when(body != "", value["faithful"])


def announces_a_proposal(draft: Column) -> Column:
    """Whether a sentence awaits a validation, or proposes an intervention or a ticket."""

    def announces(sentence: Column) -> Column:
        return sentence.rlike(" attente de validation ") | (
            sentence.rlike(" propos") & sentence.rlike(" (?:intervent|ticket)")
        )

    # The prefixes are shorter than what stemming removes from these words, so the word itself decides.
    sentences = F.transform(tx.split_sentences(draft), lambda s: F.concat(F.lit(" "), _sequence(s), F.lit(" ")))
    return F.exists(sentences, announces)


def _sequence(text: Column) -> Column:
    return F.array_join(tx.plain_words(tx.strip_latin(F.lower(text))), " ")
