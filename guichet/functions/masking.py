"""Masking of personal identifiers: ordered detectors over a text column, all of them column expressions.

EMAIL, NIR and TEL are plain patterns. IBAN and card/SIRET numbers carry check digits, and other groups of letters or
digits may stand before or behind them: the text is cut where such a number could start, every start is tried on the
characters that follow it, and the run of whole groups that passes the check and is longest becomes the tag.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guichet.functions.text import once

# Formats of the identifiers. Space, no-break space and narrow no-break space separate groups.
_SP = " \u00a0\u202f"
EMAIL = r"(?U)[\w.+%-]+@[\w-]+(?:\.[\w-]+)+"
TEL = (
    rf"(?U)(?<![\w+])(?:(?:\+|00[{_SP}]?)33[{_SP}.-]?(?:\(0\)|0)?[{_SP}.-]?|0)[1-79]"
    rf"(?:(?<sep>[{_SP}.-]?)[0-9]{{2}}(?:\k<sep>[0-9]{{2}}){{3}}|(?:[{_SP}]?[0-9]){{8}})(?![0-9])"
)
NIR = (
    rf"(?U)(?<!\w)[12][{_SP}]?[0-9]{{2}}[{_SP}]?(?:0[1-9]|1[0-2])[{_SP}]?(?:[0-9]{{2}}|2[ABab])"
    rf"[{_SP}]?[0-9]{{3}}[{_SP}]?[0-9]{{3}}[{_SP}]?[0-9]{{2}}(?![0-9])"
)
IBAN_CANDIDATE = rf"(?<!\w)[A-Za-z]{{2}}[0-9]{{2}}(?:[{_SP}]?[A-Za-z0-9]){{11,30}}(?!\w)"
NUMBER_CANDIDATE = rf"(?<!\w)[0-9](?:[{_SP}-]?[0-9]){{12,18}}(?![0-9])"
TAGS = r"\[(?:EMAIL|TEL|IBAN|CARTE|NIR|SIRET)\]"
PII_TYPES = ("CARTE", "EMAIL", "IBAN", "NIR", "SIRET", "TEL")

# No candidate is longer than 34 characters with a separator after each.
_REACH = 80


def _is_iban(compact: Column) -> Column:
    """15 to 34 characters, mostly digits, whose ISO 13616 remainder is one."""
    rotated = F.concat(F.substring(compact, F.lit(5), F.length(compact)), F.left(compact, F.lit(4)))
    values = F.transform(F.split(rotated, ""), lambda c: F.conv(c, 36, 10).cast("int"))
    remainder = F.aggregate(values, F.lit(0), lambda left, v: (left * F.when(v < 10, 10).otherwise(100) + v) % 97)
    return F.length(compact).between(15, 34) & (2 * F.length(F.regexp_replace(compact, "[^0-9]", "")) > F.length(compact)) & (remainder == 1)


def _is_number(digits: Column) -> Column:
    """13 to 19 digits whose Luhn sum is a multiple of ten."""
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def _iban_tag(_: Column) -> Column:
    return F.lit("IBAN")


def number_tag(digits: Column) -> Column:
    return F.when(F.length(digits) == 14, "SIRET").otherwise("CARTE")


def _checked(text: Column, begins: str, candidate: str, gap: str, valid: Callable[[Column], Column], tag: Callable[[Column], Column]) -> Column:
    """Struct (text, types) of a text with its valid numbers replaced.

    `begins` is what a number starts with, at the start of a word. The fold carries what is kept, the position of
    the piece at hand and the position up to which the text is already replaced; the kept pieces are joined once.
    """
    pieces = F.split(text, rf"(?U)(?<!\w)(?={begins})")
    start = F.struct(
        F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("types"), F.lit(0).alias("at"), F.lit(0).alias("until"),
    )

    def longest(at: Column) -> Column:
        """(characters, compact form) of the longest valid run of whole groups from `at`."""
        ahead = F.regexp_extract(F.substring(text, at + 1, F.lit(_REACH)), f"(?U)^{candidate}", 0)
        groups = F.split(ahead, gap)
        runs = F.transform(F.sequence(F.lit(1), F.size(groups)), lambda n: F.struct((F.length(F.array_join(F.slice(groups, 1, n), "-"))).alias("size"), F.array_join(F.slice(groups, 1, n), "").alias("compact")))
        return F.array_max(F.filter(runs, lambda r: valid(r["compact"])))

    def step(state: Column, piece: Column) -> Column:
        found = F.when((state["at"] >= state["until"]) & piece.rlike(f"^{begins}"), longest(state["at"]))
        cut = F.greatest(F.lit(0), state["until"] - state["at"])  # characters of this piece that went into the last tag
        kept = F.concat(state["out"], F.array(F.substring(piece, cut + 1, F.length(piece))))
        return F.transform(F.array(found), lambda hit: F.when(
            hit.isNotNull(),
            F.struct(
                F.concat(state["out"], F.array(F.concat(F.lit("["), tag(hit["compact"]), F.lit("]"), F.substring(piece, hit["size"] + 1, F.length(piece))))).alias("out"),
                F.concat(state["types"], F.array(tag(hit["compact"]))).alias("types"),
                (state["at"] + F.length(piece)).alias("at"), (state["at"] + hit["size"]).alias("until"),
            ),
        ).otherwise(F.struct(kept.alias("out"), state["types"].alias("types"), (state["at"] + F.length(piece)).alias("at"), state["until"].alias("until"))))[0]

    return F.aggregate(pieces, start, step, lambda state: F.struct(F.array_join(state["out"], "").alias("text"), state["types"].alias("types")))


def mask_email(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, EMAIL, "[EMAIL]")).otherwise(text)


def mask_pattern(text: Column, pattern: str, kind: str) -> Column:
    """Replace a pattern by its tag; rows without its core are left untouched.

    The core drops the look-behind and the Unicode classes, so it fails on the first character of
    nearly every position instead of looking back from each of them.
    """
    return F.when(text.rlike(core(pattern)), F.regexp_replace(text, pattern, f"[{kind}]")).otherwise(text)


def core(pattern: str) -> str:
    """A weaker, faster form of a pattern: matches at least wherever the pattern does."""
    return re.sub(r"^(?:\(\?U\))?\(\?<!\[?[^)\]]*\]?\)", "", pattern)


def checked_ibans(text: Column) -> Column:
    """Struct (text, types) for rows holding an IBAN candidate, NULL for the others."""
    ahead = re.sub(r"^\(\?<!\\w\)", "", IBAN_CANDIDATE)
    return F.when(text.rlike(core(IBAN_CANDIDATE)), _checked(text, "[A-Za-z]{2}[0-9]{2}", ahead, f"[{_SP}]", _is_iban, _iban_tag))


def checked_numbers(text: Column) -> Column:
    """Struct (text, types) for rows holding a 13 to 19 digit candidate, NULL for the others."""
    ahead = re.sub(r"^\(\?<!\\w\)", "", NUMBER_CANDIDATE)
    return F.when(text.rlike(core(NUMBER_CANDIDATE)), _checked(text, "[0-9]", ahead, f"[{_SP}-]", _is_number, number_tag))


def plain_numbers(text: Column) -> Column:
    """Distinct valid numbers written as one run of digits, read from left to right.

    The character before a number and the one behind it belong to it, so of two numbers a single character apart the
    second is not read. `checked_numbers`, which masks requests, reads both.
    """
    runs = F.regexp_extract_all(text, F.lit(r"(?:^|[^\p{L}\p{N}_])([0-9]{13,19})(?:$|[^0-9])"), F.lit(1))
    return F.filter(F.array_distinct(runs), _is_number)


def mask_listed(text: Column, numbers: Column) -> Column:
    """Every occurrence of the listed numbers replaced by its tag, in the order of the list."""
    return F.aggregate(numbers, text, lambda t, n: F.replace(t, n, F.concat(F.lit("["), number_tag(n), F.lit("]"))))


def mask_pii(df: DataFrame, text: str, masked: str = "masked", types: str = "pii_types") -> DataFrame:
    """Add the masked text and the sorted distinct list of the types found.

    The order is part of the rule: the digits of an IBAN or a social security number must never be
    read as a phone or a card. Every intermediate text is bound once, so the expression stays small
    however often the steps refer to it, also where a filter on the result is pushed below it.
    """
    empty = F.array().cast("array<string>")

    def found(before: Column, after: Column, kind: str) -> Column:
        return F.when(~before.eqNullSafe(after), F.array(F.lit(kind))).otherwise(empty)

    def last(t3: Column, kinds: Column) -> Column:
        return once(checked_numbers(t3), lambda n: F.struct(
            F.coalesce(n["text"], t3).alias("masked"), F.array_sort(F.array_distinct(F.concat(kinds, F.coalesce(n["types"], empty)))).alias("types"),
        ))

    def plain(t1: Column, kinds: Column) -> Column:
        return once(mask_pattern(t1, NIR, "NIR"), lambda t2: once(
            mask_pattern(t2, TEL, "TEL"), lambda t3: last(t3, F.concat(kinds, found(t1, t2, "NIR"), found(t2, t3, "TEL"))),
        ))

    def checked(raw: Column, t0: Column) -> Column:
        return once(checked_ibans(t0), lambda i: once(
            F.coalesce(i["text"], t0), lambda t1: plain(t1, F.concat(found(raw, t0, "EMAIL"), F.coalesce(i["types"], empty))),
        ))

    steps = once(F.col(text), lambda raw: once(mask_email(raw), lambda t0: checked(raw, t0)))
    return df.withColumn("__pii", steps).withColumn(masked, F.col("__pii.masked")).withColumn(types, F.col("__pii.types")).drop("__pii")


def strip_tags(text: Column) -> Column:
    """Masked text without its tags, single-spaced: a tag is not something to look up."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, TAGS, " "), r"(?U)\s+", " "))


def without_raw(df: DataFrame, raw: str = "q") -> DataFrame:
    """Drop the raw text before any sink; only the masked text is ever stored."""
    return df.drop(raw)
