"""Client identifiers and euro amounts read from free text, and their resolution against the fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats accepted by the rules.
CLIENT_FIELD = r"^C-\d{1,6}$"
CLIENT_IN_TEXT = r"(?iU)\bC-\d{1,6}\b"
_AMOUNT_NUMBER = r"(?iU)(?<![\w.,-])((?:\d{1,3}(?:(?:[\s'’]+|\.)\d{3})+|\d+)(?:[.,]\d{1,2})?)\s*(?:€|euros?\b|eur\b)"


def client_in_text(text: Column) -> Column:
    """First client identifier of the text, upper-cased; NULL when there is none."""
    return F.nullif(F.upper(F.regexp_extract(text, CLIENT_IN_TEXT, 0)), F.lit(""))


def amounts_in_text(text: Column) -> Column:
    """Every amount in euros, in order, duplicates kept.

    A comma or dot followed by one or two digits at the end is the decimal mark; every other
    separator only groups thousands.
    """
    numbers = F.regexp_extract_all(text, F.lit(_AMOUNT_NUMBER), F.lit(1))

    def value(number: Column) -> Column:
        decimals = F.regexp_extract(number, r"[.,](\d{1,2})$", 1)
        whole = F.regexp_replace(F.regexp_replace(number, r"[.,]\d{1,2}$", ""), r"\D", "")
        return F.concat(whole, F.lit("."), F.when(decimals == "", F.lit("0")).otherwise(decimals)).cast("double")

    return F.transform(numbers, value)


def format_amount(amount: Column) -> Column:
    """Amount for display, decimal comma: 1250.5 -> "1250,50 €"."""
    return F.concat(F.replace(two_decimals(amount), F.lit("."), F.lit(",")), F.lit(" €"))


def two_decimals(amount: Column) -> Column:
    return F.format_string("%.2f", amount)


def parse_amount_field(text: Column) -> Column:
    """Typed amount: spaces and euro signs ignored, decimal comma; NULL when empty or unreadable."""
    compact = F.replace(F.regexp_replace(text, r"(?U)[\s€]", ""), F.lit(","), F.lit("."))
    return F.when(compact.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)$"), compact.try_cast("double"))


def resolved_client(field: Column, text: Column) -> Column:
    """The field wins over the text."""
    return F.coalesce(field, client_in_text(text))


def client_origin(field: Column) -> Column:
    return F.when(field.isNotNull(), "champ").otherwise("texte")


def distinct_amounts(amounts: Column) -> Column:
    return F.array_sort(F.array_distinct(amounts))


def resolved_amount(field: Column, found: Column) -> Column:
    """The field, rounded to cents, else the single distinct amount of the text."""
    return F.when(field.isNotNull(), F.round(field, 2)).when(F.size(found) == 1, F.get(found, F.lit(0)))
