"""Request intake: canonical form, validation with quarantine, masking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guichet.functions import text as tx
from guichet.functions.extraction import CLIENT_FIELD
from guichet.functions.masking import mask_pii

# Bounds of a valid request.
MIN_CHARS, MAX_CHARS, MAX_AMOUNT = 3, 2000, 1_000_000


def canonicalise(requests: DataFrame) -> DataFrame:
    """Composed visible text, upper-cased client identifier, blank client as NULL."""
    return requests.withColumn("q", tx.canonical_text(F.col("q"))).withColumn(
        "client_id", tx.canonical_client(F.col("client_id"))
    )


def validate(requests: DataFrame) -> DataFrame:
    """Add `reasons` (empty when valid) and `is_valid`, in one pass over canonical requests."""
    length = F.char_length("q")
    reasons = F.array(
        F.when(F.col("q").isNull(), "text_missing"),
        F.when(length < MIN_CHARS, "text_too_short"),
        F.when(length > MAX_CHARS, "text_too_long"),
        F.when(F.col("client_id").isNotNull() & ~F.col("client_id").rlike(CLIENT_FIELD), "client_malformed"),
        F.when(F.isnan("montant") | (F.col("montant") <= 0) | (F.col("montant") > MAX_AMOUNT), "amount_out_of_range"),
    )
    return requests.withColumn("reasons", F.array_compact(reasons)).withColumn("is_valid", F.size("reasons") == 0)


def split_valid(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted requests, quarantine with the reasons)."""
    checked = validate(canonicalise(requests))
    return (
        checked.where("is_valid").drop("is_valid", "reasons"),
        checked.where(~F.col("is_valid")).drop("is_valid"),
    )


def mask_requests(requests: DataFrame) -> DataFrame:
    """Add `q_masked` and `pii_types`; the raw text stays for the triage and is dropped before any sink."""
    return mask_pii(requests, "q", masked="q_masked", types="pii_types")
