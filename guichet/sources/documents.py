"""Document scans: folder listing, front matter, titles, manifest override, e-mails and paged text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from guichet.functions import text as tx

# What the ingestion accepts.
SUPPORTED = r"(?i)\.(md|txt|pdf|eml)$"
TEXT_FILES = r"(?i)\.(md|txt)$"
MANIFEST = "manifest.json"
_BREAK = "(?:\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x{85}\\x{2028}\\x{2029}])"
_FENCE = r"(?U)^\s*---\s*$"


def scan_folder(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(files to read, skipped files) of a folder, not recursive; hidden files and the manifest are neither."""
    files = spark.read.format("binaryFile").load(folder).withColumn("doc", F.element_at(F.split("path", "/"), -1))
    return sort_files(files)


def sort_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files to read, skipped files with the reason) of files (doc, length, content).

    Text files are checked one by one: one that is not UTF-8, or holds nothing but blanks, is skipped, and the others are read.
    """
    seen = files.where(~F.col("doc").startswith(".") & ~F.col("doc").startswith("_") & (F.col("doc") != MANIFEST))
    is_text, text = F.col("doc").rlike(TEXT_FILES), F.col("content").cast("string")
    reason = (
        F.when(~F.col("doc").rlike(SUPPORTED), "unsupported file type")
        .when(is_text & ~F.is_valid_utf8(text), "not UTF-8 text")
        .when(is_text & ~text.rlike(r"(?U)[^\s\x{FEFF}]"), "no text")
    )
    judged = seen.withColumn("reason", reason)
    return judged.where(F.col("reason").isNull()).select("doc", "length", "content"), judged.where(F.col("reason").isNotNull()).select("doc", "reason")


def text_files(files: DataFrame) -> DataFrame:
    """Markdown and plain-text files as (doc, content); a file that is not UTF-8 is left to `sort_files`."""
    text = F.col("content").cast("string")
    return files.where(F.col("doc").rlike(TEXT_FILES) & F.is_valid_utf8(text)).select("doc", text.alias("content"))


def split_front_matter(files: DataFrame) -> DataFrame:
    """Add `meta` MAP and `body`: pairs between two `---` lines at the top; an unclosed block is plain text."""
    clean = F.regexp_replace("content", "^\\x{FEFF}", "")
    lines = tx.split_lines(F.col("__text"))
    closing = F.array_min(
        F.filter(
            F.transform(F.col("__lines"), lambda line, i: F.when((i > 0) & line.rlike(_FENCE), i)), lambda i: i.isNotNull()
        )
    )
    has_meta = F.get("__lines", F.lit(0)).rlike(_FENCE) & F.col("__end").isNotNull()
    header = F.slice("__lines", F.lit(2), F.col("__end") - 1)
    pairs = F.filter(header, lambda line: line.contains(":"))

    def entry(line: Column) -> Column:
        key = F.lower(tx.trim_all(F.substring_index(line, ":", 1)))
        value = F.regexp_replace(tx.trim_all(F.regexp_replace(line, r"(?s)^[^:]*:", "")), "^[\"']+|[\"']+$", "")
        return F.struct(key.alias("key"), value.alias("value"))

    # A key given twice keeps its last value, as in a plain assignment.
    entries = F.transform(pairs, entry)
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
    body = F.array_join(F.slice("__lines", F.col("__end") + 2, F.size("__lines")), "\n")
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return (
        files.withColumn("__text", clean)
        .withColumn("__lines", lines)
        .withColumn("__end", closing)
        .withColumn("meta", F.when(has_meta, F.map_from_entries(last)).otherwise(empty))
        .withColumn("body", F.when(has_meta, body).otherwise(F.col("__text")))
        .drop("__text", "__lines", "__end")
    )


def _blank_to_null(value: Column) -> Column:
    return F.nullif(tx.trim_all(value), F.lit(""))


def describe_texts(files: DataFrame) -> DataFrame:
    """Files with the `titre`, `type` and `client_id` they name, and their `body` as written; other columns stay."""
    parsed = split_front_matter(files)
    heading = F.nullif(F.regexp_extract("body", r"(?m)^#[ \t\x{A0}]+(.+?)[ \t]*$", 1), F.lit(""))
    return (
        parsed.withColumn("titre", F.coalesce(F.nullif(F.col("meta")["titre"], F.lit("")), heading))
        .withColumn("type", F.col("meta")["type"])
        .withColumn("client_id", F.col("meta")["client_id"])
        .drop("meta")
    )


def load_texts(files: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """Documents (doc, title, doc_type, client_id, pages) of text files, with the manifest's values on top."""
    described = describe_texts(files).select("doc", "titre", "type", "client_id", tx.trim_all(F.col("body")).alias("__body"))
    page = F.struct(F.lit(1).alias("number"), F.col("__body").alias("text"))
    paged = described.withColumn("pages", F.filter(F.array(page), lambda p: p["text"] != "")).drop("__body")
    return resolve_metadata(paged, manifest)


def resolve_metadata(documents: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """Manifest override and defaults: (doc, title, doc_type, client_id, pages).

    Blank manifest values are ignored, so they never turn a scoped document into a public one.
    """
    merged = documents
    if manifest is not None:
        over = manifest.select("doc", *[F.nullif(F.col(k), F.lit("")).alias(f"__{k}") for k in ("titre", "type", "client_id")])
        merged = documents.join(over, "doc", "left")
        for k in ("titre", "type", "client_id"):
            merged = merged.withColumn(k, F.coalesce(f"__{k}", k)).drop(f"__{k}")
    stem = F.regexp_replace("doc", r"(?<=.)\.[^.]*$", "")
    return merged.select(
        "doc",
        F.coalesce(_blank_to_null(F.col("titre")), stem).alias("title"),
        F.coalesce(_blank_to_null(F.col("type")), F.lit("document")).alias("doc_type"),
        F.upper(_blank_to_null(F.col("client_id"))).alias("client_id"),
        "pages",
    )


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest entries (doc, titre, type, client_id); a malformed manifest fails the job."""
    entry = "map<string, struct<titre: string, type: string, client_id: string>>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", entry, {"mode": "FAILFAST"}).alias("m"))
    return raw.select(F.explode("m").alias("doc", "e")).select("doc", "e.*")


def manifest_orphans(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest entries without a file."""
    return manifest.join(files.select("doc"), "doc", "left_anti").select("doc")


def load_emails(emails: DataFrame) -> DataFrame:
    """Documents of e-mails (doc, subject, body): subject line and plain body, addresses dropped."""
    subject = tx.trim_all(F.coalesce("subject", F.lit("")))
    body = F.array_join(tx.split_lines(F.regexp_replace(F.coalesce("body", F.lit("")), _BREAK + r"\z", "")), "\n")
    text = tx.trim_all(F.concat_ws("\n\n", F.when(subject != "", F.concat(F.lit("Objet : "), subject)), body))
    page = F.struct(F.lit(1).alias("number"), F.col("__text").alias("text"))
    described = emails.select(
        "doc", subject.alias("titre"), F.lit("email").alias("type"), F.lit(None).cast("string").alias("client_id"), text.alias("__text")
    )
    return resolve_metadata(
        described.withColumn("pages", F.filter(F.array(page), lambda p: p["text"] != "")).drop("__text")
    )


def load_paged(documents: DataFrame) -> DataFrame:
    """Documents of extracted page texts (doc, titre, texts ARRAY<STRING>): non-empty pages keep their number."""
    numbered = F.transform("texts", lambda t, i: F.struct((i + 1).alias("number"), tx.trim_all(F.coalesce(t, F.lit(""))).alias("text")))
    described = documents.select(
        "doc", "titre", F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("client_id"),
        F.filter(numbered, lambda p: p["text"] != "").alias("pages"),
    )
    return resolve_metadata(described)
