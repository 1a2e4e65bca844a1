"""Corpus pipeline: toxicity, line dedup, near copies, decontamination, mixing to target weights.

Every stage takes (spark, docs, sf_dir) and returns the columns of `documents`, but for the last, which returns what
the mix reads: (doc_id, source, tokens, epoch, place). A document is what its id and text say (`row_key`), so ids may
repeat and be null: each text under an id is judged by itself, and of rows equal in both one stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from guichet.llm import lines, mixing, toxicity
from guichet.llm.common import remainder, staged
from guichet.llm.decontaminate import contamination, is_contaminated
from guichet.llm.ngram_join import jaccard_classes
from guichet.sources.tables import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity, learned from the labels outside the held-out fold, is below 0.3."""
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 4) != 2)
    return toxicity.score(docs, toxicity.fit(docs, labels), *COLUMNS).where("toxicity < 0.3").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source."""
    kept = lines.drop_boilerplate(docs.select(*COLUMNS))
    return kept.withColumn("n_chars", F.when(F.col("_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def row_key() -> Column:
    """Key of a document: 64 bits of its id and text."""
    return F.xxhash64("doc_id", F.col("doc_id").isNull(), "text", F.col("text").isNull())


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of `docs(..., row)` whose key is not in `gone(row)`; the texts are exchanged only if the keys are too many to broadcast."""
    return docs.join(gone, "row", "left_anti").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id; null ids come last."""
    keyed = docs.withColumn("row", row_key())
    classes = jaccard_classes(keyed, "row").select(F.col("doc_id").alias("row"), F.col("component_id").alias("component")).distinct()
    several = classes.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    members = staged(classes.join(several, "component").join(keyed.select("row", "doc_id").distinct(), "row"), "groups")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    kept = members.groupBy("component").agg(F.min_by("row", order).alias("row"))
    gone = staged(members.select("row").join(kept.select("row"), "row", "left_anti").distinct(), "copies")
    alone = without(keyed, gone).withColumn("row", row_key())
    repeated = staged(keyed.groupBy("row").agg(F.count("*").alias("n")).where("n > 1").select("row"), "repeated")
    once = alone.join(repeated, "row", "left_semi").dropDuplicates(["row"])
    return without(alone, repeated).unionByName(once.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which windows of the benchmark cover less than a twentieth."""
    keyed = docs.withColumn("row", row_key())
    found = contamination(keyed.select(F.col("row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    gone = staged(found.where(is_contaminated()).select(F.col("doc_id").alias("row")).distinct(), "contaminated")
    return without(keyed, gone)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix reads: rows of each source as often as its weight asks, in permuted blocks."""
    return mixing.mix(docs.select("doc_id", "source", "text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: The first stage is a model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in order over `documents`; each stage's table is stored in the shared folder for the next."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
