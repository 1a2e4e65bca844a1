"""Line dedup by site-relative frequency: lines that too large a share of a site's pages hold are boilerplate.

Built-in functions only. A page holds a line once, however often it repeats; lines are compared without the blanks
around them, by 128 bits of hash. Lines of blanks alone are never dropped. A line goes where more than `per_mille` of
1000 pages of its site, and at least `least` of them, hold it; the other lines keep their order and their bytes.

A site can have at most (lines of a page) * 1000 / per_mille such lines, so they travel as one short array for each
site. Counts are added up within each task before they are exchanged, so one line on a third of all pages, or a site
with a third of all pages, makes no large group; Spark broadcasts the sites' arrays only where the stored table is
small, and splits the large site of the join otherwise.

A null text stays null and has no lines; an empty one has one empty line. A null site is a site of its own. Repeated
rows are pages of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guichet.llm.common import spare, staged

PER_MILLE, LEAST = 50, 3


def _mark(line: Column) -> Column:
    bare = F.trim(line)
    return F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(F.lit(1), bare).alias("b"))


def boilerplate(pages: DataFrame, per_mille: int = PER_MILLE, least: int = LEAST) -> DataFrame:
    """(site, marks): hashes of the boilerplate lines of each site that has any, from `pages(site, text)`."""
    totals = pages.groupBy("site").agg(F.count("*").alias("pages"))
    bare = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    marks = pages.select("site", F.explode(F.array_distinct(F.transform(bare, _mark))).alias("mark"))
    counts = marks.groupBy("site", "mark").agg(F.count("*").alias("holding")).where(F.col("holding") >= least)
    often = counts.join(totals.withColumnRenamed("site", "of"), F.col("site").eqNullSafe(F.col("of"))).where(F.col("holding") * 1000 > F.col("pages") * per_mille)
    return often.groupBy("site").agg(F.collect_set("mark").alias("marks"))


def drop_boilerplate(docs: DataFrame, site: str = "source", text: str = "text", per_mille: int = PER_MILLE, least: int = LEAST) -> DataFrame:
    """All columns of `docs`, the text without boilerplate lines, and the counts `_lines` and `_dropped`.

    Columns of `docs` with the names of the counts are replaced; any other name may occur.
    """
    marks = staged(boilerplate(docs.select(F.col(site).alias("site"), F.col(text).alias("text")), per_mille, least), "boilerplate")
    of, held, left = (spare(docs, name) for name in ("_site", "_marks", "_kept"))
    marks = marks.select(F.col("site").alias(of), F.col("marks").alias(held))
    joined = docs.join(marks, docs[site].eqNullSafe(marks[of]), "left")
    lines = F.split(text, "\n")
    kept = F.when(F.col(held).isNull(), lines).otherwise(F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(held, _mark(x))))
    count = lambda x: F.coalesce(F.when(F.col(text).isNotNull(), F.size(x)), F.lit(0)).cast("long")
    out = joined.withColumn(left, kept).withColumn("_lines", count(lines)).withColumn("_dropped", F.col("_lines") - count(F.col(left)))
    return out.withColumn(text, F.array_join(left, "\n")).drop(of, held, left)
