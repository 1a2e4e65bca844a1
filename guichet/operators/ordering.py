"""Row numbering and as-of lookups that never sort a whole table, or a whole key, in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from guichet.session import checkpoint_root


def number_rows(df: DataFrame, *order: Column, out: str = "number", start: int | Column = 0) -> DataFrame:
    """Consecutive numbers in a total order, from `start` + 1.

    The rows are range-sorted once and checkpointed, which fixes partitions and positions even if an
    executor is lost; the number is the position plus the sizes of the earlier partitions (a table
    of one row per partition).
    """
    checkpoint_root(df.sparkSession)
    placed = df.orderBy(*order).checkpoint().withColumn("__id", F.monotonically_increasing_id())
    placed = placed.withColumn("__part", F.shiftright("__id", 33)).withColumn("__row", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__size"))
    before = sizes.select(
        "__part",
        (F.sum("__size").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("__size")).alias("__before"),
    )
    base = start if isinstance(start, Column) else F.lit(start)
    return (
        placed.join(F.broadcast(before), "__part")
        .withColumn(out, (F.col("__row") + F.col("__before") + 1 + base).cast("bigint"))
        .drop("__id", "__part", "__row", "__before")
    )


def latest_before(
    left: DataFrame, right: DataFrame, key: str, at: str, value: str, width_us: int, slice_us: int
) -> DataFrame:
    """Add to `left` the latest (`right_at`, `value`) of the same key at or before it, at most `width_us` earlier.

    Rows of both sides meet inside (key, time slice) groups, so a hot key spreads over its slices; the
    last row of the earlier slices comes from a table with one row per key and slice. No pair of
    rows is ever formed.
    """
    slice_of = F.floor(F.col(at) / F.lit(slice_us))
    columns = [c for c in left.columns if c not in (key, at)]
    known = F.struct(F.col(at).alias("right_at"), F.col(value).alias(value))
    right_rows = right.select(key, at, F.lit(0).alias("__side"), known.alias("__known"), *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in columns])
    left_rows = left.select(key, at, F.lit(1).alias("__side"), F.lit(None).cast(right_rows.schema["__known"].dataType).alias("__known"), *columns)
    both = right_rows.unionByName(left_rows).withColumn("__slice", slice_of)
    inside = W.partitionBy(key, "__slice").orderBy(at, "__side").rowsBetween(W.unboundedPreceding, W.currentRow)
    in_slice = both.withColumn("__near", F.max("__known").over(inside)).where(F.col("__side") == 1)
    per_slice = both.groupBy(key, "__slice").agg(F.max("__known").alias("__last"))
    earlier = W.partitionBy(key).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    carried = per_slice.select(key, "__slice", F.max("__last").over(earlier).alias("__far"))
    found = F.coalesce("__near", "__far")
    return (
        in_slice.join(carried, [key, "__slice"], "left")
        .withColumn("__found", found)
        .withColumn("__found", F.when(F.col("__found.right_at") >= F.col(at) - width_us, F.col("__found")))
        .select(key, at, *columns, F.col("__found.right_at").alias("right_at"), F.col(f"__found.{value}").alias(value))
    )


def first_seen_numbers(found: DataFrame, owner: str, item: str, *order: str) -> DataFrame:
    """Number the items of an owner by first appearance: (owner, item, number).

    Appearances are reduced on the map side to one row per (owner, item) before they are ranked.
    """
    first = found.groupBy(owner, item).agg(F.min(F.struct(*order)).alias("first"))
    return first.select(owner, item, F.dense_rank().over(W.partitionBy(owner).orderBy("first")).alias("number"))


#: Slices that a pass of `nearest_rank` cuts a range of values into, and its passes.
_SLICES, _PASSES = 1024, 2


def nearest_rank(df: DataFrame, value: str, percents: dict[str, int], *by: str) -> DataFrame:
    """Nearest-rank percentiles per group, as columns named by `percents`.

    Values are counted first (combined on the map side). Then the range of each group is cut into slices, of which counts say
    in which one a rank lies; that slice is cut again, and only the values of what is left are put in order. So no task orders
    the values of a whole group, whatever their number.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("__v"), F.col(value).alias("__value")).agg(F.count("*").alias("__n"))
    checkpoint_root(df.sparkSession)
    counts = counts.select(F.struct(F.lit(0), *by).alias("__group"), "__v", "__value", "__n").checkpoint()  # read by every pass
    whole = counts.groupBy("__group").agg(F.sum("__n").alias("__total"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
    names = list(percents)
    ranks = F.explode(F.array(*[F.struct(F.lit(n).alias("__name"), F.greatest(F.lit(1), F.ceil(F.col("__total") * percents[n] / F.lit(100))).alias("__rank")) for n in names]))
    sought = whole.withColumn("__r", ranks).select("__group", "__low", "__high", F.lit(0).cast("long").alias("__before"), "__r.*")
    for _ in range(_PASSES):
        width = (F.col("__high") - F.col("__low")) / _SLICES
        inside = counts.join(sought, "__group").where((F.col("__v") >= F.col("__low")) & (F.col("__v") <= F.col("__high")))
        slice_ = F.when(width > 0, F.least(F.floor((F.col("__v") - F.col("__low")) / width), F.lit(_SLICES - 1))).otherwise(0)
        cut = inside.groupBy("__group", "__name", "__rank", "__before", slice_.alias("__slice")).agg(F.sum("__n").alias("__n"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
        upto = F.col("__before") + F.sum("__n").over(W.partitionBy("__group", "__name").orderBy("__slice"))  # at most `_SLICES` rows
        reached = cut.withColumn("__upto", upto).where(F.col("__upto") >= F.col("__rank"))
        sought = reached.groupBy("__group", "__name", "__rank").agg(F.min_by(F.struct("__low", "__high", (F.col("__upto") - F.col("__n")).alias("__before")), "__slice").alias("s"))
        sought = sought.select("__group", "__name", "__rank", "s.*")
    left = counts.join(sought, "__group").where((F.col("__v") >= F.col("__low")) & (F.col("__v") <= F.col("__high")))
    upto = F.col("__before") + F.sum("__n").over(W.partitionBy("__group", "__name").orderBy("__value"))
    found = left.withColumn("__upto", upto).where(F.col("__upto") >= F.col("__rank"))
    found = found.groupBy("__group").agg(*[F.min(F.when(F.col("__name") == n, F.col("__value"))).alias(n) for n in names])
    return found.select(*[F.col("__group")[c].alias(c) for c in by], *names)
