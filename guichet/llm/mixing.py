"""Mixing sources to target weights: temperature mixing, realised as budgeted block permutations.

Built-in functions only. The weight of a source is its token share to the power of an exponent between 0 (all equal)
and 1 (as found), normalised. The exponent is the largest whose weights have at least the target entropy (a share of
that of equal weights), raised if needed until no source is repeated more than the limit. Both are bisected, four
halvings a job, over a small table of sources.

The token budget is split by weight. Each source is cut into blocks by a keyed hash of the id (of about BLOCK_TOKENS
tokens; at most MAX_BLOCKS of a source, so that no window grows with the corpus), and read block by block in a
permutation of its own for each pass. The last pass ends where the budget does: whole blocks in order of the
permutation, and of the block on the limit those rows, in keyed order, that still fit.

Only ids, sources and counts move, never texts. A null source is a source like any other; null or wordless texts have
no tokens and are in every full pass. Repeated rows and null ids are rows like any other. An empty table, or one
without any token, gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guichet.llm.common import staged

#: Share of the entropy of equal weights, and passes over one source, that the query asks for.
ENTROPY, REPEATS = 0.97, 4.0
BLOCK_TOKENS, MAX_BLOCKS = 100_000, 65_536
_POINTS, _JOBS = 16, 8


@dataclass(frozen=True)
class Mix:
    exponent: float
    budget: int


def token_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _keyed(seed: int, *parts: str | Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]))


def exponent(sources: DataFrame, budget: float, entropy: float = ENTROPY, repeats: float = REPEATS) -> float:
    """Exponent for `sources(tokens)`, all above 0."""
    total = sources.agg(F.sum("tokens"), F.count("*")).first()
    shares = sources.select((F.col("tokens") / F.lit(float(total[0]))).alias("p"), "tokens")
    goal = entropy * float(sources.select(F.log(F.lit(float(total[1])))).first()[0])
    flat, steep = (0.0, 1.0), (0.0, 1.0)  # brackets of the entropy's and of the limit's exponent
    for _ in range(_JOBS):
        at = [lo + (hi - lo) * j / _POINTS for lo, hi in (flat, steep) for j in range(1, _POINTS)]
        points = shares.withColumn("x", F.explode(F.array(*[F.lit(v) for v in sorted(set(at))])))
        powered = points.withColumn("w", F.pow("p", "x"))
        sums = powered.groupBy("x").agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.log("p")).alias("l"), F.max(F.col("w") / F.col("tokens")).alias("most"))
        found = {r["x"]: (r["h"], r["r"]) for r in sums.select("x", (F.log("z") - F.col("x") * F.col("l") / F.col("z")).alias("h"), (F.col("most") / F.col("z") * budget).alias("r")).collect()}
        own, other = at[: _POINTS - 1], at[_POINTS - 1 :]
        flat = (max([flat[0], *[v for v in own if found[v][0] >= goal]]), min([flat[1], *[v for v in own if found[v][0] < goal]]))
        steep = (max([steep[0], *[v for v in other if found[v][1] > repeats]]), min([steep[1], *[v for v in other if found[v][1] <= repeats]]))
    return max(flat[0], steep[1] if steep[0] > 0 else 0.0)


def mix(docs: DataFrame, budget: int | None = None, entropy: float = ENTROPY, repeats: float = REPEATS, seed: int = 17) -> DataFrame:
    """(doc_id, source, tokens, epoch, place): every row of `docs(doc_id, source, text)` as often as the mix reads it.

    `epoch` counts the passes over the source, `place` is the block's place in the permutation of that pass. The
    budget is that of the corpus itself unless given.
    """
    narrow = staged(docs.select("doc_id", "source", token_count().alias("tokens")), "counted")
    sources = narrow.groupBy("source").agg(F.sum("tokens").alias("total")).where("total > 0")
    sources = staged(sources.withColumn("blocks", F.least(F.ceil(F.col("total") / BLOCK_TOKENS), F.lit(MAX_BLOCKS))), "sources")
    if sources.isEmpty():
        return narrow.select("doc_id", "source", "tokens", F.lit(0).cast("long").alias("epoch"), F.lit(0).alias("place")).limit(0)
    budget = budget or sources.agg(F.sum("total")).first()[0]
    x = exponent(sources.select(F.col("total").alias("tokens")), float(budget), entropy, repeats)
    z = sources.agg(F.sum(F.pow(F.col("total") / F.lit(float(budget)), F.lit(x)))).first()[0]
    # to a thousandth of a token: the last bits of a power may differ between machines, a budget must not
    own = F.round(F.pow(F.col("total") / F.lit(float(budget)), F.lit(x)) / F.lit(z) * F.lit(float(budget)), 3)
    plan = sources.withColumn("own", F.floor(own)).withColumn("full", F.floor(F.col("own") / F.col("total")))
    plan = staged(plan.withColumn("rest", F.col("own") - F.col("full") * F.col("total")), "plan")

    block = F.pmod(F.conv(F.substring(_keyed(seed, "doc_id"), 1, 8), 16, 10).cast("long"), F.col("blocks"))
    rows = narrow.join(plan.select(F.col("source").alias("s"), "blocks"), F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", "tokens", block.alias("block"))
    rows = staged(rows, "blocks")
    sized = rows.groupBy("source", "block").agg(F.sum("tokens").alias("size"))
    passes = sized.join(plan.select(F.col("source").alias("s"), "full", "rest"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    passes = passes.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full"))))
    order = Window.partitionBy("source", "epoch").orderBy(_keyed(seed, "source", "epoch", "block"), "block")
    passes = passes.withColumn("place", F.row_number().over(order)).withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    room = F.when(F.col("epoch") < F.col("full"), F.col("size")).otherwise(F.col("rest") - F.col("upto") + F.col("size"))
    passes = passes.withColumn("room", room).where("room > 0 or epoch < full")
    passes = staged(passes.select(F.col("source").alias("s"), F.col("block").alias("b"), "epoch", "place", "size", "room", "full"), "passes")
    read = rows.join(passes, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).drop("s", "b")
    whole = read.where("epoch < full or size <= room")
    last = Window.partitionBy("source", "block").orderBy(_keyed(seed, "source", "epoch", "doc_id"), "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, 0)
    cut = read.where("epoch = full and size > room").withColumn("upto", F.sum("tokens").over(last)).where("upto <= room").drop("upto")
    return whole.unionByName(cut).select("doc_id", "source", "tokens", "epoch", "place")
