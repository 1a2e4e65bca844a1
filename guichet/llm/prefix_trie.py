"""Prefix trie of conversations, rolled up by centroid decomposition.

A node is a distinct sequence of first turns; conversations that share it are its members. Turns travel as digests and
word counts, their texts never; each conversation's turns are sorted within its partition and chained into digests of its
prefixes, so a node is 16 bytes and a conversation of any length streams through. Nodes are counted by aggregation, in
tasks first, so a first turn shared by a third of all conversations is no large group.

Rollup over subtrees. The trie is a forest of parent edges, cut into components; at first there is one, with the root on
top. Node u weighs the number of (conversation, turn) rows below it in its component, which the counting gives at once.
A component's centroid is its deepest node that weighs more than half of it. Taking it out leaves its child components
and the part above, each at most half as heavy. What lies below the centroid is added up, becomes the centroid's total, and
is added to each node from the centroid's parent up to the top; every pair of a node and one above it is met in exactly one component, so
the sums are whole, and the number of rounds grows with the logarithm of the rows, for chains of any depth too.
Paths are never walked: the smallest member of a node runs through all nodes above it, so they are its turns.

Components of more than `LOCAL` nodes are split by joins and aggregations; smaller ones fit a task, which splits
them to the end by the same rule (many in one task, each by itself). Both ways give the same sums.

A null role or text counts as empty, a null turn comes first; turns with one number are ordered by role, then by the
SHA-256 of the text, then come equal ones. Rows without conversation id belong to none and are left out; a table without
conversations has no nodes. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from guichet.llm.common import parts, staged

#: Components of so many nodes are finished in one task (some 300 bytes a node).
LOCAL = 1 << 14
#: Characters of a piece of a list of ids.
_PIECE = 1 << 20
_TURN_WORDS = r"[^\x20\x09-\x0D]+"
_WIDE = 16
_ROOT = bytes(_WIDE)


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, mark, words): digest and word count of every turn, numbered from 1."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    mark = F.unhex(F.substring(F.sha2(F.concat(F.length(role), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * _WIDE))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.sha2(text.cast("binary"), 256).alias("tie"), mark.alias("mark"), F.regexp_count(text, F.lit(_TURN_WORDS)).cast("long").alias("words"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "tie")
    return rows.select("conv_id", F.row_number().over(order).cast("long").alias("place"), "mark", "words")


def spliced(turns: DataFrame, heads: DataFrame) -> DataFrame:
    """Turns after each conversation's first `shared` ones are replaced by those of another: `heads(conv_id, base, shared)`.

    A base gives its first turns to the conversations that name it; those beyond its end, or of a base that is absent, are none.
    """
    most = F.broadcast(heads.agg(F.max("shared").alias("most")))
    given = turns.join(most, F.col("place") <= F.col("most")).drop("most").withColumnRenamed("conv_id", "base")
    borrowed = given.join(heads, "base").where("place <= shared").select("conv_id", "place", "mark", "words")
    return turns.join(heads, "conv_id").where("place > shared").select("conv_id", "place", "mark", "words").union(borrowed)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and place: the digest of every prefix, its depth and the digest of the prefix before."""
    conv, depth, node = None, 0, _ROOT
    for batch in batches:
        nodes, above, depths = [], [], []
        for c, mark in zip(batch.column("conv_id").to_pylist(), batch.column("mark").to_pylist()):
            if c != conv:
                conv, depth, node = c, 0, _ROOT
            above.append(node)
            depth += 1
            node = hashlib.blake2b(node + mark, digest_size=_WIDE).digest()
            nodes.append(node)
            depths.append(depth)
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), pa.array(depths, pa.int64()), pa.array(nodes, pa.binary()), pa.array(above, pa.binary()), batch.column("words")],
            names=["conv_id", "depth", "node", "parent", "words"],
        )


def paths_of(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, node, parent, words): the node of every prefix of every conversation of `turns(conv_id, place, mark, words)`."""
    ordered = turns.repartition(parts(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "place")
    return ordered.mapInArrow(_chained, "conv_id bigint, depth bigint, node binary, parent binary, words bigint")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive ids of a node, joined into pieces of bounded length."""
    node, first, held, size = None, None, [], 0

    def piece():
        return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(held)])], names=["node", "first", "ids"])

    for batch in batches:
        for n, c in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist()):
            if held and (n != node or size > _PIECE):
                yield piece()
                held, size = [], 0
            if not held:
                node, first = n, c
            held.append(str(c))
            size += len(held[-1]) + 1
    if held:
        yield piece()


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by node and first id: one digest for each node, one piece in memory."""
    node, state = None, None
    for batch in batches:
        nodes, out = [], []
        for n, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
            if n != node:
                if state is not None:
                    nodes.append(node)
                    out.append(state.hexdigest())
                node, state = n, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(out, pa.string())], names=["node", "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])


def ends_of(last: DataFrame) -> DataFrame:
    """(node, ends_sha256): SHA-256 of the ids of `last(node, conv_id)`, ascending and joined by commas.

    The ids of one node are sorted and written over ranges of partitions, whatever their number; only the digest itself, which
    nothing can cut, reads the finished pieces one after the other.
    """
    count = parts(last.sparkSession)
    pieces = last.repartitionByRange(count, "node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(_pieces, "node binary, first bigint, ids string")
    return pieces.repartition(count, "node").sortWithinPartitions("node", "first").mapInArrow(_digested, "node binary, ends_sha256 string")


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by component and depth: every component, split to the end by itself."""
    comp, rows = None, []
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["comp"] != comp:
                out += _split(rows)
                comp, rows = row["comp"], []
            rows.append(row)
        yield _sums(out)
    yield _sums(_split(rows))


def _sums(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"node": pa.binary(), "n_leaves": pa.int64(), "saved_tokens": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())], names=list(kinds))


def _split(rows: list[dict]) -> list[tuple]:
    """Totals of the nodes of one component (parents before their children) by centroids, without recursion."""
    place = {r["node"]: i for i, r in enumerate(rows)}
    up = [place.get(r["parent"], -1) if i else -1 for i, r in enumerate(rows)]
    weight = [r["weight"] for r in rows]
    value = [(r["leaf"], r["saved"]) for r in rows]
    added = [(r["leaf_added"], r["saved_added"]) for r in rows]
    todo, done = [list(range(len(rows)))] if rows else [], []
    while todo:
        nodes = todo.pop()  # the top comes first, parents before children
        centre = max(i for i in nodes if 2 * weight[i] > weight[nodes[0]])  # one chain: the last is the deepest
        child = {centre: centre}  # node below the centroid: the child of it above that node
        above, total, below = [], [0, 0], {}
        for i in nodes:
            k = child.get(up[i]) if i != centre else centre
            if k is None:
                above.append(i)
                continue
            total = [t + v for t, v in zip(total, value[i])]
            if i != centre:
                child[i] = i if k == centre else k
                below.setdefault(child[i], []).append(i)
        done.append((rows[centre]["node"], *(t + a for t, a in zip(total, added[centre]))))
        i = centre
        while i != nodes[0]:
            i = up[i]
            added[i] = tuple(a + t for a, t in zip(added[i], total))
            weight[i] -= weight[centre]
        todo += [above] if above else []
        todo += list(below.values())
    return done


def rollup(nodes: DataFrame, paths: DataFrame, local: int = LOCAL) -> DataFrame:
    """(node, n_leaves, saved_tokens) summed over subtrees of `nodes(node, parent, depth, conv_id, weight, leaf, saved)`.

    `conv_id` is a member and `paths(conv_id, depth, node)` has its nodes, the root at depth 0 left out.
    """
    spark = nodes.sparkSession
    open_ = nodes.select("*", F.lit(_ROOT).alias("comp"), F.lit(0).cast("long").alias("leaf_added"), F.lit(0).cast("long").alias("saved_added"))
    names = open_.columns
    small, done = None, None
    while True:
        open_ = staged(open_, "components")
        sized = open_.groupBy("comp").agg(F.count("*").alias("size"), F.max("weight").alias("all"), F.min("depth").alias("top"))
        tagged = staged(open_.join(sized, "comp"), "sized")
        little = tagged.where(F.col("size") <= local).select(names)
        small = little if small is None else small.union(little)
        big = tagged.where(F.col("size") > local)
        if big.isEmpty():
            break
        centre = big.where("2 * weight > all").groupBy("comp").agg(F.max_by(F.struct("node", "depth", "conv_id", "weight"), "depth").alias("c"), F.max("top").alias("top"))
        centre = staged(centre.select("comp", "top", F.col("c.node").alias("centre"), F.col("c.depth").alias("at"), F.col("c.conv_id").alias("through"), F.col("c.weight").alias("weighs")), "centroids")
        rows = big.select(names).join(centre.select("comp", "centre", "at"), "comp")
        on_path = paths.select(F.col("conv_id"), F.col("depth").alias("at"), F.col("node").alias("passes"))
        next_on_path = paths.select(F.col("conv_id"), (F.col("depth") - 1).alias("at"), F.col("node").alias("child"))
        # a node lies below the centroid if its member passes through it at that depth, and in the component of the child it passes next
        placed = rows.join(on_path, ["conv_id", "at"], "left").join(next_on_path, ["conv_id", "at"], "left")
        passes = F.when(F.col("at") == 0, F.lit(_ROOT)).otherwise(F.col("passes"))
        placed = staged(placed.withColumn("under", (F.col("depth") >= F.col("at")) & F.coalesce(passes == F.col("centre"), F.lit(False))).drop("passes"), "placed")
        totals = placed.where("under").groupBy("comp").agg(F.sum("leaf").alias("leaf_total"), F.sum("saved").alias("saved_total"))
        totals = staged(centre.join(totals, "comp"), "totals")
        ended = placed.where("node = centre").join(totals.select("comp", "leaf_total", "saved_total"), "comp")
        ended = ended.select("node", (F.col("leaf_total") + F.col("leaf_added")).alias("n_leaves"), (F.col("saved_total") + F.col("saved_added")).alias("saved_tokens"))
        done = ended if done is None else done.union(ended)
        climbed = totals.join(paths.select(F.col("conv_id").alias("through"), "depth", F.col("node").alias("on")), "through").where("depth >= top and depth < at")
        rooted = totals.where("top = 0 and at > 0").select(F.lit(_ROOT).alias("on"), "leaf_total", "saved_total", "weighs")
        climbed = climbed.select("on", "leaf_total", "saved_total", "weighs").union(rooted)
        left = placed.where("not under").join(climbed, F.col("node") == F.col("on"), "left")
        plus = lambda a, b, sign: (F.col(a) + sign * F.coalesce(F.col(b), F.lit(0))).alias(a)
        left = left.select("node", "parent", "depth", "conv_id", plus("weight", "weighs", -1), "leaf", "saved", "comp", plus("leaf_added", "leaf_total", 1), plus("saved_added", "saved_total", 1))
        below = placed.where("under and node <> centre").withColumn("comp", F.col("child")).select(names)
        open_ = left.select(names).union(below)
    ordered = small.repartition(parts(spark), "comp").sortWithinPartitions("comp", "depth")
    local_sums = ordered.mapInArrow(_finished, "node binary, n_leaves bigint, saved_tokens bigint")
    return local_sums if done is None else local_sums.union(done)


def prefix_trie(conversations: DataFrame, heads: DataFrame | None = None, local: int = LOCAL) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node is named by its smallest member and its depth; the root has depth 0 and all conversations as members, and
    turnless ones end there. `n_leaves` counts the childless nodes of the subtree, its top included; `saved_tokens` sums
    (n_convs - 1) times the words of the last text over it. `heads(conv_id, base, shared)`, one row for each
    conversation, replaces first turns (see `spliced`).
    """
    turns = staged(turns_of(conversations), "turns")
    ids = turns.select("conv_id").distinct()
    rebuilt = turns if heads is None else spliced(turns, heads)
    paths = staged(paths_of(rebuilt), "paths")
    lengths = ids.join(paths.groupBy("conv_id").agg(F.max_by("node", "depth").alias("node"), F.max("depth").alias("length")), "conv_id", "left")
    lengths = staged(lengths.select("conv_id", F.coalesce("node", F.lit(_ROOT)).alias("node"), F.coalesce("length", F.lit(0)).alias("length")), "lengths")
    whole = paths.join(lengths.select("conv_id", "length"), "conv_id")
    weight = F.sum(F.col("length") - F.col("depth") + 1).alias("weight")
    nodes = whole.groupBy("node").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("words").alias("words"), weight)
    root = lengths.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(F.col("length") + 1).alias("weight")).where("n_convs > 0")
    root = root.select(F.lit(_ROOT).alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("long").alias("words"), "weight")
    nodes = staged(nodes.union(root), "nodes")
    children = nodes.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "node", "left").fillna({"n_children": 0})
    nodes = staged(nodes.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("words")), "nodes")
    sums = rollup(nodes.select("node", "parent", "depth", "conv_id", "weight", "leaf", "saved"), paths, local)
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(sums, "node").join(above, "parent", "left").join(ends_of(lengths.select("node", "conv_id")), "node", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
