"""N-gram Jaccard join: documents whose shingle sets overlap enough, by T-occurrence search.

1.  Copies collapse first: documents with the same set of shingles are one class, named by a hash of the set.
2.  A global order puts rare shingles first (a fixed-size table of hashed document frequencies, filled over all
    documents). Two classes with Jaccard similarity of at least s share at least m of the first n - ceil(s n) + m
    shingles of either, for any m, so only those enter the inverted lists; m is 1 + n / 16 of the smaller set. The order
    decides speed alone; any order gives the same links.
3.  The lists are dealt out by shingle; those that hold one class vanish, and so do classes that are left in fewer
    lists than m (a document that shares a common line, no more).
4.  Classes with the same hub (the class that shares most of its lists, mostly the text that others were copied from)
    form a cluster with a head, kept in blocks of bounded size. First each class is searched by its head; what is linked
    so far is one component.
5.  Within a cluster, every block is then searched for the classes of every block, but for those of their own component;
    between clusters, pairs of a list that lie in different components and share m lists are; short lists are
    paired, long ones searched block by block by the lists their classes share. No link between components
    is lost, and a group of n near copies that are all linked costs about n searches.
6.  A search is one query class against an inverted index of candidates: DivideSkip sets the longest lists aside, merges
    the short ones (with a heap, or by counting where they are many), and probes the long ones by bisection for what
    the merge has left.

A null or wordless text has an empty set and no link. Rows with a null id are returned with a null component and
take no part. A repeated row is a copy like any other.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from guichet.llm import kernels as K
from guichet.llm.common import column, handed_back, parts, remove, staged
from guichet.llm.components import components

#: Cells of the frequency table; the only thing that is broadcast, one byte a cell.
CELLS = 1 << 21
#: Shingles and classes of a block; a search holds two blocks.
BLOCK, BLOCK_CLASSES = 1 << 17, 1 << 8
#: Classes of a list up to which its pairs are joined, and of a block of a longer one.
SHORT, LIST_BLOCK = 16, 1 << 9
#: Most rows of (id, class, place) that are broadcast to fetch texts; more are joined by a shuffle.
FETCHED = 2_000_000
#: Entries of short lists from which on they are merged by counting.
MANY = 1 << 11
_PROFILE = "doc_id long, n long, key long, cell int, seen long"
_MU = 0.0085
#: One shared list more is asked for each so many shingles.
EXTRA = 16


def _sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every distinct shingle, sorted by row and hash."""
    starts, ends, row = K.words(data, offsets, K.SPACED)
    hashes = K.word_hashes(data, starts, ends)
    grams = K.chain(hashes, size)
    whole = row[: len(grams)] == row[size - 1 :] if len(grams) else np.zeros(0, bool)
    rows, grams = row[: len(grams)][whole], grams[whole]
    edges = K.runs(row)
    lengths = np.diff(edges)
    for a, m in zip(edges[:-1][lengths < size], lengths[lengths < size]):  # the whole sequence as one shingle
        rows, grams = np.append(rows, row[a]), np.append(grams, K.chain(hashes[a : a + m], int(m)))
    order = np.lexsort((grams, rows))
    rows, grams = rows[order], grams[order]
    keep = np.ones(len(rows), bool)
    keep[1:] = (rows[1:] != rows[:-1]) | (grams[1:] != grams[:-1])
    return rows[keep], grams[keep]


def _keys(rows: np.ndarray, grams: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Set size and hash of the set for each of `count` rows (0, 0 for an empty set)."""
    sizes = np.bincount(rows, minlength=count)
    keys = np.zeros(count, np.uint64)
    edges = K.runs(rows)[:-1]
    if len(rows):
        keys[rows[edges]] = K.mix(np.add.reduceat(K.mix(grams), edges) + K._STEP * sizes[rows[edges]].astype(np.uint64))
    return sizes, keys


def _profile(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, total, schema = np.zeros(CELLS, np.int32), 0, pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("cell", pa.int32()), ("seen", pa.int64())])
        for batch in batches:
            ids, text = column(batch, "doc_id"), column(batch, "text")
            for a, b, data, offsets in K.slices(text):
                rows, grams = _sets(data, offsets, size)
                cells += np.bincount((grams >> np.uint64(43)).astype(np.int64), minlength=CELLS).astype(np.int32)
                total += len(grams)
                sizes, keys = _keys(rows, grams, b - a)
                none = pa.nulls(b - a, pa.int32())
                yield pa.record_batch([ids.slice(a, b - a), pa.array(sizes), pa.array(keys.view(np.int64)), none, none.cast(pa.int64())], schema=schema)
        often = np.flatnonzero(cells >= 8 + 4 * total // CELLS)
        if len(often):
            none = pa.nulls(len(often), pa.int64())
            yield pa.record_batch([none, none, none, pa.array(often, pa.int32()), pa.array(cells[often], pa.int64())], schema=schema)

    return run


def _postings(size: int, percent: int, buckets: int, levels: np.ndarray) -> Callable:
    """First shingles of each class in the global order, dealt out by shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in K.slices(column(batch, "text")):
                rows, grams = _sets(data, offsets, size)
                sizes, keys = _keys(rows, grams, b - a)
                level = levels[(grams >> np.uint64(43)).astype(np.int64)]
                order = np.lexsort((grams, level, rows))
                rows, grams = rows[order], grams[order]
                first = np.searchsorted(rows, np.arange(b - a))
                place = np.arange(len(rows)) - first[rows]
                _, once = np.unique(keys, return_index=True)
                chosen = np.zeros(b - a, bool)
                chosen[once] = True
                n = sizes[rows]
                keep = chosen[rows] & (place <= n - (percent * n + 99) // 100 + n // EXTRA)
                yield _packed(K.dealt(grams[keep], buckets, keys[rows[keep]], n[keep].astype(np.int32)), ("token", "key", "n"))

    return run


def _packed(dealt: Iterator[tuple[int, list[bytes]]], names: tuple[str, ...]) -> pa.RecordBatch:
    rows = list(dealt)
    arrays = [pa.array([r[0] for r in rows], pa.int32())] + [pa.array([r[1][k] for r in rows], pa.binary()) for k in range(len(names))]
    return pa.record_batch(arrays, names=["bucket", *names])


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of the lists with at least two classes."""
    token, key, n = K.gathered(batches, ["token", "key", "n"], [np.uint64, np.uint64, np.int32])
    order = np.lexsort((key, token))
    token, key, n = token[order], key[order], n[order]
    keep = np.ones(len(token), bool)
    keep[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])
    token, key, n = token[keep], key[keep], n[keep]
    lengths = np.diff(K.runs(token))
    keep = np.repeat(lengths > 1, lengths)
    token, key, n = token[keep].view(np.int64), key[keep].view(np.int64), n[keep].astype(np.int64)
    for i in range(0, len(token), 1 << 16):
        yield pa.record_batch([pa.array(x[i : i + (1 << 16)]) for x in (token, key, n)], names=["token", "key", "n"])


def _packed_sets(size: int, kept: list[str]) -> Callable:
    """Sets of texts that are of the class asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = column(batch, "key").to_numpy()
            for a, b, data, offsets in K.slices(column(batch, "text")):
                rows, grams = _sets(data, offsets, size)
                _, keys = _keys(rows, grams, b - a)
                where = np.searchsorted(rows, np.arange(b - a + 1))
                mine = np.flatnonzero(keys.view(np.int64) == wanted[a:b])  # the same id may stand for other texts too
                blobs = pa.array([grams[where[i] : where[i + 1]].tobytes() for i in mine.tolist()], pa.binary())
                yield pa.record_batch([*[column(batch, n).take(pa.array(a + mine)) for n in kept], blobs], names=[*kept, "grams"])

    return run


class Index:
    """Inverted index of some sets (all sorted and distinct)."""

    def __init__(self, sets: list[np.ndarray]):
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), [len(c) for c in sets])
        order = np.argsort(flat, kind="stable")
        self.owner, self.sizes, edges = owner[order], np.array([len(c) for c in sets]), K.runs(flat[order])
        self.grams, self.edges = flat[order][edges[:-1]], edges

    def divide_skip(self, query: np.ndarray, percent: int, allowed: np.ndarray | None = None) -> list[tuple[int, int]]:
        """(set, overlap) of every (allowed) set whose overlap with the query reaches `percent` of the union."""
        if not len(query) or not len(self.grams):
            return []
        least = -(-percent * (len(query) + self.sizes) // (100 + percent))
        able = least <= np.minimum(len(query), self.sizes)
        able = able if allowed is None else able & allowed
        if not able.any():
            return []
        at = np.minimum(np.searchsorted(self.grams, query), len(self.grams) - 1)
        at = at[self.grams[at] == query]
        lengths = self.edges[at + 1] - self.edges[at]
        order = np.argsort(lengths, kind="stable")
        at, lengths = at[order], lengths[order]
        needed = int(least[able].min())
        if len(at) < needed:
            return []
        aside = min(int(needed / (_MU * log2(max(2, int(lengths[-1]))) + 1)), needed - 1)
        short, long = at[: len(at) - aside], at[len(at) - aside :]
        if lengths[: len(short)].sum() < MANY:
            merged: dict[int, int] = {}
            for i in heapq.merge(*[self.owner[self.edges[k] : self.edges[k + 1]].tolist() for k in short]):
                merged[i] = merged.get(i, 0) + 1
            left = np.array(sorted(i for i, c in merged.items() if c >= needed - aside and able[i]), np.int64)
            counts = np.array([merged[i] for i in left.tolist()], np.int64)
        else:
            counts = np.bincount(self.owner[K.ranges(self.edges[short], lengths[: len(short)])], minlength=len(self.sizes))
            left = np.flatnonzero((counts >= needed - aside) & able)
            counts = counts[left]
        for k, place in enumerate(long):
            alive = counts + (len(long) - k) >= least[left]
            left, counts = left[alive], counts[alive]
            if not len(left):
                break
            entries = self.owner[self.edges[place] : self.edges[place + 1]]
            at = np.minimum(np.searchsorted(entries, left), len(entries) - 1)  # one bisection for each set that is left
            counts = counts + (entries[at] == left)
        return [(i, c) for i, c, n in zip(left.tolist(), counts.tolist(), least[left].tolist()) if c >= n]


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("overlap", pa.int64())])


def _linked(rows: list[tuple[int, int, int]]) -> pa.Table:
    return pa.table({n: [r[i] for r in rows] for i, n in enumerate(_LINKS.names)}, schema=_LINKS)


def _search_pairs(percent: int) -> Callable:
    """Links among the pairs (x, y) of a group, which holds the set of every class once (rows without y)."""

    def run(table: pa.Table) -> pa.Table:
        is_set = table["y"].is_null().to_numpy()
        keys, others = table["x"].to_numpy(), table["y"].fill_null(0).to_numpy().astype(np.int64)
        grams = table["grams"].to_pylist()
        sets = {int(keys[i]): np.frombuffer(grams[i], np.uint64) for i in np.flatnonzero(is_set).tolist()}
        x, y = keys[~is_set], others[~is_set]
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        edges = K.runs(x)
        out: list[tuple[int, int, int]] = []
        for a, b in zip(edges[:-1], edges[1:]):
            index = Index([sets[k] for k in y[a:b].tolist()])
            out += [(int(x[a]), int(y[a + i]), n) for i, n in index.divide_skip(sets[int(x[a])], percent)]
        return _linked(out)

    return run


def _once(table: pa.Table, *names: str) -> pa.Table:
    """The first row of each value of `names`."""
    seen = set()
    rows = [not (r in seen or seen.add(r)) for r in zip(*(table[n].to_pylist() for n in names))]
    return table.filter(pa.array(rows))


def _search_heads(percent: int) -> Callable:
    """Links of the head of a cluster with the classes of one block."""

    def run(table: pa.Table) -> pa.Table:
        table = _once(table, "key", "asks")
        asks, keys, grams = table["asks"].to_pylist(), table["key"].to_pylist(), table["grams"].to_pylist()
        heads = [i for i, q in enumerate(asks) if q]
        if not heads:
            return _linked([])
        held = [i for i, q in enumerate(asks) if not q and keys[i] != keys[heads[0]]]
        index = Index([np.frombuffer(grams[i], np.uint64) for i in held])
        return _linked([(keys[heads[0]], keys[held[i]], n) for i, n in index.divide_skip(np.frombuffer(grams[heads[0]], np.uint64), percent)])

    return run


def _search_blocks(percent: int) -> Callable:
    """Links between the classes of block `one` and those of block `two` that lie in different components."""

    def run(table: pa.Table) -> pa.Table:
        table = _once(table, "key")
        keys, component, second = table["key"].to_numpy(), table["component"].to_numpy(), table["second"].to_numpy()
        sets = [np.frombuffer(b, np.uint64) for b in table["grams"].to_pylist()]
        same = table["one"][0].as_py() == table["two"][0].as_py()
        held = np.arange(len(keys)) if same else np.flatnonzero(second)
        index = Index([sets[i] for i in held])
        out: list[tuple[int, int, int]] = []
        for q in range(len(keys)) if same else np.flatnonzero(~second).tolist():
            allowed = component[held] != component[q]
            if same:
                allowed[: q + 1] = False
            out += [(int(keys[q]), int(keys[held[i]]), n) for i, n in index.divide_skip(sets[q], percent, allowed)]
        return _linked(out)

    return run


def _shared_most(percent: int) -> Callable:
    """Pairs of one long list, a block of it against a block, that share enough lists: each at the least of the long lists they share."""

    def run(table: pa.Table) -> pa.Table:
        token, second = table["token"][0].as_py(), table["second"].to_numpy()
        same = table["one"][0].as_py() == table["two"][0].as_py()
        keys, n, component, cluster = (table[c].to_numpy() for c in ("key", "n", "component", "cluster"))
        every, longs = ([x.values.to_numpy() for x in table[c].combine_chunks()] for c in ("every", "longs"))
        held = np.arange(len(keys)) if same else np.flatnonzero(second)
        owner = np.repeat(np.arange(len(held)), [len(every[i]) for i in held])
        lists = np.concatenate([every[i] for i in held]) if len(held) else np.zeros(0, np.int64)
        order = np.argsort(lists, kind="stable")
        lists, owner = lists[order], owner[order]
        out: list[tuple[int, int]] = []
        for q in range(len(keys)) if same else np.flatnonzero(~second).tolist():
            first, last = np.searchsorted(lists, every[q], "left"), np.searchsorted(lists, every[q], "right")
            met = np.bincount(owner[K.ranges(first, last - first)], minlength=len(held))
            least, most = np.minimum(n[q], n[held]), np.maximum(n[q], n[held])
            fits = (met > least // EXTRA) & (100 * least >= percent * most) & (component[held] != component[q]) & (cluster[held] != cluster[q])
            if same:
                fits[: q + 1] = False
            for i in held[fits].tolist():
                if np.intersect1d(longs[q], longs[i])[0] == token:
                    out.append((min(int(keys[q]), int(keys[i])), max(int(keys[q]), int(keys[i]))))
        return pa.table({"x": pa.array([x for x, _ in out], pa.int64()), "y": pa.array([y for _, y in out], pa.int64())})

    return run


def _across_clusters(lists: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of classes of different clusters and components that share enough of the `lists(token, key)`.

    Short lists are paired by a join, at most `SHORT` rows for each. Of a long list the classes go to blocks with the lists they
    are in, and the blocks are searched, so only pairs that do share enough leave it. A pair with a long list in common is
    judged there, by all its lists; any other has short lists only, and the join counts them all.
    """
    listed = Window.partitionBy("token")
    there = lists.join(placed.select("key", "cluster", "component"), "key")
    for name in ("component", "cluster"):
        there = there.withColumn(f"mixed_{name}", F.min(name).over(listed) != F.max(name).over(listed))
    there = there.withColumn("size", F.count("*").over(listed)).where("mixed_component and mixed_cluster").select("token", "key", "size")
    there = staged(there.join(placed, "key"), "listed")
    short = there.where(F.col("size") <= SHORT)
    left = short.selectExpr("token", "key as x", "n as n_x", "component as c_x", "cluster as g_x")
    right = short.selectExpr("token", "key as y", "n as n_y", "component as c_y", "cluster as g_y")
    pairs = left.join(right, "token").where("c_x <> c_y and g_x <> g_y and x < y").where(f"100 * least(n_x, n_y) >= {percent} * greatest(n_x, n_y)")
    pairs = pairs.groupBy("x", "y").agg(F.count("*").alias("shared"), F.first(F.least("n_x", "n_y")).alias("n")).where(f"shared > floor(n / {EXTRA})").select("x", "y")

    far = there.where(F.col("size") > SHORT).select("token", "key", "size")
    longs = there.groupBy("key").agg(F.sort_array(F.collect_list("token")).alias("every"), F.sort_array(F.collect_list(F.when(F.col("size") > SHORT, F.col("token")))).alias("longs")).where(F.size("longs") > 0)
    blocks = F.ceil(F.col("size") / LIST_BLOCK)
    rows = far.join(longs.join(placed, "key"), "key").withColumn("part", F.pmod(F.xxhash64("key"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    rows = rows.select("token", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"), (F.col("part") > F.col("other")).alias("second"), "key", "n", "component", "cluster", "every", "longs")
    return pairs.unionByName(rows.groupBy("token", "one", "two").applyInArrow(_shared_most(percent), "x long, y long"))


def _among_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among candidate pairs (x, y); `sets` holds (key, cluster, part, grams). A set travels once for two blocks."""
    where = sets.select("key", F.xxhash64("cluster", "part").alias("block")).distinct()
    pairs = pairs.select("x", "y").join(where.toDF("x", "block_x"), "x").join(where.toDF("y", "block_y"), "y")
    pairs = staged(pairs.select(F.least("block_x", "block_y").alias("one"), F.greatest("block_x", "block_y").alias("two"), "x", "y"), "pairs")
    members = pairs.select("one", "two", F.explode(F.array("x", "y")).alias("key")).distinct()
    held = members.join(sets.select("key", "grams"), "key").select("one", "two", F.col("key").alias("x"), F.lit(None).cast("long").alias("y"), "grams")
    asked = pairs.withColumn("grams", F.lit(None).cast("binary"))
    return held.unionByName(asked).groupBy("one", "two").applyInArrow(_search_pairs(percent), "a long, b long, overlap long")


def _by_heads(sets: DataFrame, percent: int) -> DataFrame:
    """Links of every class with the head of its cluster; the head goes to every block of the cluster."""
    members = sets.select("cluster", "part", "key", "grams", F.lit(False).alias("asks"))
    parts_of = F.explode(F.sequence(F.lit(0).cast("long"), F.col("head_of") - 1))
    heads = sets.where("head_of is not null").select(F.col("key").alias("cluster"), parts_of.alias("part"), "key", "grams", F.lit(True).alias("asks"))
    return members.unionByName(heads).groupBy("cluster", "part").applyInArrow(_search_heads(percent), "a long, b long, overlap long")


def _within_clusters(sets: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """Links between different components of a cluster, block by block; two classes have met if one of them is the head."""
    headed = F.max(F.col("key") == F.col("cluster")).alias("headed")
    mixed = placed.groupBy("cluster").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"), headed).where("low <> high and (size > 2 or not headed)")
    wanted = placed.join(mixed.select("cluster"), "cluster").select("key", "component", "blocks")
    copies = sets.select("cluster", "part", "key", "grams").join(wanted, "key").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    rows = copies.select("cluster", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"), (F.col("part") > F.col("other")).alias("second"), "key", "component", "grams")
    return rows.groupBy("cluster", "one", "two").applyInArrow(_search_blocks(percent), "a long, b long, overlap long")


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, class_key, component_id) for every row; links need 100 |x and y| >= percent |x or y|."""
    spark = docs.sparkSession
    buckets = parts(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    profile = staged(docs.mapInArrow(handed_back(_profile(size)), _PROFILE), "profile")
    levels = np.zeros(CELLS, np.uint8)
    often = profile.where("cell is not null").groupBy("cell").agg(F.sum("seen").alias("seen")).toArrow()  # at most CELLS / 4 rows
    levels[often["cell"].to_numpy()] = np.log2(often["seen"].to_numpy().astype(float)).astype(np.uint8)
    known = profile.where("cell is null").select("doc_id", "n", "key")
    classes = known.where("n > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"))

    dealt = docs.where("doc_id is not null").select("text").mapInArrow(handed_back(_postings(size, percent, buckets, levels)), "bucket int, token binary, key binary, n binary")
    lists = staged(dealt.repartition(buckets, "bucket").mapInArrow(handed_back(_lists), "token long, key long, n long"), "lists")
    shared = lists.groupBy("key").agg(F.count("*").alias("shared"), F.first("n").alias("n")).where(f"shared > floor(ceil(n * {percent} / 100) / {EXTRA})")
    shared = staged(shared, "shared")
    ranked = lists.select("token", "key").join(shared.select("key", (F.col("shared") / F.col("n")).alias("rank")), "key")
    # one exchange by list: a window streams, and spills, where an aggregate and a join back would exchange twice
    listed = Window.partitionBy("token")
    ranked = ranked.withColumn("hub", F.max(F.struct("rank", "key")).over(listed)).withColumn("size", F.count("*").over(listed))
    unranked, lists = lists, staged(ranked.where("size > 1").selectExpr("token", "key", "hub.key as hub"), "lists")
    for folder in {file.rsplit("/", 1)[0] for file in unranked.inputFiles()}:
        remove(spark, folder)

    # one exchange by class for both counts
    placed = lists.select("key", "hub").repartition(buckets, "key").groupBy("key", "hub").agg(F.count("*").alias("times")).groupBy("key").agg(F.max_by("hub", F.struct("times", "hub")).alias("hub"))
    placed = staged(placed.join(shared.select("key", "n"), "key"), "placed")
    placed = placed.join(placed.select(F.col("key").alias("hub"), F.col("hub").alias("cluster")), "hub", "left").select("key", "n", F.coalesce("cluster", "hub").alias("cluster"))
    room = placed.groupBy("cluster").agg(F.ceil(F.greatest(F.sum("n") / BLOCK, F.count("*") / BLOCK_CLASSES)).alias("blocks"))
    heads = room.select(F.col("cluster").alias("key"), F.col("blocks").alias("head_of"))
    placed = placed.join(room, "cluster").join(heads, "key", "left").withColumn("part", F.pmod(F.xxhash64("key"), F.col("blocks")))
    placed = staged(placed.join(classes, "key").select("doc_id", "key", "n", "cluster", "part", "blocks", "head_of"), "placed")
    fetched = placed.drop("blocks", "n")
    fetched = F.broadcast(fetched) if placed.count() <= FETCHED else fetched
    names = ["key", "cluster", "part", "head_of"]
    sets = docs.join(fetched, "doc_id").select(*names, "text").mapInArrow(handed_back(_packed_sets(size, names)), "key long, cluster long, part long, head_of long, grams binary")
    sets = staged(sets, "sets")

    within = f"100 * least(n_x, n_y) >= {percent} * greatest(n_x, n_y)"
    links = staged(_by_heads(sets, percent), "found")
    joined = components(links.select("a", "b"))
    placed = placed.join(joined.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    placed = staged(placed, "placed")

    across = _across_clusters(lists.select("token", "key"), placed.select("key", "n", "cluster", "component"), percent)
    links = staged(links.unionByName(_within_clusters(sets, placed, percent)).unionByName(_among_pairs(across, sets, percent)), "found")

    joined = components(links.select("a", "b"))
    named = classes.join(joined.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = staged(named.join(smallest, "component").select("key", "component_id"), "named")
    out = known.join(named, "key", "left")
    alone = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n") > 0, F.col("component_id")), F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("key").alias("class_key"), alone.alias("component_id"))
