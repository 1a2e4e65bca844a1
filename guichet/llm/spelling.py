"""Spelling variants: words one code point apart, found by pairs of trie nodes.

The nodes of the trie of all words and of the trie of all reversed words are numbered; a word of m code points is then
a path of m + 1 forward nodes (its prefixes) and one of m + 1 backward nodes (its suffixes). A pair (prefix node, suffix
node) stands for the two ends of a word. Each word gives the pairs of its splits, and the pairs that skip one of its code
points. Words meet in a pair exactly if

* both skip a code point there: they differ in that code point;
* one skips and the other splits there: the other is the first without that code point.

So equal numbers are equal strings, and no candidate has to be checked. Of a run of equal code points only the first
counts as left out, so every two words meet once as longer and shorter; two words of one length meet at one place only.
What meets in a pair is at most one word for each code point of the alphabet, and one more. Within a pair no two words are
put together: its members need how many others there are and the two most frequent of them.

Numbering: words are sorted over ranges of partitions, and every partition numbers what its words add to the path of the
word before. The first word of a partition inherits the nodes it shares with the last word before it; for that the
driver walks over two words of each partition (their lengths times the partitions bound what it holds), and nothing else.
A word's last node is new in sorted order, so the numbers of last nodes stand for the words and sort like them.

All occurrences are counted; within tasks first, so a word on a third of all rows is no large group. Null words are
left out. The columns of the result are its own, so further columns of the input do not matter.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guichet.llm.common import parts, staged
from guichet.session import checkpoint_root

SHORTEST, LEAST, RATIO = 5, 3, 2
#: Nodes are numbered within partitions; the partition's number stands above so many bits.
_BITS = 40
_ROOT = -1
_ENDS = "part bigint, first string, last string, nodes array<bigint>"
_PATHS = pa.schema([("word", pa.string()), ("n", pa.int64()), ("nodes", pa.list_(pa.int64())), ("fresh", pa.list_(pa.bool_()))])


def _walk(keys: Iterable[str], word: str, path: list[int], base: int) -> Iterator[list[int]]:
    """Nodes of every prefix of each of the sorted keys; `path` has those of the `word` before them."""
    for key in keys:
        shared = len(os.path.commonprefix((word, key)))
        path = path[: shared + 1] + list(range(base + shared + 1, base + len(key) + 1))
        base += len(key) + 1
        word = key
        yield path


def _first_number() -> int:
    return TaskContext.get().partitionId() << _BITS


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and last key of a partition, and the nodes of the last as this partition alone numbers them."""
    first, last, path, base = None, "", [_ROOT], _first_number()
    for batch in batches:
        keys = batch.column("key").to_pylist()
        for path in _walk(keys, last, path, base):
            pass
        if keys:
            first, last = keys[0] if first is None else first, keys[-1]
            base += sum(map(len, keys)) + len(keys)
    if first is not None:
        yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "first": first, "last": last, "nodes": path}])


def _inherited(ends: list) -> dict[int, tuple[str, list[int]]]:
    """For each partition, what its first key shares with the key before it, and the nodes of that."""
    given, before, path = {}, "", [_ROOT]
    for row in sorted(ends, key=lambda r: r["part"]):
        shared = os.path.commonprefix((before, row["first"]))
        given[row["part"]] = shared, path[: len(shared) + 1]
        kept = min(len(shared), len(os.path.commonprefix((row["first"], row["last"]))))
        before, path = row["last"], path[: kept + 1] + row["nodes"][kept + 1 :]
    return given


def trie_paths(words: DataFrame, key: Column) -> DataFrame:
    """(word, n, nodes, fresh) of `words(word, n)`: the trie node of every prefix of the key, and whether each code point differs from the one before."""
    spark = words.sparkSession
    checkpoint_root(spark)
    ordered = words.select("word", "n", key.alias("key")).repartitionByRange(parts(spark), "key").sortWithinPartitions("key").checkpoint()
    given = _inherited(ordered.select("key").mapInArrow(_ends, _ENDS).collect())

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, path = given.get(TaskContext.get().partitionId(), ("", [_ROOT]))
        base = _first_number()
        for batch in batches:
            keys = batch.column("key").to_pylist()
            paths = list(_walk(keys, word, path, base))
            fresh = [[i == 0 or k[i] != k[i - 1] for i in range(len(k))] for k in keys]
            if keys:
                word, path = keys[-1], paths[-1]
                base += sum(map(len, keys)) + len(keys)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(paths, _PATHS.field("nodes").type), pa.array(fresh, _PATHS.field("fresh").type)], schema=_PATHS)

    return ordered.mapInArrow(number, "word string, n bigint, nodes array<bigint>, fresh array<boolean>")


def _pairs(paths: DataFrame) -> DataFrame:
    """(prefix, suffix, n, id, skips, drops): every split of a word, and every place where it skips a code point (`drops`: leaving it out counts)."""
    split = "transform(nodes, (p, i) -> named_struct('prefix', p, 'suffix', ends[size(nodes) - 1 - i], 'skips', false, 'drops', false))"
    skip = "transform(fresh, (f, i) -> named_struct('prefix', nodes[i], 'suffix', ends[size(nodes) - 2 - i], 'skips', true, 'drops', f))"
    return paths.select("n", "id", F.expr(f"inline(concat({split}, {skip}))"))


def near_words(paths: DataFrame) -> DataFrame:
    """(id, n_near, best_n, best) of every word of `paths(id, n, nodes, fresh, ends)` with words one code point apart: their number, and the most frequent (first in order) of them."""
    member = F.struct("n", (-F.col("id")).alias("less"), "drops")
    met = _pairs(paths).groupBy("prefix", "suffix").agg(
        F.collect_list(F.when(F.col("skips"), member)).alias("longer"),
        F.max(F.when(~F.col("skips"), F.struct("n", (-F.col("id")).alias("less")))).alias("shorter"),
    )
    met = met.where((F.size("longer") > 1) | (F.size("longer") == 1) & F.col("shorter").isNotNull())
    met = met.select("longer", "shorter", F.slice(F.sort_array("longer", asc=False), 1, 2).alias("top"))
    of_longer = """transform(longer, m -> named_struct('less', m.less,
      'near', size(longer) - 1 + if(m.drops and shorter is not null, 1, 0),
      'best', greatest(if(m.less = top[0].less, if(size(top) > 1, named_struct('n', top[1].n, 'less', top[1].less), null), named_struct('n', top[0].n, 'less', top[0].less)), if(m.drops, shorter, null))))"""
    of_shorter = """transform(array(filter(longer, m -> m.drops)), d -> named_struct('less', shorter.less,
      'near', size(d), 'best', array_max(transform(d, m -> named_struct('n', m.n, 'less', m.less)))))"""
    each = met.select(F.expr(f"inline(concat({of_longer}, if(shorter is null, array(), {of_shorter})))")).where("near > 0")
    found = each.groupBy("less").agg(F.sum("near").alias("n_near"), F.max("best").alias("best"))
    return found.select((-F.col("less")).alias("id"), "n_near", F.col("best.n").alias("best_n"), (-F.col("best.less")).alias("best"))


def _roots(links: DataFrame) -> DataFrame:
    """(id, root): where the pointers of `links(id, to)` end. Each round doubles the steps; a form is so many times as frequent, so few rounds do."""
    ends, moved = staged(links, "forms"), True
    while moved:
        after = ends.select(F.col("id").alias("to"), F.col("to").alias("next"))
        ends = staged(ends.join(after, "to", "left").select("id", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "forms")
        moved = not ends.where("moved").isEmpty()
        ends = ends.drop("moved")
    return ends.withColumnRenamed("to", "root")


def variants(occurrences: DataFrame, word: str = "word", shortest: int = SHORTEST, least: int = LEAST, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each distinct word of at least `shortest` code points with at least `least` rows in `occurrences`.

    `n` is the number of its rows and `n_near` that of its near words: the words that differ by one inserted, deleted or
    replaced code point. The form is the near word of largest n (ties: the first in code-point order) if that is at least
    `ratio` times the word's own, else null; the root is where forms lead to, the word itself if it has none. A `ratio`
    of 2 or more is needed for the forms to end. Words of no code points, like null, are left out.
    """
    if ratio < 2:
        raise ValueError("forms must be at least twice as frequent")
    counts = occurrences.select(F.col(word).alias("word")).where(F.length("word") >= max(1, shortest)).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    counts = staged(counts, "words")
    ahead = trie_paths(counts, F.col("word")).select("word", "n", "nodes", "fresh", F.element_at("nodes", -1).alias("id"))
    back = trie_paths(counts, F.reverse("word")).select("word", F.col("nodes").alias("ends"))
    paths = staged(ahead.join(back, "word"), "paths")
    words = paths.select("id", "word", "n")
    near = staged(near_words(paths), "near")
    known = words.join(near, "id", "left").withColumn("to", F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best")))
    known = staged(known.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "to", F.when(F.col("to").isNotNull(), F.col("best_n")).alias("form_n")), "known")
    roots = _roots(known.where("to is not null").select("id", "to"))
    named = words.select("id", "word")
    out = known.join(roots, "id", "left").join(named.select(F.col("id").alias("to"), F.col("word").alias("form")), "to", "left")
    out = out.join(named.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root", "left")
    return out.select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
