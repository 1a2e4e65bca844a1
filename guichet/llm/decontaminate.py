"""Benchmark decontamination over a positional inverted index of the training texts.

The index is a table of blocks, each holding some documents whole: sorted terms, the places of each term (word numbers
that run on through the block), and where each document starts. It is built once, in one pass and without an exchange,
stored in the shared folder, and searched by any number of benchmarks. Only terms that a benchmark can ask for need to
be stored (`terms`); without that list all are.

A phrase is searched from its rarest terms: the places of the rarest one, less its offset in the phrase, are the
possible starts, and every further term, in order of rarity, keeps those starts at which its own offset-adjusted list
has an entry. Proximity matches take the rarest term's places and look for the narrowest stretch around each that
holds all terms.

The benchmark goes to the tasks in passes of at most PASS_CHARS characters each, so what is broadcast never grows
with it. A null or wordless text has no words and no hits; a null or wordless item has no window; rows with repeated or
null ids are reported one by one; items that repeat count once for each distinct id.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guichet.llm import kernels as K
from guichet.llm.common import column, handed_back, staged

WINDOW = 13
#: Characters of benchmark text searched in one pass over the index.
PASS_CHARS = 1 << 23
#: Possible starts that a task holds at once.
STARTS = 1 << 20
_INDEX = "block string, ids array<long>, first array<long>, words long, terms binary, heads binary, places binary"


def _text_words(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts, and the number of words up to each text."""
    data, offsets = K.buffers(text)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    starts, ends, row = K.words(data, offsets, K.ALNUM)
    return K.word_hashes(data, starts, ends), np.searchsorted(row, np.arange(len(offsets)))


def _indexer(terms: np.ndarray | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = uuid.uuid4().hex
        serial = 0
        for batch in batches:
            ids = column(batch, "doc_id").to_pylist()
            for a, b, data, offsets in K.slices(column(batch, "text")):
                starts, ends, row = K.words(data, offsets, K.ALNUM)
                hashes = K.word_hashes(data, starts, ends)
                place = np.arange(len(hashes), dtype=np.int32)
                if terms is not None:
                    place = place[_member(terms, hashes)]
                order = np.argsort(hashes[place], kind="stable")
                place = place[order]
                edges = K.runs(hashes[place])
                found = hashes[place[edges[:-1]]]
                first = np.searchsorted(row, np.arange(b - a))
                serial += 1
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": [f"{name}-{serial}"], "ids": pa.array([ids[a:b]], pa.list_(pa.int64())), "first": pa.array([first.tolist()], pa.list_(pa.int64())),
                        "words": [len(hashes)], "terms": [found.tobytes()], "heads": [edges.astype(np.int64).tobytes()], "places": [place.tobytes()],
                    },
                )

    return run


def _member(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def build_index(docs: DataFrame, terms: np.ndarray | None = None) -> DataFrame:
    """Positional index of `docs(doc_id, text)`; with `terms` (sorted word hashes) only of those."""
    return staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(handed_back(_indexer(terms)), _INDEX), "positions")


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Block, ids, first places, number of words, terms, heads, places."""
    for batch in batches:
        for i in range(batch.num_rows):  # the lists of a row stay where they are, and its ids are objects for that row alone
            r = {name: batch.column(name)[i] for name in batch.schema.names}
            words = r["words"].as_py()
            terms, heads, places = (np.frombuffer(r[n].as_buffer(), kind) for n, kind in (("terms", np.uint64), ("heads", np.int64), ("places", np.int32)))
            yield r["block"].as_py(), r["ids"].as_py(), np.append(r["first"].values.to_numpy(), words), words, terms, heads, places


def _phrases(terms: np.ndarray, heads: np.ndarray, places: np.ndarray, words: int, first: np.ndarray, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, start) of every occurrence of `windows` (rows of term hashes, `lengths` of them used) in a block."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(terms) or not len(windows):
        return none
    used = np.arange(windows.shape[1]) < lengths[:, None]
    at = np.minimum(np.searchsorted(terms, windows), len(terms) - 1)
    alive = np.flatnonzero(((terms[at] == windows) | ~used).all(axis=1))
    counts = np.where(used[alive], np.diff(heads)[at[alive]], np.iinfo(np.int64).max)
    order = np.argsort(counts, axis=1, kind="stable")
    # the lists as one table by place: an entry of term t at place p stands there as t
    lists = np.full(words, -1, np.int32)
    lists[places] = np.repeat(np.arange(len(terms), dtype=np.int32), np.diff(heads))
    rarest = counts[np.arange(len(alive)), order[:, 0]] if len(alive) else np.zeros(0, np.int64)
    out: list[tuple[np.ndarray, np.ndarray]] = [none]
    upto = np.cumsum(rarest)
    i = 0
    while i < len(alive):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + STARTS, side="right")))
        w = np.repeat(np.arange(i, j), rarest[i:j])
        lead = order[i:j, 0]
        start = places[K.ranges(heads[at[alive[i:j], lead]], rarest[i:j])].astype(np.int64) - np.repeat(lead, rarest[i:j])
        keep = (start >= 0) & (start + lengths[alive[w]] <= words)
        w, start = w[keep], start[keep]
        for k in range(1, windows.shape[1]):
            off = order[w, k]
            live = off < lengths[alive[w]]
            keep = ~live | (lists[np.minimum(start + off, words - 1)] == at[alive[w], off])
            w, start = w[keep], start[keep]
        last = start + lengths[alive[w]] - 1
        keep = np.searchsorted(first, start, side="right") == np.searchsorted(first, last, side="right")
        out.append((alive[w[keep]], start[keep]))
        i = j
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def _windows(items: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    """Distinct windows (one row each), their lengths, and the ids of the items holding them."""
    hashes, upto = _text_words(items["text"].combine_chunks())
    names = items["item_id"].to_pylist()
    seen: dict[bytes, int] = {}
    holders: list[set[str]] = []
    for name, a, b in zip(names, upto[:-1], upto[1:]):
        for s in range(a, max(a + 1, b - size + 1)) if b > a and name is not None else ():
            w = seen.setdefault(hashes[s : min(s + size, b)].tobytes(), len(holders))
            if w == len(holders):
                holders.append(set())
            holders[w].add(name)
    windows, lengths = np.zeros((len(holders), size), np.uint64), np.zeros(len(holders), np.int64)
    for key, w in seen.items():
        lengths[w] = len(key) // 8
        windows[w, : lengths[w]] = np.frombuffer(key, np.uint64)
    return windows, lengths, [sorted(h) for h in holders]


def _hits(windows: np.ndarray, lengths: np.ndarray, holders: list[list[str]]) -> Callable:
    """Rows (block, row, spans of hit words, items) of the documents that hold a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block", pa.string()), ("row", pa.int32()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("items", pa.list_(pa.string()))])
        for block, _, first, words, terms, heads, places in _opened(batches):
            w, start = _phrases(terms, heads, places, words, first, windows, lengths)
            order = np.argsort(start, kind="stable")
            w, start = w[order], start[order]
            row = np.searchsorted(first, start, side="right") - 1
            # an empty document starts where the next one does: its row is the last of those with this start
            edges = K.runs(row)
            rows: dict[str, list] = {"block": [], "row": [], "spans": [], "items": []}
            for a, b in zip(edges[:-1], edges[1:]):
                base = first[row[a]]
                stop = np.maximum.accumulate(start[a:b] + lengths[w[a:b]])
                cut = np.flatnonzero(start[a + 1 : b] > stop[:-1]) + 1
                lows, highs = np.concatenate([[0], cut]), np.concatenate([cut, [b - a]]) - 1
                rows["block"].append(block), rows["row"].append(int(row[a]))
                rows["spans"].append([{"start": int(start[a + x] - base), "stop": int(stop[y] - base)} for x, y in zip(lows, highs)])
                rows["items"].append(sorted({h for x in np.unique(w[a:b]) for h in holders[x]}))
            if rows["block"]:
                yield pa.record_batch(rows, schema=schema)

    return run


def _covered(spans: Column) -> Column:
    """Number of words in the union of some spans."""
    begin = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("reach"))
    step = lambda acc, s: F.struct(
        (acc["hit"] + F.greatest(F.lit(0).cast("long"), s["stop"] - F.greatest(s["start"], acc["reach"]))).alias("hit"), F.greatest(acc["reach"], s["stop"]).alias("reach"),
    )
    return F.aggregate(F.array_sort(spans), begin, step, lambda acc: acc["hit"])


def _passes(items: DataFrame) -> Iterator[pa.Table]:
    items = items.where("item_id is not null and text is not null")
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    count = max(1, math.ceil(chars / PASS_CHARS))
    for k in range(count):
        yield items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).toArrow()


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans) for every row of `docs(doc_id, text)`, against `items(item_id, text)`."""
    passes = list(_passes(items.select(F.col("item_id").cast("string").alias("item_id"), "text")))
    terms = np.unique(np.concatenate([_text_words(p["text"].combine_chunks())[0] for p in passes])) if len(passes) == 1 else None
    index = build_index(docs, terms)
    found = [index.mapInArrow(handed_back(_hits(*_windows(p, window))), "block string, row int, spans array<struct<start: long, stop: long>>, items array<string>") for p in passes]
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    hits = hits.groupBy("block", "row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    ends = F.concat(F.slice("first", 2, F.greatest(F.size("first") - 1, F.lit(0))), F.array("words"))
    rows = index.select("block", F.posexplode(F.arrays_zip("ids", "first", ends.alias("next"))).alias("row", "d"))
    rows = rows.select("block", "row", F.col("d.ids").alias("doc_id"), (F.col("d.next") - F.col("d.first")).alias("n_words"))
    out = rows.join(hits, ["block", "row"], "left")
    none = F.array().cast("array<string>")
    return out.select("doc_id", "n_words", F.coalesce(_covered(F.col("spans")), F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"), "spans")


def is_contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def _stretches(phrases: list[tuple[str, np.ndarray]], width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])
        for _, ids, first, _, terms, heads, places in _opened(batches):
            out: dict[str, list] = {n: [] for n in schema.names}
            for name, wanted in phrases:
                if not len(wanted) or not _member(terms, wanted).all():
                    continue
                at = np.searchsorted(terms, wanted)
                lists = sorted((places[heads[t] : heads[t + 1]].astype(np.int64) for t in at), key=len)
                near = set()
                for p in lists[0]:
                    low, high = first[np.searchsorted(first, p, side="right") - 1], first[np.searchsorted(first, p, side="right")]
                    low, high = max(low, p - width + 1), min(high, p + width)
                    around = [x[np.searchsorted(x, low) : np.searchsorted(x, high)] for x in lists[1:]]
                    for begin in sorted({int(p), *(int(y) for x in around for y in x if y <= p)}, reverse=True):
                        last = [x[np.searchsorted(x, begin)] if np.searchsorted(x, begin) < len(x) else np.inf for x in around]
                        stop = max([p, *last]) + 1
                        if stop - begin <= width:
                            near.add((begin, int(stop)))
                            break
                for begin, stop in sorted(near):
                    row = int(np.searchsorted(first, begin, side="right")) - 1
                    out["doc_id"].append(ids[row]), out["item_id"].append(name), out["start"].append(int(begin - first[row])), out["stop"].append(int(stop - first[row]))
            if out["doc_id"]:
                yield pa.record_batch(out, schema=schema)

    return run


def proximity(index: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """(doc_id, item_id, start, stop): stretches of at most `width` words that hold every distinct word of an item."""
    found = None
    for p in _passes(items.select(F.col("item_id").cast("string").alias("item_id"), "text")):
        hashes, upto = _text_words(p["text"].combine_chunks())
        phrases = [(n, np.unique(hashes[a:b])) for n, a, b in zip(p["item_id"].to_pylist(), upto[:-1], upto[1:])]
        near = index.mapInArrow(_stretches(phrases, width), "doc_id long, item_id string, start long, stop long")
        found = near if found is None else found.unionByName(near)
    return found.distinct()
