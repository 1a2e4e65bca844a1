"""Suffix-array dedup: every byte covered by a long string that starts anywhere else too is removed.

Only some suffixes need sorting. Each window of LENGTH bytes is anchored at the smallest (by hash, then leftmost)
LENGTH / 2-byte string inside it; equal windows have their anchor at the same place, so windows are compared only where
they share the anchor's string. Neighbouring windows of one anchor form a segment: its suffix starts at the anchor, and
what stands before the anchor belongs to it as well.

1.  All segments are dealt out by the hash of the anchor's string, 22 bytes each. A string that occurs once leaves; a
    segment whose bytes all occur twice (copies) is settled; what remains meets other segments at its anchor only partly.
2.  The remaining segments are range-partitioned by the leading bytes of their suffix, with splitters sampled by Spark.
    Each bucket sorts suffixes, and the reversed bytes before them, by multikey quicksort on eight-byte letters. From
    the common prefixes of neighbours follows, for each distance d of window start and anchor, which segments agree on
    d bytes before and the rest behind: those windows repeat.
3.  Suffixes with one lead never lie in two buckets, except in groups of more than HOT: there the lead is lengthened to
    the whole window, and windows are compared across all buckets by a 128-bit hash.

A null text is empty. Texts shorter than LENGTH are never changed. Rows with equal id and text get equal results, and
are copies of each other; a null id is an id like any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guichet.llm import kernels as K
from guichet.llm.common import column, parts, staged

LENGTH = 400
_GRAM = LENGTH // 2
_SPAN = LENGTH - _GRAM + 1
#: Segments of one lead that a bucket sorts; larger groups are split by a longer lead.
HOT = 4096
_SLICE = 1 << 20
_ODD = (0x5851F42D4C957F2D, 0xD1342543DE82EF95)
_U8 = np.uint64(8)


class _Prefix:
    """Polynomial hash of any stretch of some bytes, modulo 2**64."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, odd: int = _ODD[0]):
        power, self.inverse = self._tables(odd, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=self.sums[1:])

    @classmethod
    def _tables(cls, odd: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        have = cls._powers.get(odd)
        if have is None or len(have[0]) < size:
            size = max(size, _SLICE + 1)
            have = tuple(np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, np.uint64(x))])) for x in (odd, pow(odd, -1, 1 << 64)))
            if size <= 4 * _SLICE:
                cls._powers[odd] = have
        return have

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return K.mix((self.sums[stop] - self.sums[start]) * self.inverse[start] + (stop - start).astype(np.uint64) * K._STEP)


def _segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...] | None:
    """Row, first window, last window, anchor, hash of the anchor's string, hash of all bytes, for every segment."""
    if len(data) < LENGTH:
        return None
    prefix = _Prefix(data)
    count = len(data) - _GRAM + 1
    grams = K.mix((prefix.sums[_GRAM:] - prefix.sums[:count]) * prefix.inverse[:count])
    blocks = -(-count // _SPAN) + 1
    ranked = np.full(blocks * _SPAN, np.iinfo(np.uint64).max, np.uint64)
    ranked[:count] = grams
    ranked &= ~np.uint64(0xFF)
    ranked = ranked.reshape(blocks, _SPAN) | np.arange(_SPAN, dtype=np.uint64)
    ahead = np.minimum.accumulate(ranked, axis=1).ravel()
    behind = np.minimum.accumulate(ranked[:, ::-1], axis=1)[:, ::-1].ravel()
    del ranked
    lengths = np.diff(offsets)
    windows = np.maximum(lengths - LENGTH + 1, 0)
    start = K.ranges(offsets[:-1], windows)
    if not len(start):
        return None
    here, there = behind[start], ahead[start + _SPAN - 1]
    near = (here >> _U8) <= (there >> _U8)
    low = np.uint64(0xFF)
    anchor = np.where(near, start - start % _SPAN + (here & low).astype(np.int64), start + _SPAN - 1 - (start + _SPAN - 1) % _SPAN + (there & low).astype(np.int64))
    edges = K.runs(anchor)
    first, last, anchor = start[edges[:-1]], start[edges[1:] - 1], anchor[edges[:-1]]
    row = np.searchsorted(offsets, first, side="right") - 1
    return row, first, last, anchor, grams[anchor], prefix.of(first, last + LENGTH)


def _anchored(buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = column(batch, "doc").to_numpy()
            for a, _, data, offsets in K.slices(column(batch, "text"), _SLICE):
                found = _segments(data, offsets)
                if found is None:
                    continue
                row, first, last, anchor, key, whole = found
                packed = list(K.dealt(key, buckets, whole, docs[a + row], anchor - offsets[row], (anchor - first).astype(np.uint8), (last - first).astype(np.uint8)))
                yield pa.record_batch([pa.array([p[0] for p in packed], pa.int32())] + [pa.array([p[1][k] for p in packed], pa.binary()) for k in range(6)], names=["bucket", *_PACKED])

    return run


_PACKED = ("key", "whole", "doc", "anchor", "left", "width")
_KINDS = [np.uint64, np.uint64, np.int64, np.int64, np.uint8, np.uint8]


def _by_doc(doc: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    order = np.argsort(doc, kind="stable")
    edges = K.runs(doc[order])
    packed = [c[order] for c in columns]
    for a, b in zip(edges[:-1], edges[1:]):
        yield int(doc[order[a]]), [c[a:b].tobytes() for c in packed]


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each document: spans that certainly repeat, and segments to compare (key, anchor, left, width)."""
    key, whole, doc, anchor, left, width = K.gathered(batches, list(_PACKED), _KINDS)
    order = np.lexsort((whole, key))
    key, whole, doc, anchor, left, width = (x[order] for x in (key, whole, doc, anchor, left, width))
    edges = K.runs(key)
    sizes = np.repeat(np.diff(edges), np.diff(edges))
    same = np.ones(len(key), bool)
    same[1:] = (whole[1:] != whole[:-1]) | (key[1:] != key[:-1])  # first of each distinct segment
    inner = K.runs(np.cumsum(same))
    copies = np.repeat(np.diff(inner), np.diff(inner))
    kinds = np.repeat(np.add.reduceat(same.astype(np.int64), edges[:-1]), np.diff(edges)) if len(key) else np.zeros(0, np.int64)
    done = copies > 1
    start = anchor - left
    spans = (_by_doc(doc[done], start[done], (start + width + LENGTH)[done]), ("start", "stop"))
    ask = (kinds > 1) & same & (sizes > 1)  # one of each distinct segment; those of `done` only to be compared with
    wanted = (_by_doc(doc[ask], key[ask], anchor[ask], left[ask], width[ask]), ("key", "anchor", "left", "width"))
    names = ("start", "stop", "key", "anchor", "left", "width")
    for rows, filled in (spans, wanted):
        held: dict[str, list] = {n: [] for n in ("doc", *names)}
        for d, blobs in rows:
            held["doc"].append(d)
            for n in names:
                held[n].append(blobs[filled.index(n)] if n in filled else b"")
            if len(held["doc"]) == 4096:
                yield _table(held, names)
                held = {n: [] for n in held}
        if held["doc"]:
            yield _table(held, names)


def _table(held: dict[str, list], names: tuple[str, ...]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(held["doc"], pa.int64())] + [pa.array(held[n], pa.binary()) for n in names], names=["doc", *names])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the segments to compare."""
    for batch in batches:
        data, offsets = K.buffers(column(batch, "text"))
        docs = column(batch, "doc").to_pylist()
        blobs = {n: column(batch, n).to_pylist() for n in ("key", "anchor", "left", "width")}
        for i, doc in enumerate(docs):
            text = data[offsets[i] : offsets[i + 1]].tobytes()
            read = lambda n, kind: np.frombuffer(b"".join(blobs[n][i]), kind)  # noqa: B023, E731
            key, anchor, left, width = read("key", np.int64), read("anchor", np.int64), read("left", np.uint8), read("width", np.uint8)
            if not len(key):
                continue
            first = anchor - left
            body = [text[s : s + w + LENGTH] for s, w in zip(first.tolist(), width.tolist())]
            lead = [text[s : s + 32] for s in anchor.tolist()]
            yield pa.record_batch(
                [pa.array(lead, pa.binary()), pa.array(key), pa.array(np.full(len(key), doc)), pa.array(anchor), pa.array(left.astype(np.int32)), pa.array(width.astype(np.int32)), pa.array(body, pa.binary())],
                names=["lead", "key", "doc", "anchor", "left", "width", "body"],
            )


def multikey_sort(group: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by (group, letters), and the bytes each row shares with the one before it (-1: other group).

    Letters are big-endian words of eight bytes. Each round splits the ties of the last one by their next letter, and
    rows without ties leave, so a letter is read only where all before it were equal.
    """
    order = np.argsort(group, kind="stable")
    shared = np.where(np.concatenate([[True], group[order][1:] != group[order][:-1]]), -1, 8 * letters.shape[1])[: len(group)]
    for k in range(letters.shape[1]):
        tie = np.cumsum(shared < 8 * letters.shape[1])
        tied = np.flatnonzero(np.bincount(tie)[tie] > 1)
        if not len(tied):
            break
        word = letters[order[tied], k]
        inner = np.lexsort((word, tie[tied]))
        order[tied] = order[tied[inner]]
        word, owner = word[inner], tie[tied]
        split = np.flatnonzero((owner[1:] == owner[:-1]) & (word[1:] != word[:-1])) + 1
        apart = word[split] ^ word[split - 1]
        same = np.zeros(len(split), np.int64)
        for b in range(1, 8):
            same[apart >> np.uint64(64 - 8 * b) == 0] = b
        shared[tied[split]] = 8 * k + same
    return order, shared


def _letters(body: np.ndarray, start: np.ndarray, length: np.ndarray, step: int) -> np.ndarray:
    """Up to _GRAM bytes from each start, forwards or backwards, as words; missing ones are 0."""
    size = -(-_GRAM // 8) * 8
    at = np.arange(size)
    inside = at < length[:, None]
    bytes_ = np.where(inside, body[np.where(inside, start[:, None] + step * at, 0)], 0).astype(np.uint8)
    return bytes_.view(">u8").astype(np.uint64)


def repeated(key: np.ndarray, left: np.ndarray, width: np.ndarray, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(segment, d) of every window, d bytes before its anchor, that another segment of the same key holds as well."""
    anchor = offsets[:-1] + left
    ends = []
    for start, length, step in ((anchor + _GRAM, offsets[1:] - anchor - _GRAM, 1), (anchor - 1, left, -1)):
        ends.append(multikey_sort(key, _letters(body, start, length, step)))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for d in range(_SPAN):
        holds = np.flatnonzero((left - width <= d) & (d <= left))
        if len(holds) < 2:
            continue
        classes = []
        for (order, shared), least in zip(ends, (LENGTH - _GRAM - d, d)):
            number = np.empty(len(key), np.int64)
            number[order] = np.cumsum(shared < least)
            classes.append(number[holds])
        code = classes[0] * (len(key) + 1) + classes[1]
        _, where, counts = np.unique(code, return_inverse=True, return_counts=True)
        twice = holds[counts[where] > 1]
        found.append((twice, np.full(len(twice), d)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _sorted_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans (doc, start, stop) of the windows that repeat in a bucket, group by group of leads."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    cols = {n: table[n].to_numpy().astype(np.int64) for n in ("key", "doc", "anchor", "left", "width")}
    data, offsets = K.buffers(table["body"].combine_chunks())
    order = np.argsort(cols["key"], kind="stable")
    edges = K.runs(cols["key"][order])
    a = 0
    while a < len(edges) - 1:  # some thousand segments at a time, whole groups only
        b = max(a + 1, int(np.searchsorted(edges, edges[a] + 2 * HOT, side="right")) - 1)
        chosen = order[edges[a] : edges[b]]
        sizes = (offsets[1:] - offsets[:-1])[chosen]
        body = data[K.ranges(offsets[chosen], sizes)]
        own = np.concatenate([[0], np.cumsum(sizes)])
        segment, d = repeated(cols["key"][chosen], cols["left"][chosen], cols["width"][chosen], body, own)
        where = chosen[segment]
        yield from _joined(cols["doc"][where], cols["anchor"][where] - d)
        a = b


def _joined(doc: np.ndarray, start: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Windows as spans, those that follow one another joined."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(doc))[: len(first)] - 1
    if len(first):
        yield pa.record_batch([pa.array(doc[first]), pa.array(start[first]), pa.array(start[last] + LENGTH)], names=["doc", "start", "stop"])


def _windows(buckets: int) -> Callable:
    """Every window of the segments of hot leads, dealt out by its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {n: column(batch, n).to_numpy().astype(np.int64) for n in ("doc", "anchor", "left", "width")}
            for a, b, data, offsets in K.slices(column(batch, "body"), _SLICE):
                count = cols["width"][a:b] + 1
                at = K.ranges(offsets[:-1], count)
                start = np.repeat(cols["anchor"][a:b] - cols["left"][a:b], count) + at - np.repeat(offsets[:-1], count)
                one, two = (_Prefix(data, odd).of(at, at + LENGTH) for odd in _ODD)
                packed = list(K.dealt(one, buckets, two, np.repeat(cols["doc"][a:b], count), start))
                yield pa.record_batch([pa.array([p[0] for p in packed], pa.int32())] + [pa.array([p[1][k] for p in packed], pa.binary()) for k in range(4)], names=["bucket", "one", "two", "doc", "start"])

    return run


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    one, two, doc, start = K.gathered(batches, ["one", "two", "doc", "start"], [np.uint64, np.uint64, np.int64, np.int64])
    order = np.lexsort((two, one))
    one, two = one[order], two[order]
    fresh = np.ones(len(one), bool)
    fresh[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    sizes = np.diff(K.runs(np.cumsum(fresh)))
    keep = order[np.repeat(sizes > 1, sizes)]
    yield from _joined(doc[keep], start[keep])


def _stripped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {n: [] for n in ("doc", "n_removed", "n_spans", "kept_sha256", "kept")}
        texts, spans = column(batch, "text").to_pylist(), column(batch, "spans").to_pylist()
        for doc, text, own in zip(column(batch, "doc").to_pylist(), texts, spans):
            raw, kept, at, gone, merged = (text or "").encode(), [], 0, 0, 0
            reach = -1
            for s in sorted((x["start"], x["stop"]) for x in own):
                if s[0] > reach:
                    merged += 1
                    kept.append(raw[at : s[0]])
                    reach = at = s[0]
                gone += max(0, s[1] - reach)
                reach = at = max(reach, s[1])
            kept.append(raw[at:])
            left = b"".join(kept)
            out["doc"].append(doc), out["n_removed"].append(gone), out["n_spans"].append(merged)
            out["kept_sha256"].append(hashlib.sha256(left).hexdigest()), out["kept"].append(left)
        yield pa.record_batch([pa.array(out["doc"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["n_spans"], pa.int64()), pa.array(out["kept_sha256"]), pa.array(out["kept"], pa.binary())], names=list(out))


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(d, np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)) for d, a, b in zip(*(column(batch, n).to_pylist() for n in ("doc", "start", "stop")))]
        if rows:
            sizes = [len(r[1]) for r in rows]
            yield pa.record_batch([pa.array(np.repeat([r[0] for r in rows], sizes)), pa.array(np.concatenate([r[1] for r in rows])), pa.array(np.concatenate([r[2] for r in rows]))], names=["doc", "start", "stop"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row; `kept` is null where nothing goes."""
    spark = docs.sparkSession
    buckets = parts(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.withColumn("doc", F.xxhash64("doc_id", "text"))
    blobs = lambda names: ", ".join(f"{n} binary" for n in names)
    dealt = docs.select("doc", "text").mapInArrow(_anchored(buckets), f"bucket int, {blobs(_PACKED)}")
    found = staged(dealt.repartition(buckets, "bucket").mapInArrow(_settled, f"doc long, {blobs(('start', 'stop', 'key', 'anchor', 'left', 'width'))}"), "settled")

    asked = found.groupBy("doc").agg(*[F.collect_list(n).alias(n) for n in ("key", "anchor", "left", "width")])
    touched = staged(docs.join(asked, "doc").select("doc", "text", "key", "anchor", "left", "width"), "touched")
    segments = staged(touched.where("exists(key, k -> octet_length(k) > 0)").mapInArrow(_cut, "lead binary, key long, doc long, anchor long, left int, width int, body binary"), "segments")
    large = segments.groupBy("key").count().where(F.col("count") > hot).select("key")
    spans = "doc long, start long, stop long"
    cold = segments.join(large, "key", "left_anti").select("lead", "key", "doc", "anchor", "left", "width", "body")
    cold = cold.repartitionByRange(buckets, "lead", "key").mapInArrow(_sorted_bucket, spans)
    across = segments.join(large, "key", "left_semi").mapInArrow(_windows(buckets), f"bucket int, {blobs(('one', 'two', 'doc', 'start'))}")
    across = across.repartition(buckets, "bucket").mapInArrow(_matched, spans)
    sure = found.where("octet_length(start) > 0").select("doc", "start", "stop").mapInArrow(_unpacked, spans)
    gone = sure.unionByName(cold).unionByName(across).groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    changed = touched.select("doc", "text").join(gone, "doc").mapInArrow(_stripped, "doc long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    changed = changed.groupBy("doc").agg(*[F.first(n).alias(n) for n in ("n_removed", "n_spans", "kept_sha256", "kept")])
    plain = docs.select("doc", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("same_sha256"))
    zero = F.lit(0).cast("long")
    return plain.join(changed, "doc", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "same_sha256").alias("kept_sha256"), "kept",
    )
