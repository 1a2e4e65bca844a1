"""Language-model scoring with a hierarchical Pitman-Yor model of word pairs.

Restaurants: one for every word that stands before another in training (and one for the start of a text), all with the
same parent, the restaurant of single words. Dishes are all words and the end of a text. Nothing is capped: pairs, words
and contexts are counted over all texts, and no table of them reaches the driver, which sees a few sums for each bucket.

Pairs of each text are dealt out by the hash of the pair, so a frequent context is spread over all buckets like its
dishes. A bucket counts its pairs and asks the buckets of the words (dealt by the hash of the word) for what it needs
of them as dish and as context; answers come back in the order of the question, as ranges of hashes. Every bucket of
pairs asks every bucket of words in each sweep, so there are few of these (`_word_buckets`), and they read one question
at a time. A task holds one bucket; what travels or is stored names words, texts and contexts by their place in a list of hashes sent once, and is
compressed. Exchanges give their disk back when their step is stored, and a table is removed when the next replaces it.
What holds a row for each pair of a text is dealt and scored in passes, each over all texts and a share of the buckets, so
that its exchange takes the disk of a share.

Seating is sampled by Gibbs: in each sweep the number of tables of each pair is drawn from its conditional distribution
(generalised Stirling numbers, the parent's probabilities and the other tables of the restaurant as of the last sweep);
the tables become the customers of the parent, which is seated in turn. A pair that occurs once has one table whatever
is drawn, so only the others move in the sweeps. After the burn-in the predictive probabilities of the sweeps are
averaged.

A null text is empty and consists of the end alone. Rows with null ids are scored like others and train by the rule of
the caller. Repeated rows count as often as they occur. Without training rows every probability is that of the base.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guichet.llm import kernels as K
from guichet.llm.common import column, freed, parts, remove, staged
from guichet.session import checkpoint_root

SWEEPS, BURN_IN = 6, 3
#: Counts up to this are seated exactly; larger ones in steps of a quarter of the customers seated.
EXACT = 24
#: Passes over the texts; each deals out the pairs of a share of the buckets.
PASSES = 2
#: What the base of the parent leaves to words never seen.
NEW = 0.9
#: Of every restaurant.
STRENGTH = 5.0
#: The end of a text as a word, and as the context of the first word.
_END = np.uint64(0)
#: Pairs drawn at once, and words of texts that are dealt out at once (more only in a single slice).
_DRAWN, _DEALT = 1 << 15, 1 << 20
#: Answers that leave a bucket of words at once.
_REPLIES = 256
#: What a packed row holds.
_PAIRS, _SEATED, _ASKED, _SUMS, _WORDS, _ANSWERS, _TOTALS = range(7)
_SCHEMA = pa.schema([("what", pa.int32()), ("bucket", pa.int32()), ("origin", pa.int32()), ("blobs", pa.list_(pa.binary()))])
_ROW = "what int, bucket int, origin int, blobs array<binary>"


def _word_buckets(buckets: int) -> int:
    """Buckets of words for so many of pairs: as they grow by the root, rows between both stay far from the square."""
    return min(buckets, 2 * math.ceil(math.sqrt(buckets)))


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, row = K.words(data, offsets, K.SPACED)
    return K.word_hashes(data, starts, ends), row


def _rows(rows: list[tuple[int, int, int, list[bytes]]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], _SCHEMA.field(i).type) for i in range(4)], schema=_SCHEMA)


def _blob(values: np.ndarray) -> bytes:
    """A column: ordered hashes as differences, then the bytes of each significance together, compressed."""
    ordered = values.dtype == np.uint64 and bool((values[1:] >= values[:-1]).all())
    values = np.diff(values, prepend=np.uint64(0)) if ordered else values
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    return bytes([ordered]) + len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _bytes(blob: bytes) -> int:
    """Size of a column before it was packed."""
    return int.from_bytes(blob[1:9], "little")


def _values(blob: bytes, kind: type) -> np.ndarray:
    if not _bytes(blob):
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(blob[9:], _bytes(blob), codec="zstd"), np.uint8)
    values = np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()
    return np.cumsum(values, dtype=kind) if blob[0] else values


def _row(what: int, bucket: int, origin: int, *columns: np.ndarray) -> tuple[int, int, int, list[bytes]]:
    return what, bucket, origin, [_blob(c) for c in columns]


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[tuple[int, list[bytes]]]]]]:
    """Each bucket of a partition with its rows (origin, blobs) by what they hold, in order of origin."""
    found: dict[int, dict[int, list]] = {}
    for batch in batches:
        for what, bucket, origin, blobs in zip(*(batch.column(i).to_pylist() for i in range(4))):
            found.setdefault(bucket, {}).setdefault(what, []).append((origin, blobs))
    for bucket in sorted(found):
        yield bucket, {what: sorted(rows, key=lambda r: r[0]) for what, rows in found.pop(bucket).items()}


def _unpacked(rows: list[tuple[int, list[bytes]]], *kinds: type) -> list[np.ndarray]:
    return [np.concatenate([_values(r[1][k], kind) for r in rows]) if rows else np.zeros(0, kind) for k, kind in enumerate(kinds)]


def _summed(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(at, values, minlength=size).astype(np.int64)


def _pairs(buckets: int, turn: int) -> Callable:
    """The pairs of each text that fall into the buckets of this turn, dealt out by pair: (words; place of context and word among them; texts, their pairs, trains; occurrences)."""

    def dealt(docs: np.ndarray, trains: np.ndarray, held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        context, word, row, pair = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((pair, row))
        pair, row = pair[order], row[order]
        fresh = np.ones(len(row), bool)
        fresh[1:] = (row[1:] != row[:-1]) | (pair[1:] != pair[:-1])
        first = np.flatnonzero(fresh)
        times = np.diff(np.append(first, len(row))).astype(np.int32)
        rows = []
        for bucket, (_, before, after, own, n) in K.dealt(pair[first], buckets, context[order[first]], word[order[first]], row[first].astype(np.int32), times, pack=np.asarray):
            ids, at = np.unique(np.concatenate([before, after]), return_inverse=True)
            edges = K.runs(own)
            texts = own[edges[:-1]]
            rows.append(_row(_PAIRS, bucket, 0, ids, at[: len(own)].astype(np.int32), at[len(own) :].astype(np.int32), docs[texts], np.diff(edges).astype(np.int32), trains[texts].astype(np.uint8), n))
        return _rows(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, trains = column(batch, "doc").to_numpy(), column(batch, "trains").to_numpy(zero_copy_only=False)
            held: list[tuple[np.ndarray, ...]] = []
            for a, _, data, offsets in K.slices(column(batch, "text")):
                word, row = _tokens(data, offsets)
                rows = np.arange(len(offsets) - 1)
                stop = np.searchsorted(row, rows, side="right")
                word, row = np.insert(word, stop, _END), np.insert(row, stop, rows)
                context = np.concatenate([[_END], word[:-1]])  # what precedes a text is an end
                pair = K.mix(context * K._STEP + word)
                own = K.bucket_of(pair, buckets) % PASSES == turn
                held.append((context[own], word[own], a + row[own], pair[own]))
                if sum(len(h[1]) for h in held) >= _DEALT:
                    yield dealt(docs, trains, held)
                    held = []
            if held:
                yield dealt(docs, trains, held)

    return run


def _counted(words: int) -> Callable:
    """Counts of the pairs of a bucket, the texts that hold them, and what is asked of the buckets of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _buckets(batches):
            met = rows.pop(_PAIRS)
            ids = np.unique(np.concatenate([_values(r[1][0], np.uint64) for r in met]))
            codes = []
            for _, blobs in met:
                place = np.searchsorted(ids, _values(blobs[0], np.uint64))
                codes.append(place[_values(blobs[1], np.int32)] * len(ids) + place[_values(blobs[2], np.int32)])
            code = np.concatenate(codes)
            del codes
            texts, held, trains, times = _unpacked([(r[0], r[1][3:]) for r in met], np.uint64, np.int32, np.uint8, np.int32)
            del met
            texts, doc = np.unique(texts, return_inverse=True)
            doc, weight = np.repeat(doc.astype(np.int32), held), times * np.repeat(trains, held)
            order = np.argsort(code, kind="stable")
            code, doc, times, weight = code[order], doc[order], times[order], weight[order]
            del order
            first = K.runs(code)
            held = np.diff(first).astype(np.int32)
            n = np.add.reduceat(weight.astype(np.int64), first[:-1])
            c, w = (x.astype(np.int32) for x in np.divmod(code[first[:-1]], len(ids)))
            del code, weight, first
            yield _rows([_row(_PAIRS, bucket, 0, np.bincount(c, minlength=len(ids)).astype(np.int32), w, n, held, ids[w] == _END, doc, times, texts)])
            del doc, times, texts, held
            once = (n == 1).astype(float)
            stats = [_summed(w, n, len(ids)), _summed(w, once, len(ids)), _summed(c, n, len(ids)), _summed(c, once, len(ids))]
            yield _rows([(_ASKED, to, bucket, blobs) for to, blobs in K.dealt(ids, words, *stats, pack=_blob)])
            many = n > 1
            present = np.unique(np.concatenate([c[many], w[many]]))
            tables = np.ones(many.sum(), np.int64)
            c, w = (np.searchsorted(present, x[many]).astype(np.int32) for x in (c, w))
            yield from _told(bucket, words, ids[present], c, w, n[many], tables, np.zeros(len(c), np.int64))
            yield _rows([_row(_TOTALS, bucket, 0, np.array([(n == 1).sum(), (n == 2).sum()], float))])

    return run


def _told(bucket: int, words: int, ids: np.ndarray, c: np.ndarray, w: np.ndarray, n: np.ndarray, tables: np.ndarray, kept: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The seating of a bucket, and its tables for each word as dish and as context."""
    yield _rows([_row(_SEATED, bucket, 0, ids, c, w, n, tables, kept)])
    yield _rows([(_SUMS, to, bucket, blobs) for to, blobs in K.dealt(ids, words, _summed(w, tables, len(ids)), _summed(c, tables, len(ids)), pack=_blob)])


def stirling(discount: float, size: int) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: [customers, tables]."""
    out = np.full((size + 1, size + 1), -np.inf)
    out[0, 0] = 0.0
    for c in range(size):
        for t in range(1, c + 2):
            stay = out[c, t] + np.log(c - t * discount) if t <= c else -np.inf
            out[c + 1, t] = np.logaddexp(out[c, t - 1], stay)
    return out


def seat(customers: np.ndarray, parent: np.ndarray, tables: np.ndarray, strength: float, discount: float, rng: np.random.Generator, total: np.ndarray | None = None) -> np.ndarray:
    """One Gibbs sweep over dishes: tables of each, given the parent's probabilities and all others.

    `total` has the tables of the restaurant of each dish; without it all dishes are of one restaurant.
    """
    logs = stirling(discount, EXACT)
    total = np.full(len(customers), tables.sum()) if total is None else total
    out = np.minimum(customers, 1)
    few = np.flatnonzero((customers > 1) & (customers <= EXACT))
    few = few[np.argsort(customers[few], kind="stable")]
    for i in range(0, len(few), _DRAWN):
        exact = few[i : i + _DRAWN]
        t = np.arange(1, customers[exact[-1]] + 1)
        others = total[exact] - tables[exact]
        opened = np.cumsum(np.log(strength + discount * (others[:, None] + t[None, :] - 1)), axis=1)
        weight = logs[customers[exact], 1 : len(t) + 1] + t * np.log(parent[exact])[:, None] + opened
        out[exact] = (weight + rng.gumbel(size=weight.shape)).argmax(axis=1) + 1
    large = np.flatnonzero(customers > EXACT)
    if len(large):
        n, seated, own = customers[large], np.ones(len(large)), np.ones(len(large))
        pull = (strength + discount * total[large]) * parent[large]
        while (seated < n).any():
            step = np.clip(np.maximum(seated // 4, 1), 0, n - seated)
            own += rng.binomial(step.astype(np.int64), np.clip(pull / (pull + seated - discount * own), 0, 1))
            seated += step
        out[large] = own.astype(np.int64)
    return out


def _discount(once: float, twice: float) -> float:
    return float(np.clip(once / (once + 2 * twice), 0.2, 0.9)) if once else 0.5


def _reseated(words: int, discount: float, add: float, out_of: float, sweep: int) -> Callable:
    """One sweep over the pairs of a bucket; the parent's probability is (answer + add) / out_of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _buckets(batches):
            ids, c, w, n, tables, kept = _unpacked(rows[_SEATED], np.uint64, np.int32, np.int32, np.int64, np.int64, np.int64)
            served, opened = _unpacked(rows.get(_ANSWERS, []), float, np.int64) if len(ids) else (np.zeros(0), np.zeros(0, np.int64))
            tables = seat(n, (served[w] + add) / out_of, tables, STRENGTH, discount, np.random.default_rng([sweep, bucket]), opened[c])
            yield from _told(bucket, words, ids, c, w, n, tables, kept + (tables if sweep >= BURN_IN else 0))

    return run


def _told_of(ids: np.ndarray, rows: list[tuple[int, list[bytes]]], columns: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Places of the words of each row, and the sums of the columns for each word; a row names a word once."""
    places, sums = [], np.zeros((columns, len(ids)), np.int64)
    for _, blobs in rows:
        at = np.searchsorted(ids, _values(blobs[0], np.uint64)).astype(np.int32)
        places.append(at)
        for k in range(columns):
            sums[k, at] += _values(blobs[k + 1], np.int64)
    return places, sums


def _parent(sweep: int, discount: float, known: float, tables_before: float) -> Callable:
    """The parent is seated over the words of a bucket; answers what was asked: dishes served less the discount, and tables as a context.

    Sweep -1 gathers the words and gives every one a table; its answers are the counts of the words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _buckets(batches):
            if sweep < 0:
                ids, past = np.unique(np.concatenate([_values(r[1][0], np.uint64) for r in rows[_ASKED]])), []
                _, (count, single, before, alone) = _told_of(ids, rows[_ASKED], 4)
            else:
                ids, count, single, before, alone, seated = _unpacked(rows[_WORDS], np.uint64, *[np.int64] * 5)
                past = [_values(b, np.float32) for b in rows[_WORDS][0][1][6:]]
            asked = rows.get(_SUMS, [])
            places, (tables_w, tables_c) = _told_of(ids, asked, 2)
            customers, opened = single + tables_w, alone + tables_c
            if sweep < 0:
                seated, served = np.minimum(customers, 1), count.astype(float)
            else:
                base = np.full(len(ids), (1 - NEW) / known)
                seated = seat(customers, base, np.minimum(seated, customers), STRENGTH, discount, np.random.default_rng([sweep, bucket, 1]), np.full(len(ids), tables_before))
                served = customers - discount * seated
                past += [served.astype(np.float32), opened.astype(np.float32)] if sweep >= BURN_IN else []
            yield _rows([_row(_WORDS, bucket, 0, ids, count, single, before, alone, seated, *past)])
            for i in range(0, len(asked), _REPLIES):
                yield _rows([_row(_ANSWERS, r[0], bucket, served[at], opened[at]) for r, at in zip(asked[i : i + _REPLIES], places[i : i + _REPLIES])])
            yield _rows([_row(_TOTALS, bucket, 0, np.array([count.sum(), (count > 0).sum(), customers.sum(), seated.sum(), (customers == 1).sum(), (customers == 2).sum()], float))])

    return run


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For all that was asked: counts as dish and as context, and what the kept sweeps served and opened."""
    for bucket, rows in _buckets(batches):
        own = rows[_WORDS][0][1]
        ids, count, before = (_values(own[k], kind) for k, kind in ((0, np.uint64), (1, np.int64), (3, np.int64)))
        values = [count, before, *[_values(b, np.float32) for b in own[6:]]]
        for origin, blobs in rows.get(_ASKED, []):
            at = np.searchsorted(ids, _values(blobs[0], np.uint64))
            yield _rows([_row(_ANSWERS, origin, bucket, *[v[at] for v in values])])


def _scored(buckets: int, discount: float, sweeps: list[tuple[float, float, float]], tokens: float, distinct: float) -> Callable:
    """What the pairs of a bucket add to each text, dealt out by text: (text, copies, tokens, known ones, base, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _buckets(batches):
            c, w, n, held, end, doc, times, texts = _unpacked(rows.pop(_PAIRS), np.int32, np.int32, np.int64, np.int32, bool, np.int32, np.int32, np.uint64)
            c = np.repeat(np.arange(len(c)), c)
            count, before, *past = _unpacked(rows.pop(_ANSWERS), np.int64, np.int64, *[np.float32] * (2 * len(sweeps)))
            kept = np.zeros(len(n))
            kept[n == 1] = len(sweeps)
            kept[n > 1] = _unpacked([(r[0], r[1][5:]) for r in rows[_SEATED]], np.int64)[0]
            p = len(sweeps) * n - discount * kept
            for k, (add, new, out_of) in enumerate(sweeps):
                single = np.where(count > 0, past[2 * k] + add, new) / out_of
                p += (STRENGTH + discount * past[2 * k + 1][c]) * single[w]
            logs = np.log10(p / len(sweeps) / (STRENGTH + before[c]))
            base = np.log10(count + 1.0) - np.log10(tokens + distinct + 1.0)
            pair = np.repeat(np.arange(len(n), dtype=np.int32), held)
            sums = [np.bincount(doc, times * v[pair], minlength=len(texts)) for v in (end, np.ones(len(n)), count[w] > 0, base[w], logs)]
            columns = [v.astype(k) for v, k in zip(sums, (np.int32, np.int32, np.int32, float, float))]
            yield _rows([_row_of(to, blobs) for to, blobs in K.dealt(K.mix(texts), buckets, texts.view(np.int64), *columns, pack=_blob)])

    return run


def _row_of(bucket: int, blobs: list[bytes]) -> tuple[int, int, int, list[bytes]]:
    return _TOTALS, bucket, 0, blobs[1:]


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over all pairs of each text; rows of equal id and text share them."""
    for _, rows in _buckets(batches):
        doc, copies, *values = _unpacked(rows[_TOTALS], np.int64, np.int32, np.int32, np.int32, float, float)
        order = np.argsort(doc, kind="stable")
        first = K.runs(doc[order])[:-1]
        copies, *values = (np.add.reduceat(v[order].astype(float), first) for v in (copies, *values))
        for i in range(0, len(first), 1 << 14):
            own = slice(i, i + (1 << 14))
            yield pa.record_batch([pa.array(doc[order][first][own])] + [pa.array((v / copies)[own]) for v in values], names=["doc", "tokens", "known", "base", "score"])


class _Exchange:
    """Packed rows, met by bucket and stored in the shared folder apart by what they hold, until others replace them."""

    def __init__(self, docs: DataFrame):
        self.spark, self.buckets, self.stored, self.folders = docs.sparkSession, parts(docs.sparkSession), {}, {}
        self.words = _word_buckets(self.buckets)

    def met(self, rows: DataFrame, buckets: int | None = None) -> DataFrame:
        """A partition for each bucket."""
        return rows.repartitionById(buckets or self.buckets, "bucket")

    def put(self, rows: DataFrame, *whats: int, further: bool = False) -> None:
        """Store rows in place of those that are stored, or as `further` ones."""
        path = f"{checkpoint_root(self.spark)}/language-{uuid.uuid4().hex}"
        with freed(self.spark):
            rows.write.partitionBy("what").parquet(path)
        table = self.spark.read.schema(_ROW).parquet(path).select("what", "bucket", "origin", "blobs")
        for what in whats:
            if not further:
                self.drop(what)
            self.stored.setdefault(what, []).append(table.where(F.col("what") == what))
            self.folders.setdefault(what, []).append(f"{path}/what={what}")

    def drop(self, what: int) -> None:
        """Remove the tables of rows that nothing reads any more."""
        for folder in self.folders.pop(what, []):
            remove(self.spark, folder)
        self.stored.pop(what, None)

    def rows(self, *whats: int) -> DataFrame:
        tables = [table for what in whats for table in self.stored[what]]
        return reduce(DataFrame.unionByName, tables)

    def of(self, *whats: int) -> DataFrame:
        """Rows for the buckets of words, if they hold any of these, or else for those of pairs or texts."""
        return self.met(self.rows(*whats), self.words if {_WORDS, _ASKED, _SUMS} & {*whats} else None)

    def totals(self, size: int) -> np.ndarray:
        """Sum over the buckets, one row of a few numbers for each."""
        return sum((_values(r["blobs"][0], float) for r in self.rows(_TOTALS).toLocalIterator()), np.zeros(size))


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, trains, n_tokens, n_known, train_tokens, base_score, score, perplexity) for `docs(doc_id, text, trains)`."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "trains").withColumn("doc", F.xxhash64("doc_id", "text"))
    x = _Exchange(docs)
    for turn in range(PASSES):
        dealt = x.met(docs.select("doc", "trains", "text").mapInArrow(_pairs(x.buckets, turn), _ROW))
        x.put(dealt.mapInArrow(_counted(x.words), _ROW), _PAIRS, _ASKED, _SEATED, _SUMS, _TOTALS, further=turn > 0)
    discount = _discount(*x.totals(2))
    x.put(x.of(_ASKED, _SUMS).mapInArrow(_parent(-1, 0.0, 0.0, 0.0), _ROW), _WORDS, _ANSWERS, _TOTALS)
    tokens, distinct, _, tables, once, twice = x.totals(6).tolist()
    top, add, out_of = _discount(once, twice), 1.0, tokens + distinct + 1.0
    sweeps = []
    for sweep in range(SWEEPS):
        x.put(x.of(_SEATED, _ANSWERS).mapInArrow(_reseated(x.words, discount, add, out_of, sweep), _ROW), _SEATED, _SUMS)
        x.put(x.of(_WORDS, _SUMS).mapInArrow(_parent(sweep, top, max(distinct, 1.0), tables), _ROW), _WORDS, _ANSWERS, _TOTALS)
        _, _, customers, tables, _, _ = x.totals(6).tolist()
        spare, out_of = STRENGTH + top * tables, STRENGTH + customers
        add = spare * (1 - NEW) / max(distinct, 1.0)
        if sweep >= BURN_IN:
            sweeps.append((add, spare * NEW, out_of))
    x.put(x.of(_WORDS, _ASKED).mapInArrow(_answered, _ROW), _ANSWERS)
    for what in (_WORDS, _ASKED, _SUMS):
        x.drop(what)
    for turn in range(PASSES):
        rows = x.stored[_PAIRS][turn].unionByName(x.rows(_SEATED, _ANSWERS).where(F.col("bucket") % PASSES == turn))
        x.put(x.met(rows).mapInArrow(_scored(x.buckets, discount, sweeps, tokens, distinct), _ROW), _TOTALS, further=turn > 0)
    sums = staged(x.of(_TOTALS).mapInArrow(_added, "doc long, tokens double, known double, base double, score double"), "language-sums")
    for what in list(x.folders):
        x.drop(what)
    out = docs.select("doc", "doc_id", "trains").join(sums, "doc")
    out = out.select("doc_id", "trains", F.col("tokens").cast("long").alias("n_tokens"), F.col("known").cast("long").alias("n_known"), F.lit(int(tokens)).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
