"""Language identification by character language models with interpolated Kneser-Ney smoothing.

Texts become letters in lower case with single blanks between words (letters are what Unicode calls so; everything else
is blank). For each language, ORDER-letter models are counted over at most SAMPLE training rows (those with the smallest
hash of id and text), whole texts. Every gram seen in any language gets its interpolated Kneser-Ney probability in all
of them, and every context its back-off weights, in hash arrays sorted by gram, so one bisection per letter serves all
languages; only unseen grams look further down.

The language with the least cross-entropy per letter wins, ties to the smaller name. `score` is its share of
the likelihoods at a temperature that is calibrated on training rows left out of the counts, and `rejected` marks texts
whose cross-entropy is above what all but REJECT of such rows of that language have: junk, or a language never seen.

A text that is null or has no letter gives `und`, score 0, not rejected. Rows with a null label teach nothing; without
any training row every text is `und`. Repeated and null ids are rows like any other.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from guichet.llm import kernels as K
from guichet.llm.common import column

ORDER = 4
#: Training rows of each language; one in HELD_OUT_OF is left out of the counts and calibrates.
SAMPLE, HELD_OUT_OF = 1800, 6
REJECT = 0.001
_BLANK = 32


#: Code points from here on are no letters.
_LAST = 0x33000


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letter or combining mark of each code point, or a blank; and whether it is a letter."""
    table, letter = np.full(_LAST + 1, _BLANK, np.uint32), np.zeros(_LAST + 1, bool)
    for point in range(_LAST):
        char = chr(point)
        kind = unicodedata.category(char)[0]
        if kind in "LM":
            low = char.lower()
            table[point] = ord(low) if len(low) == 1 else point
            letter[point] = kind == "L"
    return table, letter


_TABLE, _LETTER = _letters()


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter; combining marks alone are none."""
    bounds = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    upto = np.concatenate([[0], np.cumsum(_LETTER[np.minimum(chars, _LAST)])])
    return upto[bounds[1:]] > upto[bounds[:-1]]


def _code(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points with single blanks between words and one before each text, and where each text starts."""
    lead = (data & 0xC0) != 0x80
    chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    upto = np.concatenate([[0], np.cumsum(lead)])
    bounds = upto[offsets]
    code = _TABLE[np.minimum(chars, _LAST)]
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    first = np.zeros(len(code) + 1, bool)
    first[bounds[:-1]] = True
    blank = code == _BLANK
    after = np.concatenate([[True], blank[:-1]]) if len(code) else blank
    keep = ~blank | ~(after | first[: len(code)])
    code, row = code[keep], row[keep]
    # one blank before each text, so its first letter has a context and texts do not mix
    starts = np.searchsorted(row, np.arange(len(bounds) - 1))
    code = np.insert(code, starts, _BLANK)
    return code, np.append(starts + np.arange(len(starts)), len(code))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Full-order grams by language, with letters and a number of occurrences; contexts are cut at the text's start."""
    for batch in batches:
        langs = column(batch, "lang").to_pylist()
        for a, b, data, offsets in K.slices(column(batch, "text")):
            code, starts = _code(data, offsets)
            row = np.searchsorted(starts, np.arange(len(code)), side="right") - 1
            names = sorted(set(langs[a:b]))
            number = np.array([names.index(x) for x in langs[a:b]])
            windows = np.stack([np.concatenate([np.full(min(k, len(code)), _BLANK, np.uint32), code[: max(0, len(code) - k)]]) for k in range(ORDER - 1, -1, -1)], axis=1)
            crossing = np.arange(len(code)) - starts[row] < np.arange(ORDER - 1, -1, -1)[:, None]
            windows[crossing.T] = _BLANK
            inside = np.arange(len(code)) > starts[row]
            keyed = np.concatenate([number[row][:, None].astype(np.uint32), windows], axis=1)[inside]
            found, times = np.unique(keyed, axis=0, return_counts=True)
            if len(found):
                yield pa.record_batch(
                    [pa.array([names[i] for i in found[:, 0]]), pa.array(found[:, 1:].astype(np.int64).tolist(), pa.list_(pa.int64())), pa.array(times)], names=["lang", "gram", "times"],
                )


@dataclass
class Model:
    langs: list[str]
    #: For each order from ORDER to 1: sorted hashes and log2 probabilities (a column for each language).
    grams: list[tuple[np.ndarray, np.ndarray]]
    #: For each order from ORDER to 2: sorted context hashes and log2 back-off weights.
    backs: list[tuple[np.ndarray, np.ndarray]]
    unseen: np.ndarray
    limit: np.ndarray
    heat: float = 1.0

    def entropy(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits per letter (a row for each text, a column for each language) and number of letters and blanks."""
        code, starts = _code(data, offsets)
        row = np.searchsorted(starts, np.arange(len(code)), side="right") - 1
        place = np.arange(len(code)) - starts[row]
        at = np.flatnonzero(place > 0)
        bits = np.zeros((len(at), len(self.langs)), np.float32)
        left = np.arange(len(at))
        for k, (hashes, logs) in enumerate(self.grams):
            size = ORDER - k
            own = self._hashes(code, place, size)[at[left]]
            spot = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
            hit = hashes[spot] == own
            bits[left[hit]] += logs[spot[hit]]
            left = left[~hit]
            if not len(left):
                break
            if size > 1:
                contexts, weights = self.backs[k]
                before = self._hashes(code, place, size - 1)[at[left] - 1]
                spot = np.minimum(np.searchsorted(contexts, before), len(contexts) - 1)
                seen = contexts[spot] == before
                bits[left[seen]] += weights[spot[seen]]
        bits[left] += self.unseen
        rows = len(starts) - 1
        letters = np.bincount(row[at], minlength=rows)
        total = np.stack([np.bincount(row[at], bits[:, j], minlength=rows) for j in range(len(self.langs))], axis=1) if len(self.langs) else np.zeros((rows, 0))
        return -total / np.maximum(letters, 1)[:, None], letters

    @staticmethod
    def _hashes(code: np.ndarray, place: np.ndarray, size: int) -> np.ndarray:
        """Hash of the `size` letters that end at each place, with blanks for what stands before the text."""
        out = np.full(len(code), np.uint64(size), np.uint64)
        for k in range(size - 1, -1, -1):
            shifted = np.concatenate([np.full(min(k, len(code)), _BLANK, np.uint32), code[: max(0, len(code) - k)]])
            out = K.mix(out * K._STEP + np.where(place < k, np.uint32(_BLANK), shifted).astype(np.uint64))
        return out

    def judge(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score, rejection."""
        bits, _ = self.entropy(data, offsets)
        has = _has_letter(data, offsets)
        if not self.langs:
            return ["und"] * len(has), np.zeros(len(has)), np.zeros(len(has), bool)
        best = bits.argmin(axis=1)
        odds = -(bits - bits.min(axis=1, keepdims=True)) * self.heat
        share = 1 / np.exp2(odds).sum(axis=1)
        names = [self.langs[b] if h else "und" for b, h in zip(best, has)]
        return names, np.where(has, share, 0.0), has & (bits[np.arange(len(best)), best] > self.limit[best])


def _hash_rows(letters: np.ndarray) -> np.ndarray:
    out = np.full(len(letters), np.uint64(letters.shape[1]), np.uint64)
    for k in range(letters.shape[1]):
        out = K.mix(out * K._STEP + letters[:, k].astype(np.uint64))
    return out


def _by_row(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the number of the distinct row of each."""
    distinct, where = np.unique(rows, axis=0, return_inverse=True)
    return distinct, where.reshape(-1)


def kneser_ney(langs: list[str], lang: np.ndarray, grams: np.ndarray, times: np.ndarray) -> Model:
    """Interpolated Kneser-Ney from full-order gram counts: (lang number, letters, occurrences)."""
    counts = []  # for each order, distinct grams and their counts: occurrences at the top, distinct left neighbours below
    distinct, where = _by_row(grams)
    table = np.zeros((len(distinct), len(langs)))
    np.add.at(table, (where, lang), times)
    counts.append((distinct, table))
    for _ in range(1, ORDER):
        shorter, where = _by_row(distinct[:, 1:])
        lower = np.zeros((len(shorter), len(langs)))
        np.add.at(lower, where, (table > 0).astype(float))
        counts.append((shorter, lower))
        distinct, table = shorter, lower
    model = Model(langs, [], [], np.zeros(len(langs)), np.full(len(langs), np.inf))
    size = len(counts[-1][0]) + 1  # letters seen, and one for all others
    below = None
    for distinct, table in reversed(counts):
        once, twice = (table == 1).sum(axis=0), (table == 2).sum(axis=0)
        discount = np.clip(once / np.maximum(once + 2 * twice, 1), 0.1, 0.9)
        contexts, where = _by_row(distinct[:, :-1])
        total, kinds = np.zeros((len(contexts), len(langs))), np.zeros((len(contexts), len(langs)))
        np.add.at(total, where, table)
        np.add.at(kinds, where, (table > 0).astype(float))
        back = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
        if below is None:
            lower = np.full((len(distinct), len(langs)), 1 / size)
        else:
            shorter, probabilities = below
            lookup = {bytes(k): i for i, k in enumerate(shorter)}
            lower = probabilities[[lookup[bytes(k)] for k in np.ascontiguousarray(distinct[:, 1:])]]
        p = np.maximum(table - discount, 0) / np.maximum(total, 1)[where] + back[where] * lower
        below = (np.ascontiguousarray(distinct), p)
        hashes = _hash_rows(distinct)
        order = np.argsort(hashes)
        model.grams.insert(0, (hashes[order], np.log2(p[order]).astype(np.float32)))
        if distinct.shape[1] > 1:
            hashes = _hash_rows(contexts)
            order = np.argsort(hashes)
            model.backs.insert(0, (hashes[order], np.log2(back[order]).astype(np.float32)))
        else:
            model.unseen = np.log2(back[0] / size)
    return model


def _calibrate(model: Model, held: pa.Table) -> None:
    """Temperature of least log loss, and the cross-entropy that nearly all rows of a language stay under."""
    texts = held["text"].combine_chunks()
    bits = [model.entropy(data, offsets)[0] for _, _, data, offsets in K.slices(texts)]
    if not bits:
        return
    bits = np.concatenate(bits)
    truth = np.array([model.langs.index(x) if x in model.langs else -1 for x in held["lang"].to_pylist()])
    bits, truth = bits[truth >= 0], truth[truth >= 0]
    if not len(truth):
        return
    own = bits[np.arange(len(truth)), truth]
    best = None
    for heat in 2.0 ** np.arange(-2, 7, 0.5):
        loss = np.log(np.exp2(-(bits - own[:, None]) * heat).sum(axis=1)).mean()
        if best is None or loss < best:
            best, model.heat = loss, float(heat)
    for j in range(len(model.langs)):
        if (truth == j).any():
            model.limit[j] = np.quantile(own[truth == j], 1 - REJECT) * 1.02


def fit(train: DataFrame) -> Model:
    """Model from `train(doc_id, text, lang)`."""
    train = train.where("lang is not null and text is not null")
    names = train.select(F.col("lang"), F.xxhash64("doc_id", "text").alias("h"), "doc_id", "text")
    # the rows of least hash of each language: a bounded window first within each task, then over all
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    chosen = names.select("lang", "h", "doc_id").withColumn("rank", rank).where(f"rank <= {SAMPLE}")
    sample = train.withColumn("h", F.xxhash64("doc_id", "text")).join(F.broadcast(chosen.select("h", "rank").dropDuplicates(["h"])), "h").select("lang", "text", "rank")
    counted = sample.where(f"rank % {HELD_OUT_OF} > 0").mapInArrow(_counts, "lang string, gram array<long>, times long")
    counted = counted.groupBy("lang", "gram").agg(F.sum("times").alias("times")).toArrow()
    langs = sorted(set(counted["lang"].to_pylist()))
    if not langs:
        return Model([], [], [], np.zeros(0), np.zeros(0))
    grams = np.array(counted["gram"].to_pylist(), np.uint32)
    model = kneser_ney(langs, np.array([langs.index(x) for x in counted["lang"].to_pylist()]), grams, counted["times"].to_numpy().astype(float))
    _calibrate(model, sample.where(f"rank % {HELD_OUT_OF} = 0").select("lang", "text").toArrow())
    return model


def _judged(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = column(batch, "doc_id")
            for a, b, data, offsets in K.slices(column(batch, "text"), 1 << 19):
                names, share, rejected = model.judge(data, offsets)
                yield pa.record_batch([ids.slice(a, b - a), pa.array(names, pa.string()), pa.array(share), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every row of `docs(doc_id, text)`."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_judged(model), f"doc_id {kind}, lang_pred string, score double, rejected boolean")
