"""Toxicity score: gradient-boosted trees over dense features of the text, with isotonic calibration.

The model learns from at most SAMPLE labelled rows (those with the smallest hash of their id), in two halves. Each half
gives a lexicon (words, and beginnings of words, whose document frequency among toxic rows stands out) that describes
the rows of the other half, so that no row is judged by words it taught; trees fitted on one half are calibrated on the
other. The model that scores has the lexicon and the trees of both. Every row is scored, each whole text in one pass
without an exchange.

Features: density of strong and mild lexicon hits, their number and weight, hits near a second-person pronoun, hits
that show only once a disguise is undone (digits and signs for letters, signs between them), capitals, shouting,
exclamation and question marks, other signs, digits, word length, share of distinct words, and length.

A null or empty text has all features 0 and a score like any other. Without labels of both kinds the score is the
share of toxic labels (0 without labels). Null labels teach nothing; rows with null ids are scored and count as not
held out by the caller's rule; repeated labels count once (the largest wins), repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guichet.llm import boosting
from guichet.llm import kernels as K
from guichet.llm.common import column, handed_back

#: Labelled rows the model learns from.
SAMPLE = 24_000
#: Entries of the lexicon.
LEXICON = 1024
NEAR = 6
_BEGINNINGS = (4, 5, 6, 7, 8)

#: Second-person words of the four languages of the corpus.
SECOND_PERSON = "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deinen ihr euch usted ustedes ti tus vosotros".split()
#: Signs and digits commonly written for letters.
DISGUISES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

_PLAIN = np.zeros(256, np.uint8)  # letter that a byte stands for; 0: dropped; 1: blank
for _b in range(256):
    _c = chr(_b)
    _PLAIN[_b] = 1 if not K.SPACED[_b] else ord(DISGUISES[_c]) if _c in DISGUISES else ord(_c.lower()) if _c.isascii() and _c.isalnum() else _b if _b >= 128 else 0
_LETTER = _PLAIN > 1
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SIGN = np.array([33 <= b < 127 and not chr(b).isalnum() and chr(b) not in ".,;:!?'-\"()" for b in range(256)])
WIDTH = 18


def _named(words: list[str]) -> np.ndarray:
    text = pa.array(words)
    data, offsets = K.buffers(text)
    return np.sort(K.word_hashes(data, offsets[:-1], offsets[1:]))


_PRONOUNS = _named(SECOND_PERSON)


def _units(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(word number, hash) of whole words and of their beginnings."""
    out = [(np.arange(len(starts)), K.word_hashes(data, starts, ends))]
    for size in _BEGINNINGS:
        at = np.flatnonzero(ends - starts > size)
        out.append((at, K.mix(K.word_hashes(data, starts[at], starts[at] + size) + np.uint64(size))))
    return out


@dataclass
class Lexicon:
    """Sorted hashes with their log odds."""

    hashes: np.ndarray
    odds: np.ndarray

    def weights(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Largest log odds of the units of each word, 0 without a hit."""
        out = np.zeros(len(starts))
        if len(self.hashes):
            for at, hashes in _units(data, starts, ends):
                place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
                hit = self.hashes[place] == hashes
                out[at[hit]] = np.maximum(out[at[hit]], self.odds[place[hit]])
        return out


def _features(lexicon: Lexicon, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    rows = len(offsets) - 1
    x = np.zeros((rows, WIDTH))
    starts, ends, row = K.words(data, offsets, K.ALNUM)
    count = lambda at, w=None: np.bincount(at, w, minlength=rows)[:rows].astype(float)
    words = np.maximum(count(row), 1)
    weight = lexicon.weights(data, starts, ends)
    strong, mild = weight >= 2.5, (weight > 0) & (weight < 2.5)
    x[:, 0], x[:, 1] = count(row[strong]) / words, np.log1p(count(row[strong]))
    x[:, 2], x[:, 3] = count(row[mild]) / words, np.log1p(count(row[mild]))
    x[:, 4] = count(row, weight) / np.sqrt(words)
    np.maximum.at(x[:, 5], row, weight)
    hashes = K.word_hashes(data, starts, ends)
    second = _PRONOUNS[np.minimum(np.searchsorted(_PRONOUNS, hashes), len(_PRONOUNS) - 1)] == hashes
    at = np.flatnonzero(second)
    if len(at):
        hits = np.flatnonzero(strong)
        place = np.searchsorted(at, hits)
        near = np.zeros(len(hits), bool)
        for k in (np.maximum(place - 1, 0), np.minimum(place, len(at) - 1)):
            near |= (np.abs(at[k] - hits) <= NEAR) & (row[at[k]] == row[hits])
        x[:, 6] = count(row[hits[near]]) / words
        x[:, 7] = count(row[at]) / words
    order = np.lexsort((hashes, row))
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[order][1:] != row[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
    x[:, 8] = count(row[order][fresh]) / words
    x[:, 9], x[:, 10] = np.log1p(count(row)), count(row, ends - starts) / words

    kept = _PLAIN[data] > 0
    upto = np.concatenate([[0], np.cumsum(kept)])
    plain, bounds = _PLAIN[data[kept]], upto[offsets]
    p_starts, p_ends, p_row = K.words(plain, bounds, _LETTER)
    bare = lexicon.weights(plain, p_starts, p_ends) >= 2.5
    x[:, 11] = np.maximum(count(p_row[bare]) - count(row[strong]), 0) / words

    size = np.maximum(np.diff(offsets), 1)
    upper = _UPPER[data]
    sums = lambda mask: (lambda c: c[offsets[1:]] - c[offsets[:-1]])(np.concatenate([[0], np.cumsum(mask)]))
    x[:, 12] = sums(upper) / size
    x[:, 13] = sums(data == 33) / words
    x[:, 14] = sums(data == 63) / words
    x[:, 15] = sums(_SIGN[data]) / size
    x[:, 16] = sums(_DIGIT[data]) / size
    capitals = np.concatenate([[0], np.cumsum(upper)])
    shout = (capitals[ends] - capitals[starts] == ends - starts) & (ends - starts > 2)
    x[:, 17] = count(row[shout]) / words
    return x


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of units among toxic and other rows, added up for each slice."""
    for batch in batches:
        toxic = column(batch, "toxic").to_numpy().astype(bool)
        for a, _, data, offsets in K.slices(column(batch, "text")):
            starts, ends, row = K.words(data, offsets, K.ALNUM)
            units = _units(data, starts, ends)
            rows = np.concatenate([row[at] for at, _ in units])
            hashes = np.concatenate([h for _, h in units])
            order = np.lexsort((rows, hashes))
            rows, hashes = rows[order], hashes[order]
            keep = np.ones(len(rows), bool)
            keep[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
            rows, hashes = rows[keep], hashes[keep]
            edges = K.runs(hashes)[:-1]
            if len(edges):
                bad = np.add.reduceat(toxic[a + rows].astype(np.int64), edges)
                good = np.add.reduceat((~toxic[a + rows]).astype(np.int64), edges)
                yield pa.record_batch([pa.array(hashes[edges].view(np.int64)), pa.array(bad), pa.array(good)], names=["unit", "bad", "good"])


def _lexicon(sample: DataFrame, bad: int, good: int) -> Lexicon:
    """Units that stand out by their log odds and by its size in standard errors; at most LEXICON of them."""
    counts = sample.select("text", "toxic").mapInArrow(handed_back(_counted), "unit long, bad long, good long").groupBy("unit").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    counts = counts.where(F.col("bad") >= max(4, bad // 50)).withColumn("odds", odds).withColumn("z", F.col("odds") / F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5)))
    top = counts.where("odds > 1 and z > 2.8").orderBy(F.desc("z"), "unit").limit(LEXICON).toArrow()
    hashes = top["unit"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return Lexicon(hashes[order], top["odds"].to_numpy().astype(float)[order])


@dataclass
class Model:
    lexicon: Lexicon
    trees: boosting.Boosted
    knots: np.ndarray
    values: np.ndarray

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return boosting.calibrated(self.trees.margin(_features(self.lexicon, data, offsets)), self.knots, self.values)


def _featured(lexicons: list[Lexicon]) -> Callable:
    """Features of each row by the lexicon of the other half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            half = column(batch, "half").to_numpy()
            for a, b, data, offsets in K.slices(column(batch, "text")):
                by = [_features(lexicon, data, offsets) for lexicon in lexicons]
                x = np.where((half[a:b] == 0)[:, None], by[1], by[0])
                yield pa.record_batch([column(batch, n).slice(a, b - a) for n in ("toxic", "half")] + [pa.array(list(x), pa.list_(pa.float64()))], names=["toxic", "half", "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Model from `labels(doc_id, toxic)` of `docs(doc_id, text)`."""
    labels = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    chosen = chosen.withColumn("half", F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)).cast("int"))
    # at most SAMPLE short rows are broadcast; a text that was copied teaches once, as toxic if any copy is marked so
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    sample = sample.groupBy("text").agg(F.max("toxic").alias("toxic"), F.min_by("half", "doc_id").alias("half"))
    totals = {r["half"]: (r["bad"], r["good"]) for r in sample.groupBy("half").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).collect()}
    halves = [_lexicon(sample.where(F.col("half") == h), *totals.get(h, (0, 0))) for h in (0, 1)]
    rows = sample.select("toxic", "half", "text").mapInArrow(handed_back(_featured(halves)), "toxic int, half int, x array<double>").toArrow()
    y, half = rows["toxic"].to_numpy().astype(float), rows["half"].to_numpy()
    x = np.array(rows["x"].to_pylist(), float).reshape(len(y), WIDTH)
    margin = np.zeros(len(y))
    for h in (0, 1):
        margin[half != h] = boosting.fit_trees(x[half == h], y[half == h]).margin(x[half != h])
    lexicon = _lexicon(sample, *[sum(t[k] for t in totals.values()) for k in (0, 1)])
    return Model(lexicon, boosting.fit_trees(x, y), *boosting.fit_isotonic(margin, y))


def _scored(model: Model, kept: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(data, offsets) for _, _, data, offsets in K.slices(column(batch, "text"))]
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.record_batch([column(batch, n) for n in kept] + [pa.array(score)], names=[*kept, "toxicity"])

    return run


def score(docs: DataFrame, model: Model, *kept: str) -> DataFrame:
    """The columns `kept` of every row, with its `toxicity` (0 to 1); needs the column `text`."""
    shown = docs.select(*dict.fromkeys([*kept, "text"]))
    out = "".join(f"`{n}` {shown.schema[n].dataType.simpleString()}, " for n in kept) + "toxicity double"
    return shown.mapInArrow(handed_back(_scored(model, list(kept))), out)
