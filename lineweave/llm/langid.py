"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lowered, runs of non-letters become one space, and their n-grams of one to three characters are hashed into
FEATURES cells. Document frequencies are counted over all training documents. Weights are learned from a bounded sample,
SAMPLE_PER_LANG documents of each of the MAX_LANGS most frequent languages (those with the smallest hashes, so that any
partitioning gives the same), by
follow-the-regularised-leader with elastic-net penalties; a fifth of the sample isn't learned from but gives the
temperature that makes scores probabilities. Every document is predicted from its whole text alone.

A document is held out, and never learned from, if crc32 of its doc_id as text leaves 2 when divided by 4.

Edge cases: a text that is null or has no letter is `und` with score 0; so is every text when no document is labelled; a
null lang is never learned; a document without doc_id isn't held out; a very long text is one vector like any other; of
equal scores the first language by name is taken; repeated rows each have their row and are learned once; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.llm import common

FEATURES_BITS = 15
FEATURES = 1 << FEATURES_BITS
SAMPLE_PER_LANG = 800
#: Languages that are learned, those with the most documents: the bound of the sample, with SAMPLE_PER_LANG, and of the weights.
MAX_LANGS = 200
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.0005
UNKNOWN = "und"

_LETTER = np.array([chr(c).isalpha() for c in range(1 << 16)])
#: Odd multipliers of the n-gram hashes.
_MIX = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


def features(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Cells and counts of a text's n-grams; None if it has no letter."""
    if not text:
        return None
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _LETTER[np.minimum(cp, 0xFFFF)]
    if len(high := np.flatnonzero(cp > 0xFFFF)):
        letter[high] = [chr(c).isalpha() for c in cp[high]]
    if not letter.any():
        return None
    cp = np.where(letter, cp, np.uint32(32))
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    cp = np.concatenate([[np.uint32(32)], cp[keep], [np.uint32(32)]]).astype(np.uint32)
    one = cp * _MIX[0]
    two = (one[:-1] ^ (cp[1:] + np.uint32(0x9E37))) * _MIX[1]
    three = (two[:-1] ^ (cp[2:] + np.uint32(0x79B9))) * _MIX[2]
    shift = np.uint32(32 - FEATURES_BITS)
    n = np.bincount(np.concatenate([one[1:-1] >> shift, two >> shift, three >> shift]), minlength=FEATURES)
    cells = np.flatnonzero(n)
    return cells, n[cells]


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # languages x FEATURES
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, cells: np.ndarray, n: np.ndarray) -> np.ndarray:
        v = (1 + np.log(n)) * self.idf[cells]
        return v / np.sqrt((v * v).sum())

    def logits(self, cells: np.ndarray, v: np.ndarray) -> np.ndarray:
        return self.weights[:, cells] @ v + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        found = features(text) if self.langs else None
        if found is None:
            return UNKNOWN, 0.0
        p = _softmax(self.logits(found[0], self.vector(*found)) / self.temperature)
        k = int(np.argmax(p))
        return self.langs[k], float(min(1.0, p[k]))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def train(sample: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray) -> Model:
    """sample: language, cells and counts of each document, in an order that doesn't depend on the partitioning."""
    langs = sorted({x[0] for x in sample})
    model = Model(langs, idf, np.zeros((len(langs), FEATURES)), np.zeros(len(langs)))
    if not langs:
        return model
    cells = [x[1] for x in sample]
    vectors = [model.vector(x[1], x[2]) for x in sample]
    label = np.array([langs.index(x[0]) for x in sample])
    held = np.arange(len(sample)) % 5 == 4
    z, n = np.zeros((len(langs), FEATURES + 1)), np.zeros((len(langs), FEATURES + 1))  # the last cell is the bias
    full = [(np.append(c, FEATURES), np.append(v, 1.0)) for c, v in zip(cells, vectors, strict=True)]
    shrink = np.append(np.full(FEATURES, L1), 0.0)

    def weights(c) -> np.ndarray:
        l1 = shrink[c]
        return np.where(np.abs(z[:, c]) <= l1, 0.0, -(z[:, c] - np.sign(z[:, c]) * l1) / ((BETA + np.sqrt(n[:, c])) / ALPHA + L2))

    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in order.permutation(np.flatnonzero(~held)):
            c, v = full[i]
            w = weights(c)
            p = _softmax(w @ v)
            p[label[i]] -= 1
            g = p[:, None] * v
            z[:, c] += g - (np.sqrt(n[:, c] + g * g) - np.sqrt(n[:, c])) / ALPHA * w
            n[:, c] += g * g
    every = weights(np.arange(FEATURES + 1))
    model.weights, model.bias = np.ascontiguousarray(every[:, :-1]), every[:, -1]
    if held.any():
        scores = [(model.logits(cells[i], vectors[i]), label[i]) for i in np.flatnonzero(held)]
        grid = np.geomspace(0.05, 20, 80)
        loss = [-sum(np.log(max(1e-300, _softmax(s / t)[k])) for s, k in scores) for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def is_held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df = np.zeros(FEATURES + 1, np.int64)
    for batch in batches:
        for k in range(0, len(batch), 256):
            for text in batch.column("text")[k : k + 256].to_pylist():
                if (found := features(text)) is not None:
                    df[found[0]] += 1
                    df[-1] += 1
    yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([zlib.compress(df.astype("<i8").tobytes(), 1)])], names=["k", "cells"])


def _as_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(lang, h, *found) for lang, h, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "h", "text")), strict=True) if (found := features(text)) is not None]
        if rows:
            cols = list(zip(*rows, strict=True))
            arrays = [pa.array(cols[0]), pa.array(cols[1], pa.int64()), *(pa.array([x.astype(np.int32) for x in c], pa.list_(pa.int32())) for c in cols[2:])]
            yield pa.RecordBatch.from_arrays(arrays, names=["lang", "h", "cells", "n"])


def fit(docs: DataFrame, *, per_lang: int = SAMPLE_PER_LANG) -> Model:
    """docs: doc_id, text and lang; learns from labelled documents that aren't held out."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    own = own.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out()).withColumn("h", F.xxhash64("doc_id", "text"))
    counts = common.smallest(own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select(F.lit(0).alias("all"), (-F.col("n")).alias("less"), "lang"), "all", ["less", "lang"], MAX_LANGS)
    first = common.smallest(own.select("lang", "h").join(F.broadcast(counts.select("lang")), "lang", "left_semi").distinct(), "lang", ["h"], per_lang)
    chosen = own.join(F.broadcast(first), ["lang", "h"]).dropDuplicates(["lang", "h"])  # per_lang rows of MAX_LANGS languages at most
    rows = chosen.mapInArrow(_as_features, "lang string, h long, cells array<int>, n array<int>").collect()
    sample = [(r.lang, np.array(r.cells, np.int64), np.array(r.n, np.float64)) for r in sorted(rows, key=lambda r: (r.h, r.lang))]
    df = common.sum_vectors(own.select("text").mapInArrow(_frequencies, "k int, cells binary"), FEATURES + 1)
    return train(sample, np.log((1 + df[-1]) / (1 + df[:-1])) + 1)


def identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    model = docs.sparkSession.sparkContext.broadcast(model or fit(docs))

    def ran(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                langs, scores = zip(*map(model.value.predict, part.column("text").to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = common.texts(docs).withColumn("held_out", is_held_out())
    return rows.mapInArrow(ran, "doc_id long, held_out boolean, lang_pred string, score double")
