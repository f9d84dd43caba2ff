"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the distinct hashed words, word pairs and pairs that skip
one word (lower-cased words of words.py). Every coordinate has its own learning
rate; L1 leaves few weights, which are broadcast as one small array.

The model is fitted on at most `sample` labelled ids and `sample_bytes` of their
texts (those with the smallest hashes); their features are built by the executors
and one task fits them in a fixed order. Everything is scored, whole texts only.

Defined results: null and empty texts have no features and score the base rate;
rows without a label, with a null label, or held out are never learned from; an
id with several labels counts as toxic if one of them says so; each distinct text
of an id is learned from once; with no labelled row at all every score is 0.5;
repeated rows give repeated results; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import Texts, batch_of, bounded_sample, map_batches, split_flag, tidy
from framewright.llm.words import P, folded_words, mix, owner, sums

#: Most labelled ids, and bytes of their texts, to learn from.
SAMPLE, SAMPLE_BYTES = 32_000, 32 << 20
BITS = 20


@dataclass(frozen=True)
class Ftrl:
    """Chosen by three folds inside the training two thirds (log loss over two sizes of table); held-out rows had no part in it."""

    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 10.0
    l2: float = 0.1
    epochs: int = 8
    bias_rate: float = 0.3


def grams(words: np.ndarray, firsts: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text) of each word, word pair and skip pair of many texts."""
    text = owner(firsts)
    shift = np.uint64(64 - bits)
    features, texts = [mix(words) >> shift], [text]
    for gap, salt in ((1, 0x51), (2, 0xA3)):
        if len(words) > gap:
            same = text[:-gap] == text[gap:]
            pair = mix(words[:-gap] * P + mix(words[gap:] ^ np.uint64(salt)))
            features.append((pair >> shift)[same])
            texts.append(text[:-gap][same])
    return np.concatenate(features).astype(np.int64), np.concatenate(texts)


def distinct(features: np.ndarray, texts: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text) without repeats, by text and feature."""
    key = np.sort(pd.unique((texts << bits) | features))
    return key & ((1 << bits) - 1), key >> bits


def fit(rows: list[np.ndarray], labels: np.ndarray, how: Ftrl, bits: int = BITS) -> tuple[np.ndarray, float]:
    """(weights, bias) after `epochs` passes in the given order."""
    z, n, w = np.zeros(1 << bits), np.zeros(1 << bits), np.zeros(1 << bits)
    rate = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3)) if len(labels) else 0.5
    bias, squared = float(np.log(rate / (1 - rate))), 1.0
    for _ in range(how.epochs):
        for x, y in zip(rows, labels, strict=True):
            p = 1.0 / (1.0 + np.exp(-min(35.0, max(-35.0, bias + w[x].sum()))))
            g = p - y
            if abs(g) < 1e-4:
                continue
            nx = n[x]
            root, grown = np.sqrt(nx), np.sqrt(nx + g * g)
            zx = z[x] + g - (grown - root) / how.alpha * w[x]
            z[x], n[x] = zx, nx + g * g
            w[x] = np.where(np.abs(zx) <= how.l1, 0.0, -(zx - np.sign(zx) * how.l1) / ((how.beta + grown) / how.alpha + how.l2))
            squared += g * g
            bias -= how.bias_rate * g / np.sqrt(squared)
    return w, bias


class Toxicity:
    """The compact weights, broadcast."""

    def __init__(self, weights: np.ndarray, bias: float, bits: int = BITS):
        self.bits, self.bias = bits, bias
        self.at = np.flatnonzero(weights).astype(np.int32)
        self.weights = weights[self.at].astype(np.float32)

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, np.float32)
        out[self.at] = self.weights
        return out

    def score(self, column: pa.Array, dense: np.ndarray) -> np.ndarray:
        texts = Texts(column)
        out = np.zeros(len(texts))
        for lo, hi, data, offsets in texts.slices():
            words, firsts, _ = folded_words(data, offsets)
            features, text = grams(words, firsts, self.bits)
            heavy = dense[features] != 0
            features, text = distinct(features[heavy], text[heavy], self.bits)
            bounds = np.searchsorted(text, np.arange(hi - lo + 1))
            out[lo:hi] = sums(dense[features].astype(np.float64), bounds)
        return np.round(1.0 / (1.0 + np.exp(-np.clip(out + self.bias, -35, 35))), 6)


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, how: Ftrl = Ftrl()
) -> Toxicity:
    """Fit on labelled rows outside the held-out third."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~split_flag(3, 1, id_col))
    known = known.groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    known = bounded_sample(known, sample, 1 << 62, [id_col])
    # at most `sample` rows of an id and a label
    rows = bounded_sample(docs.select(id_col, text_col).join(F.broadcast(known), id_col), sample, sample_bytes, [id_col, text_col], F.octet_length(text_col))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            texts = Texts(batch.column(1))
            for lo, hi, data, offsets in texts.slices():
                words, firsts, _ = folded_words(data, offsets)
                feature, text = distinct(*grams(words, firsts))
                bounds = np.searchsorted(text, np.arange(hi - lo + 1))
                yield batch_of(
                    ["k", "label", "x"],
                    [
                        batch.column(0).slice(lo, hi - lo).cast(pa.string()),
                        batch.column(2).slice(lo, hi - lo),
                        pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(feature, pa.int32())),
                    ],
                )

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ys, xs = [], [], []
        for batch in tidy(batches):
            keys += batch.column(0).to_pylist()
            ys.append(batch.column(1).to_numpy(zero_copy_only=False))
            lists = batch.column(2)
            flat, at = lists.values.to_numpy(), lists.offsets.to_numpy()
            xs += [flat[a:b] for a, b in zip(at, at[1:], strict=False)]
        if not keys:
            return
        y = np.concatenate(ys)
        # a fixed order that does not depend on how the rows were dealt
        order = sorted(range(len(keys)), key=lambda i: (hash_of(keys[i]), xs[i].tobytes()))
        w, bias = fit([xs[i] for i in order], y[order], how)
        at = np.flatnonzero(w)
        yield batch_of(["at", "w"], [np.append(at, -1).astype(np.int64), np.append(w[at], bias)])

    built = rows.select(id_col, text_col, "label").mapInArrow(features, "k string, label int, x array<int>")
    model = built.repartition(1).mapInArrow(fitted, "at long, w double").toPandas()
    w = np.zeros(1 << BITS)
    inside = model["at"] >= 0
    w[model["at"][inside].to_numpy()] = model["w"][inside].to_numpy()
    bias = model["w"][~inside]
    return Toxicity(w, float(bias.iloc[0]) if len(bias) else 0.0)


def hash_of(key: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(key, 7)


def _scored(df: DataFrame, model: Toxicity, text_at: int):
    shared = df.sparkSession.sparkContext.broadcast(model)
    made: list[np.ndarray] = []

    def score(batch: pa.RecordBatch) -> np.ndarray:
        if not made:
            made.append(shared.value.dense())
        return shared.value.score(batch.column(text_at), made[0])

    return score


def score_toxicity(docs: DataFrame, model: Toxicity, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """(id, held_out, score, predicted) for each row of docs."""
    score = _scored(docs, model, 1)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = score(batch)
        return batch_of([id_col, "held_out", "score", "predicted"], [batch.column(0), batch.column(2), s, (s >= threshold).astype(np.int32)])

    rows = docs.select(id_col, text_col, split_flag(3, 1, id_col).alias("held_out"))
    return map_batches(rows, run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Toxicity, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of docs, all columns as they are, that score below the threshold."""
    score = _scored(docs, model, docs.columns.index(text_col))
    return map_batches(docs, lambda batch: batch.filter(pa.array(score(batch) < threshold)), docs.schema)
