"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts come from NumPy passes over many texts at once. Trees
of a fixed depth are grown level by level on histograms of binned statistics
(logistic loss, second-order gains); they are flattened into arrays, so that a
batch walks all trees with a few vector steps.

Learned from at most `sample` labelled rows (those with the smallest id hashes)
outside the held-out third; the executors compute their statistics, and one task
grows the trees in a fixed order. Everything is scored.

Defined results: null and empty texts have statistics of zeros and are scored
like any other; rows without a label or with a null label are never learned
from; an id with several labels counts as good only if all say so; with no
labelled row every score is 0.5; repeated rows give repeated results; extra
columns are not read.
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
from framewright.llm.words import hash_words, mix, owner, spans, sums

SAMPLE = 20_000

_b = np.arange(256)
#: Byte classes: letters, digits, white space, line ends, punctuation by kind, the rest.
CLASSES = ["lower", "upper", "digit", "space", "line", "stop", "comma", "loud", "mark", "bar", "quote", "bracket", "other", "lead", "follow"]
_class = np.full(256, CLASSES.index("other"), np.uint8)
for _name, _chars in (
    ("lower", b"abcdefghijklmnopqrstuvwxyz"), ("upper", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digit", b"0123456789"), ("space", b" \t\r\x0b\x0c"),
    ("line", b"\n"), ("stop", b".?"), ("comma", b",;:"), ("loud", b"!"), ("mark", b"#$%&*@^~+=<>"), ("bar", b"|/\\_"), ("quote", b"\"'`-"), ("bracket", b"()[]{}"),
):
    _class[np.frombuffer(_chars, np.uint8)] = CLASSES.index(_name)
_class[192:] = CLASSES.index("lead")
_class[128:192] = CLASSES.index("follow")
_blank = np.zeros(256, bool)
_blank[[9, 10, 11, 12, 13, 32]] = True

STATISTICS = (
    ["log_bytes"] + [f"share_{c}" for c in CLASSES]
    + ["upper_of_letters", "log_words", "word_length", "word_length_spread", "long_words", "short_words", "distinct_words", "top_word", "same_as_last",
       "same_as_before_last", "marked_words", "capital_words", "log_lines", "line_words", "repeated_lines", "repeated_line_words", "distinct_pairs", "distinct_fours"]
)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    per = np.maximum(size, 1)
    kind = _class[data]
    counts = np.bincount(np.repeat(np.arange(n) * len(CLASSES), size) + kind, minlength=n * len(CLASSES)).reshape(n, -1)
    share = counts / per[:, None]
    upper = counts[:, 1] / np.maximum(counts[:, 0] + counts[:, 1], 1)

    starts, lengths, firsts = spans(~_blank[data], offsets)
    text = owner(firsts)
    n_words = np.diff(firsts)
    of = np.maximum(n_words, 1)
    h = hash_words(data, starts, lengths)
    mean = sums(lengths, firsts) / of
    spread = np.sqrt(np.maximum(sums(lengths.astype(np.float64) ** 2, firsts) / of - mean**2, 0))

    def repeats(keys: np.ndarray, owners: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(share of distinct keys, share of the commonest key) of each text."""
        code, uniq = pd.factorize(mix(keys ^ mix(owners.astype(np.uint64) + np.uint64(1))))
        number = np.bincount(code, minlength=len(uniq))
        at = np.zeros(len(uniq), np.int64)
        at[code] = owners
        top = np.zeros(n)
        np.maximum.at(top, at, number)
        return np.bincount(at, minlength=n) / np.maximum(total, 1), top / np.maximum(total, 1)

    def runs(k: int) -> np.ndarray:
        if len(h) < k:
            return np.zeros(n)
        key = np.zeros(len(h) - k + 1, np.uint64)
        for j in range(k):
            key = mix(key + h[j : len(h) - k + 1 + j])
        inside = text[: len(key)] == text[k - 1 :]
        return repeats(key[inside], text[: len(key)][inside], np.maximum(n_words - k + 1, 0))[0]

    def same(gap: int) -> np.ndarray:
        if len(h) <= gap:
            return np.zeros(n)
        hit = (h[gap:] == h[:-gap]) & (text[gap:] == text[:-gap])
        return np.bincount(text[gap:][hit], minlength=n) / of

    distinct, top = repeats(h, text, n_words)
    ends = data[starts + lengths - 1] if len(starts) else data[:0]
    heads = data[starts] if len(starts) else data[:0]
    flag = lambda x: np.bincount(text[x], minlength=n) / of

    lstart, llen, lfirst = spans(data != 10, offsets)
    n_lines = np.diff(lfirst)
    lines_of = owner(lfirst)
    line_words = np.diff(np.append(np.searchsorted(starts, lstart), len(starts)))
    # a line's key: its length and the sum of its words' hashes by place
    csum = np.concatenate(([np.uint64(0)], np.cumsum(h * (np.arange(len(h), dtype=np.uint64) * np.uint64(2) + np.uint64(1)))))
    first_word = np.searchsorted(starts, lstart)
    plain = np.concatenate(([np.uint64(0)], np.cumsum(h)))
    a, b = first_word, np.minimum(first_word + line_words, len(h))
    key = mix((csum[b] - csum[a]) - (plain[b] - plain[a]) * (a.astype(np.uint64) * np.uint64(2))) ^ llen.astype(np.uint64)
    code, uniq = pd.factorize(mix(key ^ mix(lines_of.astype(np.uint64) + np.uint64(1))))
    again = (np.bincount(code, minlength=len(uniq)) > 1)[code] if len(code) else np.zeros(0, bool)
    repeated = np.bincount(lines_of[again], minlength=n) / np.maximum(n_lines, 1)
    repeated_words = np.bincount(lines_of[again], weights=line_words[again], minlength=n) / of
    return np.column_stack([
        np.log1p(size), share, upper, np.log1p(n_words), mean, spread, flag(lengths > 12), flag(lengths < 3), distinct, top, same(1), same(2),
        flag(np.isin(_class[ends], [7, 8, 9, 12])), flag(_class[heads] == 1), np.log1p(n_lines), n_words / np.maximum(n_lines, 1), repeated, repeated_words, runs(2), runs(4),
    ]).astype(np.float32)


@dataclass(frozen=True)
class Boosting:
    trees: int = 80
    depth: int = 4
    rate: float = 0.15
    bins: int = 64
    l2: float = 1.0
    least: float = 1.0  # smallest sum of second derivatives in a leaf


@dataclass
class Trees:
    """Perfect trees as arrays: node i has children 2 i + 1 and 2 i + 2; a row goes right if its statistic is over the threshold."""

    feature: np.ndarray  # [trees, 2 ** depth - 1]
    threshold: np.ndarray
    leaf: np.ndarray  # [trees, 2 ** depth]
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        depth = (self.leaf.shape[1]).bit_length() - 1 if self.leaf.size else 0
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - len(leaf) + 1]
        return np.round(1.0 / (1.0 + np.exp(-np.clip(out, -35, 35))), 6)


def grow(x: np.ndarray, y: np.ndarray, how: Boosting = Boosting()) -> Trees:
    n, width = x.shape
    nodes, leaves = 2**how.depth - 1, 2**how.depth
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if n else 0.5
    bias = float(np.log(rate / (1 - rate)))
    if not n or y.min() == y.max():
        empty = np.zeros((0, nodes))
        return Trees(empty.astype(np.int64), empty, np.zeros((0, leaves)), bias)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, how.bins + 1)[1:-1])) for f in range(width)]
    binned = np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])  # bin b: over cuts[b - 1], at most cuts[b]
    usable = np.array([[b < len(c) for b in range(how.bins)] for c in cuts])
    score = np.full(n, bias)
    features, thresholds, values = [], [], []
    for _ in range(how.trees):
        p = 1.0 / (1.0 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-12)
        feature, threshold = np.zeros(nodes, np.int64), np.full(nodes, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(how.depth):
            first, wide = 2**level - 1, 2**level
            at = node - first
            key = (at[:, None] * width + np.arange(width)) * how.bins + binned
            shape = (wide, width, how.bins)
            gs = np.bincount(key.ravel(), np.repeat(g, width), wide * width * how.bins).reshape(shape).cumsum(2)
            hs = np.bincount(key.ravel(), np.repeat(h, width), wide * width * how.bins).reshape(shape).cumsum(2)
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + how.l2) + (gt - gs) ** 2 / (ht - hs + how.l2) - gt**2 / (ht + how.l2)
            gain[~(usable[None] & (hs >= how.least) & (ht - hs >= how.least))] = -1.0
            best = gain.reshape(wide, -1).argmax(1)
            good = gain.reshape(wide, -1)[np.arange(wide), best] > 1e-9
            f, b = best // how.bins, best % how.bins
            feature[first : first + wide] = f
            threshold[first : first + wide] = [cuts[i][j] if ok else np.inf for i, j, ok in zip(f, b, good, strict=True)]
            right = (binned[np.arange(n), f[at]] > b[at]) & good[at]
            node = 2 * node + 1 + right
        at = node - nodes
        leaf = -how.rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + how.l2)
        score = score + leaf[at]
        features.append(feature)
        thresholds.append(threshold)
        values.append(leaf)
    return Trees(np.array(features), np.array(thresholds), np.array(values), bias)


def of_column(column: pa.Array) -> np.ndarray:
    texts = Texts(column)
    parts = [statistics(data, offsets) for _, _, data, offsets in texts.slices()]
    return np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)), np.float32)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, how: Boosting = Boosting()) -> Trees:
    """Grow trees on labelled rows outside the held-out third."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~split_flag(3, 1, id_col))
    known = bounded_sample(known.groupBy(id_col).agg(F.min(F.col(label_col).cast("int")).alias("label")), sample, 1 << 62, [id_col])
    # at most `sample` rows of an id and a label
    rows = docs.select(id_col, text_col).join(F.broadcast(known), id_col).select(id_col, text_col, "label")

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = of_column(batch.column(1))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), pa.float32()))
        return batch_of(["k", "label", "x"], [batch.column(0).cast(pa.string()), batch.column(2), lists])

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in tidy(batches) if b.num_rows]
        y = np.concatenate([b.column(1).to_numpy() for b in held]) if held else np.zeros(0)
        x = np.concatenate([b.column(2).flatten().to_numpy() for b in held]).reshape(len(y), -1) if held else np.zeros((0, len(STATISTICS)))
        order = np.lexsort([*x.T, y])  # a fixed order that does not depend on how the rows were dealt
        t = grow(x[order], y[order].astype(np.float64), how)
        yield batch_of(
            ["feature", "threshold", "leaf", "bias"],
            [pa.array([t.feature.ravel().tolist()], pa.list_(pa.int64())), pa.array([t.threshold.ravel().tolist()], pa.list_(pa.float64())), pa.array([t.leaf.ravel().tolist()], pa.list_(pa.float64())), pa.array([t.bias])],
        )

    measured = map_batches(rows, measure, "k string, label int, x array<float>")
    # rows that repeat an id count once, whatever their number
    once = measured.groupBy("k").agg(F.min(F.struct("label", "x")).alias("s")).select("k", "s.label", "s.x")
    t = once.repartition(1).mapInArrow(grown, "feature array<long>, threshold array<double>, leaf array<double>, bias double").first()
    nodes = 2**how.depth - 1
    if t is None:
        return grow(np.zeros((0, len(STATISTICS))), np.zeros(0), how)
    return Trees(np.array(t["feature"], np.int64).reshape(-1, nodes), np.array(t["threshold"], float).reshape(-1, nodes), np.array(t["leaf"], float).reshape(-1, nodes + 1), t["bias"])


def score_quality(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(id, held_out, score, predicted) for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = shared.value.score(of_column(batch.column(1)))
        return batch_of([id_col, "held_out", "score", "predicted"], [batch.column(0), batch.column(2), s, (s >= threshold).astype(np.int32)])

    rows = docs.select(id_col, text_col, split_flag(3, 1, id_col).alias("held_out"))
    return map_batches(rows, run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, held_out boolean, score double, predicted int")
