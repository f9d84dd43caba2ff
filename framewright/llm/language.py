"""Language ID: word-first backoff.

A known word adds its log frequency in each language; an unseen word adds the
mean log frequency of its character 5-grams (with word-end marks), or of shorter
ones down to single characters where no longer one is known. The language with
the largest sum wins; the score is its share after the sums are damped by the
square root of the number of words.

Learned from at most `sample` rows and `sample_bytes` of text (those with the
smallest hashes of id and text, repeated rows once), outside the held-out fifth:
word counts are summed by the executors, one task makes the tables of all words of the sample, which its
bytes bound, and the tables alone reach the driver. Words and n-grams that occur fewer than `least` times (one: none) are
left out of the tables.

Defined results: null texts, empty texts and texts without a letter are `und`
with score 0, as is everything if nothing could be learned; rows with a null
lang are never learned from; ties go to the language that sorts first; repeated
rows give repeated results; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import Texts, batch_of, bounded_sample, map_batches, split_flag, tidy
from framewright.llm.words import P, hash_words, mix, spans, sums

#: Most rows, and bytes of text, to learn from.
SAMPLE, SAMPLE_BYTES = 16_000, 16 << 20
LONGEST = 5
#: Most words whose scores a worker keeps at a time.
CACHE = 400_000
_tables: list[np.ndarray] = []


def folded_letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower-cased letters as code points and 1 for everything else, offsets in code points)."""
    if not _tables:
        low = (ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in map(chr, range(0x110000)))
        _tables.append(np.fromiter((x if chr(i).isalpha() else 1 for i, x in enumerate(low)), np.uint32, 0x110000))
    try:
        text = data.tobytes().decode("utf-8")
        places = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    except UnicodeDecodeError:
        parts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets, offsets[1:], strict=False)]
        text, places = "".join(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int64)
    return _tables[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)], places


def gram_hashes(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word) of each character n-gram of words with a mark at both ends."""
    size = lengths + 2
    total = int(size.sum())
    heads = np.cumsum(size) - size
    at = np.repeat(starts - 1 - heads, size) + np.arange(total)
    buffer = codes[np.clip(at, 0, max(0, len(codes) - 1))] if len(codes) else np.zeros(0, np.uint32)
    buffer[heads] = 1
    buffer[heads + size - 1] = 1
    word = np.repeat(np.arange(len(size)), size)
    if total < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(total - n + 1, np.uint64)
    for j in range(n):
        h = h * P + buffer[j : total - n + 1 + j]
    inside = word[: total - n + 1] == word[n - 1 :]
    if n == 1:
        inside &= buffer != 1
    return mix(h[inside] + np.uint64(n)), word[: total - n + 1][inside]


class Table:
    """Log frequencies of hashed keys in each language."""

    def __init__(self, keys: np.ndarray, logs: np.ndarray):
        self.keys, self.logs = keys, logs

    @classmethod
    def of(cls, keys: np.ndarray, languages: np.ndarray, counts: np.ndarray, width: int, least: float, smooth: float) -> Table:
        uniq, code = np.unique(keys, return_inverse=True)
        grid = np.bincount(code * width + languages, counts, len(uniq) * width).reshape(-1, width)
        kept = grid.sum(1) >= least
        uniq, grid = uniq[kept], grid[kept]
        total = grid.sum(0) + smooth * max(1, len(uniq))
        return cls(uniq, (np.log(grid + smooth) - np.log(total)).astype(np.float32))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where it isn't known."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        row = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[row] == keys, row, -1)


class Languages:
    """The model: languages, word table, and one table for each n-gram length."""

    def __init__(self, names: list[str], tables: dict[int, Table]):
        self.names, self.words = names, tables[0]
        self.grams = {n: t for n, t in tables.items() if n}

    @classmethod
    def of(cls, words: pd.DataFrame, least: int = 1) -> Languages:
        """From (lang, word, n): table 0 of words, table n of n-grams."""
        names = sorted(words["lang"].unique().tolist())
        width = len(names)
        text = words["word"].tolist()
        data = np.frombuffer("".join(text).encode(), np.uint8)
        ends = np.cumsum([len(x.encode()) for x in text]).astype(np.int64) if text else np.zeros(0, np.int64)
        codes, places = folded_letters(data, np.concatenate(([0], ends)).astype(np.int64))
        starts, lengths = places[:-1], np.diff(places)
        language = words["lang"].map({x: i for i, x in enumerate(names)}).to_numpy(np.int64)
        counts = words["n"].to_numpy(np.float64)
        tables = {0: Table.of(hash_words(codes, starts, lengths), language, counts, width, least, 0.3)}
        for n in range(1, LONGEST + 1):
            h, word = gram_hashes(codes, starts, lengths, n)
            tables[n] = Table.of(h, language[word], counts[word], width, least, 0.3)
        return cls(names, tables)

    def scores(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Centred scores of words in each language."""
        out = np.zeros((len(starts), len(self.names)), np.float32)
        row = self.words.find(hashes)
        known = row >= 0
        out[known] = self.words.logs[row[known]]
        left = np.flatnonzero(~known)
        for n in range(LONGEST, 0, -1):
            if not len(left):
                break
            h, word = gram_hashes(codes, starts[left], lengths[left], n)
            row = self.grams[n].find(h)
            hit = row >= 0
            seen = np.bincount(word[hit], minlength=len(left))
            firsts = np.concatenate(([0], np.cumsum(seen)))
            total = sums(self.grams[n].logs[row[hit]], firsts)
            done = seen > 0
            out[left[done]] = total[done] / seen[done, None]
            left = left[~done]
        return out - out.mean(axis=1, keepdims=True)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, least: int = 1) -> Languages | None:
    """The model, or None if there is nothing to learn from."""
    usable = docs.filter(~split_flag(5, 0, id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    rows = bounded_sample(usable.select(id_col, lang_col, text_col), sample, sample_bytes, [id_col, lang_col, text_col], F.octet_length(text_col)).select(lang_col, text_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            texts, names = Texts(batch.column(1)), np.array(batch.column(0).cast(pa.string()).to_pylist(), object)
            for lo, hi, data, offsets in texts.slices():
                codes, places = folded_letters(data, offsets)
                starts, lengths, firsts = spans(codes != 1, places)
                word = hash_words(codes, starts, lengths)
                code, uniq = pd.factorize(word)
                at = np.zeros(len(uniq), np.int64)
                at[code[::-1]] = np.arange(len(code))[::-1]
                lang, seen = pd.factorize(np.repeat(names[lo:hi], np.diff(firsts)))
                pair, n = np.unique(code.astype(np.int64) * max(1, len(seen)) + lang, return_counts=True)
                spelled = np.array([codes[starts[i] : starts[i] + lengths[i]].astype("<u4").tobytes().decode("utf-32-le", "replace") for i in at], object)
                yield batch_of(
                    ["lang", "word", "n"],
                    [pa.array(seen[pair % max(1, len(seen))], pa.string()), pa.array(spelled[pair // max(1, len(seen))], pa.string()), n.astype(np.int64)],
                )

    counts = rows.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in tidy(batches) if b.num_rows]
        if not held:
            return
        words = pa.Table.from_batches(held).to_pandas().sort_values(["lang", "word"], ignore_index=True)
        model = Languages.of(words, least)
        tables = {0: model.words} | model.grams
        kinds = (pa.int32(), pa.list_(pa.string()), pa.binary(), pa.binary())
        rows = [(n, model.names, t.keys.tobytes(), t.logs.tobytes()) for n, t in tables.items()]
        yield batch_of(["n", "names", "keys", "logs"], [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)])

    # one task makes the tables of the sample; a row for each of them
    rows = counts.repartition(1).mapInArrow(built, "n int, names array<string>, keys binary, logs binary").collect()
    if not rows:
        return None
    names = list(rows[0]["names"])
    return Languages(names, {r["n"]: Table(np.frombuffer(bytes(r["keys"]), np.uint64), np.frombuffer(bytes(r["logs"]), np.float32).reshape(-1, len(names))) for r in rows})


class Predictor:
    """Scores of words seen so far, in one worker."""

    def __init__(self, model: Languages):
        self.model = model
        self.rows: dict[int, int] = {}
        self.pool = np.zeros((1 << 12, len(model.names)), np.float32)

    def word_scores(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        hashes = hash_words(codes, starts, lengths)
        code, uniq = pd.factorize(hashes)
        if len(self.rows) > CACHE:
            self.rows = {}
        keys = uniq.tolist()
        rows = self.rows
        new = [i for i, k in enumerate(keys) if k not in rows]
        if new:
            at = np.zeros(len(uniq), np.int64)
            at[code[::-1]] = np.arange(len(code))[::-1]
            at, base = at[new], len(rows)
            while base + len(new) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            for lo in range(0, len(new), 50_000):
                part = at[lo : lo + 50_000]
                self.pool[base + lo : base + lo + len(part)] = self.model.scores(codes, starts[part], lengths[part], hashes[part])
            rows.update((keys[i], base + j) for j, i in enumerate(new))
        return self.pool[np.fromiter((rows[k] for k in keys), np.int64, len(keys))][code]

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(language number or -1, score) of each text."""
        texts = Texts(column)
        best, score = np.full(len(texts), -1), np.zeros(len(texts))
        for lo, hi, data, offsets in texts.slices():
            codes, places = folded_letters(data, offsets)
            starts, lengths, firsts = spans(codes != 1, places)
            n = np.diff(firsts)
            total = sums(self.word_scores(codes, starts, lengths), firsts) / np.sqrt(np.maximum(n, 1))[:, None]
            share = np.exp(total - total.max(axis=1, keepdims=True))
            share /= share.sum(axis=1, keepdims=True)
            best[lo:hi] = np.where(n > 0, share.argmax(axis=1), -1)
            score[lo:hi] = np.where(n > 0, share.max(axis=1), 0.0)
        return best, np.round(score, 6)


def _predictor(df: DataFrame, model: Languages | None, text_at: int):
    shared = df.sparkSession.sparkContext.broadcast(model)
    made: list[Predictor] = []

    def predict(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[str]]:
        if shared.value is None:
            return np.full(batch.num_rows, -1), np.zeros(batch.num_rows), []
        if not made:
            made.append(Predictor(shared.value))
        return *made[0].predict(batch.column(text_at)), shared.value.names

    return predict


def has_letter(column: pa.Array) -> np.ndarray:
    """Whether each text holds a letter."""
    texts = Texts(column)
    out = np.zeros(len(texts), bool)
    for lo, hi, data, offsets in texts.slices():
        codes, places = folded_letters(data, offsets)
        out[lo:hi] = np.diff(spans(codes != 1, places)[2]) > 0
    return out


def identify_languages(docs: DataFrame, model: Languages | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score) for each row of docs."""
    predict = _predictor(docs, model, 1)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        best, score, names = predict(batch)
        said = [names[i] if i >= 0 else "und" for i in best]
        return batch_of([id_col, "held_out", "lang_pred", "score"], [batch.column(0), batch.column(2), pa.array(said, pa.string()), score])

    rows = docs.select(id_col, text_col, split_flag(5, 0, id_col).alias("held_out"))
    return map_batches(rows, run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, held_out boolean, lang_pred string, score double")


def drop_unidentified(docs: DataFrame, model: Languages | None, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns as they are, with a language of at least `least` score (those with a letter, if nothing could be learned)."""
    text_at = docs.columns.index(text_col)
    predict = _predictor(docs, model, text_at)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        best, score, names = predict(batch)
        return batch.filter(pa.array((best >= 0) & (score >= least) if names else has_letter(batch.column(text_at)), pa.bool_()))

    return map_batches(docs, run, docs.schema)
