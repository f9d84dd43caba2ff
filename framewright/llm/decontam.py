"""Benchmark decontamination by winnowing.

Each text keeps the smallest k-gram hash of every run of `window` neighbouring
k-grams (the last one that ties). Both sides choose alike inside a shared span of
k + window - 1 words, so every shared span of that length or more shares a kept
fingerprint. Document and benchmark fingerprints are joined, each pair of places is compared word by
word and extended to the left and right, as far as a span of that length around the
fingerprint reaches (further words belong to the next fingerprint's span), and
extensions of at least that length are hits. Places whose words all around the fingerprint agree
are one place, on both sides, so repeated words cost no pairs. Items of fewer words are one span
each; their whole-item hashes are joined with the document's runs of that length.

Distribution: a benchmark measured to have at most `most_bytes` of text is broadcast,
and every worker keeps its table: one pass over the documents, no shuffle. A larger one
stays distributed: a bitmap of its fingerprints (BITMAP_BITS bits, whatever its size) is broadcast, document
places that it lets pass are joined with the benchmark's by shuffles, hot
fingerprints in salted shares, and the hits come back to their documents by a digest of the text.

Defined results: a null or empty text has no words and no hits; items without
words match nothing; items with equal texts are all reported; a null item_id is
reported as an empty string; repeated rows give repeated results; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.llm.common import Texts, batch_of, cut, map_batches, with_facts
from framewright.llm.words import P, folded_words, mix

#: Fingerprints: k-grams of words, and how many neighbours share one minimum; K + WINDOW - 1 words are guaranteed.
K, WINDOW = 5, 6
#: Bytes of item text up to which a benchmark is broadcast.
MOST_BYTES = 8 << 20
BITMAP_BITS = 22
#: Pairs of places that are extended at a time.
JOINED = 1 << 18
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def run_hashes(words: np.ndarray, firsts: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k words from each place; NONE where the text ends before."""
    n = len(words)
    out = np.full(n, NONE, np.uint64)
    if n >= k:
        h = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            h = h * P + words[j : n - k + 1 + j]
        out[: n - k + 1] = np.minimum(mix(h ^ np.uint64(k)), NONE - np.uint64(1))
        tails = firsts[1:, None] - np.arange(1, k)[None, :]
        out[tails[tails >= firsts[:-1, None]]] = NONE
    return out


def winnowed(h: np.ndarray, window: int) -> np.ndarray:
    """The place of the smallest hash of each run of `window` places, the last one of those that tie.

    That is a place with neighbours that are not smaller before it and larger ones after it, `window` - 1 of both together.
    """
    n, side = len(h), window - 1
    edge = np.full(side, NONE, np.uint64)
    padded = np.concatenate([edge, h, edge])
    reach = np.zeros(n, np.int8)
    for way in (-1, 1):
        ok = h != NONE
        for j in range(1, window):
            other = padded[side + way * j : side + way * j + n]
            ok = ok & (other >= h if way < 0 else other > h)
            reach += ok
    return np.flatnonzero((reach >= side) & (h != NONE))


def around(words: np.ndarray, firsts: np.ndarray, at: np.ndarray, k: int, window: int) -> np.ndarray:
    """(place, word) the words from window - 1 before each place to as many after its k-gram; 0 outside the text."""
    text = np.searchsorted(firsts, at, "right") - 1
    places = at[:, None] + np.arange(1 - window, k + window - 1)[None, :]
    inside = (places >= firsts[text][:, None]) & (places < firsts[text + 1][:, None])
    return np.where(inside, np.maximum(words[np.clip(places, 0, max(0, len(words) - 1))], np.uint64(1)), np.uint64(0))


def reach(doc: np.ndarray, item: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """How many words to the left and right of a k-gram two rows of `around` agree without a gap; -1 where the k-grams differ."""
    same = (doc == item) & (doc != 0)
    core = same[:, window - 1 : window - 1 + k].all(axis=1)
    left = np.minimum.accumulate(same[:, : window - 1][:, ::-1], axis=1).sum(axis=1)
    right = np.minimum.accumulate(same[:, window - 1 + k :], axis=1).sum(axis=1)
    return np.where(core, left, -1), np.where(core, right, -1)


def digests(rows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of words."""
    h = np.zeros(len(rows), np.uint64)
    for j in range(rows.shape[1]):
        h = mix(h * P + rows[:, j] + np.uint64(j))
    return h


def places_of(words: np.ndarray, firsts: np.ndarray, k: int, window: int, short: list[int], whole: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, hashes, places): the winnowed k-grams (length 0), then the runs of each short length.

    whole: the texts are items, so the short runs are those of whole texts of that length, and only longer texts have k-grams.
    """
    size = np.diff(firsts)
    h = run_hashes(words, firsts, k)
    at = winnowed(h, window)
    if whole:
        at = at[size[np.searchsorted(firsts, at, "right") - 1] >= k + window - 1]
    yield 0, h[at], at
    for length in short:
        h = run_hashes(words, firsts, length)
        at = firsts[:-1][size == length] if whole else np.flatnonzero(h != NONE)
        yield length, h[at], at


class Bench:
    """Items: their words, and the table of their fingerprints."""

    def __init__(self, ids: list[str], texts: list[str | None], k: int, window: int):
        self.ids, self.k, self.window = ids, k, window
        words, firsts, _ = folded_words(*_flat(texts))
        size = np.diff(firsts)
        item = np.repeat(np.arange(len(size)), size)
        self.short = sorted(set(size[(size > 0) & (size < k + window - 1)].tolist()))
        #: for each length: sorted hashes, their items, and (for k-grams) the words around
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for length, h, at in places_of(words, firsts, k, window, self.short, True):
            near = around(words, firsts, at, k, window) if not length else np.zeros((len(at), 0), np.uint64)
            # places of an item with the same words around them are one
            _, once = np.unique(np.stack([h, item[at].astype(np.uint64), digests(near)], axis=1), axis=0, return_index=True) if len(at) else (None, np.zeros(0, np.int64))
            once = once[np.argsort(h[once], kind="stable")]
            self.tables[length] = h[once], item[at[once]], near[once]
        key = np.concatenate([t[0] for t in self.tables.values()])
        self.bitmap = np.zeros(1 << BITMAP_BITS, bool)
        self.bitmap[spot(key)] = True

    def pairs(self, length: int, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row of h, row of the table) for equal hashes, about JOINED pairs at a time."""
        key = self.tables[length][0]
        lo, hi = np.searchsorted(key, h, "left"), np.searchsorted(key, h, "right")
        at = np.flatnonzero(hi > lo)
        lo, n = lo[at], (hi - lo)[at]
        cuts = np.searchsorted(np.cumsum(n), np.arange(JOINED, int(n.sum()) + 1, JOINED), "right")
        for a, b in zip([0, *cuts], [*cuts, len(at)], strict=True):
            if b > a:
                size = n[a:b]
                yield np.repeat(at[a:b], size), np.repeat(lo[a:b] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def spot(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64((1 << BITMAP_BITS) - 1)).astype(np.int64)


def _flat(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    column = Texts(pa.array(texts, pa.string()))
    return column.data[column.offsets[0] : column.offsets[-1]], column.offsets - column.offsets[0]


def find_spans(words: np.ndarray, firsts: np.ndarray, bench: Bench, k: int, window: int) -> np.ndarray:
    """Rows (start, stop, item): spans of many texts' words that an item holds too; they cover all shared spans."""
    found = [np.zeros((0, 3), np.int64)]
    for length, h, at in places_of(words, firsts, k, window, bench.short, False):
        passed = bench.bitmap[spot(h)]
        h, at = h[passed], at[passed]
        if length:
            found += [np.stack([at[x], at[x] + length, bench.tables[length][1][y]], axis=1) for x, y in bench.pairs(length, h)]
            continue
        known = np.isin(h, bench.tables[0][0])
        h, at = h[known], at[known]
        near = around(words, firsts, at, k, window)
        # places with the same words around them meet the table once
        _, first, back = np.unique(digests(near), return_index=True, return_inverse=True)
        by = np.argsort(back, kind="stable")
        bounds = np.searchsorted(back[by], np.arange(len(first) + 1))
        for x, y in bench.pairs(0, h[first]):
            left, right = reach(near[first[x]], bench.tables[0][2][y], k, window)
            hit = (left >= 0) & (left + k + right >= k + window - 1)
            x, y, left, right = x[hit], bench.tables[0][1][y[hit]], left[hit], right[hit]
            # of a place and an item, the widest reach to each side; then all places that look so
            span = np.unique(np.stack([x, left, right, y], axis=1), axis=0)
            size = (bounds[1:] - bounds[:-1])[span[:, 0]]
            row = np.repeat(np.arange(len(span)), size)
            place = at[by[np.repeat(bounds[span[:, 0]] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]]
            found.append(np.stack([place - span[row, 1], place + k + span[row, 2], span[row, 3]], axis=1))
    return np.concatenate(found)


RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, hits array<struct<start: bigint, stop: bigint>>"


class Decontaminator:
    """A broadcast benchmark, and what it finds in texts."""

    def __init__(self, items: DataFrame, k: int, window: int):
        rows = items.collect()  # measured: at most most_bytes of text
        self.k, self.window = k, window
        self.held = items.sparkSession.sparkContext.broadcast(Packed([r["id"] for r in rows], [r["text"] for r in rows]))
        self.made: list[Bench] = []

    def __getstate__(self) -> dict:
        return self.__dict__ | {"made": []}

    def batch(self, column: pa.Array) -> list[tuple[int, list[str], np.ndarray]]:
        """For each text: its number of words, the items found (sorted), and its hit spans (merged)."""
        if not self.made:
            self.made.append(Bench(*self.held.value.unpacked(), self.k, self.window))
        bench, out = self.made[0], []
        texts = Texts(column)
        for lo, hi, data, offsets in texts.slices():
            words, firsts, _ = folded_words(data, offsets)
            spans = find_spans(words, firsts, bench, self.k, self.window)
            owner = np.searchsorted(firsts, spans[:, 0], "right") - 1
            order = np.argsort(owner, kind="stable")
            bounds = np.searchsorted(owner[order], np.arange(hi - lo + 1))
            for t, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                own = spans[order[a:b]]
                out.append((int(firsts[t + 1] - firsts[t]), sorted({bench.ids[i] for i in np.unique(own[:, 2])}), merged(own[:, :2] - firsts[t])))
        return out


class Packed:
    """Items, compressed."""

    def __init__(self, ids: list[str], texts: list[str | None]):
        sink = pa.BufferOutputStream()
        table = pa.table({"id": pa.array(ids, pa.string()), "text": pa.array(texts, pa.string())})
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        self.data = zlib.compress(sink.getvalue(), 1)

    def unpacked(self) -> tuple[list[str], list[str | None]]:
        table = pa.ipc.open_stream(zlib.decompress(self.data)).read_all()
        return table["id"].to_pylist(), table["text"].to_pylist()


def merged(spans: np.ndarray) -> np.ndarray:
    """Disjoint spans that cover the same places."""
    if not len(spans):
        return np.zeros((0, 2), np.int64)
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    ends = np.maximum.accumulate(spans[:, 1])
    new = np.ones(len(spans), bool)
    new[1:] = spans[1:, 0] > ends[:-1]
    heads = np.flatnonzero(new)
    return np.stack([spans[heads, 0], ends[np.append(heads[1:], len(spans)) - 1]], axis=1)


def items_of(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))


def small(items: DataFrame, most_bytes: int) -> bool:
    return items.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("id")), F.lit(0)).alias("n")).first()["n"] <= most_bytes


def text_key(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def emitted(k: int, window: int, short: list[int], whole: bool, keys: Callable[[pa.RecordBatch], list], passes: np.ndarray | None = None):
    """A mapInArrow function: (length, h, own, place, around) of each place of the batch's texts; own is the row's entry of `keys`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, named = Texts(batch.column(1)), None
            for lo, hi, data, offsets in texts.slices():
                named = pa.array(keys(batch)) if named is None else named
                words, firsts, _ = folded_words(data, offsets)
                for length, h, at in places_of(words, firsts, k, window, short, whole):
                    if passes is not None:
                        at, h = at[passes[spot(h)]], h[passes[spot(h)]]
                    text = np.searchsorted(firsts, at, "right") - 1
                    near = around(words, firsts, at, k, window) if not length else np.zeros((len(at), 0), np.uint64)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * near.shape[1], pa.int32()), pa.array(near.reshape(-1).view(np.int64)))
                    yield batch_of(
                        ["length", "h", "own", "place", "around"],
                        [np.full(len(at), length, np.int32), h.view(np.int64), named.take(pa.array(lo + text)), at - firsts[text], lists],
                    )

    return run


def distributed_hits(docs: DataFrame, text_col: str, items: DataFrame, k: int, window: int) -> DataFrame:
    """(key, hits array<struct<start, stop>>, items array<string>) of the texts (by text_key) that hold a span of an item."""
    span = k + window - 1
    n_words = items.select(F.size(F.filter(F.split(F.regexp_replace(F.lower("text"), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", " "), " "), lambda w: w != "")).alias("n"))
    short = sorted(r["n"] for r in n_words.filter(F.col("n").between(1, span - 1)).distinct().collect())  # fewer than `span` numbers
    places = "length int, h long, own {}, place long, around array<long>"
    bench = cut(items.mapInArrow(emitted(k, window, short, True, lambda batch: batch.column(0)), places.format("string")).dropDuplicates(["length", "h", "own", "around"]))
    bits = F.col("h").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1)) + 1  # bitmap positions count from 1
    rows = bench.groupBy(F.bitmap_bucket_number(bits).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bits)).alias("bits")).collect()  # 1 << BITMAP_BITS bits in all
    passes = np.zeros(1 << BITMAP_BITS, bool)
    for r in rows:
        own = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little")
        at = (r["b"] - 1) * len(own) + np.arange(len(own))
        at = at[(at >= 0) & (at < len(passes))]
        passes[at] = own[: len(at)] > 0
    text = docs.select(F.lit(0).alias("none"), F.col(text_col).alias("text"))
    keys = lambda batch: [text_key(t) for t in (texts.text(i) for texts in [Texts(batch.column(1))] for i in range(len(texts)))]
    found = cut(text.mapInArrow(emitted(k, window, short, False, keys, passes), places.format("long")).distinct())

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length, place = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            start, stop = place.copy(), place + length
            grams = np.flatnonzero(length == 0)
            if len(grams):
                doc, item = (batch.column(c).take(pa.array(grams)).flatten().to_numpy().reshape(len(grams), -1) for c in (3, 5))
                left, right = reach(doc, item, k, window)
                ok = (left >= 0) & (left + k + right >= span)
                start[grams], stop[grams] = np.where(ok, place[grams] - left, 0), np.where(ok, place[grams] + k + right, 0)
            keep = pa.array(np.flatnonzero(stop > start))
            yield batch_of(["key", "start", "stop", "item"], [batch.column(1).take(keep), pa.array(start).take(keep), pa.array(stop).take(keep), batch.column(4).take(keep)])

    right = bench.select(F.xxhash64("length", "h").alias("by"), "length", "h", F.col("own").alias("item"), F.col("around").alias("item_around"))
    left = found.withColumn("by", F.xxhash64("length", "h")).select("by", F.col("length").alias("n"), F.col("h").alias("g"), "own", "place", "around")
    pairs = with_facts(left, right, "by", ["own", "place"]).filter("n = length and g = h")
    spans = pairs.select("length", "own", "place", "around", "item", "item_around").mapInArrow(extend, "key long, start long, stop long, item string").distinct()
    return spans.groupBy("key").agg(F.collect_set(F.struct("start", "stop")).alias("hits"), F.sort_array(F.collect_set("item")).alias("items"))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    k: int = K, window: int = WINDOW, most_bytes: int = MOST_BYTES,
) -> DataFrame:
    """One row for each row of docs: which items' windows its whole text holds, and the words inside them."""
    items = items_of(benchmark, item_col, item_text)
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    names = [id_col] + [f.name for f in T._parse_datatype_string(RESULT).fields]
    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, {RESULT}"

    def written(ids: pa.Array, rows: list[tuple[int, list[str], np.ndarray]]) -> pa.RecordBatch:
        n_hit = [int((h[:, 1] - h[:, 0]).sum()) for _, _, h in rows]
        return batch_of(
            names,
            [
                ids,
                pa.array([n for n, _, _ in rows], pa.int64()),
                pa.array(n_hit, pa.int64()),
                pa.array([len(i) for _, i, _ in rows], pa.int64()),
                pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for _, i, _ in rows], pa.string()),
                pa.array([n > 0 for n in n_hit], pa.bool_()),
                pa.array([i for _, i, _ in rows], pa.list_(pa.string())),
                pa.array([[{"start": int(a), "stop": int(b)} for a, b in h] for _, _, h in rows], span),
            ],
        )

    if small(items, most_bytes):
        finder = Decontaminator(items, k, window)
        return map_batches(docs.select(id_col, text_col), lambda batch: written(batch.column(0), finder.batch(batch.column(1))), schema)

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = Texts(batch.column(1))
        n = np.zeros(len(texts), np.int64)
        for lo, hi, data, offsets in texts.slices():
            n[lo:hi] = np.diff(folded_words(data, offsets)[1])
        return batch_of(["id", "n", "key"], [batch.column(0), n, pa.array([text_key(texts.text(i)) for i in range(len(texts))], pa.int64())])

    def joined(batch: pa.RecordBatch) -> pa.RecordBatch:
        hits = [merged(np.array([[s["start"], s["stop"]] for s in h], np.int64).reshape(-1, 2)) for h in (x or [] for x in batch.column(2).to_pylist())]
        return written(batch.column(0), list(zip(batch.column(1).to_pylist(), (x or [] for x in batch.column(3).to_pylist()), hits, strict=True)))

    held = cut(distributed_hits(docs, text_col, items, k, window))
    rows = cut(map_batches(docs.select(id_col, text_col), counted, f"id {dict(docs.dtypes)[id_col]}, n long, key long"))
    return map_batches(with_facts(rows, held, "key", ["id"], "left").select("id", "n", "hits", "items"), joined, schema)


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = K, window: int = WINDOW, most_bytes: int = MOST_BYTES
) -> DataFrame:
    """The rows of docs, all columns as they are, whose text holds no benchmark span."""
    items, place = items_of(benchmark, item_col, item_text), docs.columns.index(text_col)
    if small(items, most_bytes):
        finder = Decontaminator(items, k, window)
        return map_batches(docs, lambda batch: batch.filter(pa.array([not len(h) for _, _, h in finder.batch(batch.column(place))], pa.bool_())), docs.schema)
    key = "__text_key"
    while key.lower() in {c.lower() for c in docs.columns}:
        key += "_"

    def keyed(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = Texts(batch.column(place))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([text_key(texts.text(i)) for i in range(len(texts))], pa.int64())], names=[*batch.schema.names, key])

    hit = key + "_hit"
    held = distributed_hits(docs, text_col, items, k, window).select(F.col("key").alias(key), F.lit(True).alias(hit))
    rows = map_batches(docs, keyed, T.StructType([*docs.schema.fields, T.StructField(key, T.LongType())]))
    return with_facts(rows, held, key, [f"`{c}`" for c, kind in docs.dtypes if "map<" not in kind and c != text_col], "left").filter(F.col(hit).isNull()).select(*[F.col(f"`{c}`") for c in docs.columns])
