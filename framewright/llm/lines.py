"""Line deduplication through sharded minimal perfect hashes.

Lines are known by a 128-bit hash of their key (stripped of white space, A-Z
lower-cased). Tasks count the documents of each distinct hash; hashes of two
documents or more (a line of one document can't be a repeat) are dealt to shards of
about SHARD_KEYS, and a task turns each shard into arrays: a minimal perfect
hash (a cascade of bit arrays: on each level the keys that have a bit to
themselves keep it, the others go on; a key's slot is the rank of its bit), and in the order
of slots a 64-bit fingerprint, which tells lines that are not indexed, and the count.

Documents probe the arrays. While all of them stay within `most_bytes` they are
broadcast, and one pass over the documents is enough. Beyond that the arrays
stay in their shards: the distinct hashes of each text go to the shards, each
shard's arrays come first in its task and its probes stream past them, and what
is found returns by the digest of the text. Hashes that a ten-thousandth of all probes or more share are
at most ten thousand; they make a shard that is broadcast in any case, so no
shard is hot.

Defined results: null and empty texts are one empty line; lines without any
code point in their key never go; each row counts as one document, repeated rows and null ids too; a
line counts once for each document; an empty table gives no rows. All columns of a table pass through `drop_lines`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.llm.common import Texts, batch_of, cut, map_batches, tidy, with_facts
from framewright.llm.simhash import fresh
from framewright.llm.words import P, mix

#: Documents with a line from which it goes, and from which it is indexed.
LEAST_DOCS, INDEXED = 10, 2
#: Hashes of one shard, and bytes of arrays up to which they are broadcast.
SHARD_KEYS, MOST_BYTES = 1 << 16, 32 << 20
#: Hashes of this share of all probes are hot.
HOT_SHARE = 10_000
#: Bits for each key of a level.
GAMMA = 1.5
BLANK = b" \t\n\x0b\x0c\r"
FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
MOST_COUNT = (1 << 32) - 1


def keys_of(text: bytes) -> list[bytes]:
    """The key of each line."""
    return [line.strip(BLANK) for line in text.translate(FOLD).split(b"\n")]


def hashed(keys: list[bytes]) -> np.ndarray:
    """(n, 2) words of the keys' hashes."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), "<u8").reshape(len(keys), 2)


class PerfectHash:
    """Slots 0..n-1 of n distinct 128-bit keys."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.before = np.append(0, np.cumsum(np.bitwise_count(words), dtype=np.int64))

    @staticmethod
    def spot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        seed = mix(np.array([level + 1], np.uint64) * P)[0]
        return (mix(keys[:, 0] + mix(keys[:, 1] ^ seed)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        sizes, parts, level = [], [], 0
        while len(keys):
            size = max(64, -(-int(GAMMA * len(keys)) // 64) * 64)
            at = cls.spot(keys, level, size)
            alone = np.bincount(at, minlength=size) == 1
            parts.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            keys, level = keys[~alone[at]], level + 1
        return cls(np.array(sizes, np.int64), np.concatenate(parts) if parts else np.zeros(0, np.uint64))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; keys that are not indexed get any slot or -1."""
        out, open_, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            if not len(open_):
                break
            at = base + self.spot(keys[open_], level, size)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            there = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[open_[there]] = (self.before[at >> 6] + below)[there]
            open_, base = open_[~there], base + size
        return out


class Shard:
    """The arrays of one shard."""

    def __init__(self, sizes: bytes, words: bytes, prints: bytes, counts: bytes):
        self.hash = PerfectHash(np.frombuffer(sizes, np.int64), np.frombuffer(words, "<u8"))
        self.prints, self.counts = np.frombuffer(prints, "<u8"), np.frombuffer(counts, "<u4")

    @staticmethod
    def arrays(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
        found = PerfectHash.of(keys)
        slot = found.slots(keys)
        prints, held = np.empty(len(keys), "<u8"), np.empty(len(keys), "<u4")
        prints[slot], held[slot] = Shard.print_of(keys), np.minimum(counts, MOST_COUNT)
        return found.sizes.tobytes(), found.words.astype("<u8").tobytes(), prints.tobytes(), held.tobytes()

    @staticmethod
    def print_of(keys: np.ndarray) -> np.ndarray:
        return mix(keys[:, 0] ^ P) ^ keys[:, 1]

    def count(self, keys: np.ndarray) -> np.ndarray:
        """The documents of each key, 0 for keys that are not indexed."""
        slot = self.hash.slots(keys)
        out, there = np.zeros(len(keys), np.int64), np.flatnonzero(slot >= 0)
        same = self.prints[slot[there]] == self.print_of(keys[there])
        out[there[same]] = self.counts[slot[there[same]]]
        return out


class Shards:
    """Several shards that a task holds."""

    def __init__(self, rows: list[tuple[int, bytes, bytes, bytes, bytes]], number: int):
        self.number, self.rows, self.open = number, rows, None

    def count(self, keys: np.ndarray) -> np.ndarray:
        if self.open is None:
            self.open = {k: Shard(*arrays) for k, *arrays in self.rows}
        out = np.zeros(len(keys), np.int64)
        own = shard_of(keys, self.number)
        order = np.argsort(own, kind="stable")
        cuts = np.flatnonzero(np.diff(own[order], prepend=-1, append=self.number))
        for a, b in zip(cuts, cuts[1:], strict=False):
            if (shard := self.open.get(int(own[order[a]]))) is not None:
                out[order[a:b]] = shard.count(keys[order[a:b]])
        return out

    def __reduce__(self):
        return Shards, (self.rows, self.number)


def shard_of(keys: np.ndarray, number: int) -> np.ndarray:
    return keys[:, 0].view(np.int64) % number


def line_counts(docs: DataFrame, text_col: str = "text", least: int = INDEXED) -> DataFrame:
    """(a, b, n): the documents of each distinct line hash that has `least` or more."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        texts = Texts(batch.column(0))
        found = hashed([key for i in range(len(texts)) for key in set(keys_of(texts.text(i))) if key])
        order = np.lexsort((found[:, 1], found[:, 0]))
        found = found[order]
        new = np.flatnonzero(np.append(True, (found[1:] != found[:-1]).any(axis=1))) if len(found) else np.zeros(0, np.int64)
        n = np.diff(np.append(new, len(found)))
        return batch_of(["a", "b", "n"], [np.ascontiguousarray(found[new, 0]).view(np.int64), np.ascontiguousarray(found[new, 1]).view(np.int64), n])

    return map_batches(docs.select(text_col), run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


ARRAYS = "shard int, sizes binary, words binary, prints binary, counts binary"


def shards_of(counts: DataFrame, number: int) -> DataFrame:
    """The arrays of each shard of (a, b, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []

        def out() -> pa.RecordBatch:
            rows = np.concatenate(held)
            return batch_of(ARRAYS.replace(" int", "").replace(" binary", "").split(", "), [pa.array([shard], pa.int32()), *([x] for x in Shard.arrays(np.ascontiguousarray(rows[:, :2]).view(np.uint64), rows[:, 2]))])

        for batch in tidy(batches):
            own, rows = batch.column(0).to_numpy(), np.column_stack([batch.column(c).to_numpy() for c in (1, 2, 3)])
            cuts = np.flatnonzero(np.diff(own, prepend=-1, append=-1)) if len(own) else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if shard is not None and own[a] != shard:
                    yield out()
                    held = []
                shard = int(own[a])
                held.append(rows[a:b])
        if held:
            yield out()

    dealt = counts.select(F.pmod("a", F.lit(number)).cast("int").alias("shard"), "a", "b", "n")
    return dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, ARRAYS)


def local(shards: DataFrame, number: int) -> Shards:
    """Shards whose bytes have been counted to be few."""
    return Shards([(r["shard"], *(bytes(x) for x in list(r)[1:])) for r in shards.collect()], number)


def text_digest(text: bytes) -> int:
    return np.array([xxhash.xxh3_64_intdigest(text)], np.uint64).view(np.int64)[0]


def dealt_hits(docs: DataFrame, text_col: str, hot: Shards, shards: DataFrame, number: int, least: int) -> DataFrame:
    """(digest, lines array<struct<a, b>>): the hashes outside `hot` of each text's lines that `least` or more documents have."""

    def probes(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = Texts(batch.column(0))
        sets = [[key for key in set(keys_of(texts.text(i))) if key] for i in range(len(texts))]
        keys = hashed([key for keys in sets for key in keys])
        digest = np.repeat(np.array([text_digest(texts.text(i)) for i in range(len(texts))], np.int64), [len(keys) for keys in sets])
        rest = np.flatnonzero(hot.count(keys) == 0)
        keys = np.ascontiguousarray(keys[rest]).view(np.int64)
        return batch_of(["digest", "a", "b"], [digest[rest], np.ascontiguousarray(keys[:, 0]), np.ascontiguousarray(keys[:, 1])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, own = None, None
        for batch in tidy(batches):
            at, kinds = batch.column(0).to_numpy(), batch.column(1)
            cuts = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else []
            for a, b in zip(cuts, [*cuts[1:], len(at)], strict=True):
                if at[a] != shard:
                    shard, own = at[a], None
                if not kinds[a].as_py():  # the arrays come first
                    own, a = Shard(*(batch.column(c)[a].as_py() for c in range(5, 9))), a + 1
                if own is not None and a < b:
                    part = batch.slice(a, b - a)
                    keys = np.column_stack([part.column(c).to_numpy() for c in (3, 4)]).view(np.uint64)
                    hit = pa.array(np.flatnonzero(own.count(keys) >= least))
                    yield batch_of(["digest", "a", "b"], [part.column(c).take(hit) for c in (2, 3, 4)])

    none = lambda *names: [F.lit(None).cast(kind).alias(name) for name, kind in names]
    arrays = ["sizes", "words", "prints", "counts"]
    asked = map_batches(docs.select(text_col), probes, "digest long, a long, b long").distinct()
    asked = asked.select(F.pmod("a", F.lit(number)).cast("int").alias("shard"), F.lit(1).alias("kind"), "digest", "a", "b", *none(*((x, "binary") for x in arrays)))
    held = shards.select("shard", F.lit(0).alias("kind"), *none(("digest", "long"), ("a", "long"), ("b", "long")), *arrays)
    found = held.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(run, "digest long, a long, b long")
    return found.groupBy("digest").agg(F.collect_list(F.struct("a", "b")).alias("lines"))


def without(text: bytes, gone: np.ndarray) -> str:
    return b"\n".join(line for line, out in zip(text.split(b"\n"), gone, strict=True) if not out).decode()


def drop_lines(
    docs: DataFrame, text_col: str = "text", least: int = LEAST_DOCS, most_bytes: int = MOST_BYTES, shard_keys: int = SHARD_KEYS, hot_share: int = HOT_SHARE,
    lines: str = "n_lines", dropped: str = "n_dropped",
) -> DataFrame:
    """docs without the lines whose key `least` or more documents have, and how many lines each text had and lost."""
    columns = docs.columns
    place = columns.index(text_col)
    known = cut(line_counts(docs, text_col, min(INDEXED, least)))
    total = known.agg(F.count("*").alias("keys"), F.sum("n").alias("probes")).first()
    number = max(1, -(-total["keys"] // shard_keys))
    shards = cut(shards_of(known, number))
    size = sum((F.length(c) for c in ("sizes", "words", "prints", "counts")), F.lit(0))
    held = shards.agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()["bytes"]
    schema = T.StructType(
        [T.StructField(f.name, T.StringType()) if f.name == text_col else f for f in docs.schema.fields] + [T.StructField(lines, T.LongType()), T.StructField(dropped, T.LongType())]
    )

    def kept(batch: pa.RecordBatch, gone_of) -> pa.RecordBatch:
        texts = Texts(batch.column(place))
        out, n, lost = [], [], []
        for lo, hi, _, _ in texts.slices():
            own = [keys_of(texts.text(i)) for i in range(lo, hi)]
            flat = [key for keys in own for key in keys]
            gone = gone_of(lo, own, hashed(flat)) & np.array([len(key) > 0 for key in flat])
            ends = np.cumsum([len(keys) for keys in own])
            for i, part in zip(range(lo, hi), np.split(gone, ends[:-1]), strict=True):
                out.append(without(texts.text(i), part))
                n.append(len(part))
                lost.append(int(part.sum()))
        held = [pa.array(out, pa.string()) if k == place else batch.column(k) for k in range(len(columns))]
        return pa.RecordBatch.from_arrays([*held, pa.array(n, pa.int64()), pa.array(lost, pa.int64())], names=[*columns, lines, dropped])

    if held <= most_bytes:
        all_of = local(shards, number)
        return map_batches(docs, lambda batch: kept(batch, lambda lo, own, keys: all_of.count(keys) >= least), schema)
    hot_keys = known.filter(F.col("n") * F.lit(hot_share) >= F.lit(total["probes"]))  # at most hot_share of them
    hot = local(shards_of(hot_keys, 1), 1)
    found = dealt_hits(docs, text_col, hot, shards, number, least)
    by, hits = fresh("__digest", columns), fresh("__lines", columns)

    def marked(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = Texts(batch.column(place))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([text_digest(texts.text(i)) for i in range(len(texts))], pa.int64())], names=[*batch.schema.names, by])

    def probed(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = batch.column(len(columns)).to_pylist()

        def gone_of(lo: int, own: list[list[bytes]], keys: np.ndarray) -> np.ndarray:
            known, firsts = hot.count(keys) >= least, np.cumsum([0, *map(len, own)])
            pairs = np.ascontiguousarray(keys).view(np.int64)
            for k in range(len(own)):
                if these := found[lo + k]:
                    there = {(x["a"], x["b"]) for x in these}
                    known[firsts[k] : firsts[k + 1]] |= [tuple(pair) in there for pair in pairs[firsts[k] : firsts[k + 1]].tolist()]
            return known

        return kept(batch, gone_of)

    rows = map_batches(docs, marked, T.StructType([*docs.schema.fields, T.StructField(by, T.LongType())]))
    met = with_facts(rows, found.toDF(by, hits), by, [text_col], "left").select(*[F.col(f"`{c}`") for c in columns], hits)
    return map_batches(met, probed, schema)
