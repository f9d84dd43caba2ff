"""Best-fit packing by linear grouping, exact for any number of documents.

Documents become token ids and an end token; only longer ones are cut, so that
all pieces but the first are full. What the packing needs to know of them is
how many pieces there are of each length: at most `capacity` numbers, the only
data that reach the driver. There the large lengths are put into a few dozen groups
of equally many pieces and rounded up to the largest of their group. How often each
configuration of these few sizes fills a sequence comes from a linear program over
all configurations (column generation: a simplex over one column a size, priced
by a knapsack); its whole parts are used, actual lengths take the rounded ones' places,
and what is left is grouped anew, as long as that uses up large pieces. The
remaining and the small pieces then go best-fit into the rooms and new sequences. Several numbers of
groups and bounds of small pieces are tried, and the fewest sequences win. Sequences with
equal contents are one class with a count, so the work depends on the number of
lengths, not of documents.

Pieces find their places by rank: each one's rank among the pieces of its length
(counted per task, then summed over tasks) selects a class, a sequence of that
class and an offset, from a table whose size the lengths bound.

Defined results: a null or empty text is the end token alone; repeated rows are
packed like any others; empty input gives no rows; extra columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.llm.common import Texts, batch_of, cut, tidy
from framewright.llm.words import hash_words, sums

CAPACITY, END = 1024, 2
TOKENIZER = "byte_bpe_50k.json"
#: Numbers of groups of large lengths that are tried, and shares of a sequence below which a piece is small.
GROUPS, SMALL = (16, 32, 48), (1 / 4, 1 / 3, 2 / 5, 1 / 2)
#: Bytes of words whose ids a worker process keeps; later words are encoded anew for each slice of text.
CACHE_BYTES = 4 << 20
#: Bytes of text that are tokenized at a time (a longer single text makes a slice of its own).
SLICE = 1 << 20


# --- tokens

#: Where a space may be cut off as the start of a token: white space on neither side of it.
_between = re.compile(r"(?<=\S) (?=\S)")
#: A space with white space after it, as Unicode defines it.
_spaced = r" [\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


class Places64:
    """Open addressing from nonzero 64-bit hashes to numbers, for whole arrays at a time."""

    def __init__(self, bits: int = 16):
        self.bits, self.n = bits, 0
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 where it isn't known."""
        out = np.full(len(h), -1)
        left, at = np.arange(len(h)), (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(left):
            key = self.keys[at]
            hit = key == h[left]
            out[left[hit]] = self.values[at[hit]]
            more = ~hit & (key != 0)
            left, at = left[more], (at[more] + 1) & (len(self.keys) - 1)
        return out

    def add(self, h: np.ndarray, values: np.ndarray) -> None:
        """New distinct hashes."""
        if 2 * (self.n + len(h)) > len(self.keys):
            held = np.flatnonzero(self.keys)
            keys, old = self.keys[held], self.values[held]
            while 2 * (self.n + len(h)) > 1 << self.bits:
                self.bits += 1
            self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int64)
            self._put(keys, old)
        self._put(h, values)
        self.n += len(h)

    def _put(self, h: np.ndarray, values: np.ndarray) -> None:
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(h):
            free = self.keys[at] == 0
            self.keys[at[free]] = h[free]
            placed = free & (self.keys[at] == h)
            self.values[at[placed]] = values[placed]
            h, values, at = h[~placed], values[~placed], (at[~placed] + 1) & (len(self.keys) - 1)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, .. for each run of `size` places, one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class Tokens:
    """Ids of whole texts through a tokenizer, word by word, with the ids of words seen before kept.

    A space that no white space follows always begins a token, so texts are cut
    there; the others are cut at the spaces that stand between two words, and
    those with special tokens in them are encoded whole.
    """

    def __init__(self, path: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one core for each task
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path(TOKENIZER))
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known, self.n_known = Places64(), 0  # hash of a word after a space -> its place in the arrays below
        self.bytes, self.n_bytes = np.zeros(1 << 16, np.uint8), 0  # the words themselves: a hash alone does not make a word
        self.spelled = np.zeros((1 << 14, 2), np.int64)  # where a word starts there, and its length
        self.ids, self.sizes = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)
        self.n_ids = 0
        self.starts = np.zeros(1 << 14, np.int64)

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        flat, sizes = [], []
        for lo in range(0, len(texts), 1024):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts[lo : lo + 1024], add_special_tokens=False)]
            sizes += map(len, found)
            flat.append(np.fromiter(chain.from_iterable(found), np.uint32))
        return np.concatenate(flat) if flat else np.zeros(0, np.uint32), np.array(sizes, np.int64)

    def _keep(self, hashes: np.ndarray, words: Texts, at: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        first, n = self.n_known, len(at)
        while first + n > len(self.sizes):
            self.sizes, self.starts = np.concatenate([self.sizes, np.zeros_like(self.sizes)]), np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.spelled = np.concatenate([self.spelled, np.zeros_like(self.spelled)])
        long = words.offsets[at + 1] - words.offsets[at]
        chars = words.data[ranges(words.offsets[at], long)]
        while self.n_bytes + len(chars) > len(self.bytes):
            self.bytes = np.concatenate([self.bytes, np.zeros_like(self.bytes)])
        self.bytes[self.n_bytes : self.n_bytes + len(chars)] = chars
        self.spelled[first : first + n, 0] = self.n_bytes + np.cumsum(long) - long
        self.spelled[first : first + n, 1] = long
        self.n_bytes += len(chars)
        while self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.sizes[first : first + n] = sizes
        self.starts[first : first + n] = self.n_ids + np.cumsum(sizes) - sizes
        self.n_ids += len(ids)
        self.known.add(hashes, np.arange(first, first + n))
        self.n_known += n

    def _same(self, words: Texts, place: np.ndarray) -> np.ndarray:
        """Whether the word known at each place is the word."""
        long = np.diff(words.offsets)
        same = (place >= 0) & (self.spelled[place, 1] == long)
        at = np.flatnonzero(same & (long > 0))
        if len(at):
            differ = words.data[ranges(words.offsets[at], long[at])] != self.bytes[ranges(self.spelled[place[at], 0], long[at])]
            same[at[np.add.reduceat(differ, np.cumsum(long[at]) - long[at], dtype=np.int64) > 0]] = False
        return same

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, size) such that the word w after a space has ids[start : start + size]."""
        coded = words.dictionary_encode()
        uniq = Texts(coded.dictionary)
        starts, ends = uniq.offsets[:-1], uniq.offsets[1:]
        hashes = np.maximum(hash_words(uniq.data, starts, ends - starts), np.uint64(1))
        place = self.known.find(hashes)
        unseen = place < 0
        new = np.flatnonzero(~self._same(uniq, place))
        pool, starts, sizes = self.ids, self.starts[place], self.sizes[place]
        if len(new):
            texts = coded.dictionary.take(pa.array(new)).to_pylist()
            ids, n = self._encoded([" " + w for w in texts])
            if self.n_bytes < CACHE_BYTES and unseen[new].all() and len(np.unique(hashes[new])) == len(new):
                at = self.n_known
                self._keep(hashes[new], uniq, new, ids, n)
                pool, starts[new], sizes[new] = self.ids, self.starts[at : at + len(new)], n
            else:  # the cache is full, or two words share a hash
                pool, starts[new], sizes[new] = np.concatenate([self.ids[: self.n_ids], ids]), self.n_ids + np.cumsum(n) - n, n
        code = coded.indices.to_numpy()
        return pool, starts[code], sizes[code]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each); null counts as empty."""
        texts = pc.fill_null(texts, "")
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        spaced = pc.match_substring_regex(texts, _spaced).to_numpy(zero_copy_only=False)
        whole = np.zeros(len(texts), bool)
        for special in self.special:
            whole |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        if odd := np.flatnonzero(spaced | whole).tolist():
            lists = pc.split_pattern(pc.if_else(pa.array(~(spaced | whole)), texts, ""), " ").to_pylist()
            for i in odd:
                lists[i] = [""] if whole[i] else _between.split(texts[i].as_py())
            lists = pa.array(lists, pa.list_(pa.string()))
        else:
            lists = pc.split_pattern(texts, " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        words = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
        pool, starts, sizes = self._words(words)
        # a text's first word has no space before it, and some texts are encoded whole
        heads = offsets[:-1] - offsets[0]
        first = words.take(pa.array(heads)).to_pylist()
        for i in np.flatnonzero(whole).tolist():
            first[i] = texts[i].as_py()
        ids, n = self._encoded(first)
        starts[heads], sizes[heads] = len(pool) + np.cumsum(n) - n, n
        pool = np.concatenate([pool, ids])
        flat = pool[ranges(starts, sizes)]
        return flat, sums(sizes, np.append(heads, len(words)))


_tokens: dict[str | None, Tokens] = {}


def tokens_of(path: str | None) -> Tokens:
    """The tokenizer of this worker process, with the words that earlier tasks have seen."""
    if path not in _tokens:
        _tokens[path] = Tokens(path)
    return _tokens[path]


def piece_lengths(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of n tokens: all but the first are full."""
    if n <= capacity:
        return [n]
    first = n % capacity or capacity
    return [first] + [capacity] * ((n - first) // capacity)


def tokenized(docs: DataFrame, id_col: str, text_col: str, capacity: int, end: int, path: str | None, keep_ids: bool) -> DataFrame:
    """One row for each piece, with its rank among the pieces of its length in this task."""
    names = [id_col, "piece", "start", "length", "ids_crc32", "part", "rank"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, ranks = tokens_of(path), TaskContext.get().partitionId(), defaultdict(int)
        for batch in tidy(batches):
            for lo, hi, _, _ in Texts(batch.column(1)).slices(SLICE):
                flat, sizes = tokens.encode(batch.column(1).slice(lo, hi - lo))
                rows: list[tuple] = []
                kept = []
                ends = np.cumsum(sizes)
                for k, (a, b) in enumerate(zip((ends - sizes).tolist(), ends.tolist(), strict=True)):
                    ids = np.append(flat[a:b], np.uint32(end)).astype("<u4")
                    at = 0
                    for number, n in enumerate(piece_lengths(len(ids), capacity)):
                        own = ids[at : at + n]
                        rows.append((lo + k, number, at, n, zlib.crc32(own), part, ranks[n]))
                        kept.append(own) if keep_ids else None
                        ranks[n] += 1
                        at += n
                columns = np.array(rows, np.int64).reshape(-1, 7).T
                out = [batch.column(0).take(pa.array(columns[0])), columns[1].astype(np.int32), *(np.ascontiguousarray(c) for c in columns[2:])]
                yield batch_of(names, out + ([pa.array(kept, pa.list_(pa.int64()))] if keep_ids else []))

    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, part long, rank long" + ", ids array<long>" * keep_ids
    return docs.select(id_col, text_col).mapInArrow(run, schema)


# --- packing of lengths


@dataclass
class Group:
    size: int  # rounded up
    runs: list[list[int]]  # [length, count], longest first

    @property
    def left(self) -> int:
        return sum(c for _, c in self.runs)

    def take(self, n: int) -> list[tuple[int, int]]:
        out = []
        while n:
            length, count = self.runs[0]
            k = min(n, count)
            out.append((length, k))
            n -= k
            self.runs[0][1] -= k
            if not self.runs[0][1]:
                self.runs.pop(0)
        return out


def linear_groups(counts: dict[int, int], groups: int) -> list[Group]:
    """Groups of equally many pieces, longest first; each length alone where there are no more than `groups`."""
    lengths = sorted((x for x in counts if counts[x]), reverse=True)
    if len(lengths) <= groups:
        return [Group(x, [[x, counts[x]]]) for x in lengths]
    total = sum(counts[x] for x in lengths)
    out, done, number = [], 0, 0
    for x in lengths:
        left = counts[x]
        while left:
            end = total * (number + 1) // groups
            k = min(left, end - done)
            if k:
                if out and out[-1][0] == number:
                    out[-1][1].runs.append([x, k])
                else:
                    out.append((number, Group(x, [[x, k]])))
                done += k
                left -= k
            if done == end:
                number += 1
    # groups that round to one size are one
    merged: dict[int, Group] = {}
    for _, g in out:
        if g.size in merged:
            merged[g.size].runs += g.runs
        else:
            merged[g.size] = g
    return list(merged.values())


def knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable configuration: how often each size is used, each as often as it fits."""
    best = np.zeros(capacity + 1)
    stages = [best]
    for size, value in zip(sizes.tolist(), values.tolist(), strict=True):
        best = best.copy()
        for _ in range(capacity // size if value > 0 else 0):
            grown = np.maximum(best[size:], best[:-size] + value)
            if np.array_equal(grown, best[size:]):
                break
            best[size:] = grown
        stages.append(best)
    used, room = np.zeros(len(sizes), np.int64), capacity
    for k in range(len(sizes) - 1, -1, -1):
        while stages[k + 1][room] > stages[k][room] + 1e-12:
            used[k] += 1
            room -= int(sizes[k])
    return float(best[capacity]), used


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 2000) -> list[tuple[np.ndarray, float]]:
    """(how often each size is used, how many sequences) of the linear program: the fewest sequences that hold the demand.

    A basis of one configuration for each size; its prices value the sizes, the
    knapsack finds a configuration worth more than one sequence, and it replaces one of the basis.
    """
    m, size = len(sizes), np.array(sizes)
    columns = np.diag(capacity // size).astype(float)
    inverse, amount = np.diag(1.0 / (capacity // size)), np.array(demand) / (capacity // size)
    for step in range(rounds):
        if step % 64 == 63:  # rounding errors of the updates
            inverse = np.linalg.inv(columns)
            amount = inverse @ np.array(demand, float)
        worth, new = knapsack(size, inverse.sum(axis=0), capacity)
        if worth <= 1 + 1e-9:
            break
        direction = inverse @ new
        ratio = np.where(direction > 1e-12, amount / np.where(direction > 1e-12, direction, 1.0), np.inf)
        row = int(ratio.argmin())
        columns[:, row] = new
        amount = amount - ratio[row] * direction
        amount[row] = ratio[row]
        inverse[row] /= direction[row]
        others = np.arange(m) != row
        inverse[others] -= np.outer(direction[others], inverse[row])
    return [(columns[:, k].astype(np.int64), float(amount[k])) for k in range(m)]


def pack_lengths(
    counts: dict[int, int], capacity: int = CAPACITY, groups: tuple[int, ...] = GROUPS, small: tuple[float, ...] = SMALL
) -> list[tuple[tuple[int, ...], int]]:
    """Classes of sequences: (lengths in order, how many sequences); the fewest sequences of the settings."""
    tried = (grouped_packing(counts, capacity, g, s) for s in small for g in groups)
    return min(tried, key=lambda classes: sum(n for _, n in classes))


def substituted(by_size: dict[int, Group], chosen: list[int], times: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """Classes of actual lengths that take the places of the chosen rounded sizes, `times` sequences in all."""
    runs = [by_size[s].take(times) for s in chosen]
    at = [[0, r[0][1]] for r in runs]
    while times:
        n = min(x[1] for x in at)
        yield tuple(r[x[0]][0] for r, x in zip(runs, at, strict=True)), n
        times -= n
        for r, x in zip(runs, at, strict=True):
            x[1] -= n
            if not x[1] and times:
                x[0] += 1
                x[1] = r[x[0]][1]


def grouped_packing(counts: dict[int, int], capacity: int, groups: int, small: float) -> list[tuple[tuple[int, ...], int]]:
    """Classes of sequences with one number of groups and one bound of small pieces."""
    limit = capacity * small
    classes: list[tuple[tuple[int, ...], int]] = []
    rest = {x: c for x, c in counts.items() if c and x >= limit and x < capacity}
    if counts.get(capacity):
        classes.append(((capacity,), counts[capacity]))
    # whole parts of the program; what is left is grouped anew while there are more pieces than groups
    while sum(rest.values()) > groups:
        held = linear_groups(rest, groups)
        by_size = {g.size: g for g in held}
        sizes = [g.size for g in held]
        used = 0
        for uses, amount in configurations(sizes, [g.left for g in held], capacity):
            chosen = [s for s, k in zip(sizes, uses.tolist(), strict=True) for _ in range(k)]
            times = min([int(amount + 1e-6), *(by_size[s].left // chosen.count(s) for s in set(chosen))])
            if times > 0:
                classes += substituted(by_size, chosen, times)
                used += times
        rest = defaultdict(int)
        for g in held:
            for x, c in g.runs:
                rest[x] += c
        if not used:
            break
    return best_fit({x: c for x, c in counts.items() if x < limit and x < capacity} | rest, classes, capacity)


def best_fit(counts: dict[int, int], classes: list[tuple[tuple[int, ...], int]], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """The classes with pieces of the counted lengths put, longest first, into the smallest room that holds them, and into new sequences."""
    rooms: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for lengths, n in classes:
        rooms[capacity - sum(lengths)].append((lengths, n))
    for x in sorted((x for x in counts if counts[x]), reverse=True):
        left = counts[x]
        while left:
            room = min((r for r in rooms if r >= x and rooms[r]), default=None)
            if room is None:
                per = min(left, capacity // x)
                n = left // per
                rooms[capacity - per * x].append(((x,) * per, n))
                left -= n * per
                continue
            lengths, n = rooms[room].pop()
            k = min(n, left)
            if k < n:
                rooms[room].append((lengths, n - k))
            rooms[room - x].append((lengths + (x,), k))
            left -= k
    return sorted(((c, n) for held in rooms.values() for c, n in held), reverse=True)


class Places:
    """For (length, rank): the sequence and the offset."""

    def __init__(self, classes: list[tuple[tuple[int, ...], int]]):
        used: dict[int, int] = defaultdict(int)
        rows, base = [], 0
        for lengths, n in classes:
            at = 0
            for x in lengths:
                rows.append((x, used[x], base, at))
                used[x] += n
                at += x
            base += n
        self.sequences = base
        table = np.array(sorted(rows), np.int64).reshape(-1, 4)
        self.key = (table[:, 0] << 44) | table[:, 1]
        self.rank, self.base, self.offset = table[:, 1], table[:, 2], table[:, 3]

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.searchsorted(self.key, (length << 44) | rank, "right") - 1
        return self.base[row] + rank - self.rank[row], self.offset[row]


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end: int = END,
    tokenizer: str | None = None,
    groups: tuple[int, ...] = GROUPS,
    small: tuple[float, ...] = SMALL,
    keep_ids: bool = False,
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset): one row for each piece; keep_ids adds the ids."""
    pieces = cut(tokenized(docs, id_col, text_col, capacity, end, tokenizer, keep_ids))
    by_part = cut(pieces.groupBy("part", "length").agg(F.count("*").alias("n")))
    # at most `capacity` rows
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = docs.sparkSession.sparkContext.broadcast(Places(pack_lengths(counts, capacity, groups, small)))
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = pieces.join(by_part.select("part", "length", before.alias("before")), ["part", "length"])
    out = [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * keep_ids
    kind = dict(docs.dtypes)[id_col]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                length = batch.column(3).to_numpy()
                sequence, offset = places.value.find(length, batch.column(5).to_numpy())
                yield batch_of(out, [*batch.columns[:5], sequence, offset, *batch.columns[6:]])

    rows = ranked.select(id_col, "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank")).alias("rank"), *["ids"] * keep_ids)
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<long>" * keep_ids
    return rows.mapInArrow(place, schema)
