"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are majority votes over the hashes of word shingles, of one or
more 64-bit words. Two fingerprints link at `radius` or fewer differing bits.

Distribution: fingerprints are cut into blocks, and distinct ones are dealt by
(block, its value). With radius + 1 blocks (the default deal of one word) linked
fingerprints agree in one block at least, so the deal loses nothing. A hot value
(see `hot`) is dealt again by radius + 1 blocks of its other bits, up to LEVELS times,
and a value that is still hot after that is dealt to pairs of tiles, so no task holds more than two
tiles. In other deals a pair may agree in one block alone, so their hot values go to tiles at
once: every pair that a value holds meets, hot or not, at the price of one copy of a row for each tile of its value. Inside a task, the fingerprints of a value are sorted by Gray rank
and stacked into a hierarchy: a node keeps the bits that all below share and
that no node above already holds (a masked pattern); a search adds up the
differences on its way down and drops a whole group once they pass the radius.
Nodes whose fingerprints are all within the radius are joined at once, and a
search stops at groups that its class has joined already, so dense groups of
near copies cost no pairs.

A task returns a spanning forest of its links (fewer rows than fingerprints);
components over all tasks come from one task if the links are counted to be few
(ONE_TASK), else from rounds of star contraction over tables in the shared checkpoint
folder, hubs salted. Nothing of it reaches the driver but counts.

Defined results: null and empty texts have fingerprint zero and link like any
other; rows with a null id link but offer no id (a class of only null ids has a
null component); repeated rows give repeated results; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.llm.common import Texts, batch_of, bounded_broadcast, cut, map_batches, salt, tidy, with_facts

SEED = 42
FANOUT = 8
#: Fingerprints of one block value beyond which it is dealt again by its other bits, then by tiles.
HOT_GROUP = 20_000
#: 64-bit words of candidate (query, node) pairs in one search step, and fingerprints that are searched together.
FRONTIER, TOGETHER = 1 << 20, 1 << 16


# --- fingerprints


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of each run of `width` words (all words where there are fewer)."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if n <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[: n - width] + 1)).tolist()
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    return np.array([digest(view[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], np.uint64)


#: Byte -> its eight bits, each in a byte of its own.
_lanes = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").reshape(256, 8).view("<u8").reshape(-1)


def vote(hashes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """For each text, the bits that over half of its hashes set.

    Eight counters share a word, so runs of at most 255 hashes are summed first.
    """
    n = np.diff(firsts)
    pieces = -(-n // 255)
    counts = np.zeros((len(n), 64), np.int64)
    if pieces.sum():
        owner = np.repeat(np.arange(len(n)), pieces)
        starts = firsts[owner] + 255 * (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        lanes = _lanes[hashes.astype("<u8").view(np.uint8).reshape(-1, 8)]
        sums = np.add.reduceat(lanes, starts, axis=0).astype("<u8").view(np.uint8).reshape(len(starts), 64).astype(np.int64)
        filled = np.flatnonzero(n)
        counts[filled] = np.add.reduceat(sums, (np.cumsum(pieces) - pieces)[filled], axis=0)
    return np.packbits(2 * counts > n[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)


def prints_of(texts: Texts, width: int) -> np.ndarray:
    """The 64-bit fingerprint of each text."""
    out = np.zeros(len(texts), np.uint64)
    for lo, hi, _, _ in texts.slices():
        hashes = [shingle_hashes(texts.text(i), width) for i in range(lo, hi)]
        out[lo:hi] = vote(np.concatenate(hashes), np.concatenate(([0], np.cumsum([len(h) for h in hashes]))).astype(np.int64))
    return out


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id, fp long): the signed form of each row's 64-bit fingerprint."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch_of([id_col, "fp"], [batch.column(0), prints_of(Texts(batch.column(1)), width).view(np.int64)])

    return map_batches(df.select(id_col, text_col), run, f"`{id_col}` {dict(df.dtypes)[id_col]}, fp long")


# --- index


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of x in the Gray-code order."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def bits_set(x: np.ndarray) -> np.ndarray:
    """Bits of each row of words."""
    return np.bitwise_count(x[:, 0]).astype(np.int16) if x.shape[1] == 1 else np.bitwise_count(x).sum(axis=1, dtype=np.int16)


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def flat(self) -> np.ndarray:
        p = self.parent
        while not np.array_equal(q := p[p], p):
            p = q
        self.parent = p
        return p

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            p = self.flat()
            x, y = p[a], p[b]
            differ = x != y
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(self.parent, np.maximum(x, y), np.minimum(x, y))


class GrayIndex:
    """A hierarchy over groups of fingerprints (rows of words), for links inside each group.

    order: the fingerprints sorted by (group, Gray rank). Level 0 are the
    fingerprints; a node of the next level stands over up to FANOUT neighbours.
    """

    def __init__(self, fps: np.ndarray, groups: np.ndarray, radius: int):
        self.radius = radius
        fps = fps.reshape(len(fps), -1)
        self.order = np.lexsort([*(gray_rank(fps[:, w]) for w in reversed(range(fps.shape[1]))), groups])
        self.fps, self.groups = fps[self.order], groups[self.order]
        n = len(fps)
        # per level: AND and OR of what is below, the first and last fingerprint, the group
        ands, ors, first, last, group = self.fps, self.fps, np.arange(n), np.arange(n), self.groups
        self.levels = [(ands, ors, first, last)]
        self.children: list[np.ndarray] = []
        while n:
            new = np.ones(len(group), bool)
            new[1:] = group[1:] != group[:-1]
            start = np.flatnonzero(new)
            place = np.arange(len(group)) - np.repeat(start, np.diff(np.append(start, len(group))))
            heads = np.flatnonzero(place % FANOUT == 0)
            if len(heads) == len(group):
                break
            self.children.append(np.append(heads, len(group)))
            ands, ors = np.bitwise_and.reduceat(ands, heads), np.bitwise_or.reduceat(ors, heads)
            first, last, group = first[heads], last[np.append(heads[1:], len(last)) - 1], group[heads]
            self.levels.append((ands, ors, first, last))

    def forest(self) -> np.ndarray:
        """For each fingerprint (as given), the place of a fingerprint that stands for its class."""
        n, r = len(self.fps), self.radius
        found = Forest(n)
        if n < 2:
            return np.arange(n)
        # groups that lie within the radius altogether, and neighbours in Gray order
        for ands, ors, first, last in self.levels[1:]:
            tight = np.flatnonzero((bits_set(ands ^ ors) <= r) & (last > first))
            if len(tight):
                size = last[tight] - first[tight]
                member = np.repeat(first[tight], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + 1
                found.join(np.repeat(first[tight], size), member)
        near = np.flatnonzero((self.groups[1:] == self.groups[:-1]) & (bits_set(self.fps[1:] ^ self.fps[:-1]) <= r))
        found.join(near, near + 1)
        roots = np.searchsorted(self.groups[self.levels[-1][2]], self.groups)  # the top node of each one's group
        step, lo = 4096, 0
        while lo < n:
            queries = np.arange(lo, min(n, lo + step))
            if not self._search(queries, roots[queries], found):
                step = max(1, step // 4)
                continue
            lo += len(queries)
        label = np.empty(n, np.int64)
        label[self.order] = self.order[found.flat()]
        return label

    def _search(self, q: np.ndarray, node: np.ndarray, found: Forest) -> bool:
        """Join the queries with what they link to further on; False: too many candidates for one step."""
        classes = found.flat()
        width = self.fps.shape[1]
        above = np.zeros((len(q), width), np.uint64)  # bits that nodes above hold
        apart = np.zeros(len(q), np.int16)  # differences there
        single = len(q) == 1
        for level in range(len(self.levels) - 1, -1, -1):
            ands, ors, first, last = self.levels[level]
            lows = np.minimum.reduceat(classes, first) if level else classes
            highs = np.maximum.reduceat(classes, first) if level else classes
            own = classes[q]
            open_ = np.flatnonzero((last[node] > q) & ~((lows[node] == own) & (highs[node] == own)))
            q, node, above, apart = q[open_], node[open_], above[open_], apart[open_]
            low = ands[node]
            shared = ~(low ^ ors[node])
            apart = apart + bits_set((self.fps[q] ^ low) & shared & ~above)
            keep = np.flatnonzero(apart <= self.radius)
            q, node, apart, shared = q[keep], node[keep], apart[keep], shared[keep]
            if not len(q):
                return True
            if level == 0:
                found.join(q, node)
                return True
            bounds = self.children[level - 1]
            size = bounds[node + 1] - bounds[node]
            total = int(size.sum())
            if total * width > FRONTIER and not single:
                return False
            start = np.repeat(bounds[node] - (np.cumsum(size) - size), size)
            q, apart, above = np.repeat(q, size), np.repeat(apart, size), np.repeat(shared, size, axis=0)
            node = start + np.arange(total)
        return True


# --- distribution


def blocks(width: int, parts: int) -> list[tuple[int, int]]:
    """(shift, bits) of `parts` runs that cover `width` bits."""
    cuts = [width * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _others(fp: Column, shift: int, bits: int) -> Column:
    """fp without the block's bits: those below, then those above."""
    low = fp.bitwiseAND(F.lit((1 << shift) - 1)) if shift else F.lit(0).cast("long")
    high = F.shiftrightunsigned(fp, shift + bits) if shift + bits < 64 else F.lit(0).cast("long")
    return low.bitwiseOR(F.shiftleft(high, shift)) if shift else high


def _run_of(x: Column, shift: int, bits: int) -> Column:
    return F.shiftrightunsigned(x, shift).bitwiseAND(F.lit((1 << bits) - 1))


@dataclass(frozen=True)
class Deal:
    """How fingerprints meet: `each` blocks for each of `words` words. One word in radius + 1 blocks loses no link;
    other deals find a pair with the probability that one block agrees."""

    radius: int
    words: int = 1
    each: int = 0

    @property
    def exact(self) -> bool:
        return self.words == 1 and self.parts > self.radius

    @property
    def parts(self) -> int:
        return self.each or self.radius + 1

    def columns(self) -> list[str]:
        return ["fp"] if self.words == 1 else [f"fp{w}" for w in range(self.words)]

    def values(self) -> list[Column]:
        """The value of each block."""
        return [_run_of(F.col(c), s, b) for c in self.columns() for s, b in blocks(64, self.parts)]


#: How often the bits of exact deals are cut before tiles.
LEVELS = 4


def dealt(nodes: DataFrame, deal: Deal, hot: int) -> DataFrame:
    """(node, fingerprint words, key): each fingerprint once for each block; hot values by blocks of what is left, then by pairs of tiles."""
    held = ["node", *deal.columns()]
    if not deal.exact:
        rows = nodes.select(*held, F.posexplode(F.array(*deal.values())).alias("block", "value")).select(*held, F.xxhash64("block", "value").alias("key"))
    done, width, level = None, 64, 0
    while True:
        if deal.exact and level < LEVELS:
            # `rest` are the bits that no block so far has taken, `width` at most
            before = nodes.select(*held, F.col("fp").alias("rest"), F.lit(0).cast("long").alias("key")) if done is None and not level else rows
            cuts = blocks(width, deal.parts)
            parts = F.array(*(F.struct(_run_of(F.col("rest"), s, b).alias("value"), _others(F.col("rest"), s, b).alias("left")) for s, b in cuts))
            rows = before.select(*held, "key", F.posexplode(parts).alias("block", "part"))
            rows = rows.select(*held, F.col("part.left").alias("rest"), F.xxhash64("key", "block", "part.value").alias("key"))
            width -= min(b for _, b in cuts)
        sizes = cut(rows.groupBy("key").count().filter(F.col("count") > hot))
        if not sizes.limit(1).count():
            found = rows.select(*held, "key")
            return found if done is None else done.unionByName(found)
        marked = with_facts(rows, sizes, "key", ["node"], "left")
        cold = marked.filter(F.col("count").isNull()).select(*held, "key")
        done = cold if done is None else done.unionByName(cold)
        warm, level = cut(marked.filter(F.col("count").isNotNull())), level + 1
        if not deal.exact or level == LEVELS:
            tiles = tile_pairs(warm, "key", F.ceil(F.col("count") / F.lit(hot)).cast("int"), "node")
            return done.unionByName(tiles.select(*held, "key"))
        rows = warm.drop("count")


def tile_pairs(rows: DataFrame, key: str, tiles: Column, by: str) -> DataFrame:
    """rows dealt to the pairs of `tiles` tiles of their key: any two rows of a key meet, and no task holds more than two tiles."""
    own = rows.withColumn("__tiles", tiles).withColumn("__tile", F.pmod(F.xxhash64(F.lit(11), by), F.col("__tiles")).cast("int"))
    paired = own.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__tiles") - 1)))
    return paired.withColumn(key, F.xxhash64(key, F.least("__tile", "__other"), F.greatest("__tile", "__other"))).drop("__tiles", "__tile", "__other")


def grouped(batches: Iterator[pa.RecordBatch], key: int, together: int) -> Iterator[pa.Table]:
    """Whole runs of equal keys of sorted batches, about `together` rows at a time (a longer run is a table of its own)."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if held and held[-1].column(key)[-1].as_py() != keys[0]:
            edges = np.concatenate(([0], edges))
        if len(edges) and rows + edges[-1] >= together:
            # whole runs end at the last edge; what is held may be let go at its own end
            cut_at = int(edges[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, cut_at)])
            held, rows = [batch.slice(cut_at)], batch.num_rows - cut_at
        else:
            held.append(batch)
            rows += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def smallest(label: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """For each fingerprint, the place of the smallest one of its class: other tasks that hold it choose it too, so their links agree."""
    order = np.lexsort([fps[:, w] for w in reversed(range(fps.shape[1]))])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    best = np.full(len(order), len(order))
    np.minimum.at(best, label, rank)
    return order[best[label]]


def links(nodes: DataFrame, deal: Deal | int = 4, hot: int = HOT_GROUP) -> DataFrame:
    """(a, b): a spanning forest of the links between distinct fingerprints of (node, fingerprint words), b the smallest of the class in its task."""
    deal = Deal(deal) if isinstance(deal, int) else deal
    radius, words = deal.radius, deal.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(tidy(batches), 1 + words, TOGETHER):
            fps = np.column_stack([table.column(1 + w).to_numpy() for w in range(words)]).view(np.uint64)
            label = smallest(GrayIndex(fps, pd.factorize(table.column(1 + words).to_numpy())[0], radius).forest(), fps)
            other = np.flatnonzero(label != np.arange(len(label)))
            node = table.column(0).combine_chunks()
            if len(other):
                yield batch_of(["a", "b"], [node.take(pa.array(other)), node.take(pa.array(label[other]))])

    kind = nodes.schema["node"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    return dealt(nodes, deal, hot).repartition("key").sortWithinPartitions("key").mapInArrow(run, schema)


#: Links up to which one task settles their components; more go through rounds of star contraction.
ONE_TASK = 2_000_000


def contracted(edges: DataFrame) -> DataFrame:
    """(node, root) of links (u, v) that have been counted to fit one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in tidy(batches) if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        both = pa.concat_arrays([c.combine_chunks() for c in table.columns])
        parts = both.flatten() if pa.types.is_struct(both.type) else [both]
        flat = pa.table(parts, names=[str(k) for k in range(len(parts))])
        order = pc.sort_indices(flat, sort_keys=[(str(k), "ascending") for k in range(len(parts))]).to_numpy()
        new = np.zeros(len(order), bool)
        new[:1] = True
        for part in parts:
            there = pc.is_valid(part).to_numpy(zero_copy_only=False)[order]
            code = part.dictionary_encode().indices.fill_null(-1).to_numpy()[order]
            new[1:] |= (code[1:] != code[:-1]) | (there[1:] != there[:-1])
        code = np.empty(len(order), np.int64)
        code[order] = np.cumsum(new) - 1  # numbers in the order of the nodes
        found = Forest(int(new.sum()))
        found.join(code[: table.num_rows], code[table.num_rows :])
        root, first = found.flat(), order[new]
        node = np.flatnonzero(root != np.arange(len(root)))
        yield batch_of(["node", "root"], [both.take(pa.array(first[node])), both.take(pa.array(first[root[node]]))])

    kind = edges.schema["u"].dataType
    schema = T.StructType([T.StructField("node", kind), T.StructField("root", kind)])
    return edges.coalesce(1).mapInArrow(run, schema)


def components(pairs: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, root): the smallest node that each other node of `pairs` (a, b) reaches.

    Links that have been counted to fit one task are settled there; more go through alternating star contraction, hubs salted.
    """
    edges = cut(pairs.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    if edges.count() <= one_task:
        return cut(contracted(edges))
    edges = cut(edges.distinct())

    def lows(edges: DataFrame) -> DataFrame:
        """(u, salt, m): the smallest neighbour of u, for each share of u's edges."""
        part = edges.groupBy("u", "salt").agg(F.min("v").alias("m"))
        return part.select("u", "salt").join(part.groupBy("u").agg(F.min("m").alias("m")), "u")

    while True:
        # large star: every larger neighbour of u goes to the smallest of u and its neighbours
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).withColumn("salt", salt("v"))
        low = lows(both).select("u", "salt", F.least("m", "u").alias("m"))
        large = both.join(low, ["u", "salt"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().withColumn("salt", salt("v"))
        # small star: u and its smaller neighbours go to the smallest of them
        low = lows(large)
        small = large.join(low, ["u", "salt"]).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(low.select("u", F.col("m").alias("v")).unionAll(small).distinct())
        # settled once each node has one edge and no root has an edge down
        loose = edges.groupBy("u").agg(F.count("*").alias("n"))
        if not (loose.filter("n > 1").limit(1).count() or edges.select(F.col("v").alias("u")).distinct().join(edges.select("u"), "u", "left_semi").limit(1).count()):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def numbered(prints: DataFrame, id_col: str) -> DataFrame:
    """(node, fp) of each distinct fingerprint: node is (no id, smallest id, fp), so the smallest node of a class names its component."""
    return prints.groupBy("fp").agg(F.min(id_col).alias("id")).select(F.struct(F.col("id").isNull().alias("none"), "id", "fp").alias("node"), "fp")


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, hot: int = HOT_GROUP
) -> DataFrame:
    """(id, fingerprint, component_id): one row for each row of df; component_id is the smallest id reachable over links."""
    prints = cut(fingerprints(df, id_col, text_col, width))
    nodes = cut(numbered(prints, id_col))
    roots = components(links(nodes, radius, hot))
    classes = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node")["id"].alias("component_id"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return with_facts(prints, classes, "fp", [id_col]).select(id_col, digits.alias("fingerprint"), "component_id")


def fresh(name: str, columns: list[str]) -> str:
    """`name`, lengthened until it is not among the columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_key(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("string"), F.lit("\0"))


def one_of_each(docs: DataFrame, id_col: str, text_col: str, rows: DataFrame, classes: DataFrame, node_of: Callable[[Texts], np.ndarray]) -> DataFrame:
    """One row of each class, all columns as they are: the one with the smallest id.

    rows are (id, node long) of every row of docs; classes are (node, root) of nodes that stand for others too;
    node_of gives the nodes of texts. Ids that stand once only are decided by id alone; texts of other ids
    (and of null ids) are read again, and of rows that agree in id and node the one with the smallest digest of all columns stays.
    """
    columns = docs.columns
    key, node = fresh("__id", columns), fresh("__node", columns)
    keyed = rows.select(id_key(id_col).alias(key), F.col(id_col).alias("id"), F.col("node").alias(node))
    ids = keyed.groupBy(key).agg(F.count("*").alias("n"))
    # the representative of a class: its smallest id (null last), and of that id's texts the smallest node
    nodes = keyed.groupBy(node).agg(F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col(node).alias("node"))).alias("m"))
    placed = nodes.join(classes.select(F.col("node").alias(node), "root"), node, "left")
    lowest = placed.groupBy(F.coalesce("root", node).alias("root")).agg(F.min("m").alias("m"))
    kept = cut(lowest.select(F.coalesce(F.col("m.id").cast("string"), F.lit("\0")).alias(key), F.col("m.node").alias(node)))
    known = ids.join(kept.groupBy(key).agg(F.lit(True).alias("won")), key, "left")
    gone = cut(known.filter(F.col("won").isNull() | (F.col("n") > 1)).select(key, (F.col("n") > 1).alias("again")))
    named = docs.withColumn(key, id_key(id_col))
    out = named.join(bounded_broadcast(gone.select(key)), key, "left_anti").select(*[F.col(f"`{c}`") for c in columns])
    again = gone.filter("again").select(key)
    if not again.limit(1).count():
        return out
    text_at = columns.index(text_col)

    def marked(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(node_of(Texts(batch.column(text_at))).view(np.int64))], names=[*batch.schema.names, node])

    some = named.join(bounded_broadcast(again), key, "left_semi").select(*[F.col(f"`{c}`") for c in columns], key)
    schema = T.StructType([*some.schema.fields, T.StructField(node, T.LongType())])
    first = map_batches(some, marked, schema).join(kept, [key, node], "left_semi")
    digest = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{f.name}`"))) if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`") for f in docs.schema.fields])
    whole = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)])
    least = first.groupBy(key, node).agg(F.min_by(whole, digest).alias("row"))
    return out.unionAll(least.select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(columns)]))


def drop_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, hot: int = HOT_GROUP
) -> DataFrame:
    """One row of each class of near copies, all columns as they are: the one with the smallest id."""
    rows = cut(fingerprints(docs, id_col, text_col, width).withColumnRenamed("fp", "node"))
    nodes = cut(rows.select("node").distinct().withColumn("fp", F.col("node")))
    return one_of_each(docs, id_col, text_col, rows, components(links(nodes, radius, hot)), lambda texts: prints_of(texts, width))
