"""Near copies on five-word shingles: the SimHash index proposes, exact Jaccard similarity decides.

Texts are nodes by their sets of shingle hashes (64 bits; words as in `simhash`).
A fingerprint has four 64-bit words, each the majority vote of the set under
another mixing of the hashes. A similarity J turns about arccos(2 J / (1 + J)) / pi
of its 256 bits: 39 of them at 0.8, 27 at 0.9. The Gray-order index of `simhash` joins
fingerprints at RADIUS or fewer differing bits into groups of candidates, over
a deal of EACH blocks of each word: at a similarity of 0.8 a pair shares no block
with a probability of about 0.01, at 0.9 of 0.0004; values that many fingerprints share are
dealt to tiles, which hold the same pairs. `pairs_at_least` finds all links exactly, by prefixes of the sets, and
`recall` holds the deal against it (README: as measured).

Groups of candidates are then settled by their whole sets: two texts link where
the Jaccard similarity is `least` or more, and classes are what links connect.
A group's sets meet in one task if it has at most TILE texts. Larger groups are dealt
to tiles; first each tile is settled, then one text of each class that came out,
and then, where a group still has several classes, all tiles but those of its
largest class among themselves. So every pair of a group that is not in one
class already is compared, dense groups cost little, no task holds more than two
tiles, and no pairs are written.

Defined results: texts without words are one node; texts of up to five words
link where they are equal; null ids and repeated rows as in `simhash`; an empty
table gives no rows; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import Texts, batch_of, bounded_broadcast, cut, map_batches, tidy, with_facts
from framewright.llm.simhash import HOT_GROUP, Deal, Forest, components, dealt, id_key, links, one_of_each, tile_pairs, vote
from framewright.llm.words import LOWERED, P, hash_words, mix, owner, spans

WIDTH, LEAST = 5, 0.8
WORDS, EACH, RADIUS = 4, 6, 56
#: Texts, and shingles, of one tile of a large group.
TILE, TILE_SHINGLES = 512, 1 << 20
#: Shingles in at most this many texts of a task are counted pair by pair, others by products of CHUNK columns.
RARE, CHUNK = 16, 4096

_blank = np.zeros(256, bool)
_blank[[9, 10, 11, 12, 13, 32]] = True
_salts = [mix(np.array([k + 1], np.uint64))[0] for k in range(WORDS)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, sorted within each text; first of each text and the end); one zero for a text without words."""
    starts, lengths, firsts = spans(~_blank[data], offsets)
    words = hash_words(LOWERED[data], starts, lengths)
    text, n = owner(firsts), np.diff(firsts)
    keys, owners = [np.zeros(np.count_nonzero(n == 0), np.uint64)], [np.flatnonzero(n == 0)]
    for size in range(1, width + 1):
        # whole texts of fewer words, then the runs of `width`
        at = firsts[:-1][n == size] if size < width else np.flatnonzero(text[: max(0, len(words) - width + 1)] == text[width - 1 :])
        key = np.zeros(len(at), np.uint64)
        for j in range(size):
            key = key * P + words[at + j]
        keys.append(mix(key ^ np.uint64(size)))
        owners.append(text[at])
    key, own = np.concatenate(keys), np.concatenate(owners)
    order = np.lexsort((key, own))
    key, own = key[order], own[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
    key, own = key[new], own[new]
    return key, np.searchsorted(own, np.arange(len(offsets)))


def set_nodes(keys: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The 64-bit digest of each set."""
    view = memoryview(np.ascontiguousarray(keys).view(np.uint8))
    bounds = (firsts * 8).tolist()
    return np.array([xxhash.xxh64_intdigest(view[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)], np.uint64)


def nodes_of(texts: Texts, width: int = WIDTH) -> np.ndarray:
    out = np.zeros(len(texts), np.uint64)
    for lo, hi, data, offsets in texts.slices():
        out[lo:hi] = set_nodes(*shingle_sets(data, offsets, width))
    return out


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, node, n, fp0..): the digest, size and fingerprint of each row's set."""
    names = [id_col, "node", "n", *(f"fp{w}" for w in range(WORDS))]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = Texts(batch.column(1))
        columns = [np.zeros(len(texts), np.uint64) for _ in range(2 + WORDS)]
        for lo, hi, data, offsets in texts.slices():
            keys, firsts = shingle_sets(data, offsets, width)
            columns[0][lo:hi], columns[1][lo:hi] = set_nodes(keys, firsts), np.diff(firsts)
            for w in range(WORDS):
                columns[2 + w][lo:hi] = vote(mix(keys ^ _salts[w]), firsts)
        return batch_of(names, [batch.column(0), *(c.view(np.int64) for c in columns)])

    return map_batches(docs.select(id_col, text_col), run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, " + ", ".join(f"{x} long" for x in names[1:]))


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many hashes each two sets share (upper triangle)."""
    m = len(sets)
    counts = np.zeros(m * m, np.int64)
    flat, who = np.concatenate(sets), np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.lexsort((who, flat))
    flat, who = flat[order], who[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    token = np.cumsum(new) - 1
    size = np.bincount(token)[token]
    rare = (size > 1) & (size <= RARE)
    t, w = token[rare], who[rare]
    for step in range(1, RARE):
        same = t[step:] == t[:-step]
        if not same.any():
            break
        counts += np.bincount(w[:-step][same] * m + w[step:][same], minlength=m * m)
    often = size > RARE
    t, w = token[often], who[often]
    heads = np.flatnonzero(np.append(True, t[1:] != t[:-1])) if len(t) else np.zeros(0, np.int64)
    counts = counts.reshape(m, m)
    for lo in range(0, len(heads), CHUNK):
        a, b = heads[lo], heads[lo + CHUNK] if lo + CHUNK < len(heads) else len(t)
        held = np.zeros((m, min(CHUNK, len(heads) - lo)), np.float32)
        held[w[a:b], np.searchsorted(heads, np.arange(a, b), "right") - 1 - lo] = 1.0
        counts += np.rint(held @ held.T).astype(np.int64)
    return counts


def settled(classes: np.ndarray, sets: list[np.ndarray], least: Fraction) -> np.ndarray:
    """For each set, the place of one that stands for it once all pairs of different classes are compared."""
    m, found = len(sets), Forest(len(sets))
    code = np.unique(classes, return_inverse=True)[1]
    first = np.full(code.max() + 1, m)
    np.minimum.at(first, code, np.arange(m))
    found.join(first[code], np.arange(m))
    if m <= 6:
        pairs = [(i, j) for j in range(m) for i in range(j) if code[i] != code[j]]
        a, b = (np.array(x, np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
        both = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in pairs], np.int64)
    else:
        counts = common_counts(sets)
        a, b = np.nonzero(np.triu(counts, 1))
        differ = code[a] != code[b]
        a, b = a[differ], b[differ]
        both = counts[a, b]
    size = np.array([len(s) for s in sets])
    p, q = least.numerator, least.denominator
    alike = both * (p + q) >= p * (size[a] + size[b])
    found.join(a[alike], b[alike])
    return found.flat()


def settle(docs: DataFrame, id_col: str, text_col: str, where: DataFrame, width: int, least: Fraction) -> DataFrame:
    """(a, b): links that connect the classes of the nodes in each group of where (node, key: the id of a row that has it, group, class).

    The texts of those ids are read and only their sets go to the groups. A node that several rows of an id make is harmless.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, classes, sets = None, [], [], []

        def out() -> Iterator[pa.RecordBatch]:
            if len(nodes) > 1:
                order = np.argsort(nodes, kind="stable")  # the smallest node stands for a class
                own = np.array(nodes, np.int64)[order]
                label = settled(np.array(classes, np.int64)[order], [sets[i] for i in order], least)
                other = np.flatnonzero(label != np.arange(len(label)))
                if len(other):
                    yield batch_of(["a", "b"], [own[other], own[label[other]]])

        for batch in tidy(batches):
            lists = batch.column(3)
            flat, at = lists.values.to_numpy(), lists.offsets.to_numpy()
            for row, (k, node, held) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                if k != key:
                    yield from out()
                    key, nodes, classes, sets = k, [], [], []
                nodes.append(node)
                classes.append(held)
                sets.append(flat[at[row] : at[row + 1]].view(np.uint64).copy())
        yield from out()

    where = cut(where.select("node", "key", "group", "class"))
    members = sets_of(docs, id_col, text_col, where.select("key").distinct(), width).join(bounded_broadcast(where.drop("key")), "node")
    return members.select("group", "node", "class", "hashes").repartition("group").sortWithinPartitions("group").mapInArrow(run, "a long, b long")


def sets_of(docs: DataFrame, id_col: str, text_col: str, keys: DataFrame, width: int) -> DataFrame:
    """(node, hashes) of each row whose id is in keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            texts = Texts(batch.column(0))
            for _, _, data, offsets in texts.slices():
                keys, firsts = shingle_sets(data, offsets, width)
                lists = pa.ListArray.from_arrays(pa.array(firsts, pa.int32()), pa.array(keys.view(np.int64)))
                yield batch_of(["node", "hashes"], [set_nodes(keys, firsts).view(np.int64), lists])

    rows = docs.select(id_key(id_col).alias("key"), F.col(text_col).alias("text")).join(bounded_broadcast(cut(keys)), "key", "left_semi")
    return rows.select("text").mapInArrow(run, "node long, hashes array<long>")


def near_classes(docs: DataFrame, id_col: str, text_col: str, width: int, least: Fraction, rows: DataFrame, tile: int = TILE) -> DataFrame:
    """(node, root) of the nodes that stand in a class with others."""
    prints = [f"fp{w}" for w in range(WORDS)]
    first = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"))).alias("first")
    nodes = cut(rows.groupBy("node").agg(first, F.min("n").alias("n"), *(F.min(p).alias(p) for p in prints)))
    blobs = components(links(nodes.select("node", *prints), Deal(RADIUS, WORDS, EACH)))
    blobs = blobs.union(blobs.select("root", "root").distinct()).toDF("node", "blob")
    known = cut(nodes.join(blobs, "node").select("node", "blob", "n", F.coalesce(F.col("first.id").cast("string"), F.lit("\0")).alias("key")))
    sizes = known.groupBy("blob").agg(F.count("*").alias("texts"), F.sum("n").alias("shingles"))
    tiles = F.greatest(F.ceil(F.col("texts") / F.lit(tile)), F.ceil(F.col("shingles") / F.lit(TILE_SHINGLES))).cast("int")
    large = cut(sizes.select("blob", tiles.alias("tiles")).filter("tiles > 1"))
    placed = cut(with_facts(known, large, "blob", ["node"], "left"))  # tiles is null in small groups
    spot = F.pmod(F.xxhash64(F.lit(11), "node"), F.coalesce("tiles", F.lit(1)))
    links_of = lambda where: cut(settle(docs, id_col, text_col, where, width, least))
    found = links_of(placed.withColumn("group", F.xxhash64("blob", spot)).withColumn("class", F.col("node")))
    if not large.limit(1).count():
        return components(found)

    def labelled(roots: DataFrame) -> DataFrame:
        """Nodes of large groups with their classes."""
        wide = placed.filter("tiles is not null").join(roots, "node", "left")
        return cut(wide.withColumn("class", F.coalesce("root", "node")).drop("root"))

    # one text of each class
    heads = labelled(components(found)).filter("node = class")
    counts = cut(heads.groupBy("blob").agg(F.count("*").alias("heads"), F.sum("n").alias("shingles")).filter("heads > 1"))
    number = F.greatest(F.ceil(F.col("heads") / F.lit(tile)), F.ceil(F.col("shingles") / F.lit(TILE_SHINGLES))).cast("int")
    some = tile_pairs(with_facts(heads, counts, "blob", ["node"]).withColumn("group", F.xxhash64("blob")), "group", number, "node")
    found = cut(found.union(links_of(some)))
    # all texts of groups that still have several classes: those outside the largest class with everything
    roots = components(found)
    wide = labelled(roots)
    classes = wide.groupBy("blob", "class").agg(F.count("*").alias("texts"), F.sum("n").alias("shingles"))
    top = F.max(F.struct("texts", "class"))
    split = cut(classes.groupBy("blob").agg(top.alias("top"), F.sum("texts").alias("texts"), F.sum("shingles").alias("shingles"), F.count("*").alias("k")).filter("k > 1"))
    if not split.limit(1).count():
        return roots
    size = split.select("blob", F.col("top.class").alias("main"), F.col("top.texts").alias("main_texts"), "texts", "shingles")
    per = F.greatest(F.lit(1.0 / tile), F.col("shingles") / F.col("texts") / F.lit(float(TILE_SHINGLES)))
    parts = size.select("blob", "main", F.ceil(F.col("main_texts") * per).cast("int").alias("in_main"), F.ceil((F.col("texts") - F.col("main_texts")) * per).cast("int").alias("outside"))
    dealt = with_facts(wide, parts, "blob", ["node"])
    is_main = F.col("class") == F.col("main")
    own = F.pmod(F.xxhash64(F.lit(11), "node"), F.when(is_main, F.col("in_main")).otherwise(F.col("outside"))).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("inside", is_main)
    # (side, tile) of the partner: a text of the main class meets the tiles outside, the others meet all tiles
    steps = lambda n, side: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.lit(side).alias("inside"), i.alias("tile")))
    partner = F.when(F.col("inside"), steps(F.col("outside"), False)).otherwise(F.concat(steps(F.col("outside"), False), steps(F.col("in_main"), True)))
    mine = F.struct("inside", F.col("own").alias("tile"))
    paired = dealt.withColumn("partner", F.explode(partner)).withColumn("mine", mine)
    rest = paired.withColumn("group", F.xxhash64("blob", F.least("mine", "partner"), F.greatest("mine", "partner")))
    return components(cut(found.union(links_of(rest))))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, least: float = LEAST, tile: int = TILE) -> DataFrame:
    """One row of each class of near copies, all columns as they are: the one with the smallest id."""
    rows = cut(sketches(docs, id_col, text_col, width))
    classes = near_classes(docs, id_col, text_col, width, Fraction(str(least)), rows, tile)
    return one_of_each(docs, id_col, text_col, rows.select(id_col, "node"), classes, lambda texts: nodes_of(texts, width))


def pairs_at_least(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, least: float = LEAST, every: int = 1) -> DataFrame:
    """(a, b) of all different texts' nodes at `least` or more, one of them from every `every`-th node: the exact way that the deal is measured against.

    In sets ordered by how few texts have a hash, two that are so similar share one of their first n - ceil(least * n) + 1 hashes.
    """
    share = Fraction(str(least))
    rows = docs.filter(F.col(text_col).isNotNull()).select(id_key(id_col).alias("key"), F.col(text_col).alias(text_col), F.col(id_col).alias(id_col))
    sets = cut(sets_of(rows, id_col, text_col, rows.select("key").distinct(), width).dropDuplicates(["node"]).withColumn("n", F.size("hashes")))
    tokens = sets.select("node", "n", F.explode("hashes").alias("h"))
    rare = tokens.groupBy("h").agg(F.count("*").alias("texts"))
    placed = tokens.join(rare, "h").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("texts", "h"))).alias("by"))
    head = F.col("n") - F.ceil(F.col("n") * F.lit(share.numerator) / F.lit(share.denominator)).cast("int") + 1
    heads = cut(placed.select("node", "n", F.explode(F.slice("by", F.lit(1), head)["h"]).alias("h")))
    a = heads.filter(F.pmod("node", F.lit(every)) == 0).select("h", F.col("node").alias("a"), F.col("n").alias("a_n"))
    b = heads.select("h", F.col("node").alias("b"), F.col("n").alias("b_n"))
    sized = (F.col("a_n") * share.denominator >= F.col("b_n") * share.numerator) & (F.col("b_n") * share.denominator >= F.col("a_n") * share.numerator)
    met = a.join(b, "h").filter((F.col("a") != F.col("b")) & sized).select("a", "b").distinct()
    hashes = lambda x: sets.select(F.col("node").alias(x), F.col("hashes").alias(f"{x}_set"))
    both = F.size(F.array_intersect("a_set", "b_set"))
    alike = both * (share.numerator + share.denominator) >= (F.size("a_set") + F.size("b_set")) * share.numerator
    found = met.join(hashes("a"), "a").join(hashes("b"), "b").filter(alike)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def recall(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, least: float = LEAST, every: int = 1, hot: int | None = None) -> tuple[int, int]:
    """(found, all): how many of the pairs of pairs_at_least meet in a block value and lie within the radius, so that the deal proposes them itself."""
    pairs = cut(pairs_at_least(docs, id_col, text_col, width, least, every))
    prints = [f"fp{w}" for w in range(WORDS)]
    nodes = cut(sketches(docs, id_col, text_col, width).groupBy("node").agg(*(F.min(p).alias(p) for p in prints)))
    deal = Deal(RADIUS, WORDS, EACH)
    keys = dealt(nodes, deal, hot or HOT_GROUP).select("node", "key").distinct()
    a, b = (keys.select(F.col("node").alias(x), F.col("key")) for x in "ab")
    met = pairs.join(a, "a").join(b, ["b", "key"]).select("a", "b").distinct()
    side = lambda x: nodes.select(F.col("node").alias(x), F.array(*prints).alias(f"{x}_fp"))
    apart = F.aggregate(F.zip_with("a_fp", "b_fp", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    return met.join(side("a"), "a").join(side("b"), "b").filter(apart <= RADIUS).count(), pairs.count()
