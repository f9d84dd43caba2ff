"""SimHash, packing and sharding against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.llm import common, packing, shards, simhash, similar
from tests.llm.fixtures import documents, empty


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(words[k : k + 4]).encode(), 42) for k in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, radius=4):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


@pytest.mark.parametrize("hot", [20_000, 2])
def test_near_duplicates_equal_brute_force(spark, hot, monkeypatch):
    if hot == 2:  # the ways beyond the bounds
        monkeypatch.setattr(simhash.components, "__defaults__", (0,))
        monkeypatch.setattr(common.with_facts, "__defaults__", ("inner", 0))
    docs = documents(spark)
    rows = docs.collect()
    fps = [fingerprint(r["text"]) for r in rows]
    root = classes(fps)
    low = {}
    for r, x in zip(rows, root):
        low.setdefault(x, []).append(r["doc_id"])
    want = sorted(((r["doc_id"], f"{f:016x}", min((i for i in low[x] if i is not None), default=None)) for r, f, x in zip(rows, fps, root)), key=str)
    got = simhash.near_duplicates(docs, hot=hot).collect()
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=str) == want
    kept = simhash.drop_copies(docs, hot=hot)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(ids, key=str) == sorted((min((i for i in x if i is not None), default=None) for x in low.values()), key=str)


def test_survivors_of_equal_ids_do_not_depend_on_partitions(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a  b c d e f", "y"), (1, "A b c d e f", "z"), (1, "other words of one more text", "w"), (2, "a b c d e f", "v")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    seen = {tuple(sorted(map(tuple, simhash.drop_copies(docs.repartition(n)).collect()))) for n in (1, 3, 7)}
    assert len(seen) == 1 and len(next(iter(seen))) == 2


def test_near_duplicates_of_nothing(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0 and simhash.drop_copies(empty(spark)).count() == 0


def near(rng, base, bits):
    for b in rng.sample(range(64), bits):
        base ^= 1 << b
    return base


@pytest.mark.parametrize("seed", range(4))
def test_gray_index_equals_brute_force(seed):
    rng = random.Random(seed)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for _ in range(6):
        base = rng.getrandbits(64)
        fps |= {near(rng, base, rng.randint(0, 6)) for _ in range(40)}
    fps = sorted(fps)
    rng.shuffle(fps)
    got = simhash.GrayIndex(np.array(fps, np.uint64), np.zeros(len(fps), np.int64), 4).forest()
    want = classes(fps)
    assert len(set(zip(got.tolist(), want))) == len(set(want)) == len(set(got.tolist()))


def test_gray_index_stays_inside_its_groups():
    fps = np.array([1, 1 ^ 2, 8, 0, 3], np.uint64)
    got = simhash.GrayIndex(fps, np.array([0, 1, 0, 1, 2]), 4).forest()
    assert got[0] == got[2] and got[1] == got[3] and len(set(got.tolist())) == 3


def test_dense_group_and_long_chain(spark):
    rng = random.Random(1)
    base = rng.getrandbits(63)
    chain, x = [], rng.getrandbits(63)
    for i in range(0, 60, 4):
        chain.append(x)
        x ^= 0b1111 << i
    values = {near(rng, base, 2) & (2**63 - 1) for _ in range(900)} | set(chain)
    df = spark.createDataFrame([(v, v) for v in values], "node long, fp long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, 4, hot=300)).collect()}
    values = sorted(values)
    want = classes(values)
    for v, w in zip(values, want):
        assert roots.get(v, v) == values[w]


@pytest.mark.parametrize("one_task", [0, simhash.ONE_TASK])
def test_components_equal_union_find(spark, one_task):
    rng = random.Random(4)
    pairs = [(0, i) for i in range(1, 80)] + [(i, i + 1) for i in range(100, 140)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(120)]
    parent = list(range(401))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(pairs, "a long, b long"), one_task).collect()}
    assert all(got.get(x, x) == top(x) for pair in pairs for x in pair)
    # nodes of several fields, with nulls: the smallest in their order
    name = lambda x: (x % 3 == 0, None if x % 3 == 0 else f"id{x:03d}", x)
    kind = "struct<none: boolean, id: string, fp: bigint>"
    named = simhash.components(spark.createDataFrame([(name(a), name(b)) for a, b in pairs], f"a {kind}, b {kind}"), one_task)
    got = {r["node"]["fp"]: r["root"]["fp"] for r in named.collect()}
    held = {}
    for x in {x for pair in pairs for x in pair}:
        held.setdefault(top(x), []).append(x)
    low = {x: min(xs, key=lambda y: (name(y)[0], name(y)[1] or "", y)) for xs in held.values() for x in xs}
    assert all(got.get(x, x) == low[x] for x in low)


@pytest.mark.parametrize("words", [1, 4])
def test_links_of_any_deal_stay_whole_when_values_are_hot(spark, words):
    rng = random.Random(words)
    base = [rng.getrandbits(63) for _ in range(words)]
    rows = []
    for i in range(300):
        own = [near(rng, x, rng.randint(0, 1)) & (2**63 - 1) for x in base]
        rows.append((i, *own))
    names = simhash.Deal(4, words, 0 if words == 1 else 6).columns()
    nodes = spark.createDataFrame(rows, "node long, " + ", ".join(f"{x} long" for x in names)).dropDuplicates(names)
    deal = simhash.Deal(4) if words == 1 else simhash.Deal(8, words, 6)
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(nodes, deal, hot=40)).collect()}
    held = [r["node"] for r in nodes.collect()]
    assert {roots.get(x, x) for x in held} == {min(held)}


def test_vote_counts_beyond_a_byte():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 2**64, 2000, np.uint64, endpoint=False) | np.uint64(1 << 5)
    firsts = np.array([0, 0, 1400, 1401, 2000])
    got = simhash.vote(h, firsts)
    for i, (a, b) in enumerate(zip(firsts, firsts[1:])):
        assert int(got[i]) == sum(1 << k for k in range(64) if 2 * sum(int(x) >> k & 1 for x in h[a:b]) > b - a)


def test_gray_rank_orders_by_one_bit():
    codes = np.arange(64, dtype=np.uint64)
    order = np.argsort(simhash.gray_rank(codes ^ (codes >> np.uint64(1))))
    assert (order == np.arange(64)).all()


def test_pack_equals_brute_force(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = documents(spark).filter("doc_id is not null").dropDuplicates(["doc_id"])
    rows = packing.pack(docs, keep_ids=True).collect()
    by, sequences, total = {}, {}, 0
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d in docs.collect():
        ids = reference.encode(d["text"] or "", add_special_tokens=False).ids + [2]
        at = 0
        for k, r in enumerate(sorted(by[d["doc_id"]], key=lambda r: r["piece"])):
            own = ids[at : at + r["length"]]
            assert (r["piece"], r["start"], r["ids"]) == (k, at, own) and r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
            assert r["length"] == 1024 or k == 0
            at += r["length"]
        assert at == len(ids)
        total += at
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    assert -(-total // 1024) <= len(sequences) <= -(-total // 1024) + 3


def test_pack_repeats_and_nothing(spark):
    docs = documents(spark)
    rows = packing.pack(docs).collect()
    assert sum(r["piece"] == 0 for r in rows) == docs.count()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    assert packing.pack(empty(spark)).count() == 0


ODD = ["", " ", "  a  b ", "a\n\n b", "x \n y  \n\n  z", "é   b", "<|endoftext|> hi", "it's we'll  don't", "12 345  6", "日本 語  text 　 z", "\0a", "a \0b", "a\x1c \x1cb", " \x85 b", "a \tb"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \n\t\xa0　ab1.'é\x85\0"), max_size=20), max_size=4))
def test_word_by_word_tokens_equal_whole_texts(texts):
    tokens = made()
    flat, sizes = tokens.encode(pa.array([*texts, *ODD], pa.string()))
    assert [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] == [tokens.tokenizer.encode(t, add_special_tokens=False).ids for t in [*texts, *ODD]]


def test_words_beyond_the_cache(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_BYTES", 10)
    tokens = packing.Tokens()
    for texts in (["one two three four"], ["five one six", None, ""], ["six seven"]):
        flat, sizes = tokens.encode(pa.array(texts, pa.string()))
        assert [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] == [tokens.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert tokens.n_known < 6


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 2**64 - 1), unique=True, max_size=300), st.integers(1, 7))
def test_hash_places(keys, parts):
    table, keys = packing.Places64(2), np.array(keys, np.uint64)
    for part in range(parts):
        table.add(keys[part::parts], np.arange(len(keys))[part::parts])
    assert table.find(keys).tolist() == list(range(len(keys)))
    other = keys ^ np.uint64(1)
    other = other[(other != 0) & ~np.isin(other, keys)]
    assert (table.find(other) == -1).all()


_made = []


def made():
    if not _made:
        _made.append(packing.Tokens())
    return _made[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_packing_holds_every_length_once(lengths):
    counts = {x: lengths.count(x) for x in lengths}
    packed = packing.pack_lengths(counts, 64, (3, 8, 64))
    got = {}
    for held, n in packed:
        assert sum(held) <= 64 and n > 0
        for x in held:
            got[x] = got.get(x, 0) + n
    assert got == counts
    bins = sum(n for _, n in packed)
    free = []  # best-fit decreasing
    for x in sorted(lengths, reverse=True):
        room = min((r for r in free if r >= x), default=None)
        free.remove(room) if room is not None else None
        free.append((room if room is not None else 64) - x)
    assert bins <= len(free) + 1


def test_words_that_share_a_hash_keep_their_own_ids(monkeypatch):
    monkeypatch.setattr(packing, "hash_words", lambda data, starts, lengths: np.minimum(lengths, 3).astype(np.uint64) + np.uint64(1))
    tokens = packing.Tokens()
    for texts in (["aa bb ccc dddd"], ["aa ee fffff dddd gg"], ["hh ccc aa bb"]):
        flat, sizes = tokens.encode(pa.array(texts, pa.string()))
        assert [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] == [tokens.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def all_configurations(sizes, capacity):
    if not sizes:
        return [()]
    return [(k, *rest) for k in range(capacity // sizes[0] + 1) for rest in all_configurations(sizes[1:], capacity - k * sizes[0])]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(5, 40), min_size=1, max_size=5, unique=True), st.data())
def test_configurations_are_optimal(sizes, data):
    sizes = sorted(sizes, reverse=True)
    demand = data.draw(st.lists(st.integers(1, 30), min_size=len(sizes), max_size=len(sizes)))
    every = all_configurations(sizes, 40)
    values = np.array(data.draw(st.lists(st.floats(0, 1), min_size=len(sizes), max_size=len(sizes))))
    worth, used = packing.knapsack(np.array(sizes), values, 40)
    assert abs(worth - max(float(np.dot(c, values)) for c in every)) < 1e-9 and used @ np.array(sizes) <= 40 and abs(used @ values - worth) < 1e-9
    plan = packing.configurations(sizes, demand, 40)
    held = sum(uses * amount for uses, amount in plan)
    assert np.allclose(held, demand) and all(amount >= -1e-9 and uses @ np.array(sizes) <= 40 for uses, amount in plan)
    # no configuration is worth more than a sequence at the prices of the basis: the plan is optimal
    prices = np.linalg.solve(np.array([uses for uses, _ in plan], float), np.ones(len(plan)))
    assert max(float(np.dot(c, prices)) for c in every) <= 1 + 1e-6


def test_large_lengths_are_rounded_up_in_groups():
    rng = random.Random(3)
    counts = {}
    for _ in range(4000):
        x = rng.randint(300, 1000)
        counts[x] = counts.get(x, 0) + rng.randint(1, 3)
    groups = packing.linear_groups(counts, 32)
    assert len(groups) <= 32 and max(g.left for g in groups) <= 1.2 * sum(counts.values()) / 32
    assert all(x <= g.size for g in groups for x, _ in g.runs)
    packed = packing.grouped_packing(counts, 1024, 32, 1 / 4)
    least = sum(x * n for x, n in counts.items()) / 1024
    assert sum(x * n for held, n in packed for x in held) == sum(x * n for x, n in counts.items())
    assert sum(n for _, n in packed) < 1.35 * least


def brute_shards(rows, limit):
    seen, keyed = {}, []
    for i, text in rows:
        k = (i, text or "")
        seen[k] = seen.get(k, 0) + 1
        name = ("" if i is None else str(i)) + ":" + hashlib.md5((text or "").encode()).hexdigest() + ":" + str(seen[k])
        keyed.append((i, seen[k], len((text or "").encode()), format(int(hashlib.md5(name.encode()).hexdigest()[:15], 16), "060b")))
    out, open_ = {}, [("", keyed)]
    while open_:
        bits, held = open_.pop()
        if not held:
            continue
        if sum(x[2] for x in held) <= limit or len(held) == 1:
            for x in held:
                out[x[:3] + (x[3],)] = (bits, sum(y[2] for y in held), len(held))
        else:
            open_ += [(bits + b, [x for x in held if x[3].startswith(bits + b)]) for b in "01"]
    return sorted(((*k[:3], *v) for k, v in out.items()), key=str)


@pytest.mark.parametrize("limit", [1 << 20, 3000, 200, 1])
def test_shards_equal_brute_force(spark, limit, monkeypatch):
    monkeypatch.setattr(shards, "SPARE_BITS", 0 if limit == 200 else 4)  # too few bits at first: dealt again
    docs = documents(spark)
    rows = shards.shard(docs, limit=limit).collect()
    got = sorted(((r["doc_id"], r["copy"], r["n_bytes"], r["shard"], r["shard_bytes"], r["shard_rows"]) for r in rows), key=str)
    assert got == brute_shards([(r["doc_id"], r["text"]) for r in docs.collect()], limit)
    assert all(r["depth"] == len(r["shard"]) and (r["shard_bytes"] <= limit or r["shard_rows"] == 1) for r in rows)


def test_many_copies_are_numbered_once(spark, monkeypatch):
    monkeypatch.setattr(shards, "COPIES_A_TASK", 7)
    docs = spark.createDataFrame([(1, "same text")] * 40 + [(1, "other tex")] * 3 + [(None, None)] * 9, "doc_id long, text string")
    rows = shards.shard(docs, limit=40).collect()
    held = {}
    for r in rows:
        held.setdefault((r["doc_id"], r["digest"]), []).append(r["copy"])
    assert sorted(sorted(v) for v in held.values()) == sorted(list(range(1, n + 1)) for n in (40, 3, 9))


def test_written_shards_hold_all_rows(spark, tmp_path):
    docs = documents(spark).withColumnRenamed("part", "shard_")
    assigned = shards.write_shards(docs.repartition(3), str(tmp_path / "out"), limit=2000)
    back = spark.read.schema(T.StructType([*docs.schema.fields, T.StructField("shard", T.StringType())])).parquet(str(tmp_path / "out"))
    assert sorted(map(str, back.select(*docs.columns).collect())) == sorted(map(str, docs.collect()))
    sizes = {r["shard"]: (r["b"], r["n"]) for r in back.groupBy("shard").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("b"), F.count("*").alias("n")).collect()}
    assert sizes == {"s" + r["shard"]: (r["shard_bytes"], r["shard_rows"]) for r in assigned.collect()}


def test_shards_of_nothing(spark):
    assert shards.shard(empty(spark)).count() == 0


def test_components_of_random_graphs(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(40)]
    parent = list(range(400))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == root(x) for e in edges for x in e)


def test_a_pair_that_shares_one_block_links_in_hot_values(spark):
    rng = random.Random(12)
    deal = simhash.Deal(similar.RADIUS, similar.WORDS, similar.EACH)
    names = deal.columns()
    base = [rng.getrandbits(64) for _ in names]
    cuts = [(w, s, b) for w in range(len(names)) for s, b in simhash.blocks(64, similar.EACH)]
    other = list(base)
    for w, s, _ in cuts[:-1]:  # one bit of every block but the last
        other[w] ^= 1 << s
    w, s, b = cuts[-1]
    keep = ((1 << b) - 1) << s
    crowd = [[rng.getrandbits(64) for _ in names[:-1]] + [rng.getrandbits(64) & ~keep | base[w] & keep] for _ in range(40)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(i, *map(signed, fp)) for i, fp in enumerate([base, other, *crowd])]
    nodes = spark.createDataFrame(rows, "node long, " + ", ".join(f"{x} long" for x in names))
    for hot in (20_000, 10):
        found = {r["node"]: r["root"] for r in simhash.components(simhash.links(nodes, deal, hot=hot)).collect()}
        assert found.get(1) == 0, hot


@pytest.mark.parametrize("words", [1, 4])
def test_links_do_not_depend_on_what_is_hot(spark, words):
    rng = random.Random(words)
    deal = simhash.Deal(4) if words == 1 else simhash.Deal(40, 4, 6)
    rows = []
    for c in range(60):
        base = [rng.getrandbits(63) for _ in range(words)]
        rows.append(base)
        for _ in range(5):
            own = list(base)
            for _ in range(rng.randint(1, 6 if words == 1 else 50)):
                own[rng.randrange(words)] ^= 1 << rng.randrange(63)
            rows.append(own)
    nodes = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "node long, " + ", ".join(f"{x} long" for x in deal.columns())).dropDuplicates(deal.columns())
    found = [sorted(map(tuple, simhash.components(simhash.links(nodes, deal, hot=hot)).collect())) for hot in (20_000, 3, 1)]
    assert found[0] == found[1] == found[2] and found[0]
