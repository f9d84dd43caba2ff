"""Vector codes, spelling variants and line deduplication against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framewright.llm import lines, variants, vectors
from tests.llm.fixtures import documents, empty

# --- vector codes

VECTORS = "vec_id long, embedding array<double>, label int, code string, part string, position int, `row` string"


def vector_rows(spark, n=150, width=8, seed=1):
    rng = random.Random(seed)
    cell = lambda: rng.choice([-2, -1, 0, 1, 2]) / 1024 + rng.choice([0, 0, 0.0004, -0.0004])
    rows = [(i, [cell() for _ in range(width)], rng.choice([0, 1, None])) for i in range(n)]
    common = rows[3][1]
    rows += [(n + i, common, 1) for i in range(n // 2)]  # a third of all rows
    rows += [rows[5]] * 2 + [(None, rows[0][1], 2), (7000, None, 1), (7001, [None] + [0.0] * (width - 1), 1), (7002, [float("nan")] * width, 1)]
    rows += [(7003, [float("inf")] + [0.0] * (width - 1), 0), (7004, [0.1], 0), (7005, [], None)]
    return spark.createDataFrame([(*r, "c", "p", 1, "r") for r in rows], VECTORS)


def expected_codes(rows, width, parts, entries, rounds):
    held = []
    for r in rows:
        v = r["embedding"]
        if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v):
            whole = [int(np.floor(1024 * x)) for x in v] + [0] * (-width % parts)
            size = len(whole) // parts
            held.append((r["vec_id"], r["label"], [tuple(whole[p * size : (p + 1) * size]) for p in range(parts)]))
    held.sort(key=lambda x: (x[0] is None, x[0] or 0))
    books = [[list(h[2][p]) for h in held[:entries]] for p in range(parts)]

    def best(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            own = defaultdict(list)
            for h in held:
                own[best(h[2][p], book)[1]].append(h[2][p])
            books[p] = [[sum(c) // len(own[k]) for c in zip(*own[k])] if k in own else entry for k, entry in enumerate(book)]
    out, labels = [], Counter()
    for i, label, x in held:
        found = [best(x[p], books[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
        labels[label] += out[-1][3]
    said = ",".join(str(x) for book in books for entry in book for x in entry)
    return sorted(((i, code, error, labels[label]) for i, label, code, error in out), key=str), hashlib.sha256(said.encode()).hexdigest()


@pytest.mark.parametrize(("width", "entries", "hot_share"), [(8, 16, 1000), (6, 256, 3)])
def test_vector_codes_equal_brute_force(spark, width, entries, hot_share):
    df = vector_rows(spark, width=width).repartition(5)
    got, books = vectors.compress(df, entries=entries, hot_share=hot_share)
    want, digest = expected_codes(df.collect(), width, 4, entries, 4)
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got.collect()), key=str) == want
    assert vectors.digest(books) == digest
    near = {r["vec_id"]: r["vector"] for r in vectors.approximations(got, books).collect()}
    assert all(len(x) == -(-width // 4) * 4 for x in near.values())


def test_vector_codes_of_large_components_and_of_nothing(spark):
    rows = [(i, [float(i) * 10.0**k for k in (1, 6, 9, 12)], None) for i in range(6)] + [(9, [1e300, -1e300, 0.0, 1.0], 0)]
    df = spark.createDataFrame([(*r, "c", "p", 1, "r") for r in rows], VECTORS)
    got, books = vectors.compress(df, entries=2)
    by = {r["vec_id"]: r for r in got.collect()}
    assert len(by) == 7 and by[9]["error"] <= vectors.MOST and books[0][:, 0].max() <= vectors.LIMIT
    want, digest = expected_codes([r for r in df.collect() if r["vec_id"] != 9], 4, 4, 2, 4)
    clean, own = vectors.compress(df.filter("vec_id <> 9"), entries=2)
    got = sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in clean.collect()), key=str)
    assert vectors.digest(own) == digest
    assert got == [(i, c, min(e, vectors.MOST), min(le, vectors.MOST)) for i, c, e, le in want]
    none, books = vectors.compress(df.limit(0))
    assert none.count() == 0 and vectors.digest(books) == hashlib.sha256(b"").hexdigest()
    with pytest.raises(ValueError):
        vectors.compress(df, entries=300)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-(2**62), 2**62), min_size=3, max_size=3), max_size=20))
def test_parts_survive_their_bytes(rows):
    held = np.array(rows, np.int64).reshape(-1, 3)
    assert (vectors.from_bytes(vectors.to_bytes(held), 3) == held).all()


# --- spelling variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected_variants(counts):
    out, form = {}, {}
    for w, n in counts.items():
        near = [x for x in counts if one_edit(w, x)]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 2 * n else None
        out[w] = (n, len(near), counts[best] if form[w] else None)
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (w, form[w], root, *out[w])
    return sorted(out.values())


def test_spelling_variants_equal_brute_force(spark):
    rng = random.Random(5)
    counts = {}
    for base in ["kitten", "größer", "aaaaa", "abababab", "straßen"]:
        level = [base]
        counts[base] = 400
        for depth in range(3):
            grown = []
            for w in level:
                for _ in range(6):
                    i, c = rng.randrange(len(w) + 1), rng.choice("abßkt")
                    grown.append(rng.choice([w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :]]))
            level = [w for w in grown if len(w) >= 5]
            for w in level:
                counts.setdefault(w, max(3, 400 >> (2 * depth + rng.randint(1, 3))))
    counts["x" * 300], counts["x" * 299] = 3, 9
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    want = expected_variants(counts)
    for hot in (20_000, 4):
        got = [tuple(r) for r in variants.spelling_variants(words, hot=hot).select("word", "form", "root", "n", "n_near", "form_n").collect()]
        assert sorted(got) == want, hot
    assert any(r[1] and r[2] != r[1] for r in want)


def test_words_and_their_misspellings_equal_brute_force(spark):
    docs = documents(spark, n=90)
    found = Counter()
    for r in docs.collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if r['doc_id'] is None else r['doc_id']}:{run}".encode())
            found[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    want = {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}
    got = {r["word"]: r["n"] for r in variants.word_counts(docs, altered=variants.one_deleted).collect()}
    assert got == want
    assert variants.spelling_variants(variants.word_counts(empty(spark))).count() == 0


def test_common_segments_cost_no_pairs(spark):
    letters = "abcdefghijklmnopqrst"
    words = spark.createDataFrame([("same" + a + b + c + d, 3) for a in letters for b in letters[:10] for c in letters[:10] for d in letters[:5]], "word string, n long")
    rows = variants.indexed(words, hot=500)
    own = rows.groupBy("key").agg(F.count_if(~F.col("longer")).alias("n"), F.count_if("longer").alias("m"))
    most = own.agg(F.max(F.col("n") * (F.col("n") - 1) / 2 + F.col("n") * F.col("m"))).first()[0]
    assert most <= 500  # ten thousand words share a first segment
    got = variants.near_words(words, hot=500).groupBy("word").count().agg({"count": "min"}).first()[0]
    assert got == 19 + 9 + 9 + 4  # each letter of the second half against those at its place


# --- lines


def expected_lines(rows, least=10):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    docs = Counter(k for r in rows for k in {key(x) for x in (r["text"] or "").split("\n")} if k)
    out = []
    for r in rows:
        own = (r["text"] or "").split("\n")
        kept = [x for x in own if docs.get(key(x), 0) < least]
        out.append((r["doc_id"], len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest(), r["lang"]))
    return sorted(out, key=str)


def line_docs(spark):
    rng = random.Random(8)
    often = [f"Footer {k}" for k in range(6)] + [" Cookies \t", "cookies", "É accent", "x\x00y", "\x85", "   ", ""]
    docs = documents(spark)
    rows = [(1000 + i, "\n".join(rng.choice(often) if rng.random() < 0.4 else f"line {rng.randint(0, 60)}" for _ in range(rng.randint(1, 12))), rng.choice(["en", None])) for i in range(90)]
    rows += [(2000 + i, "Cookies\r\nsame text\n\nFOOTER 1", "fr") for i in range(40)]
    more = spark.createDataFrame([(i, t, lang, "s", 1, "s", "f", "p", "q") for i, t, lang in rows], docs.schema)
    return docs.unionByName(more).withColumn("__digest", docs["lang"]).withColumnRenamed("part", "lines")


@pytest.mark.parametrize(("most_bytes", "shard_keys", "hot_share"), [(32 << 20, 1 << 16, 10_000), (0, 8, 10_000), (0, 16, 20), (32 << 20, 5, 10)])
def test_line_dedup_equals_brute_force(spark, most_bytes, shard_keys, hot_share):
    docs = line_docs(spark)
    got = lines.drop_lines(docs, most_bytes=most_bytes, shard_keys=shard_keys, hot_share=hot_share)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
    rows = [(r["doc_id"], r["n_lines"], r["n_dropped"], hashlib.sha256(r["text"].encode()).hexdigest(), r["lang"]) for r in got.collect()]
    assert sorted(rows, key=str) == expected_lines(docs.collect())
    assert any(r[2] for r in rows)


def test_line_dedup_of_nothing(spark):
    assert lines.drop_lines(empty(spark)).count() == 0
    one = spark.createDataFrame([(1, None), (1, ""), (2, "a\nA")], "doc_id long, text string")
    assert sorted((r["n_lines"], r["n_dropped"], r["text"]) for r in lines.drop_lines(one).collect()) == [(1, 0, ""), (1, 0, ""), (2, 0, "a\nA")]
    assert {r["text"] for r in lines.drop_lines(one, least=1).collect()} == {""}


@pytest.mark.parametrize("n", [0, 1, 2, 500, 20_000])
def test_perfect_hash_is_minimal_and_perfect(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**63, (n, 2)).astype(np.uint64)
    keys[: n // 2, 0] = 7  # equal halves
    keys[n // 2 :, 1] = 9
    found = lines.PerfectHash.of(keys)
    assert sorted(found.slots(keys)) == list(range(n))
    counts = np.arange(n) + 2
    shard = lines.Shard(*lines.Shard.arrays(keys, counts))
    assert (shard.count(keys) == counts).all()
    assert not shard.count(rng.integers(0, 2**63, (1000, 2)).astype(np.uint64)).any()
