"""The pipeline's near-duplicate stage against Jaccard similarity over all pairs."""

import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from framewright.llm import simhash, similar
from framewright.llm.common import Texts
from tests.llm.fixtures import LEXICON, documents, empty, prose


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def kept_ids(rows):
    """The smallest id of each class of texts that links at 0.8 connect."""
    held, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(held):
        for j in range(i):
            if 5 * len(a & held[j]) >= 4 * len(a | held[j]):
                parent[top(i)] = top(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        low[top(i)] = min(low.get(top(i), doc), doc)
    return sorted(low.values())


def test_near_duplicate_stage_is_jaccard(spark):
    rng, rows = random.Random(5), []
    for family in range(12):
        base = prose(rng, rng.choice(list(LEXICON)), 150).split()
        rows.append((100 * family, " ".join(base)))
        for i in range(8):  # from 1 to 8 words changed: similarities on both sides of 0.8
            words = list(base)
            for at in rng.sample(range(len(words)), i + 1):
                words[at] = f"other{rng.randint(0, 99)}"
            rows.append((100 * family + i + 1, " ".join(words)))
    rows += [(5000, None), (5001, ""), (5002, "one two"), (5003, "One  two"), (5004, "one two three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r["doc_id"] for r in corpus_pipeline.keep_distinct(spark, docs, "").collect())
    assert got == kept_ids(rows)
    assert 12 < sum(i < 5000 for i in got) < 12 * 9
    assert len(simhash.drop_copies(docs).collect()) > len(got)
    assert sorted(r["doc_id"] for r in similar.drop_near_copies(docs, tile=5).collect()) == got


def test_tiled_groups_lose_no_link(spark):
    """One large group: chains of small steps between families, and single texts that only look alike."""
    rng, rows = random.Random(9), []
    base = prose(rng, "en", 160).split()
    for family in range(4):
        words = list(base)
        for at in rng.sample(range(len(words)), 12 * family):
            words[at] = f"family{family}x{at}"
        for i in range(30):
            own = list(words)
            for at in rng.sample(range(len(own)), rng.randint(0, 5)):
                own[at] = f"own{rng.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = kept_ids(rows)
    assert 1 < len(want) < 60
    for tile in (512, 16, 7):
        assert sorted(r["doc_id"] for r in similar.drop_near_copies(docs, tile=tile).collect()) == want


def test_shingle_sets_and_common_counts():
    texts = ["a b c d e f g a b c d e", "", None, "One two", "one  two", "x", "a b c d e f", "\xa0 é b c d"]
    column = Texts(pa.array(texts, pa.string()))
    data, offsets = column.data[column.offsets[0] : column.offsets[-1]], column.offsets - column.offsets[0]
    keys, firsts = similar.shingle_sets(data, offsets)
    sets = [keys[a:b] for a, b in zip(firsts, firsts[1:])]
    want = [shingles(t) for t in texts]
    assert [len(s) for s in sets] == [len(w) for w in want]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert len(np.intersect1d(a, b)) == len(want[i] & want[j])
    rng = np.random.default_rng(1)
    many = [np.unique(rng.choice(np.arange(200, dtype=np.uint64), rng.integers(1, 60))) for _ in range(50)]
    counts = similar.common_counts(many)
    assert all(counts[i, j] == len(np.intersect1d(many[i], many[j])) for j in range(50) for i in range(j))


def test_awkward_rows_keep_their_columns(spark):
    docs = documents(spark)
    kept = similar.drop_near_copies(docs)
    assert kept.columns == docs.columns
    want = kept_ids([(10**9 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(10**9 if r["doc_id"] is None else r["doc_id"] for r in kept.collect()) == want
    assert similar.drop_near_copies(empty(spark)).count() == 0


def test_recall_of_the_deal_against_the_exact_way(spark):
    rng = random.Random(21)
    rows = []
    for base in range(40):
        words = prose(rng, "en", 150).split()
        words = [w + str(rng.randint(0, 40)) for w in words]
        rows.append(" ".join(words))
        for _ in range(3):
            own = list(words)
            for at in rng.sample(range(len(own)), rng.randint(1, 3)):
                own[at] = f"own{rng.randint(0, 10**6)}"
            rows.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate([*rows, rows[0], None, ""])), "doc_id long, text string")
    sets = {t: shingles(t) for t in set(rows)}
    close = sum(5 * len(a & b) >= 4 * len(a | b) for x, a in sets.items() for y, b in sets.items() if x < y)
    pairs = similar.pairs_at_least(docs)
    assert pairs.count() == close > 60
    for hot in (None, 5):
        found, every = similar.recall(docs, hot=hot)
        assert every == close and found >= 0.95 * every
