"""License scans and decontamination against brute force."""

import hashlib
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from framewright.llm import decontam, licenses
from tests.llm.fixtures import documents, empty, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expected_hits(text, items):
    own = words(text)
    hit, found = set(), set()
    for item, t in items:
        w = words(t)
        size = min(10, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            for at in range(len(own) - size + 1):
                if own[at : at + size] == w[k : k + size]:
                    hit.update(range(at, at + size))
                    found.add(str(item) if item is not None else "")
    return len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def bench_rows(docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] is not None}
    long = words(texts[74])
    return [
        (1, " ".join(long[100:130])), (2, " ".join(long[500:510]).upper()), (3, " ".join(long[2000:2009])), (4, "tail1"), (5, None), (6, ""), (7, "?!"),
        (8, " ".join(long[110:118] + ["other"] + long[119:140])), (9, " ".join(long[100:130])), (10, "river stone river stone river stone river stone river stone"), (None, "no id here"),
    ]


@pytest.mark.parametrize("most_bytes", [8 << 20, 120])
def test_decontamination_equals_brute_force(spark, most_bytes):
    docs = documents(spark)
    items = bench_rows(docs)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.decontaminate(docs, bench, most_bytes=most_bytes).collect()
    want = sorted(((r["doc_id"], *expected_hits(r["text"], items)) for r in docs.collect()), key=str)
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got), key=str) == want
    assert any(r["contaminated"] for r in got)


def test_decontamination_of_nothing(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontam.decontaminate(empty(spark), bench).count() == 0
    assert not any(r["contaminated"] for r in decontam.decontaminate(documents(spark), bench).collect())
    assert decontam.drop_contaminated(documents(spark), bench).count() == documents(spark).count()


def test_drop_contaminated_keeps_columns_and_clean_rows(spark):
    docs = documents(spark)
    bench = spark.createDataFrame(bench_rows(docs)[:1], "item_id long, text string")
    for most_bytes in (8 << 20, 10):
        kept = decontam.drop_contaminated(docs, bench, most_bytes=most_bytes)
        assert kept.columns == docs.columns
        assert kept.count() == docs.count() - 1 and kept.filter("doc_id = 74").count() == 0


def test_repeated_words_cost_no_pairs(spark):
    """20,000 equal words against items of as many, and short periods: seconds, not hours."""
    import time

    items = [(1, "a " * 20_000), (2, "b c " * 5000), (3, "a " * 12), (4, "x " * 9)]
    docs = spark.createDataFrame([(1, "a " * 20_000), (2, "c b " * 8000 + "d"), (3, "x " * 30), (4, "a " * 9)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    began = time.monotonic()
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontam.decontaminate(docs, bench).collect()}
    assert got == {1: (20_000, 20_000, ["1", "3"]), 2: (16_001, 16_000, ["2"]), 3: (30, 30, ["4"]), 4: (9, 0, [])}
    assert time.monotonic() - began < 20
    held = decontam.Bench(["1"], [items[0][1]], decontam.K, decontam.WINDOW)
    words, firsts, _ = decontam.folded_words(*decontam._flat([items[0][1]]))
    began = time.monotonic()
    spans = decontam.find_spans(words, firsts, held, decontam.K, decontam.WINDOW)
    assert time.monotonic() - began < 2 and decontam.merged(spans[:, :2]).tolist() == [[0, 20_000]]

@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60), st.lists(st.lists(st.sampled_from("abc"), max_size=14), max_size=5), st.integers(2, 4), st.integers(1, 4))
def test_winnowing_finds_every_shared_span(text, items, k, window):
    span = k + window - 1
    bench = decontam.Bench([str(i) for i in range(len(items))], [" ".join(x) for x in items], k, window)
    data, offsets = decontam._flat(["q q", " ".join(text)])
    hashes, firsts, _ = decontam.folded_words(data, offsets)
    got = set()
    for a, b, item in decontam.find_spans(hashes, firsts, bench, k, window):
        got.update((x - 2, item) for x in range(a, b))
    want = set()
    for i, w in enumerate(items):
        size = min(span, len(w))
        for x in range(len(w) - size + 1 if w else 0):
            for at in range(len(text) - size + 1):
                if text[at : at + size] == w[x : x + size]:
                    want.update((p, i) for p in range(at, at + size))
    assert got == want


def test_license_base_equals_brute_force(spark):
    import random

    rng = random.Random(5)
    texts = [
        "Under the GNU General Public License. mit-license, MIT\nLicense!", "cc by cc by", "summit license and admit licensed", "Apache  License", None, "", "cc", "MIT Licence of",
        prose(rng, "en", 5000) + " Apache License", "gnu generel public licence v3", "licensed under the apache licensee", "all rights reservd",
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] * 2, "doc_id long, text string, labels string")
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    for r in licenses.scan_licenses(df).collect():
        own, at, found = words(texts[r["doc_id"]]), [], set()
        for phrase, label in phrases.items():
            p = phrase.split()
            for k in range(len(own) - len(p) + 1):
                if own[k : k + len(p)] == p:
                    at.append(k)
                    found.add(label)
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(own), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(found)))
        assert found <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
    by = {r["doc_id"]: r for r in licenses.scan_licenses(df).collect()}
    assert by[9]["labels"] == "gpl" and by[9]["base_labels"] == "" and 0.8 < by[9]["score"] < 1
    assert by[7]["labels"] == "mit" and by[11]["labels"] == "all-rights-reserved" and by[2]["labels"] == ""
    assert by[9]["spans"][0]["edits"] == 2
    assert licenses.scan_licenses(empty(spark)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.text("abmitlces ", max_size=30), st.data())
def test_pigeonhole_finds_every_damaged_notice(around, data):
    phrase = "mozilla public license"
    harmed = list(phrase)
    for _ in range(data.draw(st.integers(0, 2))):
        at = data.draw(st.integers(1, len(harmed) - 2))
        harmed[at : at + 1] = data.draw(st.sampled_from([[], ["x"], [harmed[at], "y"]]))
    text = f"{around} {''.join(harmed)} {around}"
    own = words(text)
    if " ".join(words("".join(harmed))).count(" ") == phrase.count(" "):
        _, spans = licenses.Scanner().scan([w.encode() for w in own])
        assert any(licenses.NOTICES[k].label == "mpl" for k, *_ in spans)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return row[-1]


def brute_spans(text, phrase, edits):
    """Edits of disjoint word-aligned matches: the fewest edits first, then left and right of it."""
    starts = [0] + [i + 1 for i, c in enumerate(text) if c == " "]
    ends = [i for i, c in enumerate(text) if c == " "] + [len(text)]
    every = [(distance(phrase, text[a:b]), a, b) for a in starts for b in ends if abs(b - a - len(phrase)) <= edits]
    every = sorted(x for x in every if x[0] <= edits)

    def best(lo, hi):
        found = next((x for x in every if x[1] >= lo and x[2] <= hi), None)
        return [found, *best(lo, found[1] - 1), *best(found[2] + 1, hi)] if found else []

    return best(0, len(text))


@pytest.mark.parametrize("text", ["mozila publc license mozilla public licence", "gnu generl publc license gnu general public licence", "mozilla public licens mozila publc license x mozilla public license"])
def test_a_match_hides_none_beside_it(text):
    for k, notice in enumerate(licenses.NOTICES):
        want = brute_spans(text, notice.phrase, notice.edits)
        got = [s for s in licenses.Scanner().scan([w.encode() for w in text.split()])[1] if s[0] == k]
        assert sorted(e for *_, e in got) == sorted(e for e, *_ in want)
    assert sum(s[3] > 0 for s in licenses.Scanner().scan([w.encode() for w in text.split()])[1]) >= 2


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["mit license", "apache license", "mozilla public license"]), st.lists(st.tuples(st.integers(0, 30), st.sampled_from(["", "x", "qq"])), max_size=2)), min_size=1, max_size=4))
def test_all_fuzzy_spans_equal_brute_force(notices):
    said = []
    for phrase, changes in notices:
        letters = list(phrase)
        for at, new in changes:
            letters[at % len(letters)] = new
        said.append("".join(letters))
    text = " ".join(w.decode() for w in " ".join(said).encode().split())
    scanner = licenses.Scanner()
    spans = scanner.scan([w.encode() for w in text.split()])[1]
    for k, notice in enumerate(scanner.notices[:7]):
        own = [s for s in spans if s[0] == k]
        want = brute_spans(text, notice.phrase, notice.edits)
        assert len(own) == len(want) and sorted(e for *_, e in own) == sorted(e for e, *_ in want)
        assert all(distance(notice.phrase, text[a:b]) == e for _, a, b, e in own)


def test_pathological_texts(spark):
    df = spark.createDataFrame([(1, "license " * 20_000), (2, "gnu " * 20_000), (3, "é" * 200_000)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_words"] for r in licenses.scan_licenses(df).collect()} == {1: 20_000, 2: 20_000, 3: 1}


def test_adjacent_damaged_notices_cost_their_length():
    scanner = licenses.Scanner()
    began = time.monotonic()
    _, spans = scanner.scan(b"gnu generl publc licens x ".split() * 4000)
    assert time.monotonic() - began < 5 and sum(scanner.notices[k].label == "gpl" for k, *_ in spans) == 4000
    _, spans = scanner.scan(b"gnu generl publc licens".split() * 500)
    assert sum(scanner.notices[k].label == "gpl" for k, *_ in spans) == 500


def test_hot_texts_of_a_large_benchmark_go(spark):
    rng = random.Random(4)
    dirty, clean = prose(rng, "en", 60), prose(rng, "fr", 60)
    docs = spark.createDataFrame([(i, dirty if i % 2 else clean, {"a": i}) for i in range(400)], "doc_id long, text string, extra map<string, int>")
    bench = spark.createDataFrame([(1, dirty[:200]), (2, None)], "item_id long, text string")
    kept = decontam.drop_contaminated(docs, bench, most_bytes=10)
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(0, 400, 2)) and kept.columns == docs.columns
