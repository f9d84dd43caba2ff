"""Toxicity, quality and language ID: parts against brute force, held-out accuracy, awkward rows."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from framewright.llm import language, quality, toxicity
from framewright.llm.words import folded_words, hash_word, word_list
from tests.llm.fixtures import LEXICON, documents, empty, prose

LABELS = "doc_id long, quality int, toxic int, text string"


def held(i, modulus, remainder):
    return zlib.crc32(str(i).encode() if i is not None else b"") % modulus == remainder


def labelled(spark, n=500, seed=2):
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        lang = rng.choice(list(LEXICON))
        text = prose(rng, lang, rng.randint(20, 120))
        toxic, good = int(rng.random() < 0.2), int(rng.random() < 0.8)
        if toxic:
            own = text.split()
            for _ in range(3):
                own.insert(rng.randint(0, len(own)), rng.choice(["vileword", "foulname", "nastyterm"]))
            text = " ".join(own)
        if not good:
            text = " | ".join(w.upper() + "!!" for w in text.split()[:15]) * 3
        rows.append((i, text, lang, "s"))
        labels.append((i, good, toxic, "clash"))
    labels += [(n + 5, None, None, "unlabelled"), (None, 1, 1, "no id"), (0, labels[0][1], labels[0][2], "twice")]
    rows += [(0, rows[0][1], rows[0][2], "s"), (n + 5, None, None, "s"), (n + 6, "", "en", "s"), (None, "text", "en", "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string"), spark.createDataFrame(labels, LABELS)


def test_word_hashes_equal_one_by_one():
    texts = [b"One two", b"", b"TWO \xc3\xa9t\xc3\xa9" + b"x" * 60, b"...", b"a" * 25 + b" b"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    hashes, firsts, _ = folded_words(data, offsets)
    assert hashes.tolist() == [hash_word(w) for t in texts for w in word_list(t)]
    assert np.diff(firsts).tolist() == [len(word_list(t)) for t in texts]


def test_toxicity_held_out(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels)
    rows = toxicity.score_toxicity(docs, model).collect()
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert len(rows) == docs.count()
    test = [r for r in rows if r["held_out"] and truth.get(r["doc_id"]) is not None]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in test]) > 0.97
    assert all(r["held_out"] == held(r["doc_id"], 3, 1) and r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in rows)
    assert len(model.at) < 4000  # L1 leaves few weights
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] == 0 for r in rows)
    again = toxicity.train(docs.repartition(7), labels)
    assert np.array_equal(model.at, again.at) and np.allclose(model.weights, again.weights)


def test_toxicity_never_learns_from_held_out_rows(spark):
    docs, labels = labelled(spark, 200)
    ours = labels.rdd.map(lambda r: (r["doc_id"], r["quality"], 1 if held(r["doc_id"], 3, 1) else r["toxic"], "")).toDF(LABELS)
    a, b = toxicity.train(docs, labels), toxicity.train(docs, ours)
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_grams_equal_brute_force():
    texts = [b"a b c", b"", b"x", b"a b a b"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    words, firsts, _ = folded_words(data, offsets)
    features, owners = toxicity.grams(words, firsts)
    sizes = [3 + 2 + 1, 0, 1, 4 + 3 + 2]
    assert np.bincount(owners, minlength=4).tolist() == sizes
    features, owners = toxicity.distinct(features, owners)
    assert np.bincount(owners, minlength=4).tolist() == [6, 0, 1, 2 + 2 + 2]


def test_ftrl_equals_a_plain_loop():
    how = toxicity.Ftrl(epochs=2, l1=0.1)
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 64, 8)) for _ in range(50)]
    y = np.array([int(3 in r) for r in rows])
    w, bias = toxicity.fit(rows, y, how, bits=6)
    z, n, plain = [0.0] * 64, [0.0] * 64, [0.0] * 64
    rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
    b, q = float(np.log(rate / (1 - rate))), 1.0
    for _ in range(2):
        for r, t in zip(rows, y):
            p = 1 / (1 + np.exp(-(b + sum(plain[i] for i in r))))
            g = p - t
            if abs(g) < 1e-4:
                continue
            for i in r:
                s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / how.alpha
                z[i] += g - s * plain[i]
                n[i] += g * g
                plain[i] = 0.0 if abs(z[i]) <= how.l1 else -(z[i] - np.sign(z[i]) * how.l1) / ((how.beta + np.sqrt(n[i])) / how.alpha + how.l2)
            q += g * g
            b -= how.bias_rate * g / np.sqrt(q)
    assert np.allclose(w, plain) and np.isclose(bias, b)


def test_models_on_awkward_and_empty_tables(spark):
    docs, (_, labels) = documents(spark), labelled(spark, 60)
    none = spark.createDataFrame([], LABELS)
    for known in (labels, none):
        trees, model = quality.train(docs, known), toxicity.train(docs, known)
        for rows in (quality.score_quality(docs, trees), toxicity.score_toxicity(docs, model)):
            got = rows.collect()
            assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
        assert quality.score_quality(empty(spark), trees).count() == 0 and toxicity.score_toxicity(empty(spark), model).count() == 0
    assert {r["score"] for r in toxicity.score_toxicity(docs, toxicity.train(docs, none)).collect()} == {0.5}
    assert toxicity.train(empty(spark), labels).bias == 0.0


def test_quality_held_out(spark):
    docs, labels = labelled(spark)
    trees = quality.train(docs, labels)
    rows = quality.score_quality(docs, trees).collect()
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    test = [r for r in rows if r["held_out"] and truth.get(r["doc_id"]) is not None]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in test]) > 0.97
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in rows) and len(rows) == docs.count()


def test_statistics_by_hand():
    texts = ["One two two\nOne two two\n! |", "", "aa bb aa bb"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    x = dict(zip(quality.STATISTICS, quality.statistics(data, offsets).T))
    assert np.allclose(x["distinct_words"], [4 / 8, 0, 2 / 4])
    assert np.allclose(x["top_word"], [4 / 8, 0, 2 / 4])
    assert np.allclose(x["same_as_last"], [2 / 8, 0, 0])
    assert np.allclose(x["same_as_before_last"], [1 / 8, 0, 2 / 4])
    assert np.allclose(x["repeated_lines"], [2 / 3, 0, 0])
    assert np.allclose(x["distinct_pairs"], [5 / 7, 0, 2 / 3])
    assert np.allclose(x["share_loud"], [1 / len(texts[0]), 0, 0])


def test_trees_walk_like_a_plain_loop():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] > 0)).astype(float)
    trees = quality.grow(x, y)
    got = trees.score(x)
    for i in range(0, 400, 37):
        total = trees.bias
        for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(x[i, f[node]] > t[node])
            total += leaf[node - len(f)]
        assert abs(got[i] - 1 / (1 + np.exp(-total))) < 1e-5
    assert np.mean((got > 0.5) == y) > 0.97


def test_language_held_out_and_awkward_rows(spark):
    docs = documents(spark, 300)
    model = language.learn(docs)
    assert model.names == ["de", "en", "fr"]
    rows = language.identify_languages(docs, model).collect()
    assert len(rows) == docs.count()
    texts = {(r["doc_id"], r["text"]): r["lang"] for r in docs.collect()}
    by = {r["doc_id"]: r for r in rows}
    for r in rows:
        assert r["held_out"] == held(r["doc_id"], 5, 0) and 0 <= r["score"] <= 1
    und = {i for i, t in texts if i is not None and not any(c.isalpha() for c in t or "")}
    assert {i for i, r in by.items() if r["lang_pred"] == "und"} == und and len(und) == 4
    judged = [(by[i]["lang_pred"], x) for (i, _), x in texts.items() if i is not None and i < 300 and by[i]["held_out"]]
    assert np.mean([a == b for a, b in judged]) > 0.97
    assert language.identify_languages(empty(spark), model).count() == 0
    assert language.learn(empty(spark)) is None
    assert {r["lang_pred"] for r in language.identify_languages(docs, None).collect()} == {"und"}
    kept = language.drop_unidentified(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["lang_pred"] != "und" and r["score"] >= 0.5 for r in rows)


def brute_language(counts, text, least=1):
    """Word-first backoff with dictionaries: counts are {(lang, word): n}."""
    import math

    names = sorted({lang for lang, _ in counts})

    def table(entries, least):
        grid = {}
        for key, lang, n in entries:
            grid.setdefault(key, dict.fromkeys(names, 0))[lang] += n
        grid = {k: g for k, g in grid.items() if sum(g.values()) >= least}
        total = {x: sum(g[x] for g in grid.values()) + 0.3 * max(1, len(grid)) for x in names}
        return {k: [math.log(g[x] + 0.3) - math.log(total[x]) for x in names] for k, g in grid.items()}

    def grams(word, n):
        marked = "\1" + word + "\1"
        return [marked[i : i + n] for i in range(len(marked) - n + 1) if n > 1 or marked[i] != "\1"]

    known = table([(w, lang, n) for (lang, w), n in counts.items()], least)
    tables = {k: table([(g, lang, n) for (lang, w), n in counts.items() for g in grams(w, k)], least) for k in range(1, 6)}
    own = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text or "").split()
    if not own:
        return "und", 0.0
    sums = [0.0] * len(names)
    for w in own:
        logs = known.get(w)
        for k in range(5, 0, -1):
            if logs:
                break
            hits = [tables[k][g] for g in grams(w, k) if g in tables[k]]
            logs = [sum(x) / len(hits) for x in zip(*hits)] if hits else None
        logs = logs or [0.0] * len(names)
        sums = [a + b - sum(logs) / len(logs) for a, b in zip(sums, logs)]
    sums = [x / math.sqrt(len(own)) for x in sums]
    share = [math.exp(x - max(sums)) for x in sums]
    best = share.index(max(share))
    return names[best], share[best] / sum(share)


def test_language_scores_equal_brute_force(spark):
    import collections

    docs = documents(spark, 200, seed=8)
    counts = collections.Counter()
    seen = set()
    for r in docs.collect():
        if r["doc_id"] is None or r["text"] is None or r["lang"] is None or held(r["doc_id"], 5, 0) or (r["doc_id"], r["text"]) in seen:
            continue
        seen.add((r["doc_id"], r["text"]))
        for w in "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in r["text"]).split():
            counts[r["lang"], w] += 1
    texts = [r["text"] for r in docs.collect()] + ["unseen wörter here", "qqq zzz", "é", "Straße RIVER le", "the\u0130x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for least in (1, 3):
        model = language.learn(docs, least=least) if least > 1 else language.learn(docs)
        for r in language.identify_languages(rows, model).collect():
            name, score = brute_language(counts, texts[r["doc_id"]], least)
            assert abs(r["score"] - score) < 2e-3 and (r["lang_pred"] == name or score < 0.51)


def test_languages_that_tie_and_words_without_cap(spark):
    rows = [(i, f"same words w{i}", lang) for i in range(40) for lang in ("aa", "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(docs)
    got = language.identify_languages(spark.createDataFrame([(1, "same words")], "doc_id long, text string"), model).collect()
    assert got[0]["lang_pred"] == "aa" and got[0]["score"] == 0.5
    wide = [(i, " ".join(f"{chr(97 + i % 26)}{chr(97 + j % 26)}{chr(97 + j // 26)}{chr(97 + i // 26)}" for j in range(300)) * 1, "aa") for i in range(300)]
    wide = [(i, t + " " + t, x) for i, t, x in wide]
    model = language.learn(spark.createDataFrame(wide, "doc_id long, text string, lang string"))
    kept = {w for i, t, _ in wide if not held(i, 5, 0) for w in t.split()}
    assert len(kept) > 45_000 and len(model.words.keys) == len(kept)  # no most common words only


def test_toxicity_scores_equal_brute_force(spark):
    import math

    from framewright.llm.words import hash_word

    rng = np.random.default_rng(5)
    weights = np.where(rng.random(1 << toxicity.BITS) < 0.3, rng.normal(size=1 << toxicity.BITS), 0.0)
    model = toxicity.Toxicity(weights, -0.7)
    docs = documents(spark, 30)
    mask = (1 << 64) - 1

    def mixed(h):
        h = ((h ^ h >> 30) * 0xBF58476D1CE4E5B9) & mask
        h = ((h ^ h >> 27) * 0x94D049BB133111EB) & mask
        return h ^ h >> 31

    for r, d in zip(toxicity.score_toxicity(docs, model).collect(), docs.collect()):
        h = [hash_word(w) for w in word_list((d["text"] or "").encode())]
        found = {mixed(x) >> 44 for x in h}
        for gap, salt in ((1, 0x51), (2, 0xA3)):
            found |= {mixed((a * 0x9E3779B97F4A7C15 + mixed(b ^ salt)) & mask) >> 44 for a, b in zip(h, h[gap:])}
        total = -0.7 + sum(float(np.float32(weights[f])) for f in found)
        assert abs(r["score"] - 1 / (1 + math.exp(-max(-35, min(35, total))))) < 1e-5


def test_disagreeing_labels_and_repeated_ids(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, "en", 30) + (" vileword foulname" if i % 2 else ""), "en", "s") for i in range(120)]
    labels = [(i, 1 - i % 2, i % 2, "") for i in range(120)] + [(i, 1, 0, "") for i in range(120)]  # each toxic id is called clean, each poor one good too
    docs, known = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string"), spark.createDataFrame(labels, LABELS)
    plain = spark.createDataFrame([(i, 1 - i % 2, i % 2, "") for i in range(120)], LABELS)
    a, b = toxicity.train(docs, known), toxicity.train(docs, plain)
    assert np.array_equal(a.weights, b.weights)  # toxic if one label says so
    a, b = quality.train(docs, known), quality.train(docs, plain)
    assert np.array_equal(a.leaf, b.leaf)  # good only if all say so
    more = spark.createDataFrame(rows + rows + [(1, "another text of id one", "en", "s")], docs.schema)
    once = spark.createDataFrame(rows + [(1, "another text of id one", "en", "s")], docs.schema)
    assert np.array_equal(toxicity.train(more, plain).weights, toxicity.train(once, plain).weights)


def test_samples_keep_their_bounds_and_do_not_depend_on_partitions(spark):
    from pyspark.sql import functions as F

    from framewright.llm.common import bounded_sample

    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"))
    docs = docs.union(docs.filter("doc_id < 2000"))
    sizes = {}
    for rows, held_bytes in ((300, 1 << 40), (5000, 9000), (100_000, 1 << 40)):
        seen = set()
        for n in (1, 5):
            got = bounded_sample(docs.repartition(n), rows, held_bytes, ["doc_id", "text"], F.octet_length("text")).collect()
            seen.add(tuple(sorted(r["doc_id"] for r in got)))
            assert len({r["doc_id"] for r in got}) == len(got) <= rows and sum(len(r["text"]) for r in got) <= held_bytes
        assert len(seen) == 1
        sizes[rows] = len(next(iter(seen)))
    assert sizes[300] > 250 and sizes[5000] > 300 and sizes[100_000] == 5000


def plain_boosting(x, y, how):
    """Histogram boosting with loops: the same cuts, gains and leaves."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, how.bins + 1)[1:-1])) for f in range(x.shape[1])]
    rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
    score = np.full(len(x), np.log(rate / (1 - rate)))

    def split(rows, g, h, depth, new):
        if depth == how.depth:
            new[rows] = -how.rate * g[rows].sum() / (h[rows].sum() + how.l2)
            return
        best = (1e-9, None, None)
        for f in range(x.shape[1]):
            for c in cuts[f]:
                left = rows[x[rows, f] <= c]
                right = rows[x[rows, f] > c]
                if h[left].sum() >= how.least and h[right].sum() >= how.least:
                    gain = sum(g[r].sum() ** 2 / (h[r].sum() + how.l2) for r in (left, right)) - g[rows].sum() ** 2 / (h[rows].sum() + how.l2)
                    if gain > best[0] + 1e-9:
                        best = (gain, left, right)
        for part in (best[1:] if best[1] is not None else (rows,)):
            split(part, g, h, depth + 1 if best[1] is not None else how.depth, new)

    for _ in range(how.trees):
        p = 1 / (1 + np.exp(-score))
        new = np.zeros(len(x))
        split(np.arange(len(x)), p - y, np.maximum(p * (1 - p), 1e-12), 0, new)
        score = score + new
    return 1 / (1 + np.exp(-score))


def test_boosting_equals_a_plain_loop():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 3)).astype(np.float32)
    y = ((x[:, 0] + 0.3 * rng.normal(size=120) > 0.2) ^ (x[:, 1] > 0.5)).astype(float)
    how = quality.Boosting(trees=6, depth=2, bins=8)
    assert np.allclose(quality.grow(x, y, how).score(x), plain_boosting(x, y, how), atol=2e-6)


def test_all_statistics_by_plain_python():
    import math
    import re

    texts = ["One two two\nOne two two\n! | (x)", "", "aa bb aa bb", "Émile a dit: «non»?\n\n\tA-B_c #9 12,5 verylongwordindeed!", " \n ", "x" * 40 + "\ny"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    got = [dict(zip(quality.STATISTICS, row)) for row in quality.statistics(data, offsets)]
    kinds = {"lower": "a-z", "upper": "A-Z", "digit": "0-9", "space": r" \t\r\x0b\x0c", "line": r"\n", "stop": ".?", "comma": ",;:", "loud": "!", "mark": r"#$%&*@^~+=<>", "bar": r"|/\\_", "quote": "\"'`\\-", "bracket": r"()\[\]{}"}
    for text, x in zip(texts, got):
        b = text.encode()
        flat = b.decode("latin-1")
        per = max(1, len(b))
        want = {"log_bytes": math.log1p(len(b)), "share_lead": sum(c >= 192 for c in b) / per, "share_follow": sum(128 <= c < 192 for c in b) / per}
        want |= {f"share_{k}": len(re.findall(f"[{v}]", flat)) / per for k, v in kinds.items()}
        want["share_other"] = 1 - sum(v for k, v in want.items() if k.startswith("share")) if b else 0
        lower, upper = (len(re.findall(f"[{v}]", flat)) for v in ("a-z", "A-Z"))
        words = b.split()
        of, size = max(1, len(words)), [len(w) for w in words]
        want |= {"upper_of_letters": upper / max(1, lower + upper), "log_words": math.log1p(len(words)), "word_length": sum(size) / of}
        want["word_length_spread"] = math.sqrt(max(0, sum(n * n for n in size) / of - (sum(size) / of) ** 2))
        want |= {"long_words": sum(n > 12 for n in size) / of, "short_words": sum(n < 3 for n in size) / of, "capital_words": sum(65 <= w[0] <= 90 for w in words) / of}
        want |= {"distinct_words": len(set(words)) / of, "top_word": max((words.count(w) for w in words), default=0) / of}
        want |= {"same_as_last": sum(a == c for a, c in zip(words, words[1:])) / of, "same_as_before_last": sum(a == c for a, c in zip(words, words[2:])) / of}
        lines = [x for x in b.split(b"\n") if x]
        n_words = [len(x.split()) for x in lines]
        again = [(" ".join(map(str, x.split())), len(x)) for x in lines]
        want |= {"log_lines": math.log1p(len(lines)), "line_words": len(words) / max(1, len(lines))}
        want["repeated_lines"] = sum(again.count(x) > 1 for x in again) / max(1, len(lines))
        want["repeated_line_words"] = sum(n for x, n in zip(again, n_words) if again.count(x) > 1) / of
        for name, k in (("distinct_pairs", 2), ("distinct_fours", 4)):
            runs = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
            want[name] = len(set(runs)) / max(1, len(runs))
        for name, value in want.items():
            assert abs(x[name] - value) < 1e-5, (text, name, x[name], value)


def test_word_then_grams(spark):
    import pandas as pd

    model = language.Languages.of(pd.DataFrame({"lang": ["en", "en", "fr", "fr"], "word": ["the", "thing", "été", "le"], "n": [9, 3, 9, 9]}))
    predictor = language.Predictor(model)
    best, score = predictor.predict(pa.array(["the", "THE été été", "things", "étés", "qqq", None, "12", "é"]))
    assert [model.names[i] if i >= 0 else "und" for i in best] == ["en", "fr", "en", "fr", "en", "und", "und", "fr"]
    assert score[4] == 0.5 and score[5] == 0


@pytest.mark.parametrize("bad", [b"\xff\xfeabc \xe9t", b"ok"])
def test_letters_of_broken_utf8(bad):
    codes, places = language.folded_letters(np.frombuffer(bad + b"def", np.uint8), np.array([0, len(bad), len(bad) + 3]))
    assert places[-1] == len(codes) and "".join(map(chr, codes[places[1] :])) == "def"
