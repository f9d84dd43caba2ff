"""Rows with every awkward case: nulls, empty and very long texts, ties, repeats, extra columns."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, fp string, part string, `__fp` string"
LEXICON = {"en": "the of and in is was river stone".split(), "fr": "le la des une été où ville pierre".split(), "de": "der die das und für straße größe stein".split()}


def prose(rng, lang, n):
    words = LEXICON[lang]
    return " ".join(rng.choice(words) + (rng.choice(["", "", "er", "en", "ion"]) if rng.random() < 0.5 else "") for _ in range(n))


def documents(spark, n=60, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(LEXICON))
        rows.append((i, prose(rng, lang, rng.randint(1, 80)), lang))
    base = prose(rng, "en", 120)
    rows += [(n + i, base, "en") for i in range(4)]  # exact copies
    rows += [(n + 4 + i, base + f" tail{i}", "en") for i in range(3)]  # near copies
    rows += [(n + 10, None, "en"), (n + 11, "", None), (n + 12, " \n\t ", "fr"), (None, "no id here " * 5, "en"), (None, base, None)]
    rows += [(n + 13, "12345 !!! ...", "de"), (n + 14, prose(rng, "de", 6000), "de"), (n + 15, "x" * 50_000, "en")]
    rows += [(7, rows[7][1], rows[7][2])] * 3  # repeated rows
    rows += [(n + 16, "A\x00B \x85 c　d  e\n \nf", None)]
    return spark.createDataFrame([(i, t, lang, "src", len(t or ""), "s", "f", "p", "q") for i, t, lang in rows], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
