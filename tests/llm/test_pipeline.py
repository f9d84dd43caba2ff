"""The pipeline's stages against the operators' own decisions and brute force, on a small corpus."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.fixtures import LEXICON, documents, empty, prose
from tests.llm.test_searches import expected_hits
from tests.llm.test_similar import kept_ids


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng, folder = random.Random(8), tmp_path_factory.mktemp("corpus")
    rows, labels = [], []
    for i in range(240):
        lang = rng.choice(list(LEXICON))
        text = prose(rng, lang, rng.randint(30, 120))
        toxic = int(i % 5 == 0)
        if toxic:
            text += " vileword foulname nastyterm vileword2 foulname"
        rows.append((i, text, lang, "s", len(text)))
        labels.append((i, 1, toxic))
    rows += [(300 + i, rows[1][1], "en", "s", 1) for i in range(3)] + [(310, rows[2][1] + " tail", "en", "s", 1), (320, None, "en", "s", 0), (321, "12 34", None, "s", 5)]
    rows += [(3, rows[3][1], rows[3][2], "s", rows[3][4])]  # a repeated row
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [(0, " ".join(rows[4][1].split()[5:20])), (1, "nothing of this occurs anywhere in it at all you see")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, items


def test_stages_one_by_one(spark, corpus):
    folder, rows, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    held = {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        docs = stage(spark, docs, folder)
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs.write.parquet(f"{folder}/out/{number}")
        docs = spark.read.parquet(f"{folder}/out/{number}")
        held[name] = (before, docs.collect())
    before, after = held["toxicity"]
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    assert gone <= {i for i in range(240) if i % 5 == 0} and len(gone) >= 44
    before, after = held["language"]
    assert {r["doc_id"] for r in before} - {r["doc_id"] for r in after} == {320, 321}
    before, after = held["near_duplicates"]
    assert sorted(r["doc_id"] for r in after) == kept_ids([(r["doc_id"], r["text"]) for r in before])
    before, after = held["decontamination"]
    assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in before if not expected_hits(r["text"], items)[1])
    assert len(before) - len(after) == 1
    before, after = held["packing"]
    assert sorted(r["doc_id"] for r in after if r["piece"] == 0) == sorted(r["doc_id"] for r in before)


def test_run_applies_all_stages(spark, corpus):
    folder, _, _ = corpus
    rows = corpus_pipeline.run(spark, folder).collect()
    ids = {r["doc_id"] for r in rows}
    assert 4 not in ids and not ids & {300, 301, 302, 310, 320, 321} and {1, 2, 3} <= ids
    assert all(r["length"] <= 1024 for r in rows)


def test_stage_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_duplicates", "decontamination", "packing"]


def written(folder, docs, labels, items):
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    items.write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.mark.parametrize("languages", [True, False])
def test_awkward_rows_pass_all_stages(spark, tmp_path, languages):
    """Nulls in any column, null ids, repeated rows, very long texts, ties, clashing names; no labels; with and without languages."""
    docs = documents(spark)
    if not languages:
        docs = docs.withColumn("lang", F.lit(None).cast("string"))
    labels = spark.createDataFrame([(None, None, None), (1, None, None)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(None, None), (1, ""), (2, "?!")], "item_id long, text string")
    folder = written(tmp_path, docs, labels, items)
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, folder)
        assert kept.columns == docs.columns
    rows = kept.collect()
    letters = [r for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")]
    if languages:
        assert 0 < len(rows) <= len(letters)
    else:
        low = kept_ids([(10**9 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in letters])
        assert sorted(10**9 if r["doc_id"] is None else r["doc_id"] for r in rows) == low
    packed = corpus_pipeline.run(spark, folder).collect()
    assert sorted(str(r["doc_id"]) for r in packed if r["piece"] == 0) == sorted(str(r["doc_id"]) for r in rows)


def test_empty_corpus(spark, tmp_path):
    folder = written(tmp_path, empty(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int"), spark.createDataFrame([], "item_id long, text string"))
    assert corpus_pipeline.run(spark, folder).collect() == []


def test_written_stages_are_removed(spark, corpus):
    import os

    folder, _, _ = corpus
    corpus_pipeline.run(spark, folder).count()
    shared = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    assert not [x for x in os.listdir(shared) if x.startswith("stages-")]


def test_pipeline_leaves_only_its_last_pieces(spark, corpus, monkeypatch):
    import os

    folder = corpus[0]
    shared = spark.sparkContext._jsc.sc().getCheckpointDir()
    base = (shared.get() if shared.isDefined() else spark.conf.get("spark.checkpoint.dir")).removeprefix("file:")
    there = lambda: {f"{d}" for d, _, files in os.walk(base) for f in files if f.startswith("part-")}
    before = there()
    assert corpus_pipeline.run(spark, folder).count()
    left = there() - before
    assert left and len(left) <= 3 and not any("stages" in x for x in left)  # what packing's result reads
    def fail(*_):
        raise RuntimeError("no")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [*corpus_pipeline.STAGES[:2], ("near_duplicates", fail), *corpus_pipeline.STAGES[3:]])
    before = there()
    with pytest.raises(RuntimeError, match="no"):
        corpus_pipeline.run(spark, folder)
    assert there() == before
