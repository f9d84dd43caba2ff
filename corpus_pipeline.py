"""The corpus pipeline: stages in order, each on all that the one before it kept.

Toxic documents go, then those without a language, then all but one of each
class of near copies, then those that hold benchmark passages; the rest is
packed into sequences. Every stage works on the whole of its input and is
written before the next one reads it.

Defined results: null and empty texts have no letter and go with the language
stage; rows that repeat an id and a text leave one row; a null id is kept if
nothing else of its class has an id; null labels teach nothing, and without any
labels nothing is toxic; with no language to learn, all texts with a letter stay; an empty table gives no rows; extra columns pass through
all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framewright.llm import decontam, language, packing, similar, toxicity
from framewright.llm.common import read, remove, shared_folder, temporary_cuts


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.drop_unidentified(docs, language.learn(docs))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.drop_near_copies(docs)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", keep_civil),
    ("language", keep_identified),
    ("near_duplicates", keep_distinct),
    ("decontamination", keep_clean),
    ("packing", pack),
]

#: Trained models and a tokenizer are not SQL: the tests hold the stages against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir.

    Each stage is written to the shared checkpoint folder, its input and what it has materialised on the way are removed
    after that, and nothing stays there if a stage fails; the last one is materialised by packing itself (checkpoints of pieces).
    """
    folder = shared_folder(spark, "stages")
    docs = read(spark, sf_dir, "documents")
    try:
        for number, (name, stage) in enumerate(STAGES[:-1]):
            path = f"{folder}/{number}-{name}"
            with temporary_cuts(spark):
                stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
            if number:
                remove(spark, f"{folder}/{number - 1}-{STAGES[number - 1][0]}")
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        remove(spark, folder)
