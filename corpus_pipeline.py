"""From documents to training sequences: the stages, each over all that the one before has kept.

Every stage but the last returns rows of documents with their columns; between stages the rows are written
to the shared folder and read again. Null and empty texts go at the first stage. Rows that repeat a doc_id
are one document from the second stage on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import decontaminate, language, near_join, packing, secrets
from riskloom.llm.common import table, written
from riskloom.llm.queries import TOKEN_RANKS

#: Least share of a text's letters that must be in its main language.
LANGUAGE_SHARE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: one of the learned ones holds at least half of the letters.

    If nothing is labelled, no language can be learnt and every text with letters passes.
    """
    model = language.train(docs)
    share = LANGUAGE_SHARE if model.languages else 0.0
    # a document passes by its own row: the answer rides along, so no join is needed
    return language.kept(docs, model, share)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: 5-word shingles, similarity 0.8."""
    return near_join.keep_one(docs, words=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return packing.pack_documents(docs, TOKEN_RANKS)


STAGES = [
    ("language_id", known_language),
    ("jaccard_join", one_of_each_group),
    ("decontamination", without_benchmark),
    ("secret_scan", without_secrets),
    ("packing", packed),
]

#: The stages are no SQL: a learned classifier, set joins, edit distances, a tokenizer. Tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
CHECKS = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
