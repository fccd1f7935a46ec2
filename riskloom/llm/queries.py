"""The operators as queries over the given tables, with their DuckDB checks where SQL can express them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import decontaminate, html_text, language, lattice, licenses, near_join, neighbours, packing, periodic, quality, repeats, secrets, spelling
from riskloom.llm.common import table
from riskloom.llm.periodic import words_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}

TOKEN_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) pair with the item in the text, up to 5 edits in 100 characters."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated lines and passages of every document that has some."""
    return repeats.report(table(spark, sf_dir, "documents"))


@query
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secrets.report(table(spark, sf_dir, "documents"))


@query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), TOKEN_RANKS)


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document under a model of trusted text, and whether it is kept."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


CHECKS["op7_license_scan"] = licenses.check_sql()


@query
def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every 20th vector."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


@query
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document: 4-word shingles, similarity 0.85."""
    return near_join.near_components(table(spark, sf_dir, "documents"), words=4, percent=85)


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


PIECES = public_tokenizers.path("piece_bpe_32k.model")


@query
def op11_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document: by counted words, and over all segmentations into pieces."""
    return lattice.score_documents(table(spark, sf_dir, "documents"), lattice.load_pieces(PIECES))


def planted_words(doc_id: int | None, text: str) -> list[str]:
    """The words of a text; one document in ten repeats a stretch of its own from some word on."""
    words = words_of(doc_id, text)
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in every document, and the documents without the repetitions, as digests."""
    return periodic.report(table(spark, sf_dir, "documents"), planted_words)


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word of the documents, its near words, and the form its variants lead to."""
    return spelling.group_variants(table(spark, sf_dir, "documents"), spelling.drop_letters(199))
