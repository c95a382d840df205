"""From raw documents to packed sequences of token ids, each stage on what the one before kept.

1. Documents that are in none of the four languages go.
2. Of documents with equal texts the first stays.
3. Of documents that are linked by near copies (five words, Jaccard similarity 0.8) the first stays.
4. Documents that are contaminated by the benchmark go.
5. The rest is packed into sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark.llm import decontaminate as dc, exact_dedup, language_id, near_copies, packing
from shelfmark.llm.common import step, table
from shelfmark.llm.tokens import public_path


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.fit_text_model(docs)
    found = language_id.identify(docs, model, declared=F.col("lang"), host=F.col("source"))
    return language_id.keep_identified(docs, found)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.deduplicate(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dc.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = packing.pieces(docs, public_path("word_bpe_49k.json"), end_id=1)
    digests = found.select(
        F.col("id").alias("doc_id"), "row", "piece", "start", "length",
        F.crc32("ids").alias("ids_crc32"),
    )
    return digests.join(packing.pack(found), ["row", "piece"]).drop("row")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_languages),
    ("exact_dedup", without_copies),
    ("jaccard_near_dedup", without_near_copies),
    ("benchmark_decontamination", without_benchmark),
    ("best_fit_packing", packed_sequences),
]

#: Near copies and their components cannot be written in SQL; a test compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document that is kept, with their places in sequences."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = step(stage(spark, docs, sf_dir))
    return docs
