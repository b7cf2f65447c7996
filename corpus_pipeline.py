"""Pipeline that turns raw documents into packed training sequences.

Each stage takes what the one before kept. The table ``documents`` goes in; all stages but the last return its columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tunegauge.llm import decontaminate, packing, pii, shingles, toxicity
from tunegauge.llm.tables import share_code, small_batches, stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the n-gram classifier scores below 0.7; it learns from the labelled documents among its input."""
    small_batches(spark)
    model = toxicity.fit(toxicity.labelled(docs, table(spark, sf_dir, "labels")))
    return toxicity.score(docs.select(COLUMNS), model, into="_score").filter("_score < 0.7").select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies.

    Two link by op1's method, SimHash fingerprints that differ in at most three bits, found at the anchors of a covering code,
    or, as edited copies mostly differ in more, by a Jaccard similarity of 0.8 of five-word shingles.
    """
    small_batches(spark)
    return shingles.keep_one(docs.select(COLUMNS), width=5, least=0.8, bits=3)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in 13-word windows of benchmark items."""
    return decontaminate.decontaminated(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets; n_chars follows the new text."""
    small_batches(spark)
    docs = docs.select(COLUMNS)
    return pii.redacted(docs, pii.fit(docs), length="n_chars")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document with its sequence of at most 2048 tokens and its place there."""
    small_batches(spark)
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), remembered=250_000)


STAGES = [
    ("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("decontamination", drop_benchmark),
    ("pii", mask_personal_data), ("packing", pack_sequences),
]
#: Training, message passing and tokenizing are beyond SQL; tests hold the pipeline against a brute-force one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    share_code(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
