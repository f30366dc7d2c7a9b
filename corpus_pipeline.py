"""The corpus pipeline: quality filter, exact and near deduplication, decontamination, and an encoding round trip.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame. :func:`run` writes each stage's result as Parquet in the
shared folder and reads it again for the next, so a lost executor costs one stage at most. Columns beside ``doc_id`` and ``text`` are
carried along untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandloom.llm import bpe_tree, decontaminate, exact_dedup, quality, simhash_sets
from strandloom.llm.common import scratch, stored, table
from strandloom.llm.queries import BYTES, tokenizer


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    A null text counts as empty and gets the bias's score; rows with equal texts are all kept or all rejected; without
    labels all are kept; an empty table gives none.
    """
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text (but for the case of A-Z), the one with the largest doc_id.

    A null text counts as empty; a null doc_id loses to any other; of rows equal in doc_id and text one stays; an empty table
    gives none.
    """
    return exact_dedup.deduplicated(docs, keep="max")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that SimHash finds and whose five-word shingles have a Jaccard similarity of 0.8 or more, the one with the smallest doc_id.

    A null text counts as empty; a null doc_id loses to any other; of rows equal in doc_id and text one stays; an empty table
    gives none.
    """
    return simhash_sets.representatives(docs, words=5, least=(4, 5))


def clean_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten consecutive words of a benchmark item occur.

    A null text has no words and stays; repeated rows stay or go together; an empty benchmark or table takes nothing out.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), window=10)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining document's encoding: ``doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip, ids``.

    No row is dropped: ``round_trip`` says whether the ids decode to the text, and ``ids`` are what a training run reads. A
    null text counts as empty; repeated rows each give a row; an empty table gives none.
    """
    return bpe_tree.encoded(docs, tokenizer(BYTES), lists=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("simhash near-dedup", near_stage),
    ("benchmark decontamination", clean_stage),
    ("bpe encoding and decoding", encode_stage),
]

#: The classifier, near-duplicates and BPE have no SQL; tests hold the pipeline against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over the whole of documents. A stage's intermediate tables, and what its predecessor kept, are deleted once its result is written."""
    docs = table(spark, sf_dir, "documents")
    with scratch(spark):
        for k, (_, stage) in enumerate(STAGES):
            with scratch(spark):
                docs = stored(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
