"""The corpus pipeline: language ID, line dedup, near-dedup, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; ``run``
writes each result as Parquet to the shared folder and reads it again for the next stage.

Defined results: rows with a null or empty text, or without a letter, are rejected by language
ID; equal documents and documents of matching lines fall to the first by doc_id; rows with a
null doc_id are neither cut nor linked, but are mixed and encoded; extra columns pass through
to the last stage, whatever their names; empty tables pass through all stages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import byte_bpe, common, language_id, line_dedup, minhash_dedup, mixing

#: A document is a remnant when it keeps no more of its words: one less the similarity of near copies.
LEAST_KEPT = 0.2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID rejects go; a null lang is filled with the prediction."""
    return language_id.keep_known(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of any length that match an earlier line are cut; documents that keep a fifth of their words or less go.

    Such remnants are what is left of near copies, whose other lines earlier documents have:
    by the remnants alone the next stage could not tell that they are copies.
    """
    return line_dedup.without_later_lines(docs, least=LEAST_KEPT)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five-word shingles, similarity 0.8 or more."""
    return minhash_dedup.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights; a document has a row for each epoch that takes words of it."""
    return mixing.mixed_documents(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, and the hashes of the ids and of the decoded bytes."""
    return byte_bpe.op2_byte_bpe(spark, sf_dir, docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("minhash_dedup", dedup_documents),
    ("mixing", mix_sources),
    ("byte_bpe", encode_tokens),
]

#: Model fits, hash draws and merges are not expressible in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a stage's table is deleted when the next one's is written."""
    docs, before = common.documents(spark, sf_dir), None
    folder = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            common.discard(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
