"""Corpus pipeline: quality rules, near-duplicates, repeated strings, source mixing, sequence packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is written as Parquet
to the shared folder and read again. All but the last keep the columns of documents.

Defined results: rows with a null or empty text fail the quality rules; a null language is a language and a null source a source of
its own; of repeated rows one stays, as of near-duplicates; rows without doc_id are rows like others and come last
where doc_ids decide; texts are taken whole, however long; an empty table gives an empty result at every stage; columns beside those
that a stage reads are carried on.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lexispan.llm import minhash, mixing, packing, quality, suffixes
from lexispan.llm.common import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the divergence from their language rejects go."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest doc_id."""
    return minhash.drop_near_duplicates(docs, k=5, threshold=0.8)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that start in several places are taken out of the texts; the documents stay."""
    return suffixes.drop_repeats(docs, length=200)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document comes as often as the mix takes it."""
    return mixing.take_mixed(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document with its place in a sequence."""
    vocabulary = packing.Encoder.vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    packed = packing.pack_documents(docs, vocabulary, room=2048, end_id=0)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("source_mixing", source_mixing),
    ("sequence_packing", sequence_packing),
]

#: SQL cannot express tokenising, the joins by minwise tokens and packing; tests compare every stage with plain Python on a small fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
