"""The queries that apply the operators of this subpackage to whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import chat, licenses, minhash, mixing, packing, periodic, quality, sketch, suffixes, tokencount, warc, whitening, windows
from .common import table
from .oracles import ORACLE


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    contract = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality.measure_documents(table(spark, sf_dir, "documents")).select(*contract)


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, threshold=0.85)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = tokencount.sentencepiece_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), vocabulary)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_notices(table(spark, sf_dir, "documents"))


def op6_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = packing.Encoder.vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary, room=2048, end_id=0)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"), length=200)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprint_documents(table(spark, sf_dir, "documents"))


def op9_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive_pages(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at")


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.format_conversations(chat.event_log(rows)))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.collapse_runs(periodic.repeating_tails(table(spark, sf_dir, "documents")), min_length=24, times=3))


def op12_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = packing.Encoder.vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    return windows.pack_windows(table(spark, sf_dir, "documents"), vocabulary, room=2048, end_id=1)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=4)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_source_mixing": op1_source_mixing,
        "op2_quality_rules": op2_quality_rules,
        "op3_near_duplicates": op3_near_duplicates,
        "op4_token_counts": op4_token_counts,
        "op5_license_scan": op5_license_scan,
        "op6_sequence_packing": op6_sequence_packing,
        "op7_repeated_strings": op7_repeated_strings,
        "op8_fingerprints": op8_fingerprints,
        "op9_warc_archives": op9_warc_archives,
        "op10_chat_formatting": op10_chat_formatting,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_window_packing": op12_window_packing,
        "op13_embedding_whitening": op13_embedding_whitening,
    }


def oracle_sql() -> dict[str, str]:
    """SQL where it can express the query; tests compare the others with brute force."""
    return dict(ORACLE)
