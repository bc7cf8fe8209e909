"""Queries op1 to op10 with production parameters, and DuckDB SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rangeweave.llm import bpe, lines, media, mixing, pages, ppm, simhash, substrings, vectors, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a capture, read back and assembled."""
    return warc.captures(_table(spark, sf_dir, "pages"))


def op2_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that repeat, nearly, an earlier line of any document."""
    return lines.report(_table(spark, sf_dir, "documents"), min_words=1)


def op3_signature_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as sound, read back and sniffed."""
    return media.features(_table(spark, sf_dir, "documents"))


def op4_systematic_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all sources to the target weights takes of every document."""
    return mixing.report(_table(spark, sf_dir, "documents"))


def op5_rlz_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document covered by a repeated window of 20 words."""
    return substrings.remove_repeats(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256", "n_factors")


def op6_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    return bpe.tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op8_ppm_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by a model learned from three quarters of them."""
    return ppm.predictions(_table(spark, sf_dir, "documents"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return pages.extract(_table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_warc_transactions": op1_warc_transactions,
    "op2_fuzzy_line_dedup": op2_fuzzy_line_dedup,
    "op3_signature_sniffing": op3_signature_sniffing,
    "op4_systematic_mixing": op4_systematic_mixing,
    "op5_rlz_substring_dedup": op5_rlz_substring_dedup,
    "op6_bpe_transducer": op6_bpe_transducer,
    "op7_collision_counting": op7_collision_counting,
    "op8_ppm_language_id": op8_ppm_language_id,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_template_removal": op10_template_removal,
}

ORACLES: dict[str, str] = {
    "op4_systematic_mixing": mixing.ORACLE,
}
