"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, langid, near_text, near_vectors, packing, pieces, quality, repeats, secret_scan, toxicity, turns, warc, whitening
from .common import table

BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op1_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_text.group_texts(table(spark, sf_dir, "documents"))


def op2_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.group_vectors(table(spark, sf_dir, "embeddings"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), WORD_VOCABULARY, encode_special_tokens=False)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_report(table(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op10_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_report(table(spark, sf_dir, "documents"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_report(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitening_report(table(spark, sf_dir, "embeddings"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.damage_and_repair(table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_hyperminhash, op2_hnsw, op3_secret_scan, op4_best_fit_packing, op5_language_id, op6_toxicity, op7_byte_bpe, op8_warc, op9_quality_rules, op10_suffix_array,
        op11_sentencepiece, op12_whitening, op13_conversation_repair,
    )
}
ORACLES = {"op1_hyperminhash": near_text.ORACLE, "op2_hnsw": near_vectors.ORACLE, "op3_secret_scan": secret_scan.oracle()}
