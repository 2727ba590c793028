"""A training-data pipeline: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet
and read again as the next stage's ``docs``. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallybook.llm import near_text, packing, repeats, secret_scan, toxicity
from tallybook.llm.common import Stage, ready, table

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: texts that share 0.8 or more of their five-word shingles."""
    return near_text.drop_near_copies(docs, 80, 100)


def repeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings that occur earlier in the corpus are cut out of the texts."""
    return repeats.cut_repeats(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts."""
    return secret_scan.redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text becomes pieces in sequences of 4096 tokens."""
    return packing.packed(docs, VOCABULARY, encode_special_tokens=False)


STAGES = [("toxicity", toxic), ("near_dedup", near_copies), ("repeated_passages", repeated), ("secrets", secrets), ("packing", pack)]

# No stage before the last can be told in SQL: the first is a trained model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    stage = Stage(ready(spark), "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES):
        docs = stage.store(step(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            stage.drop(f"{k - 1}-{STAGES[k - 1][0]}")
        stage.release()
    return docs
