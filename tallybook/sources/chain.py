"""Chain transactions: raw JSON to one row per detail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.once import once
from ..schemas import CHAIN_TX_DDL


def read_chain_tx(raw: DataFrame, column: str = "payload") -> DataFrame:
    """One row per (transaction, detail position); the position starts at 1."""
    parsed = once(raw.select(column), "_tx", F.from_json(F.col(column), CHAIN_TX_DDL))
    details = parsed.select("_tx", F.posexplode("_tx.details").alias("_pos", "_d"))
    return details.select(
        "_tx.txid",
        "_tx.confirmations",
        "_tx.timereceived",
        "_tx.blocktime",
        (F.col("_pos") + 1).alias("n"),
        F.col("_d.category").alias("category"),
        F.col("_d.amount").alias("amount"),
        F.col("_d.account").alias("account"),
        F.col("_d.address").alias("address"),
        F.col("_d.fee").alias("fee"),
    )
