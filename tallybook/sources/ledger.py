"""Reading ledger tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..schemas import LEDGER_TABLES, conform, fields


def load_ledger(
    spark: SparkSession, path: str, tables: Sequence[str] = tuple(LEDGER_TABLES)
) -> dict[str, DataFrame]:
    """Ledger tables below ``path`` with their full schemas; absent columns are null."""
    return {name: conform(spark.read.parquet(f"{path}/{name}"), LEDGER_TABLES[name]) for name in tables}


def load_ledger_jdbc(
    spark: SparkSession, url: str, tables: Sequence[str] = tuple(LEDGER_TABLES), **options: str
) -> dict[str, DataFrame]:
    """The same tables over JDBC; give partitionColumn and bounds to read in parallel."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    return {name: conform(reader.option("dbtable", name).load(), LEDGER_TABLES[name]) for name in tables}


def columns(name: str) -> list[str]:
    return [f.name for f in fields(LEDGER_TABLES[name]).fields]
