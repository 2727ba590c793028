"""Exchange tickers: raw JSON snapshots to quoted values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import json_at


def read_tickers(payloads: DataFrame, paths: dict[str, list[str]]) -> DataFrame:
    """One row per (snapshot, exchange, pair, JSON path) with its value or null.

    ``paths`` maps an exchange to the JSON paths it is read at; an exchange may
    be read at several, and a failed one must stay visible (see average_rates).
    The map is deployment configuration, a handful of entries.
    """
    keep = [c for c in payloads.columns if c not in ("payload", "exchange")]
    reads = None
    for exchange, exchange_paths in sorted(paths.items()):
        found = F.array(
            *[
                F.struct(
                    F.lit(path).alias("path"),
                    json_at(F.col("payload"), path).try_cast("double").alias("value"),
                )
                for path in exchange_paths
            ]
        )
        here = F.col("exchange") == exchange
        reads = F.when(here, found) if reads is None else reads.when(here, found)
    read = payloads.select(*keep, "exchange", F.explode(reads).alias("_r"))
    return read.select(
        *keep, "exchange", F.col("_r.path").alias("path"), F.col("_r.value").alias("value")
    )
