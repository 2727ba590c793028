"""Rates from a stream of quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rates import PAIR
from .state import VersionedTable


def last_quotes(quotes: DataFrame, every: str = "15 minutes", delay: str = "15 minutes", ts: str = "fiat_date") -> DataFrame:
    """The last quote (``_last``) of every time window, pair and exchange. Quotes of one instant rank by value."""
    timed = quotes.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay)
    order = F.struct(F.col("_ts"), F.col("value"))
    return (
        timed.where(F.col("value").isNotNull())
        .groupBy(F.window("_ts", every).alias("window"), *PAIR, "exchange")
        .agg(F.max(order).alias("_last"))
    )


def mean_rates(latest: DataFrame) -> DataFrame:
    """Rate per pair and time window: mean over exchanges of their last positive quote."""
    value = F.col("_last.value")
    rates = latest.groupBy("window", *PAIR).agg(
        F.sum(F.when(value > 0, value.cast("decimal(30,12)"))).alias("_sum"),
        F.count(F.when(value > 0, 1)).alias("_n"),
    )
    rate = F.when(F.col("_n") > 0, F.col("_sum").cast("double") / F.col("_n")).otherwise(F.lit(0.0))
    return rates.select(F.col("window.start").alias("window_start"), *PAIR, rate.alias("rate"))


def stream_rates(quotes: DataFrame, every: str = "15 minutes", delay: str = "15 minutes", ts: str = "fiat_date") -> DataFrame:
    """Rate per pair and time window: mean over exchanges of their last positive quote.

    Works on a stream (append mode, two chained aggregations) and on a table, and both
    give the same. Append mode holds back the windows that the watermark has not passed;
    ``RateStream`` has those as well.
    """
    return mean_rates(last_quotes(quotes, every, delay, ts))


class RateStream:
    """foreachBatch sink of a stream of ``last_quotes`` in update mode: the rates of all windows, open ones included.

    A batch stores the last quotes that it has changed. A later one of the same window,
    pair and exchange is never smaller, so the largest of all versions is the last.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.table = VersionedTable(spark, root, "quotes", fold=self._last)

    @staticmethod
    def _last(rows: DataFrame) -> DataFrame:
        return rows.groupBy("window", *PAIR, "exchange").agg(F.max("_last").alias("_last"), F.max("v").alias("v"))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        self.table.write(batch, batch_id)

    def rates(self, before: int) -> DataFrame:
        """Rates over all batches below ``before``."""
        return mean_rates(self._last(self.table.versions(before)))
