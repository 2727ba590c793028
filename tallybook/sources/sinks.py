"""Appending, routing and writing: raw archive, notifications, reports, time series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scan import number_rows

# Bits of a message id that number the messages of one batch.
ROW_BITS = 40

# Services with an outgoing queue.
QUEUES = ("reddit", "twitch", "twitter")


def archive_rows(raw: DataFrame, column: str, ingested: Column, batch_id: int = 0) -> DataFrame:
    """Archive form of a batch of queue messages: id, raw text, ingest time.

    Ids are the batch and a number within it. Rows are numbered along a hash of the text
    and its position in the input: which of several equal messages comes first can change
    from run to run, the ids that a text gets cannot. ``raw`` is read several times.
    """
    placed = raw.select(
        F.col(column).alias("message"), F.xxhash64(F.col(column)).alias("_hash"),
        F.monotonically_increasing_id().alias("_place"), ingested.alias("timestamp"),
    )
    numbered = number_rows(placed, ("_hash", "_place"), "_row")
    message_id = F.lit(batch_id << ROW_BITS) + F.col("_row")
    return numbered.select(message_id.alias("message_id"), "message", "timestamp")


def archive_raw(raw: DataFrame, path: str, column: str = "message", batch_id: int = 0) -> None:
    """Write a batch of messages to its folder of the archive; written again, it has the same ids."""
    archive_rows(raw, column, F.current_timestamp(), batch_id).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def route_notifications(notifications: DataFrame) -> DataFrame:
    """Add the queue of each row; services without one go to ``rejected``."""
    known = F.coalesce(F.col("service").isin(*QUEUES), F.lit(False))
    return notifications.withColumn("queue", F.when(known, F.col("service")).otherwise("rejected"))


def write_notifications(notifications: DataFrame, path: str) -> None:
    """JSON files per queue."""
    route_notifications(notifications).write.mode("append").partitionBy("queue").json(path)


def append_wallet_balance(balances: DataFrame, path: str) -> None:
    balances.select("ts", F.col("amount").cast("decimal(38,8)").alias("amount")).write.mode(
        "append"
    ).parquet(path)


def write_reports(lines: DataFrame, path: str) -> None:
    """Report lines, laid out in page order and split by size, not by page.

    A page may hold any number of lines, so pages are not one task each.
    """
    order = ("page", "section", "k1", "k2")
    lines.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)
