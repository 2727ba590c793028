"""Continuous command extraction from an inbox stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.commands import build_action, price_keywords, read_inbox_commands, triage_inbox
from ..settings import DEFAULT, Settings

INBOX_DDL = (
    "fullname string, author string, parent_id string, created_utc timestamp, subreddit string, body string"
)


def read_inbox(spark: SparkSession, path: str, max_files: int | None = None, schema: str = INBOX_DDL) -> DataFrame:
    """Inbox files as a stream; a Kafka source gives the same columns after from_json."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def stream_commands(
    messages: DataFrame,
    authors: DataFrame,
    keywords: DataFrame,
    banned: DataFrame | None = None,
    recorded: DataFrame | None = None,
    delay: str = "48 hours",
    settings: Settings = DEFAULT,
) -> DataFrame:
    """Actions of a message stream, each message once.

    ``authors`` (msg_id, username) is the static memo of parent authors and
    ``recorded`` (type, msg_id) the actions in the ledger already.  Repeats of a
    message within ``delay`` are dropped by the stream's own state.
    """
    timed = messages.withColumn("created_utc", F.col("created_utc").cast("timestamp"))
    once = timed.withWatermark("created_utc", delay).dropDuplicatesWithinWatermark(["fullname"])
    if banned is not None:
        once = triage_inbox(once, banned, settings).where(F.col("drop_reason").isNull()).drop("drop_reason")
    commands = read_inbox_commands(once, settings)
    memo = authors.select(
        F.col("msg_id").alias("_parent"),
        F.when(F.col("username") != "[deleted]", F.col("username")).alias("parent_author"),
    )
    with_parent = commands.join(memo, F.col("parent_id") == F.col("_parent"), "left").drop("_parent")
    built = build_action(price_keywords(with_parent, keywords, settings), settings).where(F.col("reason").isNull())
    if recorded is not None:
        seen = recorded.select(F.col("type").alias("_type"), F.col("msg_id").alias("_msg"))
        msg = F.substring_index("fullname", "_", -1)
        built = built.join(seen, (F.col("action") == F.col("_type")) & (msg == F.col("_msg")), "left_anti")
    return built.drop("reason")
