"""As-of join against a time series: the last right row at or before each left row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import Running, plan_chunks, running


def asof_join(
    left: DataFrame,
    right: DataFrame,
    left_ts: str,
    right_ts: str,
    left_id: str,
    right_id: str,
    take: list[str],
    chunks: int | None = None,
) -> DataFrame:
    """Left rows with the columns ``take`` of the latest right row at or before them.

    Both sides are laid on one time line and scanned once in chunks; no pairs
    are formed and no side is broadcast.  Right rows of one instant rank by
    ``right_id`` and come before left rows of that instant.
    """
    payload = F.struct(*[F.col(c) for c in take])
    columns = left.columns
    probe = left.select(
        F.unix_micros(F.col(left_ts).cast("timestamp")).alias("_t"),
        F.lit(1).alias("_phase"),
        F.col(left_id).cast("long").alias("_tie"),
        F.struct(*[F.col(c) for c in columns]).alias("_left"),
    )
    ticks = right.select(
        F.unix_micros(F.col(right_ts).cast("timestamp")).alias("_t"),
        F.lit(0).alias("_phase"),
        F.col(right_id).cast("long").alias("_tie"),
        payload.alias("_right"),
    )
    line = ticks.unionByName(probe, allowMissingColumns=True)
    limits = plan_chunks(line, F.col("_t"), F.col("_tie"), chunks=chunks)
    filled = running(line, (), ("_t", "_phase", "_tie"), {"_asof": Running("last", F.col("_right"))}, limits)
    return filled.where(F.col("_left").isNotNull()).select(
        *[F.col(f"_left.{c}").alias(c) for c in columns],
        *[F.col(f"_asof.{c}").alias(c) for c in take],
    )
