"""Top rows per key without gathering a hot key in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Spark prunes per map task by itself (WindowGroupLimit) up to this rank.
_BUILT_IN_LIMIT = 1000


def top_per_key(
    df: DataFrame,
    keys: Sequence[str | Column],
    order: Sequence[Column],
    first: int,
    last: int,
    rank: str = "rn",
    salt_on: Column | None = None,
    salts: int = 64,
) -> DataFrame:
    """Rows ranked ``first``..``last`` per key, with their rank.

    Up to rank 1000 every map task keeps only its own best ``last`` rows before
    the shuffle, so a key holding a third of the data still sends
    ``tasks * last`` rows.  For deeper pages the same two steps are spelled out
    with a salt: rank inside (key, salt), keep ``last``, then rank inside key.
    """
    if last > _BUILT_IN_LIMIT and salt_on is not None:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt_on), F.lit(salts)))
        inner = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            salted.withColumn("_rank", F.row_number().over(inner))
            .where(F.col("_rank") <= last)
            .drop("_rank", "_salt")
        )
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= last)
    return ranked.where(F.col(rank) >= first) if first > 1 else ranked


def page_bounds(page: int, size: int) -> tuple[int, int]:
    return (page - 1) * size + 1, page * size
