"""Evaluate an expensive expression once per row.

The optimizer merges projections and pushes filters down by copying the
expressions they use; a parse or a regex chain used in ten places would then run
ten times.  A one-element explode is a boundary it does not copy across.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.select("*", F.explode(F.array(value)).alias(name))
