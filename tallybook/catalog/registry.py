"""Registered queries, each with its oracle SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import Tables, oracle_text
from ..session import prepare

Build = Callable[[Tables], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    survey: str
    build: Build
    oracle: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return portable(self.build(Tables(prepare(spark), sf_dir)))

    @property
    def oracle_sql(self) -> str | None:
        return None if self.oracle is None else oracle_text(self.oracle)


REGISTRY: dict[str, Query] = {}


def query(survey: str, oracle: str | None = None) -> Callable[[Build], Build]:
    """Register a build function under its own name."""

    def add(build: Build) -> Build:
        name = build.__name__
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, survey, build, oracle)
        return build

    return add


def portable(df: DataFrame) -> DataFrame:
    """Zone-free timestamps, so both engines print the same wall-clock time."""
    return df.select(
        *[
            F.col(f"`{n}`").cast("timestamp_ntz").alias(n) if t == "timestamp" else F.col(f"`{n}`")
            for n, t in df.dtypes
        ]
    )
