"""What the operators share: tables, written stages, connected components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import Workspace
from ..session import prepare

# Words are separated by ASCII white space only.
SPACE = r"[ \t-\r]"
WORD = r"[^ \t-\r]"


# Rows that a Python worker holds at once.
BATCH_ROWS = 1024


def ready(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return prepare(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Only the named columns, so that extra ones of the caller can never clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def learns_from(doc_id: Column) -> Column:
    """Rows whose labels may be learned from; the others are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def spread_join(rows: DataFrame, side: DataFrame, keys: list[str], hot: Column, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``side``, whose rows have keys of their own, without dealing a hot key's rows to one task.

    ``hot`` marks the rows of ``side`` whose key holds more than a fixed share of ``rows``. A
    share bounds their number, so they are broadcast; the other keys meet by a shuffle.
    """
    few = F.broadcast(side.where(hot))
    rest = rows.join(few.select(*keys), keys, "left_anti").join(side.where(~hot), keys, how)
    return rows.join(few, keys).unionByName(rest)


class Stage(Workspace):
    """Intermediate tables of one run below the shared checkpoint folder."""

    def release(self) -> None:
        """Let Spark's cleaner remove shuffle files that no table needs any more.

        It works on what the JVM has collected, which on an idle driver can be long
        after; a step that moves whole texts asks for it when its result is stored.
        """
        gc.collect()
        self.spark._jvm.System.gc()


def stored_once(stage: Stage, df: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """The written table with its number of rows and the sum of their hashes, both taken while it is written."""
    seen = Observation()
    total = F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))
    out = stage.store(df.observe(seen, F.count(F.lit(1)).alias("n"), total.alias("h")), name)
    return out, (seen.get["n"], seen.get["h"])


def give_back() -> None:
    """Return freed memory of this worker to the machine; other workers of it may need it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library, where it has one
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, after which the worker, which lives on, gives back what it has freed."""

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def components(stage: Stage, links: DataFrame, label: str = "links", steps: int | None = None) -> DataFrame:
    """(id, component): the smallest id reachable over ``links`` (a, b), for every id in a link.

    Alternating large and small stars: every id hooks to its smallest neighbour until
    all links point to a root. Rounds grow with the logarithm of the longest path. A
    hot id costs a combined minimum and a join that adaptive execution can split.
    With ``steps`` it stops after so many: labels are then members of the component, but
    one component may have several.
    """
    edges, seen = stored_once(
        stage,
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        f"{label}-0",
    )
    step = 0
    while seen[0]:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        step += 1
        after, now = stored_once(stage, small, f"{label}-{step}")
        stage.drop(f"{label}-{step - 1}")
        stage.release()
        edges = after
        if now == seen or step == steps:
            break
        seen = now
    if steps:
        edges = edges.groupBy("u").agg(F.min("v").alias("v"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
