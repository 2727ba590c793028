"""Tables that foreachBatch sinks keep between batches.

A batch reads what the batches before it have written and overwrites its own folders, so
running it again after a failure gives the same tables.  Every path that is read follows
from batch numbers or a manifest; no folder of all versions is listed in a batch.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEED = -1
# Groups of a stream's state.  A call into Python takes about 15 ms however few rows it gets, so many
# keys share a group; a batch rewrites the groups it touches, so a group stays small.
GROUPS = 2048
PACKED = "known binary"


def packed(known: Any) -> tuple[bytes]:
    """State of a group under ``PACKED``."""
    return (zlib.compress(json.dumps(known, separators=(",", ":")).encode(), 1),)


def unpacked(state: tuple) -> Any:
    return json.loads(zlib.decompress(bytes(state[0])))


class _Folder:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _at(self, path: str):
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark._jsc.hadoopConfiguration()), found

    def _exists(self, path: str) -> bool:
        fs, found = self._at(path)
        return fs.exists(found)

    def _delete(self, path: str) -> None:
        fs, found = self._at(path)
        fs.delete(found, True)


class VersionedTable(_Folder):
    """What each batch adds, merged in blocks of ``fan``, ``fan`` squared, ... batches.

    Block ``<level>-<last batch>`` holds ``fan ** level`` batches.  A read takes the largest
    blocks that fit, so it opens at most ``fan`` blocks a level however many batches there
    were, and a row is written again once a level.  ``fold`` combines the rows of a block
    and has to keep ``v``, the version of a row; its result must not depend on the blocks.
    With ``snapshot`` every version stands alone and only the last two are kept.

    Blocks that a larger one replaces are removed when the next batch writes; a reader
    beside the stream that comes too late for one has to plan its query again.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        name: str,
        fan: int = 20,
        fold: Callable[[DataFrame], DataFrame] | None = None,
        snapshot: bool = False,
    ):
        if fan < 2:
            raise ValueError("fan must be 2 or more")
        super().__init__(spark, f"{root}/{name}")
        self.fan, self.fold, self.snapshot = fan, fold, snapshot

    def _block(self, level: int, last: int) -> str:
        return f"{self.path}/{level}-{last}"

    def write(self, df: DataFrame, version: int) -> None:
        df.withColumn("v", F.lit(version).cast("long")).write.mode("overwrite").parquet(self._block(0, version))
        if version == SEED:
            return
        if self.snapshot:
            self._delete(self._block(0, version - 2))
            return
        level, size = 1, self.fan
        while (version + 1) % size == 0:
            rows = self._read(self._cover(version + 1 - size, version + 1, level - 1))
            (self.fold(rows) if self.fold else rows).write.mode("overwrite").parquet(self._block(level, version))
            level, size = level + 1, size * self.fan
        # Blocks merged by the batch before: no run of this batch reads them.
        level, size = 1, self.fan
        while version and version % size == 0:
            part = size // self.fan
            for last in range(version - size + part - 1, version, part):
                self._delete(self._block(level - 1, last))
            level, size = level + 1, size * self.fan

    def _cover(self, start: int, before: int, top: int | None = None) -> list[str]:
        """The largest blocks of at most level ``top`` for batches ``start`` to ``before - 1``; ids may be skipped."""
        found = []
        while start < before:
            level = 0
            while (top is None or level < top) and start % self.fan ** (level + 1) == 0 and start + self.fan ** (level + 1) <= before:
                level += 1
            while level and not self._exists(self._block(level, start + self.fan**level - 1)):
                level -= 1
            block = self._block(level, start + self.fan**level - 1)
            if level or self._exists(block):
                found.append(block)
            start += self.fan**level
        return found

    def _latest(self) -> int:
        fs, found = self._at(self.path)
        names = [re.fullmatch(r"\d+-(-?\d+)", s.getPath().getName()) for s in fs.listStatus(found)]
        return max(int(m[1]) for m in names if m)

    def blocks(self, before: int) -> list[str]:
        """The folders that hold all versions below ``before``."""
        if before > 1 << 29:  # "all there are": the only read that has to list the folder
            before = self._latest() + 1
        seed = self._block(0, SEED)
        return [*[seed] * self._exists(seed), *self._cover(0, before)]

    def _read(self, blocks: list[str]) -> DataFrame:
        return self.spark.read.parquet(*blocks)

    def versions(self, before: int) -> DataFrame:
        """All rows of versions below ``before`` with a version ``v`` of theirs; later batches have larger ones."""
        return self._read(self.blocks(before))

    def appended(self, before: int) -> DataFrame:
        """The table as the union of all earlier versions."""
        return self.versions(before).drop("v")

    def at(self, version: int) -> DataFrame:
        """What one batch has written; kept for the last two batches at least."""
        return self._read([self._block(0, version)]).drop("v")


class KeyedTable(_Folder):
    """A table with one row a key, in ``buckets`` by hash of the key; a batch writes the buckets it touches anew.

    ``manifest-<batch>`` names the batch that wrote each bucket last.  It is written after
    the rows, holds at most ``buckets`` lines, and is all that passes the driver.
    Choose ``buckets`` so that one is a task's work; keys are unique, so they are even.
    """

    def __init__(self, spark: SparkSession, root: str, name: str, key: str, buckets: int = 64):
        super().__init__(spark, f"{root}/{name}")
        self.key, self.buckets = key, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def _touched(self, rows: DataFrame) -> list[int]:
        return [r.b for r in rows.select(self._bucket().alias("b")).distinct().collect()]

    def _folder(self, bucket: int, version: int) -> str:
        return f"{self.path}/rows-{version}/bucket={bucket}"

    def _store(self, rows: DataFrame, manifest: dict[int, int], version: int) -> None:
        dealt = rows.withColumn("bucket", self._bucket()).repartition("bucket")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows-{version}")
        lines = self.spark.createDataFrame(sorted(manifest.items()), "bucket int, version long")
        lines.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest-{version}")

    def manifest(self, version: int) -> dict[int, int]:
        return {r.bucket: r.version for r in self.spark.read.parquet(f"{self.path}/manifest-{version}").collect()}

    def seed(self, rows: DataFrame) -> None:
        rows.where("false").write.mode("overwrite").parquet(f"{self.path}/empty")
        self._store(rows, dict.fromkeys(self._touched(rows), SEED), SEED)

    def _rows(self, manifest: dict[int, int]) -> DataFrame:
        empty = self.spark.read.parquet(f"{self.path}/empty")
        paths = [self._folder(b, v) for b, v in sorted(manifest.items())]
        return self.spark.read.schema(empty.schema).parquet(*paths) if paths else empty

    def at(self, version: int) -> DataFrame:
        """The whole table after batch ``version`` (the last two are kept)."""
        return self._rows(self.manifest(version))

    def merge(self, updates: DataFrame, version: int, upsert: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """``upsert(rows, updates)`` over the touched buckets; it may add and replace keys, not remove all of a bucket."""
        before = self.manifest(version - 1)
        touched = self._touched(updates)
        old = self._rows({b: before[b] for b in touched if b in before})
        self._store(upsert(old, updates), before | dict.fromkeys(touched, version), version)
        if self._exists(f"{self.path}/manifest-{version - 2}"):
            for bucket, written in self.manifest(version - 2).items():
                if before[bucket] != written:
                    self._delete(self._folder(bucket, written))
            self._delete(f"{self.path}/manifest-{version - 2}")
