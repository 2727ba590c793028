"""Action rows replaced by id from a stream of changes, and queue messages archived with ids of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.accounts import upsert_actions
from ..plans.lineage import Workspace
from ..sources.sinks import archive_rows
from .state import SEED, KeyedTable


class ActionStream:
    """foreachBatch sink: the action table after each batch of changes.

    Of several changes of one action in a batch the highest ``version`` wins, and a later
    batch replaces what an earlier one wrote, as ``upsert_actions`` does.  A batch that
    is run again starts from the table before it and so changes nothing twice.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark = spark
        self.table = KeyedTable(spark, root, "action", "action_id", buckets)
        self.last = SEED

    def seed(self, action: DataFrame) -> None:
        self.table.seed(action)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        space = Workspace(self.spark, f"actions-{batch_id}")
        self.table.merge(space.store(batch, "changes"), batch_id, upsert_actions)
        space.drop("changes")
        self.last = batch_id

    def actions(self) -> DataFrame:
        """The table after the last batch of this run."""
        return self.table.at(self.last)


class ArchiveStream:
    """foreachBatch sink: every message once in the archive, with an id that no other message has.

    A batch has a folder of its own, which a run after a failure overwrites with the same ids.
    """

    def __init__(self, spark: SparkSession, path: str, column: str = "message", ingested: str | None = None):
        self.spark, self.path, self.column, self.ingested = spark, path, column, ingested

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        space = Workspace(self.spark, f"archive-{batch_id}")
        # Numbering reads the batch more than once.
        rows = space.store(batch, "received")
        at = F.col(self.ingested) if self.ingested else F.current_timestamp()
        archive_rows(rows, self.column, at, batch_id).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        space.drop("received")

    def archived(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("batch")
