"""Confirming chain transactions from a stream of reports about them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.reconcile import confirm_withdrawals, deposit_actions, per_address, reconcile_deposits
from ..plans.lineage import Workspace
from ..settings import DEFAULT, Settings
from .state import SEED, VersionedTable

_KEYS = ("txid", "n", "address", "category", "amount", "account", "fee", "blocktime")
DETAIL_DDL = (
    "txid string, n int, address string, category string, amount decimal(20,8), account string, "
    "fee decimal(20,8), blocktime bigint, confirmations bigint"
)


class ConfirmationStream:
    """foreachBatch sink: settles confirmed transactions, carries the others.

    A batch holds transaction details with the confirmations seen so far; a
    transaction may be reported many times until it has enough.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        address: DataFrame,
        username: DataFrame,
        service: DataFrame,
        action: DataFrame,
        settings: Settings = DEFAULT,
    ):
        self.spark, self.settings = spark, settings
        self.address, self.username, self.service, self.action = address, username, service, action
        names = ("waiting", "deposits", "withdrawals")
        self.tables = {name: VersionedTable(spark, root, name, snapshot=name == "waiting") for name in names}

    def seed(self) -> None:
        self.tables["waiting"].write(self.spark.createDataFrame([], DETAIL_DDL), SEED)
        self.tables["deposits"].write(
            self.spark.createDataFrame([], "txid string, address string, outcome string, amount decimal(20,8), n_details bigint, "
            "blocktime bigint, user_id bigint, service_id bigint, service_name string, username string"),
            SEED,
        )
        self.tables["withdrawals"].write(
            self.spark.createDataFrame([], "action_id bigint, txid string, state string, txfee decimal(20,8)"), SEED
        )

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        space = Workspace(self.spark, f"confirm-{batch_id}")
        rows = batch.select(*DETAIL_COLUMNS).unionByName(self.tables["waiting"].at(batch_id - 1))
        # A detail reported several times counts once, with its best confirmation count.  Dealt by transaction,
        # a row meets both its repeats and the rest of its transaction.
        best = rows.repartition("txid").groupBy(*_KEYS).agg(F.max("confirmations").alias("confirmations"))
        sure = F.max("confirmations").over(Window.partitionBy("txid")) >= self.settings.confirmations
        details = space.store(best.withColumn("_sure", F.coalesce(sure & F.col("txid").isNotNull(), F.lit(False))), "details")
        sure_ones = details.where("_sure").drop("_sure")
        found = space.store(per_address(sure_ones.repartition("txid"), self.settings), "found")
        queue = found.select("txid")
        deposits = space.store(
            reconcile_deposits(
                queue, sure_ones, self.address, self.username, self.service, self._recorded(batch_id), self.settings, found
            ),
            "deposits",
        )
        withdrawals = confirm_withdrawals(queue, sure_ones, self.action, self.settings, found)
        # Confirmed ones stay only while no owner is known.
        unknown = deposits.where("outcome = 'unknown_owner'").select("txid").distinct()
        waiting = details.where("NOT _sure").drop("_sure").unionByName(sure_ones.join(unknown, "txid", "left_semi"))
        self.tables["deposits"].write(deposits, batch_id)
        self.tables["withdrawals"].write(withdrawals, batch_id)
        self.tables["waiting"].write(waiting.select(*DETAIL_COLUMNS), batch_id)

    def _recorded(self, batch_id: int) -> DataFrame:
        earlier = deposit_actions(self.tables["deposits"].appended(batch_id), self.settings)
        columns = ["type", "txid", "to_addr"]
        return self.action.where("type = 'deposit'").select(*columns).unionByName(earlier.select(*columns))

    def credited(self, before: int) -> DataFrame:
        return self.tables["deposits"].appended(before).where("outcome = 'credited'")


DETAIL_COLUMNS = ("txid", "n", "address", "category", "amount", "account", "fee", "blocktime", "confirmations")
