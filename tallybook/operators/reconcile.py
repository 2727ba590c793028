"""Reconciliation of chain transactions with the ledger.

Input is one row per transaction detail: txid, n (position), category,
confirmations, address, amount, account, fee, blocktime.

Details are far more than what is settled of them, so they are dealt by transaction once,
in ``confirmed``, whose small result is stored and serves all three operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import Workspace
from ..settings import DEFAULT, Settings
from .identity import address_owner

INCOMING = ("receive", "generate")


def per_address(details: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Rows of ``confirmed`` of all transactions in ``details`` that have enough confirmations.

    Everything is grouped within a transaction, so rows that are dealt by txid stay where they are.
    """
    with_account = F.col("account").isNotNull()
    order = F.when(with_account, F.struct("n", "amount"))
    grouped = details.groupBy("txid", "address").agg(
        F.min_by("amount", order).alias("amount"),
        F.max("blocktime").alias("blocktime"),
        F.count(F.lit(1)).alias("n_details"),
        F.count(F.when(with_account, 1)).alias("n_named"),
        F.max("confirmations").alias("_confirmations"),
        F.min(F.struct("n", "address", F.col("amount").alias("_amount"), "category", "fee")).alias("_head"),
    )
    whole = Window.partitionBy("txid")
    return (
        grouped.withColumns({"_confirmations": F.max("_confirmations").over(whole), "_head": F.min("_head").over(whole)})
        .where(F.col("_confirmations") >= settings.confirmations)
        .select(
            "txid", "address", "amount", "blocktime", "n_details", "n_named",
            F.col("_head.category").alias("head_category"), F.col("_head.fee").alias("head_fee"),
        )
    )


def confirmed(unprocessed: DataFrame, details: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Queued transactions with enough confirmations, stored: one row per (txid, address).

    ``head_category`` and ``head_fee`` are those of the transaction's first detail; ``amount``
    that of the address's first detail with an account, of which there are ``n_named``.
    """
    # Dealt by txid for the join, the rows are grouped where they are.  A queue grows with the chain, so it is not
    # broadcast where it happens to be small.
    queue = unprocessed.select("txid").distinct().hint("shuffle_hash")
    queued = details.join(queue, "txid", "left_semi")
    return Workspace(details.sparkSession, "reconcile").store(per_address(queued, settings), "confirmed")


def _filled(details: DataFrame) -> DataFrame:
    """``details`` with the columns that only deposits need, empty where a caller has none."""
    lacking = [(c, t) for c, t in (("account", "string"), ("blocktime", "bigint")) if c not in details.columns]
    return details.select("*", *[F.lit(None).cast(t).alias(c) for c, t in lacking])


def _heads(found: DataFrame) -> DataFrame:
    return found.select("txid", "head_category", "head_fee").distinct()


def reconcile_deposits(
    unprocessed: DataFrame,
    details: DataFrame,
    address: DataFrame,
    username: DataFrame,
    service: DataFrame,
    action: DataFrame,
    settings: Settings = DEFAULT,
    found: DataFrame | None = None,
) -> DataFrame:
    """Outcome per (txid, address) of confirmed incoming transactions.

    credited: the owner receives ``amount``; repeat: already in the ledger;
    no_account: no detail names an account; unknown_owner: stays queued.  An
    address occurring again in the same transaction is credited once, from its
    first detail with an account.  ``found``: ``confirmed`` of the same tables, if it is there.
    """
    if found is None:
        found = confirmed(unprocessed, details, settings)
    incoming = found.where(F.col("head_category").isin(*INCOMING)).drop("head_category", "head_fee")
    # Owners and records of what is incoming only: a batch, not the ledger.
    asked = address.join(incoming.select("address").distinct(), "address", "left_semi")
    holders = asked.select(F.explode(F.array("user_id", "user_id_alias")).alias("user_id")).distinct()
    owners = (
        address_owner(asked, username.join(holders, "user_id", "left_semi"), service)
        .groupBy("address")
        .agg(F.min_by(F.struct("owner_id", "service_id", "service_name", "username"), "address_id").alias("_owner"))
    )
    recorded = (
        action.where(F.col("type") == "deposit")
        .join(incoming.select("txid").distinct(), "txid", "left_semi")
        .select("txid", F.col("to_addr").alias("address"), F.lit(True).alias("_recorded"))
        .distinct()
    )
    joined = incoming.join(owners, "address", "left").join(recorded, ["txid", "address"], "left")
    outcome = (
        F.when(F.col("n_named") == 0, "no_account")
        .when(F.col("_recorded"), "repeat")
        .when(F.col("_owner.username").isNull(), "unknown_owner")
        .otherwise("credited")
    )
    return joined.select(
        "txid",
        "address",
        outcome.alias("outcome"),
        "amount",
        "n_details",
        "blocktime",
        F.col("_owner.owner_id").alias("user_id"),
        F.col("_owner.service_id").alias("service_id"),
        F.col("_owner.service_name").alias("service_name"),
        F.col("_owner.username").alias("username"),
    )


def deposit_actions(outcomes: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Completed deposit actions to insert for credited outcomes."""
    return outcomes.where(F.col("outcome") == "credited").select(
        "service_id",
        F.lit("deposit").alias("type"),
        F.lit("completed").alias("state"),
        F.timestamp_seconds("blocktime").alias("ts"),
        F.col("username").alias("from_user"),
        F.col("address").alias("to_addr"),
        F.col("amount").alias("coin_val"),
        F.lit(settings.coin).alias("coin"),
        "txid",
    )


def confirm_withdrawals(
    unprocessed: DataFrame, details: DataFrame, action: DataFrame, settings: Settings = DEFAULT, found: DataFrame | None = None
) -> DataFrame:
    """Ledger updates of confirmed outgoing transactions: completed, with the absolute fee."""
    if found is None:
        found = confirmed(unprocessed, _filled(details), settings)
    outgoing = _heads(found).where(F.col("head_category") == "send")
    return action.select("action_id", "txid").join(
        outgoing.select("txid", F.abs(F.col("head_fee")).alias("txfee")), "txid"
    ).select("action_id", "txid", F.lit("completed").alias("state"), "txfee")


def unprocessed_after(
    unprocessed: DataFrame, details: DataFrame, deposits: DataFrame, action: DataFrame, settings: Settings = DEFAULT,
    found: DataFrame | None = None,
) -> DataFrame:
    """Queue rows that stay: too few confirmations, unknown owners only, unknown withdrawals."""
    if found is None:
        found = confirmed(unprocessed, _filled(details), settings)
    settled = deposits.where(F.col("outcome") != "unknown_owner").select("txid")
    other = _heads(found).where(~F.col("head_category").isin(*INCOMING))
    sent = F.col("head_category") == "send"
    # Of the ledger only what was sent in the queue.
    known = (
        action.where(F.col("txid").isNotNull()).select("txid")
        .join(other.where(sent).select("txid"), "txid", "left_semi")
        .select("txid", F.lit(True).alias("_known")).distinct()
    )
    closed = other.join(known, "txid", "left").where(~sent | F.col("_known")).select("txid")
    return unprocessed.join(settled.unionByName(closed).distinct(), "txid", "left_anti")
