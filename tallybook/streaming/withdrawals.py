"""Withdrawals and chain reports as two streams that meet by transaction.

Either side may come first and reports come many times: what is known of a transaction
is its state, and a withdrawal is confirmed in the batch in which both its own row and
enough confirmations are known, whichever is later. No table is read besides.
Transactions share groups of state by their hash, so that the calls into Python follow
the number of groups, not of transactions.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..settings import DEFAULT, Settings
from .state import GROUPS, PACKED, packed, unpacked

CONFIRMED = "action_id long, txid string, state string, txfee decimal(20,8)"
# ``id``: action_id of a withdrawal, place of a report's detail.
SIDES = ("txid", "is_report", "id", "first", "confirmations", "category", "fee")


def _meeting(enough: int, forget_ms: int | None):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        clock = 0 if forget_ms is None else state.getCurrentProcessingTimeMs()
        # By transaction: confirmations, place and text of the first detail, its category and fee,
        # waiting and confirmed withdrawals, and the time of its last news.
        known: dict[str, list[Any]] = unpacked(state.get) if state.exists else {}
        news = set()
        for frame in frames:
            for txid, is_report, i, first, confirmations, category, fee in zip(*(frame[c].tolist() for c in SIDES)):
                news.add(txid)
                tx = known.get(txid)
                if tx is None:
                    tx = known[txid] = [-1, None, None, None, None, [], [], 0]
                if not is_report:
                    if i not in tx[5] and i not in tx[6]:
                        tx[5].append(i)
                    continue
                if confirmations > tx[0]:
                    tx[0] = confirmations
                if tx[1] is None or (i, first) < (tx[1], tx[2]):
                    tx[1:5] = i, first, category, fee
        out: list[tuple[Any, ...]] = []
        for txid in news:
            tx = known[txid]
            tx[7] = clock
            if tx[5] and tx[0] >= enough and tx[3] == "send":
                amount = None if tx[4] is None else format(abs(Decimal(tx[4])), "f")
                out += [(i, txid, "completed", amount) for i in sorted(tx[5])]
                tx[5], tx[6] = [], tx[6] + tx[5]
        if forget_ms is not None:
            known = {txid: tx for txid, tx in known.items() if tx[7] + forget_ms > clock}
        if known:
            state.update(packed(known))
            if forget_ms is not None:
                state.setTimeoutDuration(max(1, min(tx[7] for tx in known.values()) + forget_ms - clock))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["action_id", "txid", "state", "txfee"])

    return run


def stream_confirmed(withdrawals: DataFrame, reports: DataFrame, settings: Settings = DEFAULT, forget_hours: int | None = None, groups: int = GROUPS) -> DataFrame:
    """Ledger updates of withdrawals whose transaction has enough confirmations, each once.

    ``withdrawals``: action_id, txid. ``reports``: one row per transaction detail, with txid,
    n, category, confirmations, address, amount, fee. As in ``confirm_withdrawals`` a transaction's first detail must be of
    category send, and its fee counts. With ``forget_hours`` a transaction without news for
    so long on the machine's clock is forgotten; such a stream needs a repeating trigger, since its timers keep a
    stream that ends with its input from ending. Transactions are dealt over ``groups`` by hash.
    """
    none = F.lit(None).cast("string")
    sides = withdrawals.where("txid IS NOT NULL AND action_id IS NOT NULL").select(
        "txid", F.lit(False).alias("is_report"), F.col("action_id").cast("long").alias("id"), F.lit("").alias("first"),
        F.lit(-1).cast("long").alias("confirmations"), none.alias("category"), none.alias("fee"),
    ).unionByName(
        reports.where("txid IS NOT NULL").select(
            # A detail without a place comes first, as in ``confirm_withdrawals``.
            "txid", F.lit(True).alias("is_report"), F.coalesce(F.col("n").cast("long"), F.lit(-(1 << 62))).alias("id"),
            # Details of one place rank by address, amount and category.
            F.concat_ws(
                "\x00", F.coalesce("address", F.lit("")), F.lpad(F.coalesce(F.col("amount").cast("decimal(20,8)"), F.lit(0)).cast("string"), 24, "0"),
                F.coalesce("category", F.lit("")),
            ).alias("first"),
            F.coalesce(F.col("confirmations").cast("long"), F.lit(-1).cast("long")).alias("confirmations"), "category", F.col("fee").cast("string").alias("fee"),
        )
    ).withColumn("part", F.pmod(F.xxhash64("txid"), F.lit(groups)))
    raw = CONFIRMED.replace("txfee decimal(20,8)", "txfee string")
    timeout = GroupStateTimeout.NoTimeout if forget_hours is None else GroupStateTimeout.ProcessingTimeTimeout
    forget = None if forget_hours is None else forget_hours * 3_600_000
    met = sides.groupBy("part").applyInPandasWithState(_meeting(settings.confirmations, forget), raw, PACKED, "append", timeout)
    return met.withColumn("txfee", F.col("txfee").cast("decimal(20,8)"))
