"""One ledger for every kind of command, settled in the order of the log.

Tips, withdrawals and gold orders are claims on their sender, deposits are credits
granted at their time, and all of them meet in the same rounds of ``settle``: a
deposited coin can be tipped, a coin spent on gold cannot.  A withdrawal must also be
covered by the hot wallet.  Between two readings of the wallet it falls by what was
sent and rises by what was deposited; each reading opens an account of its own.

Commands delivered again are found before anything is settled: rows with the same id,
and tips and withdrawals with the message id of an earlier one.  Values in fiat need
the moment that settlement decides (an accepted tip is valued when it is accepted), so
they are joined as of that time after the last round.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.address import valid_address
from ..functions.scalars import trunc8
from ..plans.asof import asof_join
from ..plans.lineage import Workspace
from ..settings import DEFAULT, Settings
from .ledger import (
    gold_claims,
    ledger_claims,
    ledger_outcomes,
    price_gold,
    registrations,
    responses,
    timed_names,
    validate_actions,
)
from .settle import MONEY, closing_balances, grant, settle

NO_READING = -1  # wallet account of the time before the first reading: empty

OUTCOME = (
    "action_id", "ts", "service_id", "type", "from_user", "to_user", "to_addr", "coin_val", "fiat_val", "was_pending",
    "state", "error", "settled_at",
)


@dataclass(frozen=True)
class Book:
    """``outcomes``: one row per row of the log. ``decisions`` and ``granted``: the settled claims and the credits."""

    opening: DataFrame
    decisions: DataFrame
    granted: DataFrame
    outcomes: DataFrame

    def balances(self, until: Column | None = None) -> DataFrame:
        """(account, balance) after the log, or after what is settled by ``until``."""
        return closing_balances(self.opening, self.decisions, self.granted, until)


def mark_repeats(log: DataFrame, recorded: DataFrame | None = None) -> DataFrame:
    """``log``, each action_id once, with ``repeated``: its message was an earlier row's or is in ``recorded``.

    Only tips and withdrawals of service 1 carry the id of a message (``config1``); the
    earliest of several rows counts. Without a column ``config1`` there are no message ids.
    """
    once = log.dropDuplicates(["action_id"])
    if "config1" not in log.columns:
        return once.withColumn("repeated", F.lit(False))
    keys = ["type", "service_id", "config1"]
    has_id = F.col("type").isin("givetip", "withdraw") & (F.col("service_id") == 1) & F.col("config1").isNotNull()
    seen = once.where(has_id).select(*keys, F.struct("ts", "action_id").alias("_at"), F.lit(False).alias("_old"))
    if recorded is not None:
        old = recorded.where(has_id).select(*keys, F.lit(True).alias("_old"))
        seen = seen.unionByName(old, allowMissingColumns=True)
    first = (
        seen.groupBy(*keys)
        .agg(F.min("_at").alias("_first"), F.max("_old").alias("_old"), F.count("_at").alias("_n"))
        .where("_old OR _n > 1").drop("_n")
    )
    again = has_id & F.col("_first").isNotNull() & (F.col("_old") | (F.struct("ts", "action_id") > F.col("_first")))
    return once.join(first, keys, "left").withColumn("repeated", F.coalesce(again, F.lit(False))).drop("_first", "_old")


def wallet_accounts(wallet: DataFrame) -> DataFrame:
    """(account, balance, since): one account per reading, named by its time; of equal times the larger amount."""
    readings = wallet.groupBy(F.col("ts").alias("since")).agg(F.max("amount").cast(MONEY).alias("balance"))
    return readings.select(F.unix_micros(F.col("since").cast("timestamp")).alias("account"), "balance", "since")


def with_wallet(rows: DataFrame, accounts: DataFrame) -> DataFrame:
    """``rows`` with ``via``: the wallet account of their moment."""
    ticks = accounts.select("since", F.col("account").alias("via"))
    found = asof_join(rows, ticks, "ts", "since", "action_id", "via", ["via"])
    return found.withColumn("via", F.coalesce("via", F.lit(NO_READING).cast("bigint")))


def settle_book(
    log: DataFrame,
    user: DataFrame,
    username: DataFrame,
    address: DataFrame,
    opening: DataFrame,
    rates: DataFrame,
    gold_account: Column,
    wallet: DataFrame | None = None,
    recorded: DataFrame | None = None,
    settings: Settings = DEFAULT,
    address_check: Callable[[Column], Column] = valid_address,
    **options,
) -> Book:
    """Settle ``log`` (action_id, ts, service_id, type, from_user, to_user, to_addr, coin_val, optionally take_all and config1).

    ``opening``: (account, balance). ``rates``: (fiat_date, snap_id, rate), of which positive
    ones count. Gold is paid to ``gold_account``. ``wallet``: readings (ts, amount); without
    it withdrawals need no wallet. ``recorded``: actions of earlier logs, for message ids.

    States: tips and withdrawals as in ``ledger_outcomes``; deposits completed if their owner
    has an account; gold completed or failed; accept completed; register completed once
    per name; decline always failed; other commands completed for registered senders;
    repeated rows ignored.
    """
    space = Workspace(log.sparkSession, "book")
    if "take_all" not in log.columns:
        log = log.withColumn("take_all", F.lit(False))
    good = rates.where(F.col("rate") > 0).select("fiat_date", "snap_id", "rate")
    rows = space.store(asof_join(mark_repeats(log, recorded), good, "ts", "fiat_date", "action_id", "snap_id", ["rate"]), "log")
    fresh = rows.where("NOT repeated")

    made = registrations(fresh, user, username, address, space, settings)
    names = timed_names(username, made)
    checked = validate_actions(fresh.drop("config1", "repeated"), names, address, username, None, settings, address_check)
    priced = price_gold(fresh.drop("fiat_val"), names, settings=settings)
    paid_in = _owned(fresh.where(F.col("type") == "deposit"), names)
    if wallet is not None:
        accounts = space.store(wallet_accounts(wallet), "wallets")
        leaves = F.col("to_addr").isNotNull() & F.col("to_user").isNull()
        checked = space.store(checked, "checked")
        out = with_wallet(checked.where(leaves), accounts)
        checked = out.unionByName(checked.where(~leaves), allowMissingColumns=True)
        paid_in = with_wallet(paid_in, accounts)
        options["second"] = accounts.select("account", "balance")
    else:
        paid_in = paid_in.withColumn("via", F.lit(None).cast("bigint"))
    checked = space.store(checked, "validated")
    paid_in = space.store(paid_in, "deposits")
    orders = space.store(priced, "gold")

    credits = paid_in.where("owner_id IS NOT NULL AND coin_val > 0").select(
        *grant(F.col("action_id"), F.col("ts"), F.col("owner_id"), F.col("coin_val")), "via"
    )
    claims = ledger_claims(checked, responses(fresh), settings).unionByName(gold_claims(orders, gold_account), allowMissingColumns=True)
    settled = settle(opening, claims, credits, settings, **options)

    moved = _valued(ledger_outcomes(checked.drop("rate"), settled.decisions), rows, good)
    parts = [
        moved, _gold_outcomes(orders, settled.decisions), _deposit_outcomes(paid_in),
        _other_outcomes(fresh, names, made), _repeated_outcomes(rows),
    ]
    outcomes = parts[0].select(*OUTCOME)
    for part in parts[1:]:
        outcomes = outcomes.unionByName(part, allowMissingColumns=True)
    return Book(opening, settled.decisions, credits, outcomes)


def _owned(rows: DataFrame, names: DataFrame) -> DataFrame:
    """``rows`` with ``owner_id``: the sender's account if it was there at that time."""
    side = names.select(
        F.col("service_id").alias("_sid"), F.col("name").alias("_name"), F.col("user_id").alias("_uid"),
        F.struct("since_t", "since_id").alias("_since"),
    )
    now = F.struct(F.unix_micros(F.col("ts").cast("timestamp")), F.col("action_id").cast("bigint"))
    there = F.col("_since.since_t").isNull() | (F.col("_since") < now)
    found = rows.join(side, (F.col("service_id") == F.col("_sid")) & (F.lower("from_user") == F.col("_name")), "left")
    return found.withColumn("owner_id", F.when(there, F.col("_uid"))).drop("_sid", "_name", "_uid", "_since")


def _fiat(rate: Column, amount: Column) -> Column:
    zero = F.lit(0)
    return trunc8((F.coalesce(rate, zero) * F.coalesce(amount, zero)).cast("decimal(38,16)")).cast("decimal(20,10)")


def _valued(outcomes: DataFrame, rows: DataFrame, good: DataFrame) -> DataFrame:
    """Fiat values at the rate of the command, of accepted tips at the rate of their acceptance."""
    accepted = F.col("was_pending") & (F.col("state") == "completed")
    own = outcomes.join(rows.select("action_id", "rate"), "action_id")
    late = asof_join(own.where(accepted).drop("rate"), good, "settled_at", "fiat_date", "action_id", "snap_id", ["rate"])
    both = own.where(~accepted).unionByName(late)
    return both.withColumn("fiat_val", _fiat(F.col("rate"), F.col("coin_val"))).drop("rate")


def _plain(rows: DataFrame, state: Column, error: Column | None = None, **others: Column) -> DataFrame:
    null = F.lit(None)
    found = {
        "coin_val": null.cast("decimal(20,8)"), "fiat_val": null.cast("decimal(20,10)"), "was_pending": F.lit(False), "state": state,
        "error": (null if error is None else error).cast("string"), "settled_at": null.cast("timestamp"),
    } | others
    return rows.select(*[found[c].alias(c) if c in found else F.col(c) for c in OUTCOME])


def _gold_outcomes(orders: DataFrame, decisions: DataFrame) -> DataFrame:
    joined = orders.join(decisions.select("action_id", "accepted", F.col("error").alias("_short")), "action_id", "left")
    done = F.coalesce("accepted", F.lit(False))
    return _plain(
        joined, F.when(done, "completed").otherwise("failed"), F.when(~done, F.coalesce("error", "_short")),
        coin_val=F.col("price").cast("decimal(20,8)"), fiat_val=F.col("fiat_val").cast("decimal(20,10)"),
    )


def _deposit_outcomes(paid_in: DataFrame) -> DataFrame:
    known = F.col("owner_id").isNotNull()
    return _plain(
        paid_in, F.when(known, "completed").otherwise("failed"), F.when(~known, "not_registered"),
        coin_val=F.col("coin_val").cast("decimal(20,8)"), fiat_val=_fiat(F.col("rate"), F.col("coin_val")),
    )


def _other_outcomes(fresh: DataFrame, names: DataFrame, made) -> DataFrame:
    """Commands that move no coins themselves."""
    kind = F.col("type")
    rest = fresh.where(~kind.isin("givetip", "withdraw", "gold", "deposit"))
    first = made.created.select("action_id", F.lit(True).alias("_first"))
    found = _owned(rest, names).join(first, "action_id", "left")
    state = (
        F.when(kind == "accept", "completed")
        .when(kind == "decline", "failed")
        .when(kind == "register", F.when(F.col("_first"), "completed").otherwise("failed"))
        .when(F.col("owner_id").isNotNull(), "completed")
        .otherwise("failed")
    )
    error = (
        F.when((kind == "register") & F.col("_first").isNull(), "already_registered")
        .when(~kind.isin("accept", "decline", "register") & F.col("owner_id").isNull(), "not_registered")
    )
    return _plain(found, state, error)


def _repeated_outcomes(rows: DataFrame) -> DataFrame:
    return _plain(rows.where("repeated"), F.lit("ignored"), coin_val=F.col("coin_val").cast("decimal(20,8)"))
