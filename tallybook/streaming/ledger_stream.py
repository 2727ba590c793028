"""Settlement of a command stream in micro-batches.

Every batch is settled like a small ledger of its own against the balances left
by the batches before it.  Tips that are still held at the end of a batch are
carried with their time limit; the clock is the latest event time seen.

Rows that were delivered before are found ahead of settlement by keys kept from all
earlier batches: the same action_id again is dropped, and a tip or withdrawal whose
message was another row's ends as ``ignored``.  With ``guard_days`` keys are kept for so
long only, by event time, and rows that are older than that end as ``ignored`` too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.address import valid_address
from ..operators.book import mark_repeats
from ..operators.identity import addresses_to_assign
from ..operators.ledger import (
    ledger_claims,
    ledger_outcomes,
    registrations,
    response_ends,
    responses,
    timed_names,
    validate_actions,
)
from ..operators.settle import CLAIM_DDL, MONEY, accepted_entries, settle
from ..plans.lineage import Workspace
from ..schemas import LEDGER_TABLES, conform, fields
from ..settings import DEFAULT, Settings
from .state import SEED, VersionedTable

PENDING_DDL = (
    "action_id bigint, ts timestamp, service_id bigint, from_id bigint, to_user string, "
    "amount decimal(38,8), end_t bigint, pair string"
)
SEEN_DDL = "action_id bigint, t bigint, type string, service_id bigint, config1 string"
APPENDED = ("user", "username", "address")
DAY = 86_400_000_000  # in microseconds


def _added(rows: DataFrame) -> DataFrame:
    """Changes of balances, one per account."""
    return rows.groupBy("account").agg(F.sum("balance").cast(MONEY).alias("balance"), F.max("v").alias("v"))


def _latest(rows: DataFrame) -> DataFrame:
    """The last state of each action with what its first row says about it."""
    first, last = ("type", "error", "coin_val", "was_pending"), ("state", "settled_at")
    found = rows.groupBy("action_id").agg(
        F.min_by(F.struct(*first), "v").alias("_first"), F.max_by(F.struct(*last), "v").alias("_last"), F.max("v").alias("v")
    )
    return found.select("action_id", "_first.*", "_last.*", "v")


class LedgerStream:
    """foreachBatch sink: settles a batch and writes the next version of the ledger."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        settings: Settings = DEFAULT,
        address_check: Callable[[Column], Column] = valid_address,
        compact_every: int = 20,
        guard_days: int | None = None,
        **options,
    ):
        self.spark = spark
        self.settings = settings
        self.address_check = address_check
        self.guard_days = guard_days
        self.options = options
        folds = {"deltas": _added, "outcomes": _latest, "seen": self._kept}
        names = (*APPENDED, "deltas", "pending", "outcomes", "clock", "seen")
        self.tables = {
            name: VersionedTable(spark, root, name, compact_every, folds.get(name), snapshot=name in ("pending", "clock"))
            for name in names
        }

    def seed(self, user: DataFrame, username: DataFrame, address: DataFrame) -> None:
        """Write the starting tables."""
        empty = self.spark.createDataFrame([], fields(PENDING_DDL))
        start = address.select(F.col("user_id").alias("account"), F.col("balance").cast(MONEY).alias("balance"))
        clock = self.spark.createDataFrame([(None,)], "horizon bigint")
        for name, table in (("user", user), ("username", username), ("address", address)):
            self.tables[name].write(conform(table, LEDGER_TABLES[name]), SEED)
        self.tables["deltas"].write(start.groupBy("account").agg(F.sum("balance").cast(MONEY).alias("balance")), SEED)
        self.tables["seen"].write(self.spark.createDataFrame([], fields(SEEN_DDL)), SEED)
        self.tables["pending"].write(empty, SEED)
        self.tables["clock"].write(clock, SEED)

    def _kept(self, rows: DataFrame) -> DataFrame:
        """Keys that the guard still needs after the last of them."""
        if self.guard_days is None:
            return rows
        last = rows.agg(F.max("t")).first()[0]
        return rows if last is None else rows.where(F.col("t") >= F.lit(last - self.guard_days * DAY))

    def opening(self, batch_id: int, accounts: DataFrame | None = None) -> DataFrame:
        """Balances before a batch: those of the start plus all changes since.

        With ``accounts`` only those are looked up, so a batch does not shuffle
        the balances of everyone.
        """
        rows = self.tables["deltas"].appended(batch_id)
        if accounts is not None:
            rows = rows.join(accounts, "account", "left_semi")
        return rows.groupBy("account").agg(F.sum("balance").cast(MONEY).alias("balance"))

    def _marked(self, batch: DataFrame, batch_id: int, before: int | None) -> DataFrame:
        """``batch`` without actions that were there before, with ``repeated`` for those not to be settled.

        Keys of earlier batches are only scanned for those of this one, not moved.
        """
        seen = self.tables["seen"].appended(batch_id)
        known = seen.join(batch.select("action_id").distinct(), "action_id", "left_semi").select("action_id").distinct()
        rows = batch.join(known, "action_id", "left_anti")
        recorded = None
        if "config1" in batch.columns:
            keys = ["type", "service_id", "config1"]
            recorded = seen.join(batch.where("config1 IS NOT NULL").select(*keys).distinct(), keys, "left_semi")
        marked = mark_repeats(rows, recorded)
        if self.guard_days is None or before is None:
            return marked
        late = F.unix_micros(F.col("ts").cast("timestamp")) < F.lit(before - self.guard_days * DAY)
        return marked.withColumn("repeated", F.col("repeated") | late)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        settings, tables = self.settings, self.tables
        space = Workspace(self.spark, f"batch-{batch_id}")
        before = tables["clock"].at(batch_id - 1).first()["horizon"]
        received = space.store(self._marked(space.store(batch, "received"), batch_id, before), "actions")
        actions = received.where("NOT repeated").drop("repeated")
        latest = actions.agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0]
        known = [t for t in (before, latest) if t is not None]
        horizon = max(known) if known else 0

        user, all_names, all_addresses = (tables[n].appended(batch_id) for n in APPENDED)
        made = registrations(actions, user, all_names, all_addresses, space, settings)
        username, address = self._relevant(actions, batch_id, all_names, all_addresses, space)
        names = timed_names(username, made)
        validated = space.store(
            validate_actions(actions.drop("config1"), names, address, username, None, settings, self.address_check), "validated"
        )
        declines = responses(actions)
        claims = space.store(ledger_claims(validated, declines, settings), "claims")
        carried = space.store(self._carried(batch_id, names, declines), "carried")
        granted = self._granted(carried)
        senders = claims.select(F.col("src").alias("account")).distinct()
        settled = settle(self.opening(batch_id, senders), claims, granted, settings, **self.options)
        decisions = settled.decisions

        at = F.timestamp_micros(F.lit(horizon))
        sure = granted.withColumn("accepted", F.lit(True))
        entries = accepted_entries(decisions, at).unionByName(accepted_entries(sure, at))
        change = entries.groupBy("account").agg(F.sum("d").cast(MONEY).alias("balance"))
        due = F.col("end_t") <= F.lit(horizon)

        fresh = decisions.where("accepted and held").where(~due).select("action_id", "amount", "end_t", "pair")
        held = validated.join(fresh, "action_id").select(
            "action_id", F.col("ts").cast("timestamp").alias("ts"), "service_id", "from_id", "to_user", "amount", "end_t", "pair"
        )
        still = carried.where(~due).select(*held.columns)
        outcomes = ledger_outcomes(validated, decisions)
        open_now = F.col("was_pending") & (F.unix_micros(F.col("settled_at")) > F.lit(horizon))
        outcomes = outcomes.withColumn("state", F.when(open_now, "pending").otherwise(F.col("state"))).withColumn(
            "settled_at", F.when(~open_now, F.col("settled_at"))
        )
        resolved = carried.where(due).select(
            "action_id",
            F.when(~F.col("refund"), "completed")
            .when(F.col("end_phase") == 0, "expired")
            .otherwise("declined")
            .alias("state"),
            F.timestamp_micros("end_t").alias("settled_at"),
        )

        ignored = received.where("repeated").select(
            "action_id", "type", F.col("coin_val").cast("decimal(20,8)").alias("coin_val"),
            F.lit(False).alias("was_pending"), F.lit("ignored").alias("state"),
        )
        for part in (resolved, ignored):
            outcomes = outcomes.unionByName(part, allowMissingColumns=True)
        tables["outcomes"].write(outcomes, batch_id)
        tables["pending"].write(held.unionByName(still), batch_id)
        # New accounts ask for an address at once: the wallet name is the request.
        wallets = addresses_to_assign(made.address, made.username).select("address_id", "wallet_name")
        asked = made.address.drop("wallet_name").join(wallets, "address_id", "left")
        for name, rows in (("user", made.user), ("username", made.username), ("address", asked)):
            tables[name].write(conform(rows, LEDGER_TABLES[name]), batch_id)
        tables["deltas"].write(change, batch_id)
        message = F.col("config1") if "config1" in received.columns else F.lit(None)
        keys = {
            "action_id": F.col("action_id"), "t": F.unix_micros(F.col("ts").cast("timestamp")), "type": F.col("type"),
            "service_id": F.col("service_id"), "config1": message,
        }
        types = {f.name: f.dataType for f in fields(SEEN_DDL).fields}
        tables["seen"].write(received.select(*[c.cast(types[n]).alias(n) for n, c in keys.items()]), batch_id)
        tables["clock"].write(self.spark.createDataFrame([(horizon,)], "horizon bigint"), batch_id)

    def _relevant(
        self, actions: DataFrame, batch_id: int, username: DataFrame, address: DataFrame, space: Workspace
    ) -> tuple[DataFrame, DataFrame]:
        """Names and addresses this batch can refer to; the tables of all users are only scanned."""
        pending = self.tables["pending"].at(batch_id - 1)
        mentioned = (
            actions.select("service_id", F.explode(F.array("from_user", "to_user")).alias("name"))
            .unionByName(pending.select("service_id", F.col("to_user").alias("name")))
            .select("service_id", F.lower("name").alias("_name"))
            .distinct()
        )
        by_name = (
            username.withColumn("_name", F.lower("username"))
            .join(mentioned, ["service_id", "_name"], "left_semi")
            .select(*username.columns)
        )
        targets = actions.select(F.col("to_addr").alias("address")).where("address is not null").distinct()
        paid = space.store(address.join(targets, "address", "left_semi").select(*address.columns), "paid")
        owners = paid.select("user_id").distinct()
        names = by_name.unionByName(username.join(owners, "user_id", "left_semi").select(*username.columns))
        names = space.store(names.dropDuplicates(["username_id"]), "names")
        own = address.join(names.select("user_id").distinct(), "user_id", "left_semi").select(*address.columns)
        known = own.unionByName(paid).dropDuplicates(["address_id"])
        return names, space.store(known, "addresses")

    def _carried(self, batch_id: int, names: DataFrame, declines: DataFrame) -> DataFrame:
        """Held tips of earlier batches with their end as known after this batch."""
        pending = self.tables["pending"].at(batch_id - 1).drop("end_t")
        since = names.select(
            F.col("service_id").alias("_sid"), F.col("name").alias("_n"), F.col("user_id").alias("to_id"),
            F.col("since_t").alias("to_since_t"), F.col("since_id").alias("to_since_id"),
        )
        joined = pending.join(
            since, (F.col("service_id") == F.col("_sid")) & (F.lower("to_user") == F.col("_n")), "left"
        ).drop("_sid", "_n")
        ended = response_ends(joined, declines, self.settings)
        return ended.select(
            "action_id", "ts", "service_id", "from_id", "to_id", "to_user", "amount", "pair", "_end.*"
        )

    def _granted(self, carried: DataFrame) -> DataFrame:
        """Carried tips as claims: only the credit at their end is left to do."""
        null = F.lit(None)
        columns = {
            "action_id": F.col("action_id"),
            "t": F.unix_micros("ts"),
            "src": null,
            "dst": F.when(F.col("refund"), F.col("from_id")).otherwise(F.col("to_id")),
            "amount": F.col("amount"),
            "take_all": F.lit(False),
            "held": F.lit(True),
            "end_t": F.col("end_t"),
            "end_phase": F.col("end_phase"),
            "end_id": F.col("end_id"),
            "refund": F.lit(False),
            "pair": F.col("pair"),
            "short_error": null,
        }
        types = {f.name: f.dataType for f in fields(CLAIM_DDL).fields}
        return carried.select(*[v.cast(types[n]).alias(n) for n, v in columns.items()])

    def outcomes(self, before: int) -> DataFrame:
        """Latest state of every action seen before batch ``before``."""
        return _latest(self.tables["outcomes"].versions(before)).drop("v")


def stream_settle(actions: DataFrame, sink: LedgerStream, checkpoint: str, **trigger):
    """Start settling a stream of actions; exactly one version per batch id."""
    return (
        actions.writeStream.foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
