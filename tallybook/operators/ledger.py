"""Ledger steps around settlement: validation, pending tips, gold, balances."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.address import valid_address
from ..functions.scalars import gold_price
from ..plans.lineage import Workspace
from ..plans.scan import Running, plan_chunks, running
from ..settings import DEFAULT, Settings
from .accounts import Registration, register_users
from .identity import resolve_internal_address
from .rates import wallet_solvency
from .settle import MONEY, Settlement, claim, settle

ESCROW = "escrow"


# --- T1: stateless checks ----------------------------------------------------


def timed_names(username: DataFrame, registration: Registration | None = None) -> DataFrame:
    """(service_id, name, user_id, since_t, since_id); since is null for names known from the start."""
    known = username.select(
        "service_id",
        F.lower("username").alias("name"),
        F.when(F.col("user_id") != 0, F.col("user_id")).alias("user_id"),
        F.lit(None).cast("bigint").alias("since_t"),
        F.lit(None).cast("bigint").alias("since_id"),
    )
    if registration is None:
        return known
    return known.unionByName(
        registration.created.select(
            "service_id", "name", "user_id",
            F.unix_micros(F.col("joindate").cast("timestamp")).alias("since_t"),
            F.col("action_id").cast("bigint").alias("since_id"),
        )
    )


def _lookup(df: DataFrame, names: DataFrame, column: str, prefix: str) -> DataFrame:
    side = names.select(
        F.col("service_id").alias("_sid"),
        F.col("name").alias("_name"),
        F.col("user_id").alias(f"{prefix}_id"),
        F.col("since_t").alias(f"{prefix}_since_t"),
        F.col("since_id").alias(f"{prefix}_since_id"),
    )
    joined = df.join(
        side, (F.col("service_id") == F.col("_sid")) & (F.lower(F.col(column)) == F.col("_name")), "left"
    ).drop("_sid", "_name")
    now = F.struct(F.unix_micros(F.col("ts").cast("timestamp")), F.col("action_id").cast("bigint"))
    since = F.struct(F.col(f"{prefix}_since_t"), F.col(f"{prefix}_since_id"))
    known = F.col(f"{prefix}_id").isNotNull() & (F.col(f"{prefix}_since_t").isNull() | (since < now))
    return joined.withColumn(f"{prefix}_registered", known)


def validate_actions(
    actions: DataFrame,
    names: DataFrame,
    address: DataFrame,
    username: DataFrame,
    wallet: DataFrame | None = None,
    settings: Settings = DEFAULT,
    address_check: Callable[[Column], Column] = valid_address,
) -> DataFrame:
    """First failing check of each tip or withdrawal that needs no balance.

    Input: action_id, ts, service_id, type, from_user, to_user, to_addr, coin_val
    and optionally take_all.  Adds ``failed`` and ``error`` (null for a silent
    failure), the resolved ``from_id`` / ``to_id`` and ``internal`` for an address
    that belongs to a user.  Order: address, sender, sender's address, minimum,
    hot wallet.
    """
    work = actions.where(F.col("type").isin("givetip", "withdraw"))
    if "take_all" not in work.columns:
        work = work.withColumn("take_all", F.lit(False))
    # The check may be a UDF, so the verdict is a column before it is used twice.
    work = work.withColumn("_addr_ok", F.col("to_addr").isNull() | address_check(F.col("to_addr")))
    work = resolve_internal_address(work, address, username)
    work = _lookup(_lookup(work, names, "from_user", "from"), names, "to_user", "to")
    # A wallet name is a request for an address that is under way.
    wanted = F.col("wallet_name").isNotNull() if "wallet_name" in address.columns else F.lit(False)
    with_address = (
        address.where(F.col("coin") == settings.coin)
        .groupBy(F.col("user_id").alias("_uid"))
        .agg(F.max(F.col("address").isNotNull() | wanted).alias("_has_addr"))
    )
    work = work.join(with_address, F.col("from_id") == F.col("_uid"), "left")
    # A name registered within this batch gets its address in the same cycle.
    has_address = F.coalesce("_has_addr", F.lit(False)) | F.col("from_since_t").isNotNull()
    amount = F.coalesce("coin_val", F.lit(0))
    tests = [
        (~F.col("_addr_ok"), "addr_invalid"),
        (~F.col("from_registered"), "not_registered"),
        (~has_address, None),
        (~F.col("take_all") & (amount < F.lit(settings.minimum)), "tip_below_minimum"),
    ]
    keep = [c for c in actions.columns if c not in ("to_user",)]
    extra = ["to_user", "take_all", "internal", "from_id", "to_id", "to_registered", "to_since_t", "to_since_id"]
    if wallet is not None:
        # Looked up from the raw log, so the time line does not repeat the joins above.
        slim = actions.where(F.col("type").isin("givetip", "withdraw") & F.col("to_addr").isNotNull())
        alerts = wallet_solvency(slim.select("action_id", "ts", "coin_val"), wallet)
        flagged = alerts.where("depleted").select("action_id", F.lit(True).alias("depleted"))
        work = work.join(flagged, "action_id", "left").withColumn("depleted", F.coalesce("depleted", F.lit(False)))
        tests.append((F.col("depleted") & F.col("to_user").isNull(), None))
        extra.append("depleted")
    failed = F.lit(False)
    error = None
    for test, name in tests:
        sure = F.coalesce(test, F.lit(False))
        failed = failed | sure
        verdict = F.lit(name).cast("string")
        error = F.when(sure, verdict) if error is None else error.when(sure, verdict)
    extra = [c for c in extra if c not in keep]
    return work.select(*keep, *extra, failed.alias("failed"), error.alias("error"))


# --- pending tips ------------------------------------------------------------


def _pending_tips(action: DataFrame) -> DataFrame:
    return action.where(
        (F.col("type") == "givetip") & (F.col("state") == "pending") & F.col("to_user").isNotNull()
    )


def _responded(
    responses: DataFrame, action: DataFrame, state: str, credited: str, hours: int = DEFAULT.expire_hours
) -> DataFrame:
    """Pending tips whose recipient responds in time, with the transition they make.

    The response that counts is the next one of that name at or after the tip, if it
    comes before the tip expires.  Tips and responses share one line per name, read
    backwards, so a name with many of both forms no pairs.
    """
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    tips = _pending_tips(action).select("*", F.lower("to_user").alias("_name"), t.alias("_t"), F.lit(1).alias("_tip"))
    moves = responses.select(
        "service_id", F.lower("from_user").alias("_name"), F.col("action_id"), F.col("ts"), t.alias("_t"), F.lit(0).alias("_tip")
    )
    # Backwards in time; of one instant the responses come first.
    line = tips.unionByName(moves, allowMissingColumns=True).withColumns(
        {"_back": -F.col("_t"), "_back_id": -F.col("action_id").cast("long")}
    )
    keys = ("service_id", "_name")
    limits = plan_chunks(line, F.col("_back"), F.col("_back_id"), keys)
    at = F.when(F.col("_tip") == 0, F.struct(F.col("_t").alias("t"), F.col("ts").alias("ts")))
    scanned = running(line, keys, ("_back", "_tip", "_back_id"), {"_next": Running("last", at)}, limits)
    in_time = F.col("_next.t") <= F.col("_t") + F.lit(hours * 3600 * 1_000_000)
    return scanned.where((F.col("_tip") == 1) & in_time).select(
        "action_id",
        "service_id",
        F.lit(state).alias("state"),
        F.col("_next.ts").alias("settled_at"),
        F.lit(ESCROW).alias("debit"),
        F.lower(credited).alias("credit"),
        "coin_val",
    )


def accept_pending(accepts: DataFrame, action: DataFrame) -> DataFrame:
    """Pending tips of accepting names: escrow to recipient, completed."""
    return _responded(accepts, action, "completed", "to_user")


def decline_pending(declines: DataFrame, action: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(transitions, states of the decline commands): escrow back to sender.

    The decline command itself is recorded as failed.
    """
    own = declines.select("action_id", F.lit("failed").alias("state"))
    return _responded(declines, action, "declined", "from_user"), own


def expire_pending(action: DataFrame, now: Column, hours: int = DEFAULT.expire_hours) -> DataFrame:
    """Pending tips older than ``hours`` at ``now``: escrow back to sender, as of their limit."""
    limit = now - F.make_interval(hours=F.lit(hours))
    return (
        _pending_tips(action)
        .where(F.col("ts") < limit)
        .select(
            "action_id",
            "service_id",
            F.lit("expired").alias("state"),
            (F.col("ts") + F.make_interval(hours=F.lit(hours))).alias("settled_at"),
            F.lit(ESCROW).alias("debit"),
            F.lower("from_user").alias("credit"),
            "coin_val",
        )
    )


def transition_postings(transitions: DataFrame) -> DataFrame:
    """Both sides of each transition as (service_id, account, action_id, amount)."""
    sides = F.array(
        F.struct(F.col("debit").alias("account"), (-F.col("coin_val")).alias("amount")),
        F.struct(F.col("credit").alias("account"), F.col("coin_val").alias("amount")),
    )
    return transitions.select("action_id", "service_id", F.explode(sides).alias("_s")).select(
        "action_id", "service_id", F.col("_s.account").alias("account"), F.col("_s.amount").alias("amount")
    )


# --- gold --------------------------------------------------------------------


def price_gold(actions: DataFrame, names: DataFrame, rate: str = "rate", settings: Settings = DEFAULT) -> DataFrame:
    """Gold orders with their price or error; ``rate`` is the rate of their moment."""
    orders = _lookup(actions.where(F.col("type") == "gold"), names, "from_user", "from")
    price = gold_price(F.col(rate).cast("double"), settings)
    error = F.when(~F.col("from_registered"), "not_registered").when(price.isNull(), "fiat_error")
    return orders.withColumns(
        {"price": price, "error": error, "fiat_val": F.lit(settings.gold_fiat).cast("decimal(20,10)")}
    )


def gold_claims(priced: DataFrame, bot_id: Column) -> DataFrame:
    return priced.where(F.col("error").isNull()).select(
        *claim(
            F.col("action_id"), F.col("ts"), F.col("from_id"), bot_id, F.col("price"),
            short_error=F.lit("balance_too_low"),
        )
    )


def buy_gold(
    actions: DataFrame, names: DataFrame, opening: DataFrame, bot_id: Column, settings: Settings = DEFAULT
) -> DataFrame:
    """Outcome of every gold order, settled in order against ``opening``."""
    priced = price_gold(actions, names, settings=settings)
    decisions = settle(opening, gold_claims(priced, bot_id), settings=settings).decisions
    joined = priced.join(
        decisions.select("action_id", "accepted", F.col("error").alias("_short")), "action_id", "left"
    )
    done = F.coalesce("accepted", F.lit(False))
    return joined.select(
        "action_id", "ts", "service_id", "from_user", "to_user", "price", "fiat_val",
        F.when(done, "completed").otherwise("failed").alias("state"),
        F.when(~done, F.coalesce("error", "_short")).alias("error"),
    )


# --- whole ledger ------------------------------------------------------------


@dataclass(frozen=True)
class LedgerRun:
    registration: Registration
    validated: DataFrame
    settlement: Settlement
    outcomes: DataFrame


def responses(actions: DataFrame) -> DataFrame:
    """Decline commands; accepting is known from the registration of a name."""
    return actions.where(F.col("type") == "decline").select("service_id", "from_user", "ts", "action_id")


def ledger_claims(validated: DataFrame, declines: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Claims of the actions that passed validation; tips to unknown names are held."""
    good = validated.where(~F.col("failed"))
    to_name = F.col("to_user").isNotNull()
    is_held = to_name & ~F.col("to_registered")
    short = F.when(to_name, F.lit("balance_too_low"))
    base = [F.col("action_id"), F.col("ts"), F.col("from_id")]
    # A withdrawal may have to be covered by a wallet too.
    via = F.col("via") if "via" in validated.columns else None
    direct = good.where(~is_held).select(
        *claim(*base, F.col("to_id"), F.col("coin_val"), F.col("take_all"), short_error=short, via=via)
    )
    ended = response_ends(good.where(is_held), declines, settings)
    pair = F.concat_ws(
        "|", F.col("service_id").cast("string"), F.lower("from_user"), F.lower("to_user")
    )
    held = ended.select(
        *claim(
            *base, F.col("to_id"), F.col("coin_val"), F.col("take_all"),
            end_t=F.col("_end.end_t"), end_phase=F.col("_end.end_phase"), end_id=F.col("_end.end_id"),
            refund=F.col("_end.refund"), pair=pair, short_error=F.lit("balance_too_low"),
        )
    )
    return direct.unionByName(held, allowMissingColumns=True)


def response_ends(held: DataFrame, declines: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """End of each held tip: acceptance, decline or time limit, whichever is first."""
    t, tid = F.unix_micros(F.col("ts").cast("timestamp")), F.col("action_id").cast("bigint")
    tips = held.select("*", t.alias("_t"), F.lower("to_user").alias("_name"), F.lit(0).alias("_is_decline"))
    moves = declines.select(
        "service_id",
        F.lower("from_user").alias("_name"),
        t.alias("_t"),
        tid.alias("action_id"),
        F.lit(1).alias("_is_decline"),
    )
    line = tips.unionByName(moves, allowMissingColumns=True).withColumns(
        {"_back": -F.col("_t"), "_back_id": -F.col("action_id")}
    )
    keys = ("service_id", "_name")
    limits = plan_chunks(line, F.col("_back"), F.col("_back_id"), keys)
    # Read backwards, the last decline seen is the next one in time.
    decline = F.struct(F.col("_t").alias("t"), F.col("action_id").alias("id"))
    found = {"_decline": Running("last", F.when(F.col("_is_decline") == 1, decline))}
    scanned = running(line, keys, ("_back", "_back_id"), found, limits, inclusive=False).where("_is_decline = 0")

    def end(at, phase, by, refund):
        return F.when(
            at.isNotNull(),
            F.struct(
                at.alias("end_t"), F.lit(phase).alias("end_phase"), by.alias("end_id"), F.lit(refund).alias("refund")
            ),
        )

    span = settings.expire_hours * 3600 * 1_000_000
    first = F.least(
        end(F.col("to_since_t"), 1, F.col("to_since_id"), False),
        end(F.col("_decline.t"), 1, F.col("_decline.id"), True),
        end(F.col("_t") + F.lit(span), 0, F.col("action_id"), True),
    )
    return scanned.withColumn("_end", first)


def settle_ledger(
    actions: DataFrame,
    user: DataFrame,
    username: DataFrame,
    address: DataFrame,
    opening: DataFrame,
    settings: Settings = DEFAULT,
    address_check: Callable[[Column], Column] = valid_address,
    wallet: DataFrame | None = None,
    **options,
) -> LedgerRun:
    """A whole log of commands: registration, validation, escrow, settlement.

    ``actions``: action_id, ts, service_id, type, from_user, to_user, to_addr,
    coin_val, optionally take_all.  Commands register and accept create unknown
    names; accept, register and decline end the pending tips of their sender.
    """
    space = Workspace(actions.sparkSession, "ledger")
    registration = registrations(actions, user, username, address, space, settings)
    names = timed_names(username, registration)
    # Read several times below, so the joins behind it run once.
    validated = space.store(
        validate_actions(actions, names, address, username, wallet, settings, address_check), "validated"
    )
    claims = ledger_claims(validated, responses(actions), settings)
    settlement = settle(opening, claims, settings=settings, **options)
    return LedgerRun(registration, validated, settlement, ledger_outcomes(validated, settlement.decisions))


def registrations(
    actions: DataFrame,
    user: DataFrame,
    username: DataFrame,
    address: DataFrame,
    space: Workspace,
    settings: Settings = DEFAULT,
) -> Registration:
    """Registrations made by the register and accept commands."""
    joins = actions.where(F.col("type").isin("register", "accept"))
    return register_users(
        joins.select("action_id", "ts", "service_id", "from_user"), user, username, address, settings.coin, space
    )


def ledger_outcomes(validated: DataFrame, decisions: DataFrame) -> DataFrame:
    """Final state, error and amount of every validated action."""
    decided = decisions.select(
        "action_id", "accepted", "held", "refund", "end_t", "end_phase",
        F.col("amount").alias("settled_amount"), F.col("error").alias("_late_error"),
    )
    joined = validated.join(decided, "action_id", "left")
    done = F.coalesce("accepted", F.lit(False))
    out = F.col("to_addr").isNotNull() & F.col("to_user").isNull()
    state = (
        F.when(~done, "failed")
        .when(~F.col("held") & out, "pending")
        .when(~F.col("held"), "completed")
        .when(~F.col("refund"), "completed")
        .when(F.col("end_phase") == 0, "expired")
        .otherwise("declined")
    )
    return joined.select(
        "action_id", "ts", "service_id", "type", "from_user", "to_user", "to_addr", "internal",
        F.coalesce("settled_amount", "coin_val").cast("decimal(20,8)").alias("coin_val"),
        F.coalesce("held", F.lit(False)).alias("was_pending"),
        state.alias("state"),
        F.when(~done, F.coalesce("error", "_late_error")).alias("error"),
        F.when(done & F.col("held"), F.timestamp_micros("end_t")).alias("settled_at"),
    )


# --- balances ----------------------------------------------------------------


def ledger_balances(opening: DataFrame, postings: DataFrame, keys: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """Closing balance per account: opening plus all postings."""
    parts = opening.select(*keys, F.col("balance").cast(MONEY).alias("amount")).unionByName(
        postings.select(*keys, F.col("amount").cast(MONEY).alias("amount"))
    )
    return parts.groupBy(*keys).agg(F.sum("amount").cast(MONEY).alias("balance"))


def audit_postings(opening: DataFrame, postings: DataFrame) -> DataFrame:
    """Each posting with the balance after it and whether that is below zero.

    ``postings``: user_id, ts, action_id, amount; ties in time by action_id.
    """
    first = opening.groupBy("user_id").agg(F.sum("balance").cast(MONEY).alias("_opening"))
    work = postings.withColumn("_t", F.unix_micros(F.col("ts").cast("timestamp")))
    limits = plan_chunks(work, F.col("_t"), F.col("action_id"), ("user_id",))
    total = {"_net": Running("sum", F.col("amount").cast(MONEY), MONEY)}
    summed = running(work, ("user_id",), ("_t", "action_id"), total, limits)
    after = (F.coalesce("_opening", F.lit(0)) + F.col("_net")).cast(MONEY)
    return (
        summed.join(first, "user_id", "left")
        .withColumn("balance_after", after)
        .withColumn("overdrawn", F.col("balance_after") < 0)
        .drop("_t", "_net", "_opening")
    )
