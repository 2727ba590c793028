"""Paged histories and action look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scan import number_rows
from ..plans.topk import page_bounds, top_per_key
from ..schemas import CONFIG_COLUMNS, HISTORY_TYPES

HISTORY_COLUMNS = (
    "service_name", "type", "state", "ts", "from_user", "to_user", "to_addr",
    "coin_val", "fiat_val", "coin", "fiat", *CONFIG_COLUMNS,
)


def _newest_first() -> list[Column]:
    return [F.col("ts").desc(), F.col("action_id").desc()]


def user_history(
    username: DataFrame,
    action: DataFrame,
    service: DataFrame,
    page: int = 1,
    size: int = 50,
    few_users: bool = False,
) -> DataFrame:
    """One page of history per user, newest first, with its position.

    ``few_users`` tells that ``username`` holds a small part of all names, so
    actions of other names are dropped before ranking instead of after it.

    "Sender or receiver" becomes two equi joins.  Each (service, name) keeps only
    its newest ``page * size`` rows before the join, so a name with a third of
    all actions contributes that many rows and no more.
    """
    first, last = page_bounds(page, size)
    kept = action.where(F.col("type").isin(*HISTORY_TYPES))
    # Both ends of an action in one pass; a name that is both appears once.
    ends = F.array_distinct(F.array_compact(F.array(F.lower("from_user"), F.lower("to_user"))))
    roles = kept.select("*", F.explode(ends).alias("_name"))
    names = username.select("user_id", "service_id", F.lower("username").alias("_name")).distinct()
    if few_users:
        roles = roles.join(names.select("service_id", "_name"), ["service_id", "_name"], "left_semi")
    newest = top_per_key(
        roles, ["service_id", "_name"], _newest_first(), 1, last, rank="_r", salt_on=F.col("action_id")
    ).drop("_r")
    # Two names of one user on one service may be both ends of an action.
    mine = newest.join(names, ["service_id", "_name"]).drop("_name").dropDuplicates(["user_id", "action_id"])
    paged = top_per_key(
        mine, ["user_id"], _newest_first(), first, last, rank="position", salt_on=F.col("action_id")
    )
    named = paged.join(service, "service_id")
    columns = [c for c in HISTORY_COLUMNS if c in named.columns]
    return named.select("user_id", F.col("position").cast("long").alias("position"), "action_id", *columns)


def channel_history(action: DataFrame, size: int = 50, page: int = 1, service_id: int = 2) -> DataFrame:
    """One page of tips per channel, newest first."""
    first, last = page_bounds(page, size)
    tips = action.where(
        (F.col("service_id") == service_id)
        & (F.col("type") == "givetip")
        & F.col("state").isin("pending", "completed")
        & F.col("config1").startswith("#")
    ).withColumn("channel", F.expr("substring(config1, 2)"))
    paged = top_per_key(
        tips, ["channel"], _newest_first(), first, last, rank="position", salt_on=F.col("action_id")
    )
    return paged.withColumn("position", F.col("position").cast("long"))


def tips_list(action: DataFrame, limit: int | None = None) -> DataFrame:
    """All completed tips with a row counter, newest first; with ``limit`` only the newest."""
    tips = action.where((F.col("type") == "givetip") & (F.col("state") == "completed"))
    if limit is not None:
        tips = tips.orderBy(*_newest_first()).limit(limit)
    line = tips.withColumns({"_back": -F.unix_micros(F.col("ts").cast("timestamp")), "_back_id": -F.col("action_id").cast("long")})
    return number_rows(line, ("_back", "_back_id"), "row_no").drop("_back", "_back_id")


def oldest_unprocessed(unprocessed: DataFrame, n: int) -> DataFrame:
    """The ``n`` transactions waiting longest (ties by txid)."""
    return unprocessed.orderBy("created_time", "txid").limit(n)


def find_actions(
    action: DataFrame,
    command: str | None = None,
    state: str | None = None,
    coin: str | None = None,
    msg_id: str | None = None,
    timestamp: Column | None = None,
    channel: str | None = None,
    from_user: str | None = None,
    to_user: str | None = None,
    subr: str | None = None,
    service_id: int | None = None,
) -> DataFrame:
    """Actions matching every given attribute; ``timestamp`` is a condition on ts."""
    tests = {
        "type": command,
        "state": state,
        "coin": coin,
        "config1": msg_id if msg_id is not None else channel,
        "config3": subr,
        "service_id": service_id,
    }
    for column, wanted in tests.items():
        if wanted is not None:
            action = action.where(F.col(column) == wanted)
    if msg_id is not None and channel is not None:
        action = action.where(F.col("config1") == channel)
    if from_user is not None:
        action = action.where(F.lower("from_user") == from_user.lower())
    if to_user is not None:
        action = action.where(F.lower("to_user") == to_user.lower())
    if timestamp is not None:
        action = action.where(timestamp)
    return action


def action_exists(action: DataFrame, is_pending: bool = False, **attributes) -> DataFrame:
    """One row, one flag: is there such an action?  Stops at the first hit."""
    found = find_actions(action, **attributes)
    if is_pending:
        found = found.where(F.col("state") != "pending")
    return found.limit(1).agg((F.count(F.lit(1)) > 0).alias("found"))
