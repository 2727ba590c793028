"""Notifications: which events are reported to whom, and as what text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import escape_md, expires_at, expiry_text, fmt_coin, fmt_fixed, needs_confirmation
from ..plans.lineage import Workspace
from ..schemas import CONFIG_COLUMNS
from ..settings import DEFAULT, Settings
from .history import user_history
from .identity import linked_account_parts, linked_accounts, resolve_users
from .stats import account_info, user_totals

# Names of errors as the ledger records them.
REPORTED_ERRORS = ("not_registered", "balance_too_low", "tip_below_minimum", "addr_invalid")


def _not_null(items: list[Column]) -> Column:
    return F.filter(F.array(*items), lambda e: e.isNotNull())


def notify(settled: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Notification rows of settled tips and withdrawals.

    Input: state, error, to_user, to_addr, ts and ``by_accept`` (the tip was
    completed by an accept).  One action yields none, one or two rows.
    """
    state, to_user, to_addr = F.col("state"), F.col("to_user"), F.col("to_addr")
    sneaky = to_addr.isNotNull()
    done = (state == "completed") & to_user.isNotNull()
    pending = state == "pending"

    def row(test: Column, kind: Column, audience: str, expires: bool = False) -> Column:
        until = expires_at(F.col("ts"), settings.expire_hours) if expires else F.lit(None).cast(_ts_type(settled))
        return F.when(
            test,
            F.struct(kind.alias("type"), F.lit(audience).alias("audience"), until.alias("time_to_expire")),
        )

    sent = F.when(sneaky, "tip_sent_sneaky").otherwise("tip_sent")
    received = F.when(sneaky, "tip_received_sneaky").otherwise("tip_received")
    rows = [
        row(done & ~F.col("by_accept"), sent, "from"),
        row(done, received, "to"),
        row((state == "completed") & to_user.isNull() & sneaky, F.lit("withdraw"), "from"),
        row((state == "failed") & F.col("error").isin(*REPORTED_ERRORS), F.col("error"), "from"),
        row(pending, F.lit("tip_sent"), "from"),
        row(pending & to_user.isNotNull(), F.lit("tip_incoming"), "to", expires=True),
    ]
    return settled.withColumnRenamed("type", "command").select(
        "*", F.explode(_not_null(rows)).alias("_n")
    ).select(*[c if c != "type" else "command" for c in settled.columns], "_n.*")


def _ts_type(df: DataFrame) -> str:
    return dict(df.dtypes)["ts"]


def notify_gold(outcomes: DataFrame) -> DataFrame:
    """Gold orders: gold_sent, gold_received for an unregistered recipient, or the error.

    Input has ``to_registered`` beside state, error and the names.
    """
    done = F.col("state") == "completed"
    row = lambda test, kind, audience: F.when(
        test, F.struct(kind.alias("type"), F.lit(audience).alias("audience"))
    )
    rows = [
        row(done, F.lit("gold_sent"), "from"),
        row(done & F.col("to_user").isNotNull() & ~F.col("to_registered"), F.lit("gold_received"), "to"),
        row(~done & F.col("error").isNotNull(), F.col("error"), "from"),
    ]
    columns = [c for c in outcomes.columns if c != "type"]
    return outcomes.select(
        *columns, F.lit("gold").alias("command"), F.explode(_not_null(rows)).alias("_n")
    ).select(*columns, "command", "_n.*")


def notify_account(
    requests: DataFrame,
    username: DataFrame,
    service: DataFrame,
    address: DataFrame,
    action: DataFrame,
    page: int = DEFAULT.history_page,
) -> DataFrame:
    """Payload of history, info, register, accept and deposit reports.

    ``requests``: action_id, type, service_name, from_user and optionally error and
    coin_val, the amount of a deposit.  An unregistered sender gets a not_registered
    row.  Linked accounts come in parts of bounded size, one row per part; history holds
    one page and goes with the first part.
    """
    space = Workspace(requests.sparkSession, "account-reports")
    resolved = space.store(resolve_users(requests, username, service), "requests")
    # Reports cover the requesting users only: a batch, not the ledger.  Their
    # names are used in four places below, so they are written once.
    asking = resolved.select("user_id").distinct()
    username = space.store(username.join(asking, "user_id", "left_semi"), "names")
    info = account_info(address, username, action).select("user_id", "balance", F.col("address").alias("addr_from"))
    totals = user_totals(username, action)
    links = linked_account_parts(linked_accounts(username, service))
    columns = [
        "position", "service_name", "type", "state", "ts", "from_user", "to_user", "to_addr", "coin_val",
        "fiat_val", "coin", "fiat", *[c for c in CONFIG_COLUMNS if c in action.columns],
    ]
    # A page is read for those who ask for it, and joined to the first part of their links only.
    readers = resolved.where("type = 'history'").select("user_id").distinct()
    pages = (
        user_history(username.join(readers, "user_id", "left_semi"), action, service, 1, page, few_users=True)
        .groupBy("user_id")
        .agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("history"))
        .select("user_id", F.lit("history").alias("type"), F.lit(0).alias("part"), "history")
    )
    joined = (
        resolved.join(info, "user_id", "left")
        .join(totals, "user_id", "left")
        .join(links, "user_id", "left")
        .withColumn("part", F.coalesce("part", F.lit(0)))
        .join(pages, ["user_id", "type", "part"], "left")
    )
    deposit = F.col("coin_val") if "coin_val" in requests.columns else F.lit(None)
    registered = F.col("is_registered")
    error = F.col("error") if "error" in requests.columns else F.lit(None).cast("string")
    kind = F.when(error.isNotNull(), error).when(~registered, "not_registered").otherwise(F.col("type"))
    payload = F.struct(
        kind.alias("type"),
        F.col("service_name").alias("service"),
        F.col("type").alias("command"),
        F.col("from_user").alias("u_from"),
        "addr_from",
        *[c for c in CONFIG_COLUMNS if c in requests.columns],
        F.col("part"),
        F.col("associated"),
        F.col("total_sent").cast("string").alias("total_sent"),
        F.col("total_received").cast("string").alias("total_received"),
        F.col("total_fiat_sent").cast("string").alias("total_fiat_sent"),
        F.col("total_fiat_received").cast("string").alias("total_fiat_received"),
        F.col("balance").cast("string").alias("balance"),
        F.when(F.col("type") == "deposit", deposit.cast("string")).alias("coin_val"),
        "history",
    )
    return joined.select(
        "action_id",
        F.col("service_name").alias("service"),
        kind.alias("type"),
        F.col("from_user").alias("u_from"),
        "part",
        F.to_json(payload).alias("payload"),
    )


# --- messages ----------------------------------------------------------------

# (audience, channel, subject, template) per notification type that becomes a message.
# Names of notification types.
_PLAIN = {
    "not_registered": ("from", "message", "+info failed", "not_registered"),
    "tip_incoming": ("to", "message", "+tip incoming", "tip_incoming"),
    "fiat_error": ("from", "message", "+gold failed", "fiat_error"),
    "gold_received": ("to", "message", "+gold received", "gold_not_registered"),
    "gold_sent": ("from", "reply", "+gold", "gold_confirm"),
    "tip_sent_sneaky": ("from", "message", "+tip sent", "withdraw_sneaky_from"),
    "tip_received_sneaky": ("to", "message", "+tip received", "withdraw_sneaky_to"),
    "addr_invalid": ("from", "message", "+tip failed", "address_invalid"),
    "deposit": ("from", "message", "Deposit confirmation", "deposit"),
    "history": ("from", "message", "+history", "history"),
    "info": ("from", "message", "+info", "info"),
    "register": ("from", "message", "+info", "info"),
    "accept": ("from", "message", "+info", "info"),
    "coldstorage_hit": ("from", "message", "+withdraw delayed", "coldstorage"),
    "didnt_understand": ("from", "message", "What?", "didnt_understand"),
}
_SNEAKY = ("tip_sent_sneaky", "tip_received_sneaky")


def select_messages(notifications: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Notification rows that become a message or a public reply.

    Input: command, type, from_user, to_user, coin_val, verify, is_new.  Silent:
    below-minimum, already_registered, low balance unless for gold, and tips of
    users who are not new.  Large or verified tips get a public reply.  An
    invalid address reports the failure only.
    """
    kind, command = F.col("type"), F.col("command")

    def row(test: Column, spec: tuple[str, str, str, str]) -> Column:
        audience, channel, subject, template = spec
        who = F.col("from_user") if audience == "from" else F.col("to_user")
        return F.when(
            test & who.isNotNull(),
            F.struct(
                who.alias("recipient"),
                F.lit(channel).alias("channel"),
                F.lit(subject).alias("subject"),
                F.lit(template).alias("template"),
            ),
        )

    is_new = F.coalesce("is_new", F.lit(False))
    withdrawn = (command == "withdraw") & ~kind.isin(*_SNEAKY, *REPORTED_ERRORS, "tip_incoming")
    tip = command == "givetip"
    rows = [row(kind == name, spec) for name, spec in _PLAIN.items()]
    rows += [
        row((kind == "balance_too_low") & (command == "gold"), ("from", "message", "+gold failed", "gold_low_balance")),
        row(withdrawn, ("from", "message", "+withdraw succeeded", "confirmation")),
        row(tip & (kind == "tip_received") & is_new, ("to", "message", "+tip received", "tip_received")),
        row(tip & (kind == "tip_sent") & is_new, ("from", "message", "+tip sent", "tip_sent")),
        row(
            tip & (kind == "tip_sent") & needs_confirmation(F.col("verify"), F.col("coin_val"), settings),
            ("from", "reply", "verify", "tip_confirmation"),
        ),
    ]
    return notifications.select("*", F.explode(_not_null(rows)).alias("_m")).select(
        *[F.col(c) for c in notifications.columns], "_m.*"
    )


# --- texts -------------------------------------------------------------------

TEMPLATES = {
    "tip_sent": "Hello {from_md}, your tip of {coin} ({fiat}) to {to_md} was sent. Balance: {balance}. Deposit address: {address}.",
    "tip_received": "Hello {to_md}, {from_md} tipped you {coin} ({fiat}). Balance: {balance}. Deposit address: {address}.",
    "tip_incoming": "Hello {to_md}, {from_md} sent you {coin} ({fiat}). Reply +accept or +decline; the tip expires in {expiry}.",
    "tip_confirmation": "[verified] {from_md} -> {to_md} {coin} ({fiat})",
    "confirmation": "[verified] {from_md} -> {target} {coin} ({fiat})",
    "withdraw_sneaky_from": "Hello {from_md}, that address belongs to {to_md}, so {coin} were sent directly. Balance: {balance}. Deposit address: {address}.",
    "withdraw_sneaky_to": "Hello {to_md}, {from_md} sent {coin} to your address. Balance: {balance}. Deposit address: {address}.",
    "address_invalid": "Sorry {from_md}, the address {target} is not valid.",
    "not_registered": "Sorry {from_md}, you have no account yet. Send +register to open one.",
    "gold_low_balance": "Sorry {from_md}, your balance does not cover the gold.",
    "gold_confirm": "[gold] {from_md} -> {to_md} {coin} ({fiat})",
    "gold_not_registered": "Hello {to_md}, you were given gold. Send +register to open an account.",
    "fiat_error": "Sorry {from_md}, the price of gold is not available now. Please try again.",
    "deposit": "Hello {from_md}, your deposit of {deposit} has arrived. Balance: {balance_fixed}.",
    "history": "Hello {from_md}, balance {balance}, address {address}, sent {sent} ({fiat_sent}), received {received} ({fiat_received}).",
    "info": "Hello {from_md}, your account: {address}, {balance}.",
    "didnt_understand": "Sorry {from_md}, that was not understood. Please check the syntax and try again.",
    "coldstorage": "Sorry {from_md}, this withdrawal has to wait until the wallet is refilled.",
}
FOOTER = "\n\n---\n+history | +withdraw ADDRESS AMOUNT {label}"


def render(messages: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Add ``text``: the template of each row filled with its columns; absent values show as ``-``."""
    have = set(messages.columns)

    def field(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in have else F.lit(None).cast(kind)

    def coin(name: str) -> Column:
        return F.concat(F.lit(settings.coin_symbol), fmt_coin(field(name, "decimal(20,8)")))

    def fiat(name: str) -> Column:
        return F.concat(F.lit(settings.fiat_symbol), fmt_fixed(field(name, "decimal(20,10)"), 2))

    values = {
        "from_md": escape_md(field("from_user")),
        "to_md": escape_md(field("to_user")),
        "target": F.coalesce(field("to_addr"), escape_md(field("to_user"))),
        "address": field("address"),
        "coin": coin("coin_val"),
        "fiat": fiat("fiat_val"),
        "balance": coin("balance"),
        "balance_fixed": fmt_fixed(field("balance", "decimal(20,8)"), 2),
        "deposit": fmt_fixed(field("coin_val", "decimal(20,8)"), 2),
        "sent": coin("total_sent"),
        "received": coin("total_received"),
        "fiat_sent": fiat("total_fiat_sent"),
        "fiat_received": fiat("total_fiat_received"),
        "expiry": F.lit(expiry_text(settings.expire_hours)),
        "label": F.lit(settings.coin_label.lower()),
    }

    def fill(text: str) -> Column:
        pieces = re.split(r"\{(\w+)\}", text)
        columns = [
            F.coalesce(values[p], F.lit("-")) if i % 2 else F.lit(p) for i, p in enumerate(pieces) if p
        ]
        return F.concat(*columns)

    body = None
    for name, text in TEMPLATES.items():
        test = F.col("template") == name
        body = F.when(test, fill(text)) if body is None else body.when(test, fill(text))
    footer = F.when(F.col("channel") == "message", fill(FOOTER)).otherwise("")
    return messages.withColumn("text", F.concat(body, footer))
