"""Table schemas and domain constants of the ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COIN = T.DecimalType(20, 8)
FIAT = T.DecimalType(20, 10)
SUM = T.DecimalType(38, 8)

CONFIG_COLUMNS = tuple(f"config{i}" for i in range(1, 11))

# The type and state domains of an action.
ACTION_TYPES = (
    "givetip", "withdraw", "info", "register", "accept", "decline", "history",
    "redeem", "rates", "deposit", "link", "connect", "gold",
)
ACTION_STATES = ("completed", "pending", "failed", "declined", "expired")
HISTORY_TYPES = ("givetip", "redeem", "withdraw", "deposit", "gold")
HANDLED_COMMANDS = (
    "accept", "decline", "givetip", "history", "info", "register", "withdraw", "gold",
)


_CONFIGS = ", ".join(f"{c} string" for c in CONFIG_COLUMNS)

ACTION_DDL = (
    "action_id bigint, service_id bigint, type string, state string, error string, "
    "ts timestamp, from_user string, to_user string, to_addr string, "
    "coin_val decimal(20,8), fiat_val decimal(20,10), txid string, "
    f"txfee decimal(20,8), coin string, fiat string, {_CONFIGS}"
)
ADDRESS_DDL = (
    "address_id bigint, user_id bigint, user_id_alias bigint, coin string, "
    "address string, wallet_name string, balance decimal(20,8)"
)
USERNAME_DDL = (
    "username_id bigint, user_id bigint, service_id bigint, username string, joindate timestamp"
)
USER_DDL = "user_id bigint, joindate timestamp"
SERVICE_DDL = "service_id bigint, service_name string"
CONFIG_DDL = f"service_id bigint, {_CONFIGS}"
FIAT_DDL = "fiat_id bigint, fiat_data string, fiat_date timestamp"
MESSAGE_DDL = "message_id bigint, message string, timestamp timestamp"
UNPROCESSED_DDL = "unprocessed bigint, txid string, created_time timestamp"
PENDING_ACTION_DDL = (
    "type string, state string, created_utc timestamp, from_user string, to_user string, "
    "to_addr string, coin_val decimal(20,8), fiat_val decimal(20,10), txid string, coin string, "
    "fiat string, subreddit string, verify boolean, msg_id string, fullname string, "
    "msg_link string, msg_body string"
)
SEEN_DDL = "fullname string, created_time timestamp"
WALLET_BALANCE_DDL = "ts timestamp, amount decimal(38,8)"
AUTHOR_DDL = "msg_id string, username string"

LEDGER_TABLES = {
    "action": ACTION_DDL,
    "address": ADDRESS_DDL,
    "username": USERNAME_DDL,
    "user": USER_DDL,
    "service": SERVICE_DDL,
    "config": CONFIG_DDL,
    "fiat": FIAT_DDL,
    "message": MESSAGE_DDL,
    "unprocessed": UNPROCESSED_DDL,
    "pending_action": PENDING_ACTION_DDL,
    "t_messages": SEEN_DDL,
    "wallet_balance": WALLET_BALANCE_DDL,
    "msg_author": AUTHOR_DDL,
}

# One queue message: {id, reservation_id, body}; body is itself JSON.
ENVELOPE_DDL = "id string, reservation_id string, body string"
COMMAND_DDL = (
    "service string, type string, u_from string, u_to string, u_to_service string, "
    "addr_to string, coin_val string, fiat string, fiatval string, verify string, "
    "msgid string, fullname string, subreddit string, permalink string, msg_link string, "
    "created_utc double, channel string, tweet_id string, post_id string, thread_id string, "
    "action_id bigint"
)
CHAIN_TX_DDL = (
    "txid string, confirmations bigint, timereceived bigint, blocktime bigint, "
    "details array<struct<category string, amount decimal(20,8), account string, "
    "address string, fee decimal(20,8)>>"
)


def fields(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Select exactly the columns of ``ddl``; absent ones become typed nulls."""

    def column(field: T.StructField) -> Column:
        source = F.col(field.name) if field.name in df.columns else F.lit(None)
        return source.cast(field.dataType).alias(field.name)

    return df.select(*[column(f) for f in fields(ddl).fields])
