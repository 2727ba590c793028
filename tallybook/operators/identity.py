"""Who is who: names, users, linked accounts, address owners, parents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scan import Running, plan_chunks, running
from ..settings import DEFAULT, Settings


def normalize_identity(df: DataFrame, columns: tuple[str, ...] = ("from_user", "to_user")) -> DataFrame:
    """Lower-case the name columns, as on every write and lookup."""
    return df.withColumns({c: F.lower(F.col(c)) for c in columns if c in df.columns})


def resolve_users(
    df: DataFrame,
    username: DataFrame,
    service: DataFrame,
    name: str = "from_user",
    service_name: str = "service_name",
    prefix: str = "",
) -> DataFrame:
    """Add service_id, user_id and is_registered for a (service name, user name).

    An unknown service keeps its row with a null service_id, for a reject output.
    User id 0 counts as unregistered.
    """
    names = username.select(
        F.col("service_id").alias("_sid"),
        F.lower("username").alias("_name"),
        F.col("user_id").alias("_uid"),
    )
    services = service.select(F.col("service_id").alias("_srv"), F.col("service_name").alias("_sname"))
    # ``service`` is a table of a handful of rows by definition.
    with_service = df.join(services, F.col(service_name) == F.col("_sname"), "left")
    joined = with_service.join(
        names, (F.col("_srv") == F.col("_sid")) & (F.lower(F.col(name)) == F.col("_name")), "left"
    )
    return joined.select(
        *[F.col(c) for c in df.columns],
        F.col("_srv").alias(f"{prefix}service_id"),
        F.when(F.col("_uid") != 0, F.col("_uid")).alias(f"{prefix}user_id"),
        F.coalesce(F.col("_uid") != 0, F.lit(False)).alias(f"{prefix}is_registered"),
    )


def lookup_user(
    df: DataFrame, username: DataFrame, name: str, service_id: str = "service_id", out: str = "user_id"
) -> DataFrame:
    """Add the user id behind (service_id, name); null when unregistered."""
    names = username.select(
        F.col("service_id").alias("_sid"),
        F.lower("username").alias("_name"),
        F.when(F.col("user_id") != 0, F.col("user_id")).alias(out),
    )
    joined = df.join(
        names, (F.col(service_id) == F.col("_sid")) & (F.lower(F.col(name)) == F.col("_name")), "left"
    )
    return joined.drop("_sid", "_name")


def linked_accounts(username: DataFrame, service: DataFrame) -> DataFrame:
    """All (service, name) pairs of each user, numbered by username_id.

    One row per account rather than a list per user: a user may link any number
    of accounts.  The numbering is chunked, so a crowded user is cut too.
    """
    named = username.join(service, "service_id").select(
        "user_id", "username_id", "service_name", F.lower("username").alias("username")
    )
    limits = plan_chunks(named, F.col("username_id"), F.col("username_id"), keys=("user_id",))
    one = Running("sum", F.lit(1).cast("long"), "long")
    return running(named, ("user_id",), ("username_id", "username_id"), {"position": one}, limits)


def linked_account_parts(links: DataFrame, part_size: int = 1000) -> DataFrame:
    """Linked accounts as lists of at most ``part_size``, for JSON payloads."""
    part = F.floor((F.col("position") - 1) / part_size).cast("long")
    entry = F.struct("position", "service_name", "username")
    return (
        links.groupBy("user_id", part.alias("part"))
        .agg(F.sort_array(F.collect_list(entry)).alias("entries"))
        .select(
            "user_id",
            "part",
            F.transform(
                "entries",
                lambda e: F.struct(
                    e["username"].alias("username"), e["service_name"].alias("service_name")
                ),
            ).alias("associated"),
        )
    )


def _first_name(username: DataFrame) -> DataFrame:
    """Lowest username_id per user (partial aggregation, no sort)."""
    pick = F.min_by(F.struct("service_id", "username"), F.col("username_id"))
    return username.groupBy(F.col("user_id").alias("_owner")).agg(pick.alias("_first"))


def address_owner(address: DataFrame, username: DataFrame, service: DataFrame) -> DataFrame:
    """Owner name of every address: by user_id, else by user_id_alias.

    Where several names qualify the lowest username_id wins.
    """
    direct = _first_name(username)
    alias = direct.select(F.col("_owner").alias("_alias_owner"), F.col("_first").alias("_alias_first"))
    known = address.where(F.col("address").isNotNull())
    joined = known.join(direct, F.col("user_id") == F.col("_owner"), "left").join(
        alias, F.col("user_id_alias") == F.col("_alias_owner"), "left"
    )
    owner = F.coalesce("_first", "_alias_first")
    owned = joined.select(
        "address_id",
        "address",
        F.when(F.col("_first").isNotNull(), F.col("user_id"))
        .when(F.col("_alias_first").isNotNull(), F.col("user_id_alias"))
        .alias("owner_id"),
        owner["service_id"].alias("service_id"),
        owner["username"].alias("username"),
    )
    return owned.join(service, "service_id", "left").select(
        "address_id", "address", "owner_id", "service_id", "service_name", "username"
    )


def resolve_internal_address(
    actions: DataFrame, address: DataFrame, username: DataFrame, addr: str = "to_addr"
) -> DataFrame:
    """A destination address owned by someone named on the same service becomes a transfer to that user.

    to_addr is kept; ``internal`` marks the rewritten rows.  Where an owner has
    several names on the service the lowest username_id wins.
    """
    owners = (
        address.where(F.col("address").isNotNull())
        .groupBy(F.col("address").alias("_address"))
        .agg(F.min_by("user_id", "address_id").alias("_owner"))
    )
    names = username.groupBy(F.col("user_id").alias("_uid"), F.col("service_id").alias("_sid")).agg(
        F.min_by(F.lower("username"), F.col("username_id")).alias("_name")
    )
    # Owner names first: the result is one row per (address, service), the small side.
    lookup = owners.join(names, F.col("_owner") == F.col("_uid")).select("_address", "_sid", "_name", "_owner")
    joined = actions.join(
        lookup, (F.col(addr) == F.col("_address")) & (F.col("service_id") == F.col("_sid")), "left"
    )
    return (
        joined.withColumn("internal", F.col("_name").isNotNull())
        .withColumn("to_user", F.coalesce("_name", "to_user"))
        .drop("_address", "_sid", "_name", "_owner")
    )


def pending_for_registered(action: DataFrame, username: DataFrame, service: DataFrame) -> DataFrame:
    """Distinct recipients of pending tips who are registered on that service by now."""
    pending = (
        action.where((F.col("type") == "givetip") & (F.col("state") == "pending"))
        .where(F.col("to_user").isNotNull())
        .select("service_id", F.lower("to_user").alias("username"))
        .distinct()
    )
    names = username.select("service_id", F.lower("username").alias("username")).distinct()
    return (
        pending.join(names, ["service_id", "username"], "left_semi")
        .join(service, "service_id")
        .select("username", "service_name")
    )


def parent_author(comments: DataFrame, messages: DataFrame) -> DataFrame:
    """Author of each comment's parent; missing or ``[deleted]`` gives null."""
    authors = messages.groupBy(F.col("fullname").alias("_full")).agg(F.max("author").alias("_author"))
    joined = comments.join(authors, F.col("parent_id") == F.col("_full"), "left")
    return joined.withColumn(
        "parent_author", F.when(F.col("_author") != "[deleted]", F.col("_author"))
    ).drop("_full", "_author")


def remember_authors(messages: DataFrame) -> DataFrame:
    """The author memo: a message whose author is gone keeps a ``[deleted]`` tombstone."""
    return messages.select(
        F.col("fullname").alias("msg_id"), F.coalesce("author", F.lit("[deleted]")).alias("username")
    ).dropDuplicates(["msg_id"])


def users_missing_coin(users: DataFrame, address: DataFrame, coin: str) -> DataFrame:
    """Users without an address row for ``coin`` (null-safe, unlike NOT IN)."""
    having = address.where(F.col("coin") == coin).select("user_id")
    return users.join(having, "user_id", "left_anti")


def addresses_to_assign(address: DataFrame, username: DataFrame) -> DataFrame:
    """Address rows still lacking an address, with the wallet name to request."""
    empty = address.where(F.col("address").isNull())
    if "wallet_name" in address.columns:
        empty = empty.where(F.col("wallet_name").isNull())
    names = username.groupBy("user_id").agg(F.min_by("username", "username_id").alias("username"))
    return empty.join(names, "user_id").select(
        "address_id",
        "user_id",
        "username",
        F.concat_ws(":", "username", F.col("user_id").cast("string")).alias("wallet_name"),
    )


def service_bots(spark: SparkSession, settings: Settings = DEFAULT) -> DataFrame:
    return spark.createDataFrame(list(settings.service_bots), "service_name string, username string")


def missing_bot_accounts(bots: DataFrame, username: DataFrame, service: DataFrame) -> DataFrame:
    """Configured service bots that have no account yet."""
    names = username.join(service, "service_id").select(
        "service_name", F.lower("username").alias("username")
    )
    return bots.select("service_name", F.lower("username").alias("username")).join(
        names, ["service_name", "username"], "left_anti"
    )


def drop_seen(messages: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages not seen before, rows to add to the seen table)."""
    fresh = messages.dropDuplicates(["fullname"]).join(seen.select("fullname"), "fullname", "left_anti")
    return fresh, fresh.select("fullname", F.col("created_utc").alias("created_time"))


def drop_duplicate_actions(new: DataFrame, action: DataFrame) -> DataFrame:
    """Drop actions whose (type, service, message id) is recorded or repeated in the batch.

    Only reddit messages carry an id (service 1); other rows pass.
    """
    keys = ["type", "service_id", "config1"]
    has_id = (F.col("service_id") == 1) & F.col("config1").isNotNull()
    marked = new.withColumn("_has_id", F.coalesce(has_id, F.lit(False)))
    recorded = action.where(has_id).select(*keys).distinct()
    first = (
        marked.where("_has_id")
        .groupBy(*keys)
        .agg(F.min_by(F.struct(*new.columns), F.struct("ts", "action_id")).alias("_row"))
        .join(recorded, keys, "left_anti")
        .select("_row.*")
    )
    return first.unionByName(marked.where(~F.col("_has_id")).select(*new.columns))
