"""Account operations: registration, linking, merging, deletion, upsert."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import Workspace
from ..plans.scan import Running, number_rows, plan_chunks, running

ZERO = "decimal(20,8)"


@dataclass(frozen=True)
class Registration:
    """New rows of the three identity tables and the outcome of every request.

    ``created`` ties each new name to the request that made it.
    """

    created: DataFrame
    user: DataFrame
    username: DataFrame
    address: DataFrame
    outcomes: DataFrame


def _top(df: DataFrame, column: str) -> int:
    """Highest id in use: one number on the driver."""
    return int(df.agg(F.coalesce(F.max(column), F.lit(0))).first()[0])


def register_users(
    requests: DataFrame,
    user: DataFrame,
    username: DataFrame,
    address: DataFrame,
    coin: str = "dog",
    space: Workspace | None = None,
) -> Registration:
    """Register the senders of ``requests`` (action_id, ts, service_id, from_user).

    The first request of an unknown (service, name) creates user, name and an
    empty address; all others end as already_registered.  New ids follow the
    order of the requests.  With ``space`` the new rows are written once there.
    """
    named = requests.withColumn("name", F.lower("from_user"))
    known = username.select("service_id", F.lower("username").alias("name")).distinct()
    first = (
        named.groupBy("service_id", "name")
        .agg(F.min(F.struct("ts", "action_id")).alias("_first"))
        .join(known, ["service_id", "name"], "left_anti")
        .select("service_id", "name", F.col("_first.ts").alias("joindate"), F.col("_first.action_id").alias("action_id"))
    )
    ordered = first.withColumn("_t", F.unix_micros(F.col("joindate").cast("timestamp")))
    numbered = number_rows(ordered, ("_t", "action_id"), "_n").drop("_t")
    users, names, addresses = _top(user, "user_id"), _top(username, "username_id"), _top(address, "address_id")
    new = numbered.select(
        "action_id",
        "service_id",
        "name",
        "joindate",
        (F.col("_n") + users).alias("user_id"),
        (F.col("_n") + names).alias("username_id"),
        (F.col("_n") + addresses).alias("address_id"),
    )
    if space is not None:
        new = space.store(new, "registered")
    created = F.col("_created").isNotNull()
    outcomes = requests.join(new.select("action_id", F.lit(True).alias("_created")), "action_id", "left").select(
        *[F.col(c) for c in requests.columns],
        F.when(created, "completed").otherwise("failed").alias("state"),
        F.when(~created, "already_registered").alias("error"),
    )
    return Registration(
        created=new,
        user=new.select("user_id", "joindate"),
        username=new.select("username_id", "user_id", "service_id", F.col("name").alias("username"), "joindate"),
        address=new.select(
            "address_id",
            "user_id",
            F.lit(None).cast("bigint").alias("user_id_alias"),
            F.lit(coin).alias("coin"),
            F.lit(None).cast("string").alias("address"),
            F.lit(None).cast("string").alias("wallet_name"),
            F.lit(0).cast(ZERO).alias("balance"),
        ),
        outcomes=outcomes,
    )


def link_service(links: DataFrame, username: DataFrame) -> DataFrame:
    """Names to add for users of other services; (service, name) stays unique.

    ``links`` is (user_id, service_id, username, seq); of several claims to one
    free name the lowest seq wins.
    """
    claims = links.withColumn("username", F.lower("username"))
    first = claims.groupBy("service_id", "username").agg(
        F.min_by("user_id", F.struct("seq", "user_id")).alias("user_id")
    )
    taken = username.select("service_id", F.lower("username").alias("username"))
    return first.join(taken, ["service_id", "username"], "left_anti").select(
        "user_id", "service_id", "username"
    )


def merge_targets(merges: DataFrame) -> DataFrame:
    """(user_id, owner): where each merged user's holdings end after all merges.

    Merges apply in order of ``seq``.  Each merge points to the next merge that
    moves its target on; pointers are doubled until none moves, so a chain of
    length n takes about log2(n) joins.  Later merges only, hence no cycles.
    """
    space = Workspace(merges.sparkSession, "merge")
    events = merges.select(
        F.col("seq").cast("long").alias("seq"),
        F.col("user_id_main").cast("long").alias("main"),
        F.col("user_id_merge").cast("long").alias("merge"),
    )
    # One time line per user, latest first: arrivals look for the next departure.
    moves = events.select(
        F.explode(
            F.array(
                F.struct(F.col("main").alias("user"), F.lit(0).alias("leaves"), "seq", "main", "merge"),
                F.struct(F.col("merge").alias("user"), F.lit(1).alias("leaves"), "seq", "main", "merge"),
            )
        ).alias("m")
    ).select("m.*")
    line = moves.withColumn("back", -F.col("seq"))
    limits = plan_chunks(line, F.col("back"), F.col("back"), keys=("user",))
    nearest = {
        "next_seq": Running("last", F.when(F.col("leaves") == 1, F.col("seq"))),
        "next_merge": Running("last", F.when(F.col("leaves") == 1, F.col("merge"))),
    }
    scanned = running(line, ("user",), ("back", "leaves", "seq"), nearest, limits, inclusive=False)
    state = space.store(
        scanned.where(F.col("leaves") == 0).select(
            "merge", "seq", F.col("main").alias("owner"), "next_merge", "next_seq"
        ),
        "round-0",
    )
    step = 0
    while not state.where(F.col("next_seq").isNotNull()).isEmpty():
        step += 1
        ahead = state.select(
            F.col("merge").alias("_m"),
            F.col("seq").alias("_s"),
            F.col("owner").alias("_owner"),
            F.col("next_merge").alias("_nm"),
            F.col("next_seq").alias("_ns"),
        )
        moved = state.where(F.col("next_seq").isNotNull()).join(
            ahead, (F.col("next_merge") == F.col("_m")) & (F.col("next_seq") == F.col("_s"))
        )
        done = state.where(F.col("next_seq").isNull())
        state = space.store(
            moved.select(
                "merge", "seq", F.col("_owner").alias("owner"),
                F.col("_nm").alias("next_merge"), F.col("_ns").alias("next_seq"),
            ).unionByName(done),
            f"round-{step}",
        )
    return state.select(F.col("merge").alias("user_id"), "seq", "owner")


def merge_accounts(merges: DataFrame, username: DataFrame, address: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(username, address) after all merges.

    Names move to the final owner, balances are added there, a merged address
    keeps zero and an alias to the final owner.
    """
    targets = merge_targets(merges)
    # What a user holds at the start leaves with that user's first merge; the
    # alias is where the last one led.
    ends = targets.groupBy("user_id").agg(
        F.min_by("owner", "seq").alias("owner"), F.max_by("owner", "seq").alias("alias")
    )
    names = username.join(ends.select("user_id", "owner"), "user_id", "left").select(
        *[F.coalesce("owner", "user_id").alias("user_id") if c == "user_id" else F.col(c) for c in username.columns]
    )
    held = address.join(ends, "user_id", "left")
    moved = held.groupBy(F.coalesce("owner", "user_id").alias("user_id")).agg(
        F.sum("balance").cast(ZERO).alias("_held")
    )
    # A user with several address rows keeps the sum on the lowest address_id.
    main = address.groupBy("user_id").agg(F.min("address_id").alias("_main"))
    joined = held.join(moved, "user_id", "left").join(main, "user_id", "left")
    here = (F.col("address_id") == F.col("_main")) & F.col("_held").isNotNull()
    changed = {
        "balance": F.when(here, F.col("_held")).otherwise(F.lit(0).cast(ZERO)).alias("balance"),
        "user_id_alias": F.coalesce("alias", "user_id_alias").alias("user_id_alias"),
    }
    return names, joined.select(*[changed.get(c, F.col(c)) for c in address.columns])


def delete_users(
    ids: DataFrame, user: DataFrame, username: DataFrame, address: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three identity tables without the given users; actions stay."""
    gone = ids.select("user_id").distinct()
    return tuple(table.join(gone, "user_id", "left_anti") for table in (user, username, address))


def upsert_actions(base: DataFrame, updates: DataFrame, version: str = "version") -> DataFrame:
    """Replace rows by action_id; of several updates the highest version wins.

    Columns an update does not carry become null, except txfee which is kept.
    The base is only probed, so a small batch of updates costs no shuffle of it.
    """
    columns = [c for c in updates.columns if c != version]
    latest = updates.groupBy("action_id").agg(
        F.max_by(F.struct(*[c for c in columns if c != "action_id"]), F.col(version)).alias("_row")
    ).select("action_id", "_row.*")
    if "txfee" in base.columns:
        kept = base.select("action_id", F.col("txfee").alias("_fee")).join(
            latest.select("action_id"), "action_id", "left_semi"
        )
        latest = latest.join(kept, "action_id", "left")
        fee = F.coalesce("txfee", "_fee") if "txfee" in latest.columns else F.col("_fee")
        latest = latest.withColumn("txfee", fee).drop("_fee")
    types = dict(base.dtypes)
    shaped = latest.select(
        *[
            (F.col(c) if c in latest.columns else F.lit(None)).cast(types[c]).alias(c)
            for c in base.columns
        ]
    )
    return base.join(latest.select("action_id"), "action_id", "left_anti").unionByName(shaped)
