"""Per-user, per-channel and global statistics.

Names are resolved after aggregating by (service, name): the join then sees one
row per name, however many actions a busy name has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import trunc8
from ..plans.topk import top_per_key
from ..settings import DEFAULT, Settings

SUM8 = "decimal(38,8)"


def _names(username: DataFrame) -> DataFrame:
    return username.select("user_id", "service_id", F.lower("username").alias("name"))


def _completed(action: DataFrame) -> DataFrame:
    return action.where(F.col("state") == "completed")


def _roles(df: DataFrame) -> DataFrame:
    """Each action once per end: ``sent`` tells which end ``name`` is.

    One scan serves both ends; rows are doubled in memory and combined again
    before the shuffle.
    """
    ends = F.array(
        F.struct(F.lit(True).alias("sent"), F.lower("from_user").alias("name")),
        F.struct(F.lit(False).alias("sent"), F.lower("to_user").alias("name")),
    )
    return df.select("*", F.explode(ends).alias("_end")).select("*", "_end.*").where(F.col("name").isNotNull())


def achievements(username: DataFrame, action: DataFrame) -> DataFrame:
    """Seven counters per user over completed actions.

    ``withdraw_count`` counts completed tips to an address, as the service does.
    Sums are null for a user without matching actions; counts are zero.
    """
    names = _names(username)
    done = _completed(action).where(F.col("type").isin("givetip", "deposit"))
    amount, sent = F.col("coin_val"), F.col("sent")
    tip, to_user = F.col("type") == "givetip", F.col("to_user").isNotNull()
    gave, got = sent & tip & to_user, ~sent & tip & F.col("from_user").isNotNull()
    # Recipients are kept apart to count them; received tips need no such detail.
    roles = _roles(done).groupBy("service_id", "name", F.when(sent, F.lower("to_user")).alias("peer")).agg(
        F.sum(F.when(gave, amount)).cast(SUM8).alias("coins_sent"),
        F.sum(F.when(got, amount)).cast(SUM8).alias("coins_received"),
        F.count(F.when(gave, amount)).alias("tips_sent"),
        F.count(F.when(got, amount)).alias("tips_received"),
        F.count(F.when(sent & (F.col("type") == "deposit") & ~to_user, amount)).alias("deposit_count"),
        F.count(F.when(sent & tip & ~to_user & F.col("to_addr").isNotNull(), amount)).alias("withdraw_count"),
        F.max(F.when(gave, 1)).alias("tipped"),
    )
    per_user = (
        roles.join(names, ["service_id", "name"])
        .groupBy("user_id")
        .agg(
            F.sum("coins_sent").cast(SUM8).alias("coins_sent"),
            F.sum("coins_received").cast(SUM8).alias("coins_received"),
            F.sum("tips_sent").alias("tips_sent"),
            F.sum("tips_received").alias("tips_received"),
            F.countDistinct(F.when(F.col("tipped") == 1, F.col("peer"))).alias("tips_sent_unique"),
            F.sum("deposit_count").alias("deposit_count"),
            F.sum("withdraw_count").alias("withdraw_count"),
        )
    )
    counts = ["tips_sent", "tips_received", "tips_sent_unique", "deposit_count", "withdraw_count"]
    return (
        username.select("user_id").distinct().join(per_user, "user_id", "left").fillna(0, counts)
    )


def channel_stats(action: DataFrame, service_id: int = 2) -> DataFrame:
    """Tip totals of every channel; pending tips count too."""
    tips = action.where(
        (F.col("service_id") == service_id)
        & (F.col("type") == "givetip")
        & F.col("state").isin("pending", "completed")
        & F.col("config1").startswith("#")
    )
    return tips.groupBy(F.expr("substring(config1, 2)").alias("channel")).agg(
        F.sum("coin_val").cast(SUM8).alias("total_tip_amount"),
        F.count("action_id").alias("total_tip_count"),
        (F.sum("coin_val").cast(SUM8).cast("double") / F.count("coin_val")).alias("average_tip_amount"),
        F.countDistinct(F.lower("from_user")).alias("total_tip_users"),
    )


def _totals(action: DataFrame, username: DataFrame) -> DataFrame:
    """Completed tips sent and received per user; tips to addresses count as sent."""
    tips = _roles(_completed(action).where(F.col("type") == "givetip"))
    sent = F.col("sent")
    roles = tips.groupBy("service_id", "name").agg(
        F.sum(F.when(sent, F.col("coin_val"))).cast(SUM8).alias("coin_sent"),
        F.sum(F.when(~sent, F.col("coin_val"))).cast(SUM8).alias("coin_received"),
        F.sum(F.when(sent, F.col("fiat_val"))).cast("decimal(38,10)").alias("fiat_sent"),
        F.sum(F.when(~sent, F.col("fiat_val"))).cast("decimal(38,10)").alias("fiat_received"),
    )
    return (
        roles.join(_names(username), ["service_id", "name"])
        .groupBy("user_id")
        .agg(
            F.sum("coin_sent").cast(SUM8).alias("coin_sent"),
            F.sum("coin_received").cast(SUM8).alias("coin_received"),
            F.sum("fiat_sent").cast("decimal(38,10)").alias("fiat_sent"),
            F.sum("fiat_received").cast("decimal(38,10)").alias("fiat_received"),
        )
    )


def account_info(
    address: DataFrame, username: DataFrame, action: DataFrame, coin: str = "dog"
) -> DataFrame:
    """Balance, address and totals per user; unlike ``achievements`` sent includes tips to addresses."""
    totals = _totals(action, username)
    accounts = address.where(F.col("coin") == coin).select("user_id", "balance", "address")
    return (
        username.select("user_id")
        .distinct()
        .join(accounts, "user_id", "left")
        .join(totals, "user_id", "left")
        .select(
            "user_id",
            "balance",
            F.col("coin_sent").alias("total_sent"),
            F.col("coin_received").alias("total_received"),
            "address",
        )
    )


def user_totals(username: DataFrame, action: DataFrame) -> DataFrame:
    """Coin and fiat, sent and received, zero when absent, cut to 8 places."""
    zero = F.lit(0).cast(SUM8)
    columns = {
        "total_sent": "coin_sent",
        "total_received": "coin_received",
        "total_fiat_sent": "fiat_sent",
        "total_fiat_received": "fiat_received",
    }
    joined = username.select("user_id").distinct().join(_totals(action, username), "user_id", "left")
    return joined.select(
        "user_id",
        *[F.coalesce(trunc8(F.col(c)), zero).cast(SUM8).alias(n) for n, c in columns.items()],
    )


def global_stats(action: DataFrame, top: int = 10) -> DataFrame:
    """Named global figures as (metric, position, label, amount, n) rows.

    Totals by type, state and coin are whole; the rankings are top lists.
    """
    amount = F.sum("coin_val").cast(SUM8).alias("amount")
    n = F.count(F.lit(1)).alias("n")

    def labels(metrics: dict[str, Column]) -> Column:
        return F.explode(
            F.array(*[F.struct(F.lit(m).alias("metric"), c.alias("label")) for m, c in metrics.items()])
        ).alias("_l")

    # A few dozen cells come out of one scan and feed the three totals.
    cells = action.groupBy("type", "state", "coin").agg(amount, n)
    totals = (
        cells.select("*", labels({f"by_{c}": F.col(c) for c in ("type", "state", "coin")}))
        .groupBy("_l.metric", "_l.label")
        .agg(F.sum("amount").cast(SUM8).alias("amount"), F.sum("n").alias("n"))
        .select("metric", F.lit(0).cast("long").alias("position"), "label", "amount", "n")
    )
    ranked = {
        "top_tippers": F.lower("from_user"),
        "top_receivers": F.lower("to_user"),
        "top_subreddits": F.col("config3"),
    }
    tips = _completed(action).where(F.col("type") == "givetip")
    per_label = (
        tips.select("coin_val", labels(ranked))
        .where(F.col("_l.label").isNotNull())
        .groupBy("_l.metric", "_l.label")
        .agg(amount, n)
    )
    best = [F.col("amount").desc_nulls_last(), F.col("label").asc()]
    tops = top_per_key(per_label, ["metric"], best, 1, top, rank="position", salt_on=F.col("label"))
    return totals.unionByName(
        tops.select("metric", F.col("position").cast("long").alias("position"), "label", "amount", "n")
    )


def user_stats(username: DataFrame, action: DataFrame) -> DataFrame:
    """Tipped and received per user and unit, for coins and fiats with a value."""
    tips = _roles(_completed(action).where(F.col("type") == "givetip"))

    def unit(kind: str) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"),
            F.col(kind).alias("unit"),
            F.col(f"{kind}_val").cast("decimal(30,10)").alias("value"),
        )

    units = tips.select("service_id", "name", "sent", F.explode(F.array(unit("coin"), unit("fiat"))).alias("u"))
    return (
        units.where(F.col("u.unit").isNotNull() & F.col("u.value").isNotNull())
        .groupBy("service_id", "name", "sent", F.col("u.kind").alias("kind"), F.col("u.unit").alias("unit"))
        .agg(F.sum("u.value").cast("decimal(38,10)").alias("total"))
        .join(_names(username), ["service_id", "name"])
        .groupBy("user_id", F.when(F.col("sent"), "tipped").otherwise("received").alias("direction"), "kind", "unit")
        .agg(F.sum("total").cast("decimal(38,10)").alias("total"))
    )


def flair(username: DataFrame, action: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """``tipped[$x] (n) / received[$y] (m)`` per name; a tip to oneself counts as tipped only."""
    names = _names(username)
    history = _completed(action).where(F.col("type").isin("givetip", "redeem", "withdraw", "deposit", "gold"))
    fiat = F.when(F.col("type") == "givetip", F.col("fiat_val"))
    sent, to_other = F.col("sent"), F.lower("to_user") != F.lower("from_user")
    per_name = _roles(history).groupBy("service_id", "name").agg(
        F.sum(F.when(sent, fiat)).cast("decimal(38,10)").alias("tipped"),
        F.count(F.when(sent, 1)).alias("num_tipped"),
        F.sum(F.when(~sent, fiat)).cast("decimal(38,10)").alias("received"),
        F.count(F.when(~sent & to_other, 1)).alias("num_received"),
    )
    both = per_name.join(names.select("service_id", "name"), ["service_id", "name"], "left_semi")

    def part(word: str, total: str, count: str) -> Column:
        money = F.col(total).cast("decimal(38,2)").cast("string")
        text = F.concat(
            F.lit(f"{word}[{settings.fiat_symbol}"),
            money,
            F.lit("] ("),
            F.coalesce(F.col(count), F.lit(0)).cast("string"),
            F.lit(")"),
        )
        return F.when(F.col(total).isNotNull(), text)

    text = F.concat_ws(" / ", part("tipped", "tipped", "num_tipped"), part("received", "received", "num_received"))
    return both.where(F.col("tipped").isNotNull() | F.col("received").isNotNull()).select(
        "service_id", F.col("name").alias("username"), text.alias("flair")
    )
