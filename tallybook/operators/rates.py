"""Exchange rates: averages, chained rates, last good values, valuation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import trunc8, trunc8_double
from ..plans.asof import asof_join
from ..plans.scan import Running, plan_chunks, running
from ..settings import DEFAULT, Settings

PAIR = ("thing_from", "thing_to")


def exchange_rates(quotes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean of an exchange's readings per pair; one failed reading drops the exchange."""
    return (
        quotes.groupBy(*by, *PAIR, "exchange")
        .agg(
            F.bool_and(F.col("value").isNotNull()).alias("_complete"),
            F.sum(F.col("value").cast("decimal(30,12)")).alias("_sum"),
            F.count(F.lit(1)).alias("_n"),
        )
        .where("_complete")
        .select(*by, *PAIR, "exchange", (F.col("_sum").cast("double") / F.col("_n")).alias("value"))
    )


def average_rates(quotes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Rate per pair: mean of the exchanges with a positive value, 0.0 if none.

    Sums run in decimal so that the result does not depend on row order.
    """
    positive = F.col("value") > 0
    pairs = quotes.select(*by, *PAIR).distinct()
    rates = (
        exchange_rates(quotes, by)
        .groupBy(*by, *PAIR)
        .agg(
            F.sum(F.when(positive, F.col("value").cast("decimal(30,12)"))).alias("_sum"),
            F.count(F.when(positive, 1)).alias("_n"),
        )
    )
    keys = [*by, *PAIR]
    rate = F.when(F.col("thing_from") == F.col("thing_to"), F.lit(1.0)).otherwise(
        F.when(F.col("_n") > 0, F.col("_sum").cast("double") / F.col("_n")).otherwise(F.lit(0.0))
    )
    return pairs.join(rates, keys, "left").select(*keys, F.coalesce(rate, F.lit(0.0)).alias("rate"))


def chained_rate(
    rates: DataFrame, coin: str = DEFAULT.coin, fiat: str = DEFAULT.fiat, by: tuple[str, ...] = ()
) -> DataFrame:
    """rate(coin, btc) x rate(btc, fiat) per snapshot, cut to 8 places; 0 when either is missing."""

    def leg(a: str, b: str) -> Column:
        if a == b:
            return F.lit(1.0)
        return F.max(F.when((F.col("thing_from") == a) & (F.col("thing_to") == b), F.col("rate")))

    legs = rates.groupBy(*by).agg(leg(coin, "btc").alias("_a"), leg("btc", fiat).alias("_b"))
    product = F.coalesce(F.col("_a") * F.col("_b"), F.lit(0.0))
    return legs.select(
        *by, F.lit(coin).alias("coin"), F.lit(fiat).alias("fiat"), trunc8_double(product).alias("rate")
    )


def append_rates(
    rates: DataFrame, by: tuple[str, ...], coin: str = DEFAULT.coin, fiat: str = DEFAULT.fiat
) -> DataFrame:
    """Snapshot rows with the rate map as JSON, kept only while coin/fiat is positive.

    A snapshot holds one entry per configured pair, so its map is small.
    """
    inner = F.map_from_entries(
        F.array_sort(F.collect_list(F.struct(F.col("thing_to").alias("key"), F.col("rate").alias("value"))))
    )
    per_from = rates.groupBy(*by, "thing_from").agg(
        inner.alias("_to"),
        F.max(F.when((F.col("thing_from") == coin) & (F.col("thing_to") == "btc"), F.col("rate"))).alias("_a"),
        F.max(F.when((F.col("thing_from") == "btc") & (F.col("thing_to") == fiat), F.col("rate"))).alias("_b"),
    )
    outer = F.map_from_entries(
        F.array_sort(F.collect_list(F.struct(F.col("thing_from").alias("key"), F.to_json("_to").alias("value"))))
    )
    snapshots = per_from.groupBy(*by).agg(
        outer.alias("_map"), F.max("_a").alias("_a"), F.max("_b").alias("_b")
    )
    entries = F.transform(
        F.map_entries("_map"), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"])
    )
    good = trunc8_double(F.coalesce(F.col("_a") * F.col("_b"), F.lit(0.0))) > 0
    return snapshots.where(good).select(
        *by, F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}")).alias("fiat_data")
    )


def parse_rates(fiat: DataFrame, coin: str = DEFAULT.coin, unit: str = DEFAULT.fiat) -> DataFrame:
    """Saved snapshots back to a chained rate per row."""
    rates = F.from_json("fiat_data", "map<string, map<string, double>>")
    product = F.coalesce(
        F.try_element_at(F.try_element_at(F.col("_m"), F.lit(coin)), F.lit("btc"))
        * F.try_element_at(F.try_element_at(F.col("_m"), F.lit("btc")), F.lit(unit)),
        F.lit(0.0),
    )
    return fiat.withColumn("_m", rates).withColumn("rate", trunc8_double(product)).drop("_m")


def rates_last_good(
    snapshots: DataFrame, ts: str = "fiat_date", snap: str = "snap_id", rate: str = "rate",
    chunks: int | None = None,
) -> DataFrame:
    """Each snapshot with its own rate if positive, else the newest good one before it."""
    work = snapshots.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")))
    limits = plan_chunks(work, F.col("_t"), F.col(snap), chunks=chunks)
    good = Running("last", F.when(F.col(rate) > 0, F.col(rate)))
    return running(work, (), ("_t", snap), {"good_rate": good}, limits).drop("_t")


def value_actions(
    actions: DataFrame,
    rates: DataFrame,
    ts: str = "ts",
    rate_ts: str = "fiat_date",
    rate_id: str = "snap_id",
    settings: Settings = DEFAULT,
    chunks: int | None = None,
) -> DataFrame:
    """Actions with the rate of their moment and fiat_val = rate x coin_val.

    Without any good rate yet the value is zero.
    """
    good = rates.where(F.col("rate") > 0).select(rate_ts, rate_id, "rate")
    base = actions.drop("fiat_val", "fiat")
    joined = asof_join(base, good, ts, rate_ts, "action_id", rate_id, ["rate"], chunks)
    value = trunc8((F.coalesce(F.col("rate"), F.lit(0)) * F.coalesce(F.col("coin_val"), F.lit(0))).cast("decimal(38,16)"))
    return joined.withColumn("fiat", F.lit(settings.fiat)).withColumn(
        "fiat_val", value.cast("decimal(20,10)")
    )


def latest_wallet_balance(balances: DataFrame) -> DataFrame:
    return balances.agg(F.max("ts").alias("ts"), F.max_by("amount", "ts").alias("amount"))


def wallet_solvency(
    withdrawals: DataFrame, balances: DataFrame, ts: str = "ts", chunks: int | None = None
) -> DataFrame:
    """Withdrawals with the hot-wallet balance of their moment and an alert flag when larger.

    Before the first snapshot the wallet counts as empty.
    """
    ticks = balances.select(F.col("ts").alias("wallet_ts"), F.col("amount").alias("wallet_amount"), F.lit(0).alias("_tick"))
    joined = asof_join(withdrawals, ticks, ts, "wallet_ts", "action_id", "_tick", ["wallet_amount"], chunks)
    short = F.col("coin_val") > F.coalesce(F.col("wallet_amount"), F.lit(0))
    return joined.withColumn("depleted", F.coalesce(short, F.lit(False)))


def ledger_cover(address: DataFrame, balances: DataFrame) -> DataFrame:
    """Sum of all account balances beside the newest hot-wallet balance."""
    owed = address.select(F.col("balance").alias("owed"))
    held = balances.select("ts", F.col("amount").alias("held"))
    # Both sides in one aggregation, so nothing has to be joined.
    both = owed.unionByName(held, allowMissingColumns=True).agg(
        F.sum("owed").cast("decimal(38,8)").alias("owed"), F.max_by("held", "ts").alias("held")
    )
    return both.withColumn("covered", F.col("held") >= F.col("owed"))
