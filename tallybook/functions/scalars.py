"""Scalar column functions: amounts, JSON paths, dates, formatting."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..settings import DEFAULT, Settings

_STEP = Decimal("0.00000001")


def trunc8(x: Column) -> Column:
    """Cut a decimal to 8 places toward zero (a cast would round half up)."""
    places = F.lit(8)
    return F.when(x < 0, -F.floor(-x, places)).otherwise(F.floor(x, places))


def trunc8_double(x: Column) -> Column:
    """Cut a double to 8 places toward zero, as decimal(20,8)."""
    whole = F.when(x < 0, -F.floor(-x * 1e8)).otherwise(F.floor(x * 1e8))
    return (whole.cast("decimal(20,0)") * F.lit(_STEP)).cast("decimal(20,8)")


def clamp_nonneg(x: Column) -> Column:
    """Negative and missing amounts are stored as zero."""
    return F.greatest(F.coalesce(x, F.lit(0).cast("decimal(20,8)")), F.lit(0).cast("decimal(20,8)"))


def parse_amount(s: Column) -> Column:
    """Text to decimal(20,8): commas dropped, extra places cut, else null."""
    plain = F.regexp_replace(s, ",", "")
    numeric = plain.rlike(r"^[0-9]*\.?[0-9]*$") & plain.rlike("[0-9]")
    whole = F.when(numeric, plain)
    return trunc8(whole.try_cast("decimal(38,18)")).try_cast("decimal(20,8)")


def json_at(column: Column, path: str) -> Column:
    """Dotted path into JSON text; digit steps index arrays, missing gives null."""
    steps = [p for p in path.strip(".").split(".") if p]
    quoted = "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in steps)
    return F.get_json_object(column, "$" + quoted)


def expand_path(template: str, thing_from: str, thing_to: str, uppercase: bool = False) -> str:
    """Fill {THING_FROM}/{THING_TO} in a ticker path."""
    case = str.upper if uppercase else str.lower
    return template.replace("{THING_FROM}", case(thing_from)).replace("{THING_TO}", case(thing_to))


def gold_price(rate: Column, settings: Settings = DEFAULT) -> Column:
    """Coins for one gold: fiat price over rate, rounded down to a whole step; null if unusable."""
    coins = F.floor(F.lit(settings.gold_fiat) / F.when(rate > 0, rate)).cast("long")
    stepped = coins - coins % settings.gold_step
    return F.when(stepped >= settings.gold_floor, stepped.cast("decimal(20,8)"))


def fmt_coin(x: Column) -> Column:
    """Plain decimal text without trailing zeros."""
    return F.regexp_replace(x.cast("decimal(20,8)").cast("string"), "[.]?0+$", "")


def fmt_fixed(x: Column, places: int) -> Column:
    """Fixed number of places, as text."""
    return x.cast(f"decimal(38,{places})").cast("string")


def si_scale(x: Column) -> tuple[Column, Column, Column]:
    """(amount, short prefix, long prefix) for display.

    The label for thousands is Mega, kept as the service has always shown it.
    """
    small, large = x < 1, x >= 1000
    amount = F.when(small, x * 1000).when(large, x / 1000).otherwise(x)
    short = F.when(small, "m").when(large, "M").otherwise("")
    long = F.when(small, "milli").when(large, "Mega").otherwise("")
    return amount, short, long


def escape_md(x: Column) -> Column:
    return F.replace(x, F.lit("_"), F.lit("\\_"))


def is_new_user(joindate: Column, now: Column, days: int = DEFAULT.new_user_days) -> Column:
    """Joined within ``days`` calendar days; an unknown user counts as new."""
    return F.coalesce(F.abs(F.datediff(now, joindate)) <= days, F.lit(True))


def expires_at(ts: Column, hours: int = DEFAULT.expire_hours) -> Column:
    return ts + F.make_interval(hours=F.lit(hours))


def expiry_text(hours: int = DEFAULT.expire_hours) -> str:
    return f"{hours / 24.0:.2g} days"


def msg_kind(fullname: Column) -> Column:
    return F.when(F.substring_index(fullname, "_", 1) == "t4", "message").otherwise("comment")


def from_epoch(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def needs_confirmation(verify: Column, coin_val: Column, settings: Settings = DEFAULT) -> Column:
    """A public reply is due for a verify flag or a large amount."""
    flagged = F.coalesce(verify, F.lit(False))
    return flagged | F.coalesce(coin_val >= F.lit(settings.verify_above), F.lit(False))


def account_value(df: DataFrame, balance: str = "balance", rate: str = "rate") -> DataFrame:
    """Fiat worth of each account; null without a positive rate."""
    worth = F.when(F.col(rate) > 0, trunc8((F.col(balance) * F.col(rate)).cast("decimal(38,16)")))
    return df.withColumn("fiat_balance", worth.cast("decimal(38,8)"))


def keyword_amount(lo: Column, hi: Column, divisor: Column, draw_on: Column, seed: int) -> Column:
    """An amount in [lo, hi] / divisor, drawn by hash so that replays agree."""
    spread = (hi - lo + 1).cast("long")
    drawn = F.pmod(F.xxhash64(draw_on, F.lit(seed)), spread) + lo.cast("long")
    return (drawn.cast("decimal(12,0)") / divisor.cast("decimal(6,0)")).cast("decimal(20,8)")
