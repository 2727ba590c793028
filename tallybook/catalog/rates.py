"""Rates, valuation and wallet checks; scalar functions on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import Tables
from ..functions import cells, scalars
from ..operators import rates
from ..sources.tickers import read_tickers as read_tickers_source
from .registry import query

PATHS = {ex: ["return.markets.k"] for ex in ("ex_a", "ex_b", "ex_c")}


_QUOTES = """
q as (select snap_id, fiat_date, date_trunc('hour', fiat_date) as hour, exchange, thing_from, thing_to,
 try_cast(json_extract_string(payload, '$.return.markets.k') as double) as value from fx_ticker)"""
_EXCHANGE = """
x as (select {by}thing_from, thing_to, exchange,
 cast(sum(cast(value as decimal(30,12))) as double) / count(*) as value
 from q group by all having bool_and(value is not null))"""
_AVERAGE = """
r as (select p.*, coalesce(a.rate, 0.0) as rate from (select distinct {by}thing_from, thing_to from q) p
 left join (select {by}thing_from, thing_to, cast(sum(cast(value as decimal(30,12))) as double) / count(*) as rate
  from x where value > 0 group by all) a using ({by}thing_from, thing_to))"""
_CHAIN = """
c as (select {by}cast(cast(floor(coalesce(
  max(case when thing_from='dog' and thing_to='btc' then rate end)
  * max(case when thing_from='btc' and thing_to='usd' then rate end), 0.0) * 1e8) as decimal(20,0))
  * cast(0.00000001 as decimal(9,8)) as decimal(20,8)) as rate from r {group})"""


def _with(by: str) -> str:
    group = "group by all" if by else ""
    return "with " + ",".join(
        [_QUOTES, _EXCHANGE.format(by=by), _AVERAGE.format(by=by), _CHAIN.format(by=by, group=group)]
    )


def _quotes(t: Tables) -> DataFrame:
    return read_tickers_source(t.ticker, PATHS)


def _hourly(t: Tables) -> DataFrame:
    quotes = _quotes(t).withColumn("hour", F.date_trunc("hour", "fiat_date").cast("timestamp_ntz"))
    return rates.average_rates(quotes, by=("hour",))


@query("S6, F6", _with("") + " select snap_id, fiat_date, exchange, thing_from, thing_to, value from q")
def read_tickers(t: Tables) -> DataFrame:
    return _quotes(t).drop("path")


@query("A5", _with("") + " select thing_from, thing_to, rate from r")
def average_rates(t: Tables) -> DataFrame:
    return rates.average_rates(_quotes(t))


@query("A5 (per hour)", _with("hour, ") + " select hour, thing_from, thing_to, rate from r")
def average_rates_hourly(t: Tables) -> DataFrame:
    return _hourly(t)


@query("F7", _with("hour, ") + " select hour, 'dog' as coin, 'usd' as fiat, rate from c")
def chained_rate(t: Tables) -> DataFrame:
    return rates.chained_rate(_hourly(t), by=("hour",))


# JSON text of a double differs between engines, so the saved map is read back.
@query(
    "S10",
    _with("hour, ")
    + """ select r.hour, max(case when thing_from='dog' then r.rate end) as dog_btc,
 max(case when thing_from='btc' then r.rate end) as btc_usd
 from r join c on c.hour = r.hour where c.rate > 0 group by 1""",
)
def append_rates(t: Tables) -> DataFrame:
    saved = rates.append_rates(_hourly(t), by=("hour",))
    m = F.from_json("fiat_data", "map<string, map<string, double>>")
    return saved.select(
        "hour", m["dog"]["btc"].alias("dog_btc"), m["btc"]["usd"].alias("btc_usd")
    )


# Snapshot rates for the time-line operators: one per event, a tenth of them bad.
_SNAPSHOTS = """
select event_id as snap_id, ts as fiat_date,
 cast(case when event_type = 'error' or event_id % 10 = 0 then 0
  else cast(value as decimal(12,2)) * cast(0.0001 as decimal(6,5)) end as decimal(20,8)) as rate
from events"""


def _snapshots(t: Tables) -> DataFrame:
    return t.sql(_SNAPSHOTS)


@query(
    "W3",
    f"""
with s as ({_SNAPSHOTS})
select snap_id, fiat_date, rate,
 last_value(case when rate > 0 then rate end ignore nulls) over (order by fiat_date, snap_id
  rows between unbounded preceding and current row) as good_rate from s""",
)
def rates_last_good(t: Tables) -> DataFrame:
    return rates.rates_last_good(_snapshots(t))


# Action times are folded into the month of the rate snapshots.
_TIMED = """
select action_id, coin_val,
 timestamp '2023-12-31 12:00:00' + INTERVAL '1' SECOND * cast((action_id * 977) % 2700000 as int) as ts
from fx_action"""


def _timed(t: Tables) -> DataFrame:
    return t.sql(_TIMED.replace("timestamp '", "timestamp_ntz '"))


@query(
    "J12",
    f"""
with s as ({_SNAPSHOTS}), a as ({_TIMED}),
g as (select fiat_date, arg_max(rate, snap_id) as rate from s where rate > 0 group by 1)
select a.action_id, a.coin_val, a.ts, g.rate, 'usd' as fiat,
 cast(cast(trunc(cast(coalesce(g.rate, 0) as decimal(20,8)) * a.coin_val * 100000000) as decimal(38,0)) * cast(0.00000001 as decimal(9,8)) as decimal(20,10)) as fiat_val
from a asof left join g on g.fiat_date <= a.ts""",
)
def value_actions(t: Tables) -> DataFrame:
    return rates.value_actions(_timed(t), _snapshots(t))


@query("S9", "select max(ts) as ts, arg_max(amount, ts) as amount from fx_wallet_balance")
def append_wallet_balance(t: Tables) -> DataFrame:
    return rates.latest_wallet_balance(t.wallet_balance)


@query(
    "A9",
    """
with a as (select action_id, ts, coin_val * (1 + action_id % 9) as coin_val from fx_action where type='withdraw')
select a.action_id, a.ts, cast(a.coin_val as decimal(38,8)) as coin_val, w.amount as wallet_amount,
 a.coin_val > coalesce(w.amount, 0) as depleted
from a asof left join fx_wallet_balance w on w.ts <= a.ts""",
)
def wallet_solvency(t: Tables) -> DataFrame:
    withdrawals = t.action.where("type = 'withdraw'").select(
        "action_id", "ts", (F.col("coin_val") * (1 + F.col("action_id") % 9)).cast("decimal(38,8)").alias("coin_val")
    )
    return rates.wallet_solvency(withdrawals, t.wallet_balance)


@query(
    "A9 (balances against wallet)",
    """
select (select cast(sum(balance) as decimal(38,8)) from fx_address) as owed,
 (select arg_max(amount, ts) from fx_wallet_balance) as held,
 (select arg_max(amount, ts) from fx_wallet_balance) >= (select sum(balance) from fx_address) as covered""",
)
def ledger_cover(t: Tables) -> DataFrame:
    return rates.ledger_cover(t.address, t.wallet_balance)


@query(
    "F1",
    """
select action_id, cast(cast(trunc(v * 100000000) as decimal(30,0)) * cast(0.00000001 as decimal(9,8)) as decimal(30,8)) as cut
from (select action_id, case when action_id % 2 = 0 then -fiat_val else fiat_val end as v from fx_action)""",
)
def trunc8(t: Tables) -> DataFrame:
    v = F.when(F.col("action_id") % 2 == 0, -F.col("fiat_val")).otherwise(F.col("fiat_val"))
    return t.action.select("action_id", scalars.trunc8(v).cast("decimal(30,8)").alias("cut"))


_HOLES = "case when action_id % 3 = 0 then null when action_id % 3 = 1 then -coin_val else coin_val end"


@query(
    "F2",
    f"select action_id, greatest(coalesce({_HOLES}, 0), 0) as kept from fx_action",
)
def clamp_nonneg(t: Tables) -> DataFrame:
    return t.action.select("action_id", scalars.clamp_nonneg(F.expr(_HOLES)).alias("kept"))


_TEXT = """case when action_id % 5 = 0 then concat(cast(coin_val as {s}), 'x') when action_id % 5 = 1 then concat('1,', cast(coin_val as {s}))
 else cast(coin_val as {s}) end"""


@query(
    "F3",
    f"""select action_id, try_cast(replace({_TEXT.format(s='varchar')}, ',', '') as decimal(20,8)) as amount from fx_action""",
)
def parse_amount(t: Tables) -> DataFrame:
    return t.action.select("action_id", scalars.parse_amount(F.expr(_TEXT.format(s="string"))).alias("amount"))


@query(
    "F8",
    f"""
with s as ({_SNAPSHOTS}),
g as (select snap_id, rate, case when rate > 0 then cast(floor(cast(4 as double) / cast(rate as double)) as bigint) end as n from s)
select snap_id, cast(case when n - n % 100 >= 10000 then n - n % 100 end as decimal(20,8)) as price,
 case when n is null or n - n % 100 < 10000 then 'fiat_error' end as error from g""",
)
def gold_price(t: Tables) -> DataFrame:
    price = scalars.gold_price(F.col("rate").cast("double"))
    return _snapshots(t).select(
        "snap_id", price.alias("price"), F.when(price.isNull(), "fiat_error").alias("error")
    )


@query(
    "F9",
    """select action_id, regexp_replace(cast(case when action_id % 4 = 0 then cast(trunc(coin_val) as decimal(20,8)) else coin_val end as varchar), '[.]?0+$', '') as shown
from fx_action""",
)
def fmt_coin(t: Tables) -> DataFrame:
    v = F.when(F.col("action_id") % 4 == 0, F.floor("coin_val").cast("decimal(20,8)")).otherwise(F.col("coin_val"))
    return t.action.select("action_id", scalars.fmt_coin(v).alias("shown"))


@query(
    "F10",
    """
select event_id, case when value < 1 then value * 1000 when value >= 1000 then value / 1000 else value end as amount,
 case when value < 1 then 'm' when value >= 1000 then 'M' else '' end as short_prefix,
 case when value < 1 then 'milli' when value >= 1000 then 'Mega' else '' end as long_prefix
from (select event_id, case when event_id % 3 = 0 then value / 1000 when event_id % 3 = 1 then value * 1000 else value end as value from events)""",
)
def si_scale(t: Tables) -> DataFrame:
    value = F.when(F.col("event_id") % 3 == 0, F.col("value") / 1000).when(
        F.col("event_id") % 3 == 1, F.col("value") * 1000
    ).otherwise(F.col("value"))
    amount, short, long = scalars.si_scale(value)
    return t.base("events").select(
        "event_id", amount.alias("amount"), short.alias("short_prefix"), long.alias("long_prefix")
    )


@query(
    "F11",
    """
select action_id,
 case when from_user = 'customer_000000007' then concat('**/u/', from_user, '**') else concat('/u/', from_user) end as user_cell,
 case when from_user = 'customer_000000007' then concat('[**', from_user, '**](/u/', from_user, ')')
  else concat('[', from_user, '](/u/', from_user, ')^[[stats]](stats_', from_user, ')') end as user_link,
 case when to_addr is null then '-' else concat('[', substr(to_addr,1,6), '...', right(to_addr,5), '](https://explorer.example/address/', to_addr, ')') end as addr_cell,
 case when state='completed' then '✓' else state end as state_cell,
 case type when 'givetip' then 'tip' when 'gold' then 'gold' when 'withdraw' then 'w' when 'redeem' then 'r' when 'deposit' then 'd' else type end as type_cell,
 case when config3 is null then '-' else concat('/r/', config3) end as sub_cell,
 strftime(ts, '%Y-%m-%d') as ts_cell,
 concat('$&nbsp;', cast(cast(fiat_val as decimal(38,2)) as varchar)) as fiat_cell
from fx_action""",
)
def fmt_cell(t: Tables) -> DataFrame:
    viewer = F.lit("customer_000000007")
    return t.action.select(
        "action_id",
        cells.fmt_cell("from_user", F.col("from_user"), viewer, compact=True).alias("user_cell"),
        cells.fmt_cell("from_user", F.col("from_user"), viewer).alias("user_link"),
        cells.fmt_cell("to_addr", F.col("to_addr"), viewer).alias("addr_cell"),
        cells.fmt_cell("state", F.col("state"), viewer).alias("state_cell"),
        cells.fmt_cell("type", F.col("type"), viewer, compact=True).alias("type_cell"),
        cells.fmt_cell("config3", F.col("config3"), viewer).alias("sub_cell"),
        cells.fmt_cell("ts", F.col("ts"), viewer).alias("ts_cell"),
        cells.fmt_cell("fiat_val", F.col("fiat_val"), viewer).alias("fiat_cell"),
    )


@query("F12", r"select username_id, replace(username, '_', '\_') as shown from fx_username")
def escape_md(t: Tables) -> DataFrame:
    return t.username.select("username_id", scalars.escape_md(F.col("username")).alias("shown"))


@query(
    "F13",
    """
select a.action_id, coalesce(abs(datediff('day', u.joindate, a.ts)) <= 7, true) as is_new from fx_action a
left join fx_username n on n.service_id=a.service_id and n.username=a.from_user
left join (select user_id, joindate + INTERVAL '1' DAY * cast(user_id % 3 as int) as joindate from fx_user) u on u.user_id = n.user_id""",
)
def is_new_user(t: Tables) -> DataFrame:
    joined = t.sql("""
select a.action_id, a.ts, u.joindate from fx_action a
left join fx_username n on n.service_id=a.service_id and n.username=a.from_user
left join (select user_id, joindate + INTERVAL '1' DAY * cast(user_id % 3 as int) as joindate from fx_user) u on u.user_id = n.user_id""")
    return joined.select("action_id", scalars.is_new_user(F.col("joindate"), F.col("ts")).alias("is_new"))


@query("F14", "select action_id, ts + INTERVAL '48' HOUR as expires from fx_action")
def expires_at(t: Tables) -> DataFrame:
    return t.action.select("action_id", scalars.expires_at(F.col("ts")).alias("expires"))


@query("F16", "select fullname, case when fullname like 't4%' then 'message' else 'comment' end as kind from fx_message")
def msg_kind(t: Tables) -> DataFrame:
    return t.message.select("fullname", scalars.msg_kind(F.col("fullname")).alias("kind"))


@query("F17", "select event_id, timestamp '1970-01-01' + INTERVAL '1' SECOND * cast(1400000000 + event_id * 61 as int) as at from events")
def from_epoch(t: Tables) -> DataFrame:
    return t.base("events").select(
        "event_id", scalars.from_epoch(F.lit(1400000000) + F.col("event_id") * 61).alias("at")
    )


@query("F18", "select action_id, (action_id % 10 = 0) or coin_val >= 1000 as confirm from (select action_id, coin_val / 100 as coin_val from fx_action)")
def needs_confirmation(t: Tables) -> DataFrame:
    flag = F.col("action_id") % 10 == 0
    return t.action.select(
        "action_id", scalars.needs_confirmation(flag, F.col("coin_val") / 100).alias("confirm")
    )
