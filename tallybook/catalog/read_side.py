"""Ledger analytics: statistics, histories, look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import Tables
from ..functions.scalars import account_value
from ..operators import history, identity, stats
from ..schemas import ACTION_DDL, conform
from ..settings import DEFAULT
from .registry import query

D38 = "decimal(38,8)"


@query(
    "S1",
    """
select cast(action_id as bigint) as action_id, cast(service_id as bigint) as service_id, type, state,
 cast(null as varchar) as error, ts, from_user, to_user, to_addr, coin_val, fiat_val, txid,
 cast(null as decimal(20,8)) as txfee, coin, fiat, config1, cast(null as varchar) as config2, config3
from fx_action""",
)
def load_ledger(t: Tables) -> DataFrame:
    full = conform(t.action, ACTION_DDL)
    return full.drop(*[f"config{i}" for i in range(4, 11)])


@query(
    "A1 (Achievement procedure)",
    """
select u.user_id,
 cast(sum(case when a.role='s' and a.type='givetip' and a.to_user is not null then a.coin_val end) as decimal(38,8)) as coins_sent,
 cast(sum(case when a.role='r' and a.type='givetip' then a.coin_val end) as decimal(38,8)) as coins_received,
 count(case when a.role='s' and a.type='givetip' and a.to_user is not null then a.coin_val end) as tips_sent,
 count(case when a.role='r' and a.type='givetip' then a.coin_val end) as tips_received,
 count(distinct case when a.role='s' and a.type='givetip' then a.to_user end) as tips_sent_unique,
 count(case when a.role='s' and a.type='deposit' and a.to_user is null then a.coin_val end) as deposit_count,
 count(case when a.role='s' and a.type='givetip' and a.to_user is null and a.to_addr is not null then a.coin_val end) as withdraw_count
from fx_username u left join (
 select 's' as role, from_user as name, * from fx_action where state='completed'
 union all
 select 'r' as role, to_user as name, * from fx_action where state='completed' and to_user is not null and from_user is not null
) a on a.service_id = u.service_id and a.name = u.username
group by u.user_id""",
)
def achievements(t: Tables) -> DataFrame:
    return stats.achievements(t.username, t.action)


@query(
    "A2 (channel statistics procedure)",
    """
select substr(config1, 2) as channel, cast(sum(coin_val) as decimal(38,8)) as total_tip_amount,
 count(action_id) as total_tip_count,
 cast(cast(sum(coin_val) as decimal(38,8)) as double) / count(coin_val) as average_tip_amount,
 count(distinct from_user) as total_tip_users
from fx_action
where service_id = 2 and type = 'givetip' and state in ('pending','completed') and config1 like '#%'
group by 1""",
)
def channel_stats(t: Tables) -> DataFrame:
    return stats.channel_stats(t.action)


@query(
    "A3 (Info procedure)",
    """
with s as (
 select u.user_id, sum(a.coin_val) as v from fx_username u join fx_action a
  on a.service_id = u.service_id and a.from_user = u.username
 where a.state='completed' and a.type='givetip' group by 1),
r as (
 select u.user_id, sum(a.coin_val) as v from fx_username u join fx_action a
  on a.service_id = u.service_id and a.to_user = u.username
 where a.state='completed' and a.type='givetip' group by 1)
select u.user_id, d.balance, cast(s.v as decimal(38,8)) as total_sent,
 cast(r.v as decimal(38,8)) as total_received, d.address
from (select distinct user_id from fx_username) u
left join fx_address d on d.user_id = u.user_id and d.coin = 'dog'
left join s on s.user_id = u.user_id left join r on r.user_id = u.user_id""",
)
def account_info(t: Tables) -> DataFrame:
    return stats.account_info(t.address, t.username, t.action)


@query(
    "A4",
    """
with s as (
 select u.user_id, sum(a.coin_val) as c, sum(a.fiat_val) as f from fx_username u join fx_action a
  on a.service_id = u.service_id and a.from_user = u.username
 where a.state='completed' and a.type='givetip' group by 1),
r as (
 select u.user_id, sum(a.coin_val) as c, sum(a.fiat_val) as f from fx_username u join fx_action a
  on a.service_id = u.service_id and a.to_user = u.username
 where a.state='completed' and a.type='givetip' group by 1)
select u.user_id,
 cast(coalesce(s.c,0) as decimal(38,8)) as total_sent,
 cast(coalesce(r.c,0) as decimal(38,8)) as total_received,
 cast(cast(trunc(coalesce(s.f,0) * 100000000) as decimal(29,0)) * cast(0.00000001 as decimal(9,8)) as decimal(38,8)) as total_fiat_sent,
 cast(cast(trunc(coalesce(r.f,0) * 100000000) as decimal(29,0)) * cast(0.00000001 as decimal(9,8)) as decimal(38,8)) as total_fiat_received
from (select distinct user_id from fx_username) u
left join s on s.user_id = u.user_id left join r on r.user_id = u.user_id""",
)
def user_totals(t: Tables) -> DataFrame:
    return stats.user_totals(t.username, t.action)


_TOP = """
 select '{metric}' as metric, row_number() over (order by amount desc, label) as position, label, amount, n from (
  select {label} as label, cast(sum(coin_val) as decimal(38,8)) as amount, count(*) as n from fx_action
  where state='completed' and type='givetip' and {label} is not null group by 1) qualify position <= 10"""


@query(
    "A6",
    """
with tot as (
 select 'by_type' as metric, cast(0 as bigint) as position, type as label, cast(sum(coin_val) as decimal(38,8)) as amount, count(*) as n from fx_action group by type
 union all
 select 'by_state', 0, state, cast(sum(coin_val) as decimal(38,8)), count(*) from fx_action group by state
 union all
 select 'by_coin', 0, coin, cast(sum(coin_val) as decimal(38,8)), count(*) from fx_action group by coin)
select * from tot union all """
    + " union all ".join(
        "select * from (" + _TOP.format(metric=m, label=c) + ")"
        for m, c in (("top_tippers", "from_user"), ("top_receivers", "to_user"), ("top_subreddits", "config3"))
    ),
)
def global_stats(t: Tables) -> DataFrame:
    return stats.global_stats(t.action)


@query(
    "A7",
    """
with roles as (
 select 'tipped' as direction, u.user_id, a.* from fx_username u join fx_action a
  on a.service_id=u.service_id and a.from_user=u.username where a.state='completed' and a.type='givetip'
 union all
 select 'received', u.user_id, a.* from fx_username u join fx_action a
  on a.service_id=u.service_id and a.to_user=u.username where a.state='completed' and a.type='givetip')
select user_id, direction, 'coin' as kind, coin as unit, cast(sum(coin_val) as decimal(38,10)) as total
from roles group by 1,2,3,4
union all
select user_id, direction, 'fiat' as kind, fiat as unit, cast(sum(fiat_val) as decimal(38,10)) as total
from roles group by 1,2,3,4""",
)
def user_stats(t: Tables) -> DataFrame:
    return stats.user_stats(t.username, t.action)


@query(
    "A8",
    """
with h as (select * from fx_action where state='completed' and type in ('givetip','redeem','withdraw','deposit','gold')),
s as (select service_id, from_user as username, sum(case when type='givetip' then fiat_val end) as v, count(*) as n from h group by 1,2),
r as (select service_id, to_user as username, sum(case when type='givetip' then fiat_val end) as v,
  count(case when to_user <> from_user then 1 end) as n from h where to_user is not null group by 1,2)
select u.service_id, u.username,
 concat_ws(' / ',
  case when s.v is not null then concat('tipped[$', cast(cast(s.v as decimal(38,2)) as varchar), '] (', cast(coalesce(s.n,0) as varchar), ')') end,
  case when r.v is not null then concat('received[$', cast(cast(r.v as decimal(38,2)) as varchar), '] (', cast(coalesce(r.n,0) as varchar), ')') end) as flair
from (select distinct service_id, username from fx_username) u
left join s on s.service_id=u.service_id and s.username=u.username
left join r on r.service_id=u.service_id and r.username=u.username
where s.v is not null or r.v is not null""",
)
def flair(t: Tables) -> DataFrame:
    return stats.flair(t.username, t.action)


@query(
    "J1",
    """
select a.action_id, s.service_name, a.from_user, s.service_id, u.user_id,
 u.user_id is not null as is_registered
from fx_action a join fx_service s on s.service_id=a.service_id
left join fx_username u on u.service_id=a.service_id and u.username=a.from_user""",
)
def resolve_users(t: Tables) -> DataFrame:
    named = t.action.join(t.service, "service_id").select("action_id", "service_name", "from_user")
    return identity.resolve_users(named, t.username, t.service)


@query(
    "J2",
    """
select u.user_id, u.username_id, s.service_name, u.username,
 row_number() over (partition by u.user_id order by u.username_id) as position
from fx_username u join fx_service s on s.service_id=u.service_id""",
)
def linked_accounts(t: Tables) -> DataFrame:
    return identity.linked_accounts(t.username, t.service)


@query(
    "J3, W2 (user history procedure)",
    """
with h as (
 select u.user_id, a.action_id, s.service_name, a.type, a.state, a.ts, a.from_user, a.to_user, a.to_addr,
  a.coin_val, a.fiat_val, a.coin, a.fiat, a.config1, a.config3
 from fx_username u join fx_action a on a.service_id=u.service_id join fx_service s on s.service_id=a.service_id
 where (a.from_user=u.username or a.to_user=u.username)
  and a.type in ('givetip','redeem','withdraw','deposit','gold'))
select user_id, row_number() over (partition by user_id order by ts desc, action_id desc) as position,
 action_id, service_name, type, state, ts, from_user, to_user, to_addr, coin_val, fiat_val, coin, fiat, config1, config3
from h qualify position <= 50""",
)
def user_history(t: Tables) -> DataFrame:
    return history.user_history(t.username, t.action, t.service)


@query(
    "W2 (second page)",
    """
with h as (
 select u.user_id, a.action_id, a.ts
 from fx_username u join fx_action a on a.service_id=u.service_id
 where (a.from_user=u.username or a.to_user=u.username)
  and a.type in ('givetip','redeem','withdraw','deposit','gold'))
select user_id, row_number() over (partition by user_id order by ts desc, action_id desc) as position, action_id
from h qualify position between 6 and 10""",
)
def user_history_page(t: Tables) -> DataFrame:
    paged = history.user_history(t.username, t.action, t.service, page=2, size=5)
    return paged.select("user_id", "position", "action_id")


@query(
    "W1 (channel history procedure)",
    """
select substr(config1, 2) as channel,
 row_number() over (partition by config1 order by ts desc, action_id desc) as position,
 action_id, state, ts, from_user, to_user, to_addr, coin_val
from fx_action
where service_id = 2 and type='givetip' and state in ('pending','completed') and config1 like '#%'
qualify position between 26 and 50""",
)
def channel_history(t: Tables) -> DataFrame:
    return history.channel_history(t.action, size=25, page=2).select(
        "channel", "position", "action_id", "state", "ts", "from_user", "to_user", "to_addr", "coin_val"
    )


@query(
    "W5",
    """
select row_number() over (order by ts desc, action_id desc) as row_no, action_id, ts, from_user, to_user, to_addr, coin_val, fiat_val
from fx_action where type='givetip' and state='completed'""",
)
def tips_list(t: Tables) -> DataFrame:
    return history.tips_list(t.action).select(
        "row_no", "action_id", "ts", "from_user", "to_user", "to_addr", "coin_val", "fiat_val"
    )


@query(
    "W4",
    "select txid, created_time from fx_unprocessed order by created_time, txid limit 10000",
)
def oldest_unprocessed(t: Tables) -> DataFrame:
    return history.oldest_unprocessed(t.unprocessed, DEFAULT.unprocessed_batch)


@query(
    "P5",
    """
select action_id, ts, from_user, to_user, config3 from fx_action
where type='givetip' and state='pending' and coin='dog' and service_id=1 and config3='sub10'
 and ts < timestamp '1998-01-01'""",
)
def find_actions(t: Tables) -> DataFrame:
    found = history.find_actions(
        t.action,
        command="givetip",
        state="pending",
        coin="dog",
        service_id=1,
        subr="sub10",
        timestamp=F.col("ts") < F.lit("1998-01-01").cast("timestamp_ntz"),
    )
    return found.select("action_id", "ts", "from_user", "to_user", "config3")


@query(
    "P5 (existence check)",
    """
select count(*) > 0 as found from fx_action
where type='givetip' and service_id=2 and state='completed' and config1='#chan7'""",
)
def action_exists(t: Tables) -> DataFrame:
    return history.action_exists(
        t.action, command="givetip", state="completed", service_id=2, channel="#chan7"
    )


@query(
    "P7",
    "select username_id, lower(c_name) as username from fx_username u join customer c on c.c_custkey+1 = u.user_id",
)
def normalize_identity(t: Tables) -> DataFrame:
    raw = t.sql("select username_id, c_name as username from fx_username u join customer c on c.c_custkey+1 = u.user_id")
    return identity.normalize_identity(raw, ("username",))


@query(
    "J4",
    """
with m as (
 select address_id, address, case when user_id % 7 = 0 then user_id + 500000000 else user_id end as user_id,
  case when user_id % 7 = 0 then user_id end as user_id_alias from fx_address),
f as (select user_id, min(username_id) as username_id from fx_username group by 1)
select m.address_id, m.address, coalesce(f1.user_id, f2.user_id) as owner_id, u.service_id, s.service_name, u.username
from m left join f f1 on f1.user_id = m.user_id left join f f2 on f2.user_id = m.user_id_alias
left join fx_username u on u.username_id = coalesce(f1.username_id, f2.username_id)
left join fx_service s on s.service_id = u.service_id
where m.address is not null""",
)
def address_owner(t: Tables) -> DataFrame:
    # Every seventh address belongs to a merged account: only its alias has names.
    merged = F.col("user_id") % 7 == 0
    addresses = t.address.withColumn("user_id_alias", F.when(merged, F.col("user_id"))).withColumn(
        "user_id", F.when(merged, F.col("user_id") + 500_000_000).otherwise(F.col("user_id"))
    )
    return identity.address_owner(addresses, t.username, t.service)


@query(
    "J5",
    """
with a as (
 select a.action_id, a.service_id, a.from_user,
  case when a.action_id % 4 = 0 then (select min(address) from fx_address) else
   coalesce(d.address, a.to_addr) end as to_addr
 from fx_action a left join fx_address d on d.user_id = (a.action_id % 1000) + 1 and a.action_id % 2 = 0
 where a.to_addr is not null),
n as (select user_id, service_id, min(username_id) as username_id from fx_username group by 1,2)
select a.action_id, a.service_id, a.from_user, a.to_addr, u.username as to_user, u.username is not null as internal
from a left join fx_address d on d.address = a.to_addr
left join n on n.user_id = d.user_id and n.service_id = a.service_id
left join fx_username u on u.username_id = n.username_id""",
)
def resolve_internal_address(t: Tables) -> DataFrame:
    withdrawals = t.sql("""
select a.action_id, a.service_id, a.from_user, cast(null as string) as to_user,
  case when a.action_id % 4 = 0 then (select min(address) from fx_address) else
   coalesce(d.address, a.to_addr) end as to_addr
 from fx_action a left join fx_address d on d.user_id = (a.action_id % 1000) + 1 and a.action_id % 2 = 0
 where a.to_addr is not null""")
    return identity.resolve_internal_address(withdrawals, t.address, t.username)


@query(
    "J6",
    """
select distinct u.username, s.service_name from fx_action a
join fx_username u on u.username=a.to_user and u.service_id=a.service_id
join fx_service s on s.service_id=u.service_id where a.type='givetip' and a.state='pending'""",
)
def pending_for_registered(t: Tables) -> DataFrame:
    return identity.pending_for_registered(t.action, t.username, t.service)


@query(
    "J7",
    """
select m.fullname, m.parent_id, p.author as parent_author
from fx_message m left join fx_message p on p.fullname = m.parent_id
where m.fullname like 't1%'""",
)
def parent_author(t: Tables) -> DataFrame:
    comments = t.message.where(F.col("fullname").startswith("t1"))
    return identity.parent_author(comments, t.message).select("fullname", "parent_id", "parent_author")


@query(
    "J8",
    """
select u.user_id, u.joindate from fx_user u
where u.user_id not in (select user_id from fx_address where coin='dog' and address is not null)""",
)
def users_missing_coin(t: Tables) -> DataFrame:
    return identity.users_missing_coin(t.user, t.address.where("address is not null"), "dog")


@query(
    "J9",
    """
select d.address_id, d.user_id, u.username, concat(u.username, ':', cast(d.user_id as varchar)) as wallet_name
from fx_address d join (select user_id, arg_min(username, username_id) as username from fx_username group by 1) u
 on u.user_id=d.user_id where d.address is null""",
)
def addresses_to_assign(t: Tables) -> DataFrame:
    return identity.addresses_to_assign(t.address, t.username)


@query(
    "J10",
    """
select * from (values ('reddit','tipbot'),('twitch','tipbot'),('twitter','tipbot'),('email','tipbot')) b(service_name, username)
where not exists (select 1 from fx_username u join fx_service s on s.service_id=u.service_id
 where u.username=b.username and s.service_name=b.service_name)""",
)
def missing_bot_accounts(t: Tables) -> DataFrame:
    bots = t.service.select("service_name", F.lit("tipbot").alias("username"))
    return identity.missing_bot_accounts(bots, t.username, t.service)


@query(
    "J11",
    """
select m.fullname, m.created_utc as created_time from fx_message m
where m.created_utc >= timestamp '2024-01-11'""",
)
def drop_seen(t: Tables) -> DataFrame:
    seen = t.message.where("created_utc < timestamp_ntz '2024-01-11'")
    return identity.drop_seen(t.message, seen)[1]


@query(
    "J14",
    """
with n as (
 select action_id + 1000000000 as action_id, type, service_id, config1, ts from fx_action
 union all
 select action_id + 2000000000, 'gold', service_id, config1, ts from fx_action
 union all
 select action_id + 3000000000, 'gold', service_id, config1, ts from fx_action)
select action_id, type, service_id, config1, ts from n
where service_id <> 1 or not exists (
 select 1 from fx_action a where a.service_id = 1 and a.type = n.type and a.config1 = n.config1)
qualify service_id <> 1 or row_number() over (partition by type, service_id, config1 order by ts, action_id) = 1""",
)
def drop_duplicate_actions(t: Tables) -> DataFrame:
    new = t.sql("""
select action_id + 1000000000 as action_id, type, service_id, config1, ts from fx_action
union all
select action_id + 2000000000, 'gold', service_id, config1, ts from fx_action
union all
select action_id + 3000000000, 'gold', service_id, config1, ts from fx_action""")
    return identity.drop_duplicate_actions(new, t.action)


@query(
    "F19",
    """
select user_id, balance, cast(cast(trunc(balance * cast(0.0002 as decimal(9,8)) * 100000000) as decimal(29,0))
 * cast(0.00000001 as decimal(9,8)) as decimal(38,8)) as fiat_balance from fx_address""",
)
def account_value_query(t: Tables) -> DataFrame:
    priced = t.address.withColumn("rate", F.lit("0.00020000").cast("decimal(9,8)"))
    return account_value(priced).select("user_id", "balance", "fiat_balance")
