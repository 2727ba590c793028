"""Notifications, messages and report pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import Tables
from ..functions.scalars import is_new_user
from ..operators import notify as n
from ..operators import reports as p
from ..sources.sinks import route_notifications
from .registry import query

# Settled actions with all kinds of outcomes.
_SETTLED = """
select a.action_id, s.service_name as service, a.type, a.state, a.ts, a.from_user, a.to_user,
 case when a.action_id % 7 = 0 and a.to_addr is null then 'Dsneaky' else a.to_addr end as to_addr,
 a.coin_val, a.fiat_val,
 case when a.state <> 'failed' then null when a.action_id % 5 = 0 then 'not_registered' when a.action_id % 5 = 1 then 'balance_too_low'
  when a.action_id % 5 = 2 then 'tip_below_minimum' when a.action_id % 5 = 3 then 'addr_invalid' end as error,
 a.action_id % 9 = 0 as by_accept, a.action_id % 4 = 0 as verify
from fx_action a join fx_service s on s.service_id = a.service_id where a.type in ('givetip', 'withdraw')"""

_NOTES = f"""
s as ({_SETTLED}),
notes as (
 select s.*, case when to_addr is not null then 'tip_sent_sneaky' else 'tip_sent' end as kind, 'from' as audience from s
  where state='completed' and to_user is not null and not by_accept
 union all
 select s.*, case when to_addr is not null then 'tip_received_sneaky' else 'tip_received' end, 'to' from s
  where state='completed' and to_user is not null
 union all select s.*, 'withdraw', 'from' from s where state='completed' and to_user is null and to_addr is not null
 union all select s.*, error, 'from' from s where state='failed' and error is not null
 union all select s.*, 'tip_sent', 'from' from s where state='pending'
 union all select s.*, 'tip_incoming', 'to' from s where state='pending' and to_user is not null)"""


def _notes(t: Tables) -> DataFrame:
    return n.notify(t.sql(_SETTLED))


@query(
    "N1",
    f"""with {_NOTES} select action_id, type as command, kind as type, audience, from_user, to_user, to_addr, coin_val,
 case when kind='tip_incoming' then ts + INTERVAL '48' HOUR end as time_to_expire from notes""",
)
def notify(t: Tables) -> DataFrame:
    return _notes(t).select(
        "action_id", "command", "type", "audience", "from_user", "to_user", "to_addr", "coin_val", "time_to_expire"
    )


@query(
    "S8",
    f"""with {_NOTES} select action_id, kind as type, service, case when service in ('reddit','twitch','twitter') then service else 'rejected' end as queue
from (select * replace (case when action_id % 13 = 0 then 'email' else service end as service) from notes)""",
)
def write_notifications(t: Tables) -> DataFrame:
    service = F.when(F.col("action_id") % 13 == 0, "email").otherwise(F.col("service"))
    routed = route_notifications(_notes(t).withColumn("service", service))
    return routed.select("action_id", "type", "service", "queue")



@query(
    "N3",
    f"""
with {_NOTES},
k as (select x.*, coalesce(abs(datediff('day', u.joindate + INTERVAL '1' DAY * cast(u.user_id % 3 as int), x.ts)) <= 400, true) as is_new
 from notes x left join (select username, min(user_id) as user_id from fx_username group by 1) f on f.username = x.from_user
 left join fx_user u on u.user_id = f.user_id)
select action_id, kind as type, from_user as recipient, 'message' as channel, '+info failed' as subject, 'not_registered' as template from k where kind='not_registered'
union all select action_id, kind, to_user, 'message', '+tip incoming', 'tip_incoming' from k where kind='tip_incoming'
union all select action_id, kind, from_user, 'message', '+tip sent', 'withdraw_sneaky_from' from k where kind='tip_sent_sneaky'
union all select action_id, kind, to_user, 'message', '+tip received', 'withdraw_sneaky_to' from k where kind='tip_received_sneaky'
union all select action_id, kind, from_user, 'message', '+tip failed', 'address_invalid' from k where kind='addr_invalid'
union all select action_id, kind, from_user, 'message', '+withdraw succeeded', 'confirmation' from k where type='withdraw' and kind in ('tip_sent','tip_received','withdraw')
union all select action_id, kind, to_user, 'message', '+tip received', 'tip_received' from k where type='givetip' and kind='tip_received' and is_new
union all select action_id, kind, from_user, 'message', '+tip sent', 'tip_sent' from k where type='givetip' and kind='tip_sent' and is_new
union all select action_id, kind, from_user, 'reply', 'verify', 'tip_confirmation' from k where type='givetip' and kind='tip_sent' and (verify or coin_val >= 1000)""",
)
def select_messages(t: Tables) -> DataFrame:
    return _messages(t).select("action_id", "type", "recipient", "channel", "subject", "template")


def _messages(t: Tables) -> DataFrame:
    joined = t.sql(
        "select username as _name, joindate + INTERVAL '1' DAY * cast(user_id % 3 as int) as joindate from ("
        " select f.username, min(f.user_id) as user_id from fx_username f group by 1) f join fx_user u using (user_id)"
    )
    notes = _notes(t).join(joined, F.col("from_user") == F.col("_name"), "left").drop("_name")
    fresh = is_new_user(F.col("joindate"), F.col("ts"), days=400)
    return n.select_messages(notes.withColumn("is_new", fresh))


_GOLD = """
select a.action_id, s.service_name as service, a.type, a.from_user, a.to_user, u.user_id is not null as to_registered,
 case when a.state = 'completed' then 'completed' else 'failed' end as state,
 case a.state when 'completed' then null when 'pending' then 'balance_too_low' when 'failed' then 'fiat_error' when 'declined' then 'not_registered' end as error
from fx_action a join fx_service s on s.service_id = a.service_id
left join fx_username u on u.service_id = a.service_id and u.username = a.to_user where a.type = 'gold'"""


@query(
    "N1, T8 (gold)",
    f"""
with g as ({_GOLD})
select action_id, service, from_user, to_user, state, 'gold' as command, 'gold_sent' as type, 'from' as audience from g where state = 'completed'
union all select action_id, service, from_user, to_user, state, 'gold', 'gold_received', 'to' from g where state = 'completed' and to_user is not null and not to_registered
union all select action_id, service, from_user, to_user, state, 'gold', error, 'from' from g where state = 'failed' and error is not null""",
)
def notify_gold(t: Tables) -> DataFrame:
    return n.notify_gold(t.sql(_GOLD)).drop("to_registered", "error")


@query("N4")
def render(t: Tables) -> DataFrame:
    return n.render(_messages(t)).select("action_id", "type", "recipient", "channel", "template", "text")


@query("N2")
def notify_account(t: Tables) -> DataFrame:
    reports = t.action.where("type in ('history', 'info', 'register', 'accept', 'deposit')")
    requests = reports.join(t.service, "service_id").select(
        "action_id", "type", "service_name", "from_user", "coin_val", "config1", "config3"
    )
    return n.notify_account(requests, t.username, t.service, t.address, t.action)


@query(
    "N5",
    """
with c as (select action_id, ts, concat('sub/', config3) as page,
 concat_ws('|', cast(action_id as varchar), case when state='completed' then '✓' else state end, concat('$&nbsp;', cast(cast(fiat_val as decimal(38,2)) as varchar))) as line
 from fx_action where config3 is not null),
p as (select distinct page from c)
select page, 3 as section, cast(epoch_us(ts) as bigint) as k1, action_id as k2, line from c
union all select page, 3, -4611686018427387904, 0, 'action_id|state|fiat_val' from p
union all select page, 3, -4611686018427387904, 1, ':---|:---|:---' from p""",
)
def markdown_table(t: Tables) -> DataFrame:
    rows = t.action.where("config3 is not null")
    cells = p.history_cells(F.lit(""), ("action_id", "state", "fiat_val"), compact=True)
    order = (F.unix_micros(F.col("ts").cast("timestamp")), F.col("action_id"))
    return p.markdown_table(rows, F.concat(F.lit("sub/"), F.col("config3")), cells, 3, order)


@query("N6 (user pages)")
def user_pages(t: Tables) -> DataFrame:
    return p.user_pages(t.username, t.action)


@query("N6 (global page)")
def global_page(t: Tables) -> DataFrame:
    return p.global_page(t.action)


@query("S11, W5 (tips page)")
def tips_page(t: Tables) -> DataFrame:
    return p.tips_page(t.action)
