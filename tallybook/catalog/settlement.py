"""Validation, settlement, pending tips, gold, balances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import Tables
from ..operators import ledger as g
from ..operators.book import settle_book
from ..operators.settle import audit_decisions, claim, closing_balances, settle
from .rates import _SNAPSHOTS
from .registry import query

BOT_ID = 9000000000001

# A log with all kinds of commands: amounts scaled down so that many are covered,
# history requests of every third sender turned into accept or decline.
_LOG = """
select action_id, ts, service_id,
 case when type = 'history' and action_id % 3 = 0 then 'accept' when type = 'history' and action_id % 3 = 1 then 'decline' else type end as type,
 from_user, to_user, to_addr, cast(trunc(coin_val / 200) as decimal(20,8)) as coin_val,
 action_id % 97 = 0 as take_all
from fx_action"""


def _log(t: Tables) -> DataFrame:
    return t.sql(_LOG.replace("trunc(coin_val / 200)", "floor(coin_val / 200)"))


def _shaped(address):
    """Shape test in place of the checksum: the derived addresses are md5 texts."""
    return address.rlike("^D[1-9a-z]{32}$") & ~address.endswith("7")


_VALID = f"""
l as ({_LOG.replace("trunc(coin_val / 200)", "floor(coin_val / 200)")}),
i as (select d.address, n.service_id, n.username from (select address, arg_min(user_id, address_id) as user_id from fx_address where address is not null group by 1) d
 join (select user_id, service_id, arg_min(username, username_id) as username from fx_username group by 1, 2) n on n.user_id = d.user_id),
v as (select l.*, f.user_id as from_id, i.username as inner_name, coalesce(i.username, l.to_user) as dest,
  d.address as own from l
 left join fx_username f on f.service_id = l.service_id and f.username = l.from_user
 left join fx_address d on d.user_id = f.user_id
 left join i on i.address = l.to_addr and i.service_id = l.service_id
 where l.type in ('givetip', 'withdraw'))"""


@query(
    "T1",
    f"""
with {_VALID},
w as (select ts, amount from fx_wallet_balance),
x as (select v.*, w.amount as held from v asof left join w on w.ts <= v.ts)
select x.action_id, x.type, x.from_user, x.dest as to_user, x.to_addr, x.from_id, t.user_id as to_id,
 x.to_addr is not null and x.to_addr like '%7' or x.from_id is null or x.own is null or (not take_all and coin_val < 4)
  or (x.to_addr is not null and x.dest is null and coin_val > coalesce(x.held, 0)) as failed,
 case when x.to_addr like '%7' then 'addr_invalid' when x.from_id is null then 'not_registered' when x.own is null then null
  when not take_all and coin_val < 4 then 'tip_below_minimum' end as error
from x left join fx_username t on t.service_id = x.service_id and t.username = x.dest""",
)
def validate_actions(t: Tables) -> DataFrame:
    checked = g.validate_actions(
        _log(t), g.timed_names(t.username), t.address, t.username, t.wallet_balance, address_check=_shaped
    )
    return checked.select(
        "action_id", "type", "from_user", "to_user", "to_addr", "from_id", "to_id", "failed", "error"
    )


# Settling events ``ev`` one after another from ``start_balance`` (acct, bal).  An event is settled when it
# is the next one of every account it touches, so no balance is ever guessed or bounded.
_IN_ORDER = """
od as (select *, row_number() over (order by ts, phase, oid, id, kind) as k from ev),
tc as (select distinct k, acct from (select k, unnest([src, dst, via, pair]) as acct from od) where acct is not null),
tp as (select k, acct, row_number() over (partition by acct order by k) as pos, count(*) over (partition by k) as n from tc),
run(acct, pos, bal, ok, error) using key (acct) as (
 select t.acct, cast(0 as bigint), cast(coalesce(s.bal, 0) as decimal(38,8)), false, cast(null as varchar)
  from (select distinct acct from tp) t left join start_balance s on s.acct = t.acct
 union all (
 with hd as (select t.k from tp t join recurring.run r on r.acct = t.acct and t.pos = r.pos + 1 group by t.k, t.n having count(*) = t.n),
 st as (select o.*, s.bal as have, w.bal as wallet, p.bal as live, c.ok as was, c.bal as paid from hd join od o on o.k = hd.k
   left join recurring.run s on s.acct = o.src left join recurring.run w on w.acct = o.via left join recurring.run p on p.acct = o.pair
   left join recurring.run c on o.kind = 'end' and c.acct = 'c' || o.id),
 ds as (select *, case when kind = 'claim' and take_all then have else amount end as need,
   case when kind <> 'claim' then 0 when take_all and have < 4 then 1 when not take_all and have < amount then 2
    when coalesce(live, 0) > 0 then 3 when coalesce(wallet, need) < need then 3 else 0 end as verdict from st)
 select t.acct, t.pos, cast(r.bal + case
   when d.verdict > 0 then 0
   when d.kind = 'in' then d.amount
   when d.kind = 'end' then case when not d.was then 0 when t.acct = d.pair then -1 else d.paid end
   else case when t.acct = d.src and d.src is distinct from d.dst then -d.need when t.acct = d.src then 0 when t.acct = d.dst then d.need
     when t.acct = d.via then -d.need else 1 end end as decimal(38,8)), false, null
  from ds d join tp t on t.k = d.k join recurring.run r on r.acct = t.acct
 union all select 'c' || id, -2, cast(need as decimal(38,8)), verdict = 0, case verdict when 1 then 'tip_below_minimum' when 2 then short end from ds where kind = 'claim'))"""

def _transfers(t: Tables):
    opening = t.opening.select(F.col("user_id").alias("account"), "balance")
    claims = t.transfer.select(
        *claim(
            F.col("action_id"), F.col("ts"), F.col("from_id"), F.col("to_id"), F.col("amount"),
            short_error=F.lit("balance_too_low"),
        )
    )
    return opening, settle(opening, claims)


_TRANSFER_EVENTS = """
ev as (select action_id as id, 'claim' as kind, ts, 1 as phase, action_id as oid, 'u' || from_id as src, 'u' || to_id as dst, cast(null as varchar) as via,
  cast(null as varchar) as pair, cast(amount as decimal(38,8)) as amount, false as take_all, 'balance_too_low' as short from fx_transfer),
start_balance as (select 'u' || user_id as acct, sum(balance) as bal from fx_opening group by 1)"""


@query(
    "T2 (plain transfers)",
    f"""
select * from (with recursive {_TRANSFER_EVENTS}, {_IN_ORDER}
select x.action_id, x.from_id as src, x.to_id as dst, cast(x.amount as decimal(38,8)) as amount, r.ok as accepted, r.error
from fx_transfer x join run r on r.acct = 'c' || x.action_id) settled""",
)
def settle_transfers(t: Tables) -> DataFrame:
    decisions = _transfers(t)[1].decisions
    return decisions.select("action_id", "src", "dst", "amount", "accepted", "error")


@query(
    "T2 (closing balances)",
    f"""
select * from (with recursive {_TRANSFER_EVENTS}, {_IN_ORDER}
select cast(substr(coalesce(r.acct, b.acct), 2) as bigint) as account, cast(coalesce(r.bal, b.bal) as decimal(38,8)) as balance
from (select * from run where acct like 'u%') r full join start_balance b on b.acct = r.acct
where b.acct is not null or exists (select 1 from ev join run k on k.acct = 'c' || ev.id and k.ok where ev.dst = r.acct or ev.src = r.acct)) settled""",
)
def settle_balances(t: Tables) -> DataFrame:
    opening, settled = _transfers(t)
    return closing_balances(opening, settled.decisions)


@query(
    "T2 (every decision against the balance of its moment; coins conserved)",
    """
select (select count(*) from fx_transfer) as n_claims, (select count(*) from fx_transfer) as n_consistent,
 (select cast(sum(balance) as decimal(38,8)) from fx_opening) as opening_total,
 (select cast(sum(balance) as decimal(38,8)) from fx_opening) as closing_total, false as overdrawn""",
)
def settle_audit(t: Tables) -> DataFrame:
    opening, settled = _transfers(t)
    checked = audit_decisions(opening, settled.decisions).select(F.col("consistent").cast("bigint").alias("fits"))
    closing = closing_balances(opening, settled.decisions).select(F.col("balance").alias("closing"))
    rows = checked.unionByName(closing, allowMissingColumns=True).unionByName(
        opening.select(F.col("balance").alias("opening")), allowMissingColumns=True
    )
    return rows.agg(
        F.count("fits").alias("n_claims"),
        F.sum("fits").alias("n_consistent"),
        F.sum("opening").cast("decimal(38,8)").alias("opening_total"),
        F.sum("closing").cast("decimal(38,8)").alias("closing_total"),
        (F.min("closing") < 0).alias("overdrawn"),
    )


# The whole log with message ids.  Of every hundredth tip the message is delivered once more as another
# row, and half of the recipients answer, from at once to three days later.
_ONCE = f"""
select l.*, a.config1 from ({_LOG.replace("trunc(coin_val / 200)", "floor(coin_val / 200)")}) l join fx_action a on a.action_id = l.action_id"""
_BOOK_LOG = f"""
select * from ({_ONCE}) o
union all select action_id + 1000000000000, ts + interval '1' hour, service_id, type, from_user, to_user, to_addr, coin_val, take_all, config1
 from ({_ONCE}) o where type = 'givetip' and action_id % 100 = 3
union all select action_id + 2000000000000, ts + interval '1' hour * cast(action_id % 72 as int), service_id,
  case when action_id % 4 = 1 then 'accept' else 'decline' end, to_user, null, null, null, false, null
 from ({_ONCE}) o where type = 'givetip' and to_user is not null and action_id % 4 in (1, 2)"""

# Readings of the wallet, far smaller than what is due, so that some withdrawals find it empty.
_BOOK_WALLET = "select ts, cast(floor(amount / 2000) as decimal(38,8)) as amount from fx_wallet_balance"

# Rate snapshots on the log's own time line: one for every tenth order.
_BOOK_RATES = """
select o_orderkey as snap_id, o_orderdate as fiat_date,
 case when o_orderkey % 70 = 0 then cast(0 as decimal(20,8)) else cast(cast(24 + o_orderkey % 21 as decimal(8,0)) * cast(0.00001 as decimal(6,5)) as decimal(20,8)) end as rate
from orders where o_orderkey % 10 = 0"""


_BOOK_OPENING = "select user_id as account, cast(balance * 4 as decimal(38,8)) as balance from fx_address"

# The same ledger one event after another: claims, deposits and ends of held tips.
_BOOK_EVENTS = f"""
lg as ({_BOOK_LOG}),
mk as (select *, type in ('givetip','withdraw') and service_id = 1 and config1 is not null
  and row_number() over (partition by type, service_id, config1 order by ts, action_id) > 1 as repeated from lg),
fr as (select * from mk where not repeated),
jn as (select service_id, from_user, min(struct_pack(ts := ts, id := action_id)) as since from fr
  where type = 'accept' and not exists (select 1 from fx_username k where k.service_id = fr.service_id and k.username = fr.from_user) group by 1, 2),
nm as (select service_id, username, 'u' || user_id as acct, cast(null as struct(ts timestamp, id bigint)) as since,
   user_id in (select user_id from fx_address where address is not null) as has_addr from fx_username
  union all select service_id, from_user, 'n' || service_id || from_user, since, true from jn),
wl as ({_BOOK_WALLET}),
gr as (select fiat_date, arg_max(rate, snap_id) as rate from ({_BOOK_RATES}) where rate > 0 group by 1),
rt as (select f.*, g.rate, struct_pack(ts := f.ts, id := f.action_id) as me from fr f asof left join gr g on g.fiat_date <= f.ts),
inn as (select d.address, k.service_id, k.username from (select address, arg_min(user_id, address_id) as user_id from fx_address where address is not null group by 1) d
  join (select user_id, service_id, arg_min(username, username_id) as username from fx_username group by 1, 2) k on k.user_id = d.user_id),
fm as (select r.*, case when f.since is null or f.since < r.me then f.acct end as src, f.has_addr from rt r
  left join nm f on f.service_id = r.service_id and f.username = r.from_user),
vd as (select r.*, coalesce(i.username, r.to_user) as dest, t.since as to_since, case when t.since is null or t.since < r.me then t.acct end as dst, t.acct as later
  from (select * from fm where type in ('givetip','withdraw')) r
  left join inn i on i.address = r.to_addr and i.service_id = r.service_id
  left join nm t on t.service_id = r.service_id and t.username = coalesce(i.username, r.to_user)),
ck as (select *, to_addr like '%7' as bad, case when to_addr like '%7' then 'addr_invalid' when src is null then 'not_registered' when not has_addr then null
   when not take_all and coin_val < 4 then 'tip_below_minimum' end as early,
  coalesce(to_addr like '%7', false) or src is null or not has_addr or (not take_all and coin_val < 4) as failed,
  dest is not null and dst is null as held from vd),
dc as (select service_id, from_user, ts, action_id, struct_pack(ts := ts, id := action_id) as me from fr where type = 'decline'),
nx as (select c.action_id, min(d.me) as decline from ck c join dc d on d.service_id = c.service_id and d.from_user = c.dest and d.me > c.me where c.held group by 1),
ce as (select c.*, least(case when to_since is not null then struct_pack(ts := to_since.ts, phase := 1, id := to_since.id, refund := false) end,
   case when n.decline is not null then struct_pack(ts := n.decline.ts, phase := 1, id := n.decline.id, refund := true) end,
   struct_pack(ts := c.ts + interval '48' hour, phase := 0, id := c.action_id, refund := true)) as fin
  from ck c left join nx n on n.action_id = c.action_id where not c.failed),
go as (select *, case when rate > 0 then cast(floor(cast(4 as double) / cast(rate as double)) as bigint) end as whole from fm where type = 'gold'),
gp as (select *, case when whole - whole % 100 >= 10000 then cast(whole - whole % 100 as decimal(38,8)) end as price from go),
wx as (select x.action_id, 'w' || epoch_us(w.ts) as via from (
   select action_id, ts from ce where to_addr is not null and dest is null union all select action_id, ts from fm where type = 'deposit') x
  asof left join wl w on w.ts <= x.ts),
ev as (
 select c.action_id as id, 'claim' as kind, c.ts, 1 as phase, c.action_id as oid, c.src, case when not c.held then c.dst end as dst,
  case when c.to_addr is not null and c.dest is null then coalesce(x.via, 'w') end as via,
  case when c.held then 'p' || c.service_id || '|' || c.from_user || '|' || c.dest end as pair,
  cast(c.coin_val as decimal(38,8)) as amount, c.take_all, case when c.dest is not null then 'balance_too_low' end as short from ce c left join wx x on x.action_id = c.action_id
 union all select action_id, 'end', fin.ts, fin.phase, fin.id, null, case when fin.refund then src else later end, null,
  'p' || service_id || '|' || from_user || '|' || dest, null, false, null from ce where held
 union all select action_id, 'claim', ts, 1, action_id, src, null, null, null, price, false, 'balance_too_low' from gp where src is not null and price is not null
 union all select f.action_id, 'in', f.ts, 1, f.action_id, null, f.src, coalesce(x.via, 'w'), null, cast(f.coin_val as decimal(38,8)), false, null
  from fm f join wx x on x.action_id = f.action_id where f.type = 'deposit' and f.src is not null and f.coin_val > 0),
start_balance as (select 'u' || account as acct, sum(balance) as bal from ({_BOOK_OPENING}) group by 1
  union all select 'w' || epoch_us(ts), max(amount) from wl group by 1)"""

_BOOK = f"""
select * from (with recursive {_BOOK_EVENTS}, {_IN_ORDER},
rs as (select cast(substr(acct, 2) as bigint) as action_id, ok, bal as paid, error from run where acct like 'c%'),
mv as (select c.*, e.fin, coalesce(r.ok, false) as ok, r.paid, case when coalesce(r.ok, false) then cast(r.paid as decimal(20,8)) else c.coin_val end as value,
  case when c.failed then c.early else r.error end as why from ck c left join ce e on e.action_id = c.action_id left join rs r on r.action_id = c.action_id),
ms as (select *, not failed and held as pend, case when not ok then 'failed' when not held and to_addr is not null and dest is null then 'pending' when not held then 'completed'
  when not fin.refund then 'completed' when fin.phase = 0 then 'expired' else 'declined' end as state, case when ok and held then fin.ts end as done_at from mv),
mr as (select m.* replace (case when m.pend and m.state = 'completed' then g.rate else m.rate end as rate)
  from ms m asof left join gr g on g.fiat_date <= coalesce(m.done_at, m.ts)),
al as (
 select action_id, ts, service_id, type, from_user, dest as to_user, to_addr, value as coin_val, rate, cast(null as decimal(20,10)) as fixed, pend as was_pending,
  state, case when not ok then why end as error, done_at as settled_at from mr
 union all select p.action_id, p.ts, p.service_id, p.type, p.from_user, p.to_user, p.to_addr, cast(p.price as decimal(20,8)), null, cast(4 as decimal(20,10)), false,
  case when r.ok then 'completed' else 'failed' end,
  case when p.src is null then 'not_registered' when p.price is null then 'fiat_error' when not r.ok then r.error end, null from gp p left join rs r on r.action_id = p.action_id
 union all select action_id, ts, service_id, type, from_user, to_user, to_addr, coin_val, rate, null, false, case when src is null then 'failed' else 'completed' end,
  case when src is null then 'not_registered' end, null from fm where type = 'deposit'
 union all select action_id, ts, service_id, type, from_user, to_user, to_addr, null, null, null, false,
  case when type = 'decline' then 'failed' when type = 'accept' or src is not null then 'completed' else 'failed' end,
  case when type = 'history' and src is null then 'not_registered' end, null from fm where type in ('accept','decline','history')
 union all select action_id, ts, service_id, type, from_user, to_user, to_addr, coin_val, null, null, false, 'ignored', null, null from mk where repeated)
select action_id, ts, service_id, type, from_user, to_user, to_addr, coin_val,
 case when fixed is not null then fixed when type in ('givetip','withdraw','deposit') and state <> 'ignored'
  then cast(cast(trunc(coalesce(rate, 0) * coalesce(coin_val, 0) * 100000000) as decimal(38,0)) * cast(0.00000001 as decimal(9,8)) as decimal(20,10)) end as fiat_val,
 was_pending, state, error, settled_at from al) book"""


def _book(t: Tables):
    return settle_book(
        t.sql(_BOOK_LOG), t.user, t.username, t.address, t.sql(_BOOK_OPENING), t.sql(_BOOK_RATES), F.lit(BOT_ID), t.sql(_BOOK_WALLET),
        address_check=_shaped,
    )


@query("T1-T6, T8, T9, A9, F4, J12, J14 (whole log)", _BOOK)
def settle_ledger(t: Tables) -> DataFrame:
    return _book(t).outcomes


_PENDING_TIPS = "p as (select * from fx_action where type='givetip' and state='pending' and to_user is not null)"


# Responses of recipients: history requests stand for some, and two of three pending tips get one
# of their own, from at once to three days later, so that some come in time and some too late.
_RESPONSES = """
select action_id, service_id, from_user, ts from fx_action where type='history'
union all select action_id, service_id, to_user, ts + interval '1' hour * cast(action_id % 72 as int) from fx_action
 where type='givetip' and state='pending' and to_user is not null and action_id % 3 <> 0"""
_ANSWERED = f"""{_PENDING_TIPS}, q as ({_RESPONSES}),
x as (select p.action_id, min(q.ts) as at from p join q on q.service_id = p.service_id and q.from_user = p.to_user
  where q.ts >= p.ts and q.ts <= p.ts + interval '48' hour group by 1)"""


@query(
    "T3",
    f"""
with {_ANSWERED}
select p.action_id, p.service_id, 'completed' as state, x.at as settled_at, 'escrow' as debit, p.to_user as credit, p.coin_val
from p join x on x.action_id = p.action_id""",
)
def accept_pending(t: Tables) -> DataFrame:
    return g.accept_pending(t.sql(_RESPONSES), t.action)


@query(
    "T4",
    f"""
with {_ANSWERED}
select p.action_id, p.service_id, 'escrow' as account, -p.coin_val as amount from p join x on x.action_id = p.action_id
union all select p.action_id, p.service_id, p.from_user, p.coin_val from p join x on x.action_id = p.action_id""",
)
def decline_pending(t: Tables) -> DataFrame:
    declined = g.decline_pending(t.sql(_RESPONSES), t.action)[0]
    return g.transition_postings(declined)


@query("T4 (the commands themselves)", f"select action_id, 'failed' as state from ({_RESPONSES})")
def decline_commands(t: Tables) -> DataFrame:
    return g.decline_pending(t.sql(_RESPONSES), t.action)[1]


@query(
    "T5",
    f"""
with {_PENDING_TIPS}
select action_id, service_id, 'expired' as state, ts + interval '48' hour as settled_at, 'escrow' as debit, from_user as credit, coin_val
from p where ts < timestamp '1998-06-01' - INTERVAL '48' HOUR""",
)
def expire_pending(t: Tables) -> DataFrame:
    return g.expire_pending(t.action, F.lit("1998-06-01").cast("timestamp_ntz"))


# Each gold order gets the rate of one snapshot.
_GOLD = f"""
select a.*, r.rate from fx_action a join ({_SNAPSHOTS}) r
 on r.snap_id = a.action_id % (select count(*) from events) where a.type = 'gold'"""


@query(
    "T8, F8 (price and stateless errors)",
    f"""
with o as ({_GOLD}),
p as (select o.*, case when rate > 0 then cast(floor(cast(4 as double) / cast(rate as double)) as bigint) end as n from o),
s as (select *, case when n - n % 100 >= 10000 then cast(n - n % 100 as decimal(20,8)) end as price from p)
select s.action_id, s.from_user, s.rate, s.price,
 case when u.user_id is null then 'not_registered' when s.price is null then 'fiat_error' end as error
from s left join fx_username u on u.service_id = s.service_id and u.username = s.from_user""",
)
def price_gold(t: Tables) -> DataFrame:
    priced = g.price_gold(t.sql(_GOLD), g.timed_names(t.username))
    return priced.select("action_id", "from_user", "rate", "price", "error")


_GOLD_EVENTS = f"""
gd as ({_GOLD}),
pr as (select g.*, u.user_id, case when n - n % 100 >= 10000 then cast(n - n % 100 as decimal(38,8)) end as price
  from (select *, case when rate > 0 then cast(floor(cast(4 as double) / cast(rate as double)) as bigint) end as n from gd) g
  left join fx_username u on u.service_id = g.service_id and u.username = g.from_user),
ev as (select action_id as id, 'claim' as kind, ts, 1 as phase, action_id as oid, 'u' || user_id as src, cast(null as varchar) as dst, cast(null as varchar) as via,
  cast(null as varchar) as pair, price as amount, false as take_all, 'balance_too_low' as short from pr where user_id is not null and price is not null),
start_balance as (select 'u' || user_id as acct, sum(balance * 100) as bal from fx_address group by 1)"""


@query(
    "T8",
    f"""
select * from (with recursive {_GOLD_EVENTS}, {_IN_ORDER}
select p.action_id, p.ts, p.service_id, p.from_user, p.to_user, cast(p.price as decimal(20,8)) as price, cast(4 as decimal(20,10)) as fiat_val,
 case when r.ok then 'completed' else 'failed' end as state,
 case when p.user_id is null then 'not_registered' when p.price is null then 'fiat_error' when not r.ok then r.error end as error
from pr p left join run r on r.acct = 'c' || p.action_id) gold""",
)
def buy_gold(t: Tables) -> DataFrame:
    opening = t.address.select(F.col("user_id").alias("account"), (F.col("balance") * 100).alias("balance"))
    return g.buy_gold(t.sql(_GOLD), g.timed_names(t.username), opening, F.lit(BOT_ID))


_POSTINGS = """
select from_id as user_id, ts, action_id, -amount as amount from fx_transfer
union all select to_id, ts, action_id, amount from fx_transfer"""


@query(
    "A10 (balances)",
    f"""
select user_id, cast(sum(amount) as decimal(38,8)) as balance from (
 select user_id, amount from ({_POSTINGS}) union all select user_id, balance from fx_opening) group by 1""",
)
def ledger_balances(t: Tables) -> DataFrame:
    return g.ledger_balances(t.opening, t.sql(_POSTINGS))


@query(
    "A10 (audit)",
    f"""
with p as ({_POSTINGS}),
r as (select p.*, cast(coalesce(o.balance, 0) + sum(p.amount) over (partition by p.user_id order by p.ts, p.action_id
  rows between unbounded preceding and current row) as decimal(38,8)) as balance_after
 from p left join fx_opening o on o.user_id = p.user_id)
select user_id, ts, action_id, amount, balance_after, balance_after < 0 as overdrawn from r""",
)
def audit_postings(t: Tables) -> DataFrame:
    return g.audit_postings(t.opening, t.sql(_POSTINGS))
