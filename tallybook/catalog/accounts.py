"""Account operations and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import Tables
from ..operators import accounts as a
from ..operators import reconcile as r
from ..sources.chain import read_chain_tx as read_chain_tx_source
from .registry import query

# Every history request doubles as a registration request.
_REQUESTS = "select action_id, ts, service_id, from_user from fx_action where type = 'history'"
_NEW = f"""
q as ({_REQUESTS}),
f as (select service_id, from_user as name, min((ts, action_id)) as k from q
 where not exists (select 1 from fx_username u where u.service_id = q.service_id and u.username = q.from_user) group by 1, 2),
n as (select service_id, name, row_number() over (order by k) as n, k[1] as ts, k[2] as action_id from f)"""


def _registration(t: Tables) -> a.Registration:
    return a.register_users(t.sql(_REQUESTS), t.user, t.username, t.address)


@query(
    "T9 (Register procedure)",
    f"""
with {_NEW.replace("min((ts, action_id)) as k", "min(struct_pack(a := ts, b := action_id)) as k").replace("k[1]", "k.a").replace("k[2]", "k.b")}
select (select max(user_id) from fx_user) + n as user_id, (select max(username_id) from fx_username) + n as username_id,
 service_id, name as username, ts as joindate from n""",
)
def register_users(t: Tables) -> DataFrame:
    return _registration(t).username


@query(
    "T9 (outcomes)",
    f"""
with q as ({_REQUESTS}),
x as (select q.*, u.username is null as fresh,
  row_number() over (partition by q.service_id, q.from_user order by ts, action_id) as rn
 from q left join fx_username u on u.service_id = q.service_id and u.username = q.from_user)
select action_id, ts, service_id, from_user, case when fresh and rn = 1 then 'completed' else 'failed' end as state,
 case when not (fresh and rn = 1) then 'already_registered' end as error from x""",
)
def register_outcomes(t: Tables) -> DataFrame:
    return _registration(t).outcomes


_LINKS = """
select c_custkey+1 as user_id, 1 + cast(c_custkey % 2 as int) as service_id,
 concat('Customer_', lpad(cast(c_custkey - c_custkey % 3 as {s}), 9, '0')) as username, c_custkey as seq
from customer where c_custkey % 5 <> 4"""


@query(
    "T10 (RegisterService procedure)",
    f"""
with l as (select user_id, service_id, lower(username) as username, seq from ({_LINKS.format(s='varchar')}))
select user_id, service_id, username from l
where not exists (select 1 from fx_username u where u.service_id = l.service_id and u.username = l.username)
qualify row_number() over (partition by service_id, username order by seq) = 1""",
)
def link_service(t: Tables) -> DataFrame:
    return a.link_service(t.sql(_LINKS.format(s="string")), t.username)


_OWNER = """
ow as (select m1.user_id_merge as user_id, coalesce(m2.user_id_main, m1.user_id_main) as owner
 from fx_merge m1 left join fx_merge m2 on m2.user_id_merge = m1.user_id_main and m2.seq > m1.seq)"""


@query(
    "T11 (Merge procedure, addresses)",
    f"""
with {_OWNER},
b as (select coalesce(o.owner, d.user_id) as user_id, sum(d.balance) as held from fx_address d left join ow o on o.user_id = d.user_id group by 1)
select d.address_id, d.user_id, o.owner as user_id_alias, cast(coalesce(b.held, 0) as decimal(20,8)) as balance
from fx_address d left join ow o on o.user_id = d.user_id left join b on b.user_id = d.user_id""",
)
def merge_accounts(t: Tables) -> DataFrame:
    merged = a.merge_accounts(t.merge, t.username, t.address)[1]
    return merged.select("address_id", "user_id", "user_id_alias", "balance")


@query(
    "T11 (Merge procedure, names)",
    f"""
with {_OWNER}
select u.username_id, coalesce(o.owner, u.user_id) as user_id, u.service_id, u.username
from fx_username u left join ow o on o.user_id = u.user_id""",
)
def merge_usernames(t: Tables) -> DataFrame:
    return a.merge_accounts(t.merge, t.username, t.address)[0]


@query(
    "T12",
    """
with g as (select user_id from fx_user where joindate < timestamp '1996-01-01')
select 'user' as tbl, user_id as id from fx_user where user_id not in (select user_id from g)
union all select 'username', username_id from fx_username where user_id not in (select user_id from g)
union all select 'address', address_id from fx_address where user_id not in (select user_id from g)""",
)
def delete_users(t: Tables) -> DataFrame:
    gone = t.user.where("joindate < timestamp '1996-01-01'")
    tables = a.delete_users(gone, t.user, t.username, t.address)
    rows = [
        df.select(F.lit(name).alias("tbl"), F.col(key).alias("id"))
        for name, key, df in zip(("user", "username", "address"), ("user_id", "username_id", "address_id"), tables)
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


_UPDATES = """
select action_id, 'completed' as state, ts, from_user, coin_val, 1 as version from fx_action where state = 'pending'
union all
select action_id, 'expired', ts, from_user, coin_val * 2, 2 from fx_action where state = 'pending' and type = 'givetip'
union all
select action_id + 700000000000, 'failed', ts, from_user, coin_val, 1 from fx_action where state = 'declined'"""


@query(
    "S7",
    f"""
with b as (select action_id, state, ts, from_user, to_user, coin_val, cast(action_id % 100 as decimal(20,8)) as txfee from fx_action),
u as (select * from ({_UPDATES}) qualify row_number() over (partition by action_id order by version desc) = 1)
select b.* from b where not exists (select 1 from u where u.action_id = b.action_id)
union all
select u.action_id, u.state, u.ts, u.from_user, null, cast(u.coin_val as decimal(20,8)), b.txfee from u left join b on b.action_id = u.action_id""",
)
def upsert_actions(t: Tables) -> DataFrame:
    base = t.action.select(
        "action_id", "state", "ts", "from_user", "to_user", "coin_val",
        (F.col("action_id") % 100).cast("decimal(20,8)").alias("txfee"),
    )
    return a.upsert_actions(base, t.sql(_UPDATES))


# --- chain -------------------------------------------------------------------

_DETAILS = """
select txid, n, category, confirmations, address, amount,
 case when l_orderkey % 17 = 0 then null else 'acct' end as account,
 cast(-(n % 7) as decimal(20,8)) as fee, 1400000000 + l_orderkey as blocktime from fx_chain_tx"""


@query(
    "S5",
    """
select txid, confirmations, n, category, amount, address from (
 select concat(txid, '-', cast(n as varchar)) as txid, confirmations, 1 as n, category, amount, address from fx_chain_tx
 union all
 select concat(txid, '-', cast(n as varchar)), confirmations, 2, 'fee', cast(0.5 as decimal(20,8)), address from fx_chain_tx)""",
)
def read_chain_tx(t: Tables) -> DataFrame:
    def detail(category, amount):
        return F.struct(category.alias("category"), amount.alias("amount"), F.lit("acct").alias("account"), F.col("address"))

    payload = F.to_json(
        F.struct(
            F.concat_ws("-", "txid", F.col("n").cast("string")).alias("txid"),
            "confirmations",
            F.array(
                detail(F.col("category"), F.col("amount")),
                detail(F.lit("fee"), F.lit("0.50000000").cast("decimal(20,8)")),
            ).alias("details"),
        )
    )
    raw = t.chain_tx.select(payload.alias("payload"))
    return read_chain_tx_source(raw).select("txid", "confirmations", "n", "category", "amount", "address")


# A few deposits are recorded already.
_RECORDED = """
select txid, address as to_addr, 'deposit' as type from fx_chain_tx where confirmations = 8 and category = 'generate'"""
_HEADS = f"""
d as ({_DETAILS}),
h as (select txid, first(category order by n, address, amount, category) as category,
  first(fee order by n, address, amount, category) as fee from d
 group by txid having max(confirmations) >= 6),
q as (select h.* from h where h.txid in (select txid from fx_unprocessed))"""
_OUTCOMES = (
    _HEADS
    + f""",
fu as (select user_id, min(username_id) as username_id from fx_username group by 1),
o as (select d.address, d.user_id, u.service_id, s.service_name, u.username from fx_address d
 join fu on fu.user_id = d.user_id join fx_username u on u.username_id = fu.username_id
 join fx_service s on s.service_id = u.service_id where d.address is not null),
p as (select txid, address, arg_min(amount, (n, amount)) filter (account is not null) as amount, max(blocktime) as blocktime,
  count(*) as n_details, count(account) as named from d where txid in (select txid from q where category in ('receive','generate')) group by 1, 2),
rec as (select distinct txid, to_addr from ({_RECORDED})),
outc as (select p.txid, p.address, case when named = 0 then 'no_account' when rec.txid is not null then 'repeat'
  when o.username is null then 'unknown_owner' else 'credited' end as outcome, p.amount, p.n_details, p.blocktime,
  o.user_id, o.service_id, o.service_name, o.username
 from p left join o on o.address = p.address left join rec on rec.txid = p.txid and rec.to_addr = p.address)"""
)
_OUTCOMES = _OUTCOMES.replace("arg_min(amount, (n, amount))", "arg_min(amount, struct_pack(a := n, b := amount))")


def _deposits(t: Tables, found: DataFrame | None = None) -> DataFrame:
    return r.reconcile_deposits(
        t.unprocessed, t.sql(_DETAILS), t.address, t.username, t.service, t.sql(_RECORDED), found=found
    )


@query("T6", f"with {_OUTCOMES} select * from outc")
def reconcile_deposits(t: Tables) -> DataFrame:
    return _deposits(t)


@query(
    "T6 (ledger rows)",
    f"""with {_OUTCOMES} select service_id, 'deposit' as type, 'completed' as state,
 timestamp '1970-01-01' + INTERVAL '1' SECOND * cast(blocktime as int) as ts, username as from_user, address as to_addr, amount as coin_val, 'dog' as coin, txid
from outc where outcome='credited'""",
)
def deposit_actions(t: Tables) -> DataFrame:
    return r.deposit_actions(_deposits(t))


@query(
    "T7",
    f"""with {_HEADS} select a.action_id, a.txid, 'completed' as state, abs(q.fee) as txfee
from q join fx_action a on a.txid = q.txid where q.category = 'send'""",
)
def confirm_withdrawals(t: Tables) -> DataFrame:
    return r.confirm_withdrawals(t.unprocessed, t.sql(_DETAILS), t.action)


@query(
    "T6, T7 (queue afterwards)",
    f"""with {_OUTCOMES} select txid, created_time from fx_unprocessed
where txid not in (select txid from outc where outcome <> 'unknown_owner')
 and txid not in (select txid from q where category = 'send' and txid in (select txid from fx_action where txid is not null))
 and txid not in (select txid from q where category not in ('send','receive','generate'))""",
)
def unprocessed_after(t: Tables) -> DataFrame:
    found = r.confirmed(t.unprocessed, t.sql(_DETAILS))
    return r.unprocessed_after(t.unprocessed, t.sql(_DETAILS), _deposits(t, found), t.action, found=found)
