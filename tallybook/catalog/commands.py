"""Command extraction, envelopes, triage and staging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import Tables
from ..functions.address import validate_addresses
from ..operators import commands as c
from ..operators.identity import parent_author
from ..operators.rules import expand_rules
from ..sources.sinks import archive_rows
from ..settings import DEFAULT
from .registry import query


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _match_sql(public_only: bool, source: str) -> str:
    """The rule chain as DuckDB SQL: number of the first match, then its groups."""
    rules = [r for r in expand_rules() if r.public or not public_only]
    pattern = lambda r: _quote("(?is)" + r.pattern)
    number = " ".join(f"when regexp_matches(body, {pattern(r)}) then {i}" for i, r in enumerate(rules))

    def text(value: str | None) -> str:
        return "null" if value is None else _quote(value)

    def pick(field: str) -> str:
        cases = " ".join(
            f"when {i} then nullif(regexp_extract(body, {pattern(r)}, {r.group(field)}), '')"
            for i, r in enumerate(rules)
            if r.group(field)
        )
        return f"case rule_no {cases} else null end"

    def label(attribute: str) -> str:
        cases = " ".join(f"when {i} then {text(getattr(r, attribute))}" for i, r in enumerate(rules))
        return f"case rule_no {cases} end"

    return f"""
select *, {label('action')} as action, {label('name')} as rule, substr({pick('user')}, 2) as to_user,
 {pick('address')} as address, {pick('amount')} as amount, lower({pick('keyword')}) as keyword,
 case when rule_no is not null then {pick('verify')} is not null end as verify,
 {label('coin')} as coin, {label('fiat')} as fiat
from (select *, case {number} end as rule_no from {source})"""


_COLUMNS = "fullname, action, rule, to_user, address, amount, keyword, verify, coin, fiat"


@query("X1, X2 (all rules)", f"select {_COLUMNS} from ({_match_sql(False, 'fx_message')})")
def extract_commands(t: Tables) -> DataFrame:
    return c.extract_commands(t.message, public_only=False).select(*_COLUMNS.split(", "))


@query("X2 (public rules)", f"select {_COLUMNS} from ({_match_sql(True, 'fx_message')})")
def extract_public_commands(t: Tables) -> DataFrame:
    return c.extract_commands(t.message, public_only=True).select(*_COLUMNS.split(", "))


@query("X1")
def expand_rules_table(t: Tables) -> DataFrame:
    """How often each rule decides, over all messages."""
    found = c.extract_commands(t.message, public_only=False)
    return found.groupBy("action", "rule", "coin", "fiat").agg(F.count(F.lit(1)).alias("n"))


_MIXED = f"""
mixed as (
 select fullname, author, parent_id, created_utc, subreddit, body, 'message' as kind, action, rule, to_user, address, amount, keyword, verify, coin, fiat
 from ({_match_sql(False, "(select * from fx_message where fullname like 't4%')")})
 union all
 select fullname, author, parent_id, created_utc, subreddit, body, 'comment', action, rule, to_user, address, amount, keyword, verify, coin, fiat
 from ({_match_sql(True, "(select * from fx_message where fullname like 't1%')")}))"""

_BUILT = (
    _MIXED
    + """,
priced as (
 select m.*, p.author as parent_author, k.lo, k.hi,
  case when m.keyword is null then try_cast(m.amount as decimal(20,8)) end as plain
 from mixed m left join fx_message p on p.fullname = m.parent_id and m.kind = 'comment'
 left join fx_keyword k on k.keyword = m.keyword),
built as (
 select *, case when kind='comment' then coalesce(to_user, case when address is null then parent_author end) end as target from priced),
judged as (
 select *, case when action is null then 'no_match'
  when kind='message' and action='givetip' and address is null then 'needs_address'
  when kind='comment' and address is null and target is null then 'no_recipient'
  when kind='comment' and author = target then 'self_tip'
  when kind='comment' and subreddit = 'promos' then 'blocked_subreddit' end as reason from built)"""
)


def _built(t: Tables) -> DataFrame:
    cmds = parent_author(c.read_inbox_commands(t.message), t.message)
    return c.build_action(c.price_keywords(cmds, t.keyword))


@query(
    "X3",
    "with "
    + _BUILT
    + """
select fullname, kind, action, rule, author as from_user, target as to_user, address as to_addr, keyword,
 case when fiat is null then plain end as plain_coin_val,
 case when kind='message' then 'dog' else coin end as coin,
 kind='comment' and coalesce(verify, false) as verify, reason from judged""",
)
def build_action(t: Tables) -> DataFrame:
    built = _built(t)
    plain = F.when(F.col("keyword").isNull(), F.col("coin_val"))
    return built.select(
        "fullname", "kind", "action", "rule", "from_user", "to_user", "to_addr", "keyword",
        plain.alias("plain_coin_val"), "coin", "verify", "reason",
    )


@query(
    "J13",
    "with "
    + _MIXED
    + """
select m.fullname, m.keyword, k.lo, k.hi,
 case when k.lo = k.hi then cast(cast(k.lo as double) / k.divisor as decimal(20,8)) end as fixed_amount,
 m.keyword is null or m.keyword = 'all' or k.keyword is not null as priced_in_range,
 coalesce(m.keyword = 'all', false) as take_all
from mixed m left join fx_keyword k on k.keyword = m.keyword where m.action is not null""",
)
def price_keywords(t: Tables) -> DataFrame:
    cmds = c.read_inbox_commands(t.message).where("action is not null")
    priced = c.price_keywords(cmds, t.keyword)
    known = t.keyword.select(F.col("keyword").alias("_kw"), "lo", "hi", "divisor")
    judged = priced.join(known, F.col("keyword") == F.col("_kw"), "left")
    low, high = F.col("lo") / F.col("divisor"), F.col("hi") / F.col("divisor")
    inside = F.col("amount").between(low, high)
    return judged.select(
        "fullname",
        "keyword",
        "lo",
        "hi",
        F.when(F.col("lo") == F.col("hi"), F.col("amount")).alias("fixed_amount"),
        (F.col("keyword").isNull() | (F.col("keyword") == "all") | F.coalesce(inside, F.lit(False))).alias(
            "priced_in_range"
        ),
        "take_all",
    )


@query("F5")
def keyword_amount(t: Tables) -> DataFrame:
    """Spread of the drawn amounts per keyword."""
    priced = c.price_keywords(c.read_inbox_commands(t.message), t.keyword)
    return (
        priced.where(F.col("keyword").isNotNull())
        .groupBy("keyword")
        .agg(F.min("amount").alias("lowest"), F.max("amount").alias("highest"), F.count("amount").alias("n"))
    )


@query(
    "X4",
    "with "
    + _BUILT
    + """
select action as type, 'pending' as state, created_utc, author as from_user, target as to_user, address as to_addr,
 case when kind='message' then 'dog' else coin end as coin,
 case when kind='comment' then subreddit end as subreddit,
 kind='comment' and coalesce(verify, false) as verify, split_part(fullname, '_', 2) as msg_id, fullname,
 case when kind='message' then body end as msg_body, coalesce(keyword = 'all', false) as take_all,
 case when keyword is null then coalesce(plain, 0) end as plain_coin_val
from judged where reason is null""",
)
def stage_actions(t: Tables) -> DataFrame:
    return c.stage_actions(_built(t), "keyword").select(
        "type", "state", "created_utc", "from_user", "to_user", "to_addr", "coin", "subreddit", "verify",
        "msg_id", "fullname", "msg_body", "take_all",
        F.when(F.col("keyword").isNull(), F.col("coin_val")).alias("plain_coin_val"),
    )


_BANNED = "select concat('Customer_', lpad(cast(c_custkey as {s}), 9, '0')) as name from customer where c_mktsegment = 'MACHINERY'"


@query(
    "P1",
    f"""
with b as ({_BANNED.format(s='varchar')}),
m as (select fullname, case when fullname like '%7' then null when fullname like '%3' then 'TipBot' else author end as author from fx_message)
select m.fullname, m.author, case when m.author is null then 'no_author' when lower(m.author) = 'tipbot' then 'self'
 when b.name is not null then 'banned' end as drop_reason
from m left join b on lower(b.name) = lower(m.author)""",
)
def triage_inbox(t: Tables) -> DataFrame:
    author = F.when(F.col("fullname").endswith("7"), F.lit(None)).when(
        F.col("fullname").endswith("3"), F.lit("TipBot")
    ).otherwise(F.col("author"))
    inbox = t.message.select("fullname", author.alias("author"))
    return c.triage_inbox(inbox, t.sql(_BANNED.format(s="string")))


@query(
    "S4",
    """
select m.fullname, m.author, m.created_utc, m.body from fx_message m
where m.created_utc >= timestamp '2024-01-06'""",
)
def read_inbox(t: Tables) -> DataFrame:
    seen = t.message.where("created_utc < timestamp_ntz '2024-01-06'")
    return c.unread_inbox(t.message, seen).select("fullname", "author", "created_utc", "body")


_PENDING = """
select case when event_type = 'purchase' then 'withdraw' else 'givetip' end as type,
 case when event_id % 4 = 0 then 'completed' else 'pending' end as state, date_trunc('minute', ts) as created_utc,
 cast(event_id as {s}) as msg_id, m.fullname, case when event_id % 9 = 0 then null else m.author end as from_user,
 case when event_id % 6 = 0 then null else m.body end as msg_body,
 case when event_id % 7 = 0 then null else concat('/c/', cast(event_id as {s})) end as msg_link
from events e join fx_message m on m.fullname = concat(case when event_id % 2 = 0 then 't4_' else 't1_' end, cast(event_id as {s}))"""


@query(
    "P2",
    f"""
with p as ({_PENDING.format(s='varchar')})
select created_utc, msg_id, fullname, type, state from p where state = 'pending'
qualify row_number() over (partition by created_utc order by msg_id) = 1 order by created_utc limit 50""",
)
def next_pending_batch(t: Tables) -> DataFrame:
    staged = t.sql(_PENDING.format(s="string"))
    return c.next_pending_batch(staged, DEFAULT.pending_batch).select("created_utc", "msg_id", "fullname", "type", "state")


# What the derived texts mean is known from how they are made, so this oracle
# does without regular expressions.
@query(
    "P3",
    f"""
with p as ({_PENDING.format(s='varchar')}),
e as (select *, concat(case when event_id % 2 = 0 then 't4_' else 't1_' end, cast(event_id as varchar)) as fullname from events),
m as (select e.fullname, case when event_id % 2 = 1 then
   (event_type in ('purchase','click','view') or (event_type = 'signup' and event_id % 5 = 3))
  else (event_type = 'signup' or event_type = 'view') end as matched,
 event_type, event_id, user_id from e),
t as (select m.*, case when event_type='purchase' then concat('customer_', lpad(cast((user_id*3+event_id) % 150 as varchar),9,'0'))
   else (select null) end as named,
 concat('customer_', lpad(cast(user_id as varchar),9,'0')) as author from m),
j as (select t.*, f.author as parent from t join fx_message f0 on f0.fullname = t.fullname left join fx_message f on f.fullname = f0.parent_id),
u as (select *, matched and (event_id % 2 = 0 or (coalesce(named, parent) is not null and coalesce(named, parent) <> author)) as usable from j)
select p.fullname, p.msg_id,
 case when p.fullname like 't4%' then case when p.from_user is null or p.msg_body is null or u.usable then 'completed' else 'failed' end
  else case when p.live_author is null or (u.usable and p.msg_link is not null) then 'completed' else 'failed' end end as state,
 case when p.fullname like 't4%' then p.from_user is not null and p.msg_body is not null and u.usable
  else p.live_author is not null and u.usable and p.msg_link is not null end as emit
from (select p.*, case when f.subreddit <> 'sub1' then f.author end as live_author from p left join fx_message f on f.fullname = p.fullname) p
join u on u.fullname = p.fullname""",
)
def triage_pending(t: Tables) -> DataFrame:
    staged = t.sql(_PENDING.format(s="string"))
    live = t.message.where("subreddit <> 'sub1'")
    matches = _built(t).where(F.col("reason").isNull()).select("fullname")
    return c.triage_pending(staged, live, matches).select("fullname", "msg_id", "state", "emit")


def _envelopes(t: Tables) -> DataFrame:
    """Queue messages made from the ledger; some are broken in known ways."""
    n = F.col("action_id") % 20
    body = F.to_json(
        F.struct(
            F.when(n != 1, F.col("service_name")).alias("service"),
            F.when(n != 2, F.col("type")).alias("type"),
            F.when(n != 3, F.col("from_user")).alias("u_from"),
            F.when(n != 4, F.col("to_user")).alias("u_to"),
            F.col("to_addr").alias("addr_to"),
            F.when(n == 5, F.lit("all")).otherwise(F.col("coin_val").cast("string")).alias("coin_val"),
            F.col("config1").alias("msgid"),
            F.concat(F.lit("t1_"), F.col("action_id").cast("string")).alias("fullname"),
            F.col("config3").alias("subreddit"),
            F.concat(F.lit("/c/"), F.col("action_id").cast("string")).alias("permalink"),
            F.col("config1").alias("channel"),
            F.col("config1").alias("tweet_id"),
        )
    )
    whole = F.to_json(F.struct(F.col("action_id").cast("string").alias("id"), F.lit("r").alias("reservation_id"), body.alias("body")))
    joined = t.action.join(t.service, "service_id")
    return joined.select(
        F.col("action_id").alias("message_id"),
        F.when(n == 6, F.lit("{broken")).otherwise(whole).alias("message"),
    )


_COMMANDS = """
b as (
 select action_id as message_id, action_id % 20 as n,
  case when action_id % 20 not in (1, 6) then service_name end as service,
  case when action_id % 20 not in (2, 6) then type end as type,
  case when action_id % 20 not in (3, 6) then from_user end as u_from,
  case when action_id % 20 not in (4, 6) then to_user end as u_to,
  case when action_id % 20 <> 6 then to_addr end as addr_to,
  case when action_id % 20 not in (5, 6) then coin_val end as amount, config1, config3
 from fx_action a join fx_service s on s.service_id = a.service_id),
cmd as (select *, case when n = 6 then 'no_body' when service is null then 'no_service' when type is null then 'no_type'
  when u_from is null then 'no_sender'
  when type in ('givetip','withdraw') and (u_to is null) = (addr_to is null) then 'target_not_unique' end as reject_reason from b)"""


@query(
    "S2",
    f"with {_COMMANDS} select message_id, service, type, u_from, u_to, addr_to, amount, n = 5 as take_all, reject_reason from cmd",
)
def read_commands(t: Tables) -> DataFrame:
    return c.read_commands(_envelopes(t)).select(
        "message_id", "service", "type", "u_from", "u_to", "addr_to", "amount", "take_all", "reject_reason"
    )


@query(
    "P6",
    f"""with {_COMMANDS} select message_id, type,
 case type when 'withdraw' then 'givetip' when 'deposit' then 'unsupported' else type end as route from cmd where reject_reason is null""",
)
def route_commands(t: Tables) -> DataFrame:
    return c.route_commands(c.accepted(c.read_commands(_envelopes(t)))).select("message_id", "type", "route")


@query(
    "P4",
    f"""with {_COMMANDS} select message_id, service, config1,
 case when service='reddit' then concat('t1_', cast(message_id as varchar)) end as config2,
 case when service='reddit' then config3 end as config3,
 case when service='reddit' then concat('/c/', cast(message_id as varchar)) end as config4
from cmd where reject_reason is null""",
)
def project_service_config(t: Tables) -> DataFrame:
    usable = c.accepted(c.read_commands(_envelopes(t)))
    return c.project_service_config(usable).select(
        "message_id", "service", "config1", "config2", "config3", "config4"
    )


@query("S3", "select body as message, created_utc as timestamp from fx_message")
def archive_raw(t: Tables) -> DataFrame:
    raw = t.message.select(F.col("body").alias("message"), "created_utc")
    return archive_rows(raw, "message", F.col("created_utc")).drop("message_id")


@query("F15", "select address_id, address, false as addr_valid from fx_address where address is not null")
def valid_address(t: Tables) -> DataFrame:
    # md5-made addresses have a good shape but no valid checksum; see the tests
    # for genuine ones.
    return validate_addresses(t.address.where("address is not null"), "address").select(
        "address_id", "address", "addr_valid"
    )
