"""Streams over the driver's tables, run until their input is used up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import RECIPES, Tables
from ..plans.lineage import Workspace
from ..sources.tickers import read_tickers
from ..streaming.actions import ActionStream, ArchiveStream
from ..streaming.commands import stream_commands as commands_of
from ..streaming.confirmations import DETAIL_COLUMNS, ConfirmationStream
from ..streaming.expiry import stream_expiry as ending
from ..streaming.ledger_stream import LedgerStream, stream_settle as start_settling
from ..streaming.rates import RateStream, last_quotes, stream_rates as rates_of
from ..streaming.withdrawals import stream_confirmed
from .accounts import _DETAILS, _RECORDED, _UPDATES
from .rates import PATHS
from .registry import query
from .settlement import _LOG, _shaped


def _stream_sql(t: Tables, table: str, text: str) -> DataFrame:
    """Portable SQL over a base table that is read as a stream."""
    static = t.base(table)
    stream = (
        t.spark.readStream.schema(static.schema).option("pathGlobFilter", f"{table}.parquet").parquet(t.sf_dir)
    )
    stream.createOrReplaceTempView(f"tallybook_stream_{table}")
    # The row source is the stream; counts in sub-queries stay on the table.
    head, _, tail = text.rpartition(f"from {table}")
    return t.sql(f"{head}from tallybook_stream_{table}{tail}")


def _drain(df: DataFrame, space: Workspace, name: str) -> DataFrame:
    started = (
        df.writeStream.format("parquet")
        .option("checkpointLocation", space.path(f"{name}-checkpoint"))
        .option("path", space.path(name))
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    started.awaitTermination()
    return space.spark.read.schema(df.schema).parquet(space.path(name))


@query(
    "ST1",
    """
with m as (select *, cast(split_part(fullname, '_', 2) as bigint) as id from fx_message),
j as (select m.fullname, m.author, m.id % 2 = 0 as is_msg, p.author as parent, e.event_type, e.user_id, e.event_id
 from m join events e on e.event_id = m.id left join fx_message p on p.fullname = m.parent_id),
k as (select *, case when event_type='purchase' then concat('customer_', lpad(cast((user_id*3+event_id) % 150 as varchar),9,'0')) else parent end as target from j)
select fullname, case when is_msg then case event_type when 'view' then 'history' else
   case event_id % 5 when 0 then 'register' when 1 then 'accept' when 2 then 'decline' when 3 then 'gold' else 'withdraw' end end
  else case when event_type='signup' then 'gold' else 'givetip' end end as action, author as from_user,
 case when not is_msg then target end as to_user
from k
where (is_msg and event_type in ('view', 'signup'))
 or (not is_msg and (event_type in ('purchase','click','view') or (event_type='signup' and event_id % 5 = 3)) and target is not null and target <> author)""",
)
def stream_commands(t: Tables) -> DataFrame:
    space = Workspace(t.spark, "stream-commands")
    messages = _stream_sql(t, "events", RECIPES["fx_message"])
    memo = t.message.select(F.col("fullname").alias("msg_id"), F.col("author").alias("username"))
    actions = commands_of(messages, memo, t.keyword)
    return _drain(actions.select("fullname", "action", "from_user", "to_user"), space, "actions")


@query("ST2, ST3")
def stream_settle(t: Tables) -> DataFrame:
    space = Workspace(t.spark, "stream-settle")
    # Amounts are cut to whole coins as in settle_ledger.
    text = _LOG.replace("trunc(coin_val / 200)", "floor(coin_val / 200)").replace(
        "from fx_action", f"from ({RECIPES['fx_action'].strip()})"
    )
    actions = _stream_sql(t, "orders", text)
    sink = LedgerStream(t.spark, space.path("state"), address_check=_shaped)
    sink.seed(t.user, t.username.withColumn("joindate", F.lit(None).cast("timestamp")), t.address)
    start_settling(actions, sink, space.path("checkpoint")).awaitTermination()
    return sink.outcomes(1 << 30)


@query("ST4")
def stream_confirmations(t: Tables) -> DataFrame:
    space = Workspace(t.spark, "stream-confirm")
    text = _DETAILS.replace("from fx_chain_tx", f"from ({RECIPES['fx_chain_tx'].strip()})")
    details = _stream_sql(t, "lineitem", text)
    sink = ConfirmationStream(t.spark, space.path("state"), t.address, t.username, t.service, _ledger(t))
    sink.seed()
    shaped = details.select(*[F.col(c).cast("bigint").alias(c) if c == "blocktime" else F.col(c) for c in DETAIL_COLUMNS])
    started = (
        shaped.writeStream.foreachBatch(sink)
        .option("checkpointLocation", space.path("checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    started.awaitTermination()
    return sink.credited(1 << 30)


def _ledger(t: Tables) -> DataFrame:
    """Actions with ids and transactions, with the deposits recorded already."""
    columns = ["action_id", "type", "txid", "to_addr"]
    recorded = t.sql(_RECORDED).withColumn("action_id", F.lit(None).cast("bigint"))
    return t.action.where("txid is not null and type = 'withdraw'").select(*columns).unionByName(
        recorded.select(*columns)
    )


@query(
    "ST4 (withdrawals that meet their reports)",
    f"""
with d as ({_DETAILS}),
h as (select txid, first(category order by n, address, amount, category) as category, first(fee order by n, address, amount, category) as fee
 from d group by txid having max(confirmations) >= 6)
select a.action_id, a.txid, 'completed' as state, cast(abs(h.fee) as decimal(20,8)) as txfee
from h join fx_action a on a.txid = h.txid where h.category = 'send'""",
)
def stream_withdrawals(t: Tables) -> DataFrame:
    space = Workspace(t.spark, "stream-withdrawals")
    actions = _stream_sql(t, "orders", f"select action_id, txid from ({RECIPES['fx_action'].strip()})")
    reports = _stream_sql(t, "lineitem", _DETAILS.replace("from fx_chain_tx", f"from ({RECIPES['fx_chain_tx'].strip()})"))
    return _drain(stream_confirmed(actions, reports), space, "confirmed")


# Held tips of the log, and answers of two of three recipients from at once to three days later.
_HELD = """
select action_id, ts, service_id, type, state, from_user, to_user, coin_val from fx_action
 where type='givetip' and state='pending' and to_user is not null
union all
select action_id + 1000000000000, ts + interval '1' hour * cast(action_id % 72 as int), service_id,
 case when action_id % 3 = 1 then 'accept' else 'decline' end, 'completed', to_user, null, null
 from fx_action where type='givetip' and state='pending' and to_user is not null and action_id % 3 <> 0"""


@query(
    "ST3",
    f"""
with l as ({_HELD}),
p as (select *, ts + interval '48' hour as ends from l where type = 'givetip'),
x as (select p.action_id, arg_min(q.type, (q.ts, q.action_id)) as how, min(q.ts) as at from p
 join l q on q.type <> 'givetip' and q.service_id = p.service_id and q.from_user = p.to_user and q.ts >= p.ts and q.ts <= p.ends group by 1)
select p.action_id, cast(p.service_id as bigint) as service_id,
 case when x.how = 'accept' then 'completed' when x.how = 'decline' then 'declined' else 'expired' end as state,
 coalesce(x.at, p.ends) as settled_at, 'escrow' as debit, case when x.how = 'accept' then p.to_user else p.from_user end as credit, p.coin_val
from p left join x on x.action_id = p.action_id where x.at is not null or p.ends < (select max(ts) from l)""",
)
def stream_expiry(t: Tables) -> DataFrame:
    space = Workspace(t.spark, "stream-expiry")
    log = _stream_sql(t, "orders", f"select * from ({RECIPES['fx_action'].strip()})")
    tips = log.where("type = 'givetip' AND state = 'pending' AND to_user IS NOT NULL").select(
        "action_id", "ts", "service_id", "type", "state", "from_user", "to_user", "coin_val"
    )
    answers = tips.where("action_id % 3 <> 0").select(
        (F.col("action_id") + 1_000_000_000_000).alias("action_id"),
        (F.col("ts") + F.make_interval(hours=(F.col("action_id") % 72).cast("int"))).alias("ts"), "service_id",
        F.when(F.col("action_id") % 3 == 1, "accept").otherwise("decline").alias("type"), F.lit("completed").alias("state"),
        F.col("to_user").alias("from_user"), F.lit(None).cast("string").alias("to_user"), F.lit(None).cast("decimal(20,8)").alias("coin_val"),
    )
    return _drain(ending(tips.unionByName(answers), clock="event"), space, "transitions")


_RATES = """
with q as (select time_bucket(INTERVAL '15' MINUTE, fiat_date, timestamp '1970-01-01') as window_start, fiat_date, exchange, thing_from, thing_to,
 try_cast(json_extract_string(payload, '$.return.markets.k') as double) as value from fx_ticker),
l as (select window_start, thing_from, thing_to, exchange, max(struct_pack(a := fiat_date, b := value)).b as value
 from q where value is not null group by all),
r as (select window_start, thing_from, thing_to,
 coalesce(cast(sum(case when value > 0 then cast(value as decimal(30,12)) end) as double) / nullif(count(case when value > 0 then 1 end), 0), 0.0) as rate from l group by all)
select * from r"""


@query("ST5", _RATES)
def rates_by_window(t: Tables) -> DataFrame:
    return rates_of(read_tickers(t.ticker, PATHS))


@query("ST5 (as a stream)", _RATES)
def stream_rates(t: Tables) -> DataFrame:
    space = Workspace(t.spark, "stream-rates")
    tickers = _stream_sql(t, "events", RECIPES["fx_ticker"])
    sink = RateStream(t.spark, space.path("state"))
    started = (
        last_quotes(read_tickers(tickers, PATHS)).writeStream.foreachBatch(sink)
        .option("checkpointLocation", space.path("checkpoint"))
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )
    started.awaitTermination()
    return sink.rates(1 << 30)


@query(
    "S7 (as a stream)",
    f"""
with u as (select * from ({_UPDATES}) qualify row_number() over (partition by action_id order by version desc) = 1),
b as (select action_id, state, ts, from_user, to_user, coin_val, cast(action_id % 100 as decimal(20,8)) as txfee from fx_action)
select b.* from b where not exists (select 1 from u where u.action_id = b.action_id)
union all
select u.action_id, u.state, u.ts, u.from_user, null, cast(u.coin_val as decimal(20,8)), b.txfee from u left join b on b.action_id = u.action_id""",
)
def stream_upserts(t: Tables) -> DataFrame:
    space = Workspace(t.spark, "stream-upserts")
    # Changes of the log's own rows, read as a stream; the table they change is there from the start.
    log = _stream_sql(t, "orders", f"select * from ({RECIPES['fx_action'].strip()})")
    columns = ("state", "ts", "from_user", "coin_val", "version")

    def change(rows: DataFrame, action_id, *values) -> DataFrame:
        return rows.select(action_id.alias("action_id"), *[v.alias(c) for c, v in zip(columns, values, strict=True)])

    key, amount = F.col("action_id"), F.col("coin_val").cast("decimal(20,8)")
    kept = (F.col("ts"), F.col("from_user"))
    changes = (
        change(log.where("state = 'pending'"), key, F.lit("completed"), *kept, amount, F.lit(1))
        .unionByName(change(log.where("state = 'pending' AND type = 'givetip'"), key, F.lit("expired"), *kept, (amount * 2).cast("decimal(20,8)"), F.lit(2)))
        .unionByName(change(log.where("state = 'declined'"), key + 700000000000, F.lit("failed"), *kept, amount, F.lit(1)))
    )
    sink = ActionStream(t.spark, space.path("state"))
    sink.seed(t.action.select(
        "action_id", "state", "ts", "from_user", "to_user", "coin_val", (key % 100).cast("decimal(20,8)").alias("txfee")
    ))
    started = (
        changes.writeStream.foreachBatch(sink).option("checkpointLocation", space.path("checkpoint"))
        .trigger(availableNow=True).start()
    )
    started.awaitTermination()
    return sink.actions()


@query(
    "S3 (as a stream)",
    "select body as message, created_utc as timestamp, count(*) as n_ids, count(*) as n_rows from fx_message group by 1, 2",
)
def stream_archive(t: Tables) -> DataFrame:
    """Messages with the ids they got; every row of the archive has one of its own."""
    space = Workspace(t.spark, "stream-archive")
    messages = _stream_sql(t, "events", f"select body, created_utc from ({RECIPES['fx_message'].strip()})")
    sink = ArchiveStream(t.spark, space.path("archive"), "body", "created_utc")
    started = (
        messages.writeStream.foreachBatch(sink).option("checkpointLocation", space.path("checkpoint"))
        .trigger(availableNow=True).start()
    )
    started.awaitTermination()
    return sink.archived().groupBy("message", "timestamp").agg(
        F.countDistinct("message_id").alias("n_ids"), F.count(F.lit(1)).alias("n_rows")
    )
