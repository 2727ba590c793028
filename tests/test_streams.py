"""Streams give what a batch over the same rows gives; replays change nothing."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallybook.catalog.commands import _built
from tallybook.catalog.settlement import _log, _shaped
from tallybook.operators.ledger import settle_ledger
from tallybook.operators.rates import average_rates
from tallybook.plans.lineage import Workspace
from tallybook.sources.tickers import read_tickers
from tallybook.streaming.commands import read_inbox, stream_commands
from tallybook.streaming.confirmations import DETAIL_COLUMNS, ConfirmationStream
from tallybook.streaming.ledger_stream import LedgerStream, stream_settle
from tallybook.streaming.rates import stream_rates

FAR = 1 << 30


def drain(df, space, name, mode="append"):
    q = (
        df.writeStream.format("parquet").outputMode(mode)
        .option("checkpointLocation", space.path(name + "-cp")).option("path", space.path(name))
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return space.spark.read.schema(df.schema).parquet(space.path(name))


def files(df, ts, path, n=3):
    """Write ``df`` as ``n`` files, oldest rows first."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    limits = df.select(F.percentile_approx(micros, [i / n for i in range(1, n)])).first()[0]
    part = sum((micros > F.lit(p)).cast("int") for p in limits)
    for i in range(n):
        df.where(part == i).coalesce(1).write.mode("append").parquet(path)


def test_commands(spark, tables):
    space = Workspace(spark, "t-commands")
    messages = tables.message.withColumn("created_utc", F.col("created_utc").cast("timestamp"))
    inbox = space.path("inbox")
    files(messages, "created_utc", inbox)
    messages.orderBy("created_utc").limit(50).coalesce(1).write.mode("append").parquet(inbox)  # repeats, too late
    messages.orderBy(F.desc("created_utc")).limit(50).coalesce(1).write.mode("append").parquet(inbox)  # repeats
    memo = tables.message.select(F.col("fullname").alias("msg_id"), F.col("author").alias("username"))
    recorded = spark.createDataFrame([("history", "0")], "type string, msg_id string")
    stream = stream_commands(read_inbox(spark, inbox, max_files=1), memo, tables.keyword, recorded=recorded)
    columns = ["fullname", "action", "rule", "from_user", "to_user", "to_addr", "coin_val", "take_all", "verify"]
    got = drain(stream.select(*columns), space, "out")
    want = _built(tables).where("reason is null").select(*columns)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(got) == rows(want.where("not (action = 'history' and fullname = 't4_0')"))


@pytest.fixture(scope="module")
def log(spark, tables):
    """The log, also as four files in time order."""
    space = Workspace(spark, "t-log")
    rows = space.store(_log(tables).withColumn("ts", F.col("ts").cast("timestamp")), "log")
    files(rows, "ts", space.path("files"), n=4)
    return space, rows


def states(df):
    return {r["action_id"]: (r["state"], r["error"], r["coin_val"]) for r in df.collect()}


def test_settle(spark, tables, log):
    space, rows = log
    root = space.path("state")
    sink = LedgerStream(spark, root, address_check=_shaped, compact_every=2)
    names = tables.username.withColumn("joindate", F.lit(None).cast("timestamp"))
    sink.seed(tables.user, names, tables.address)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(space.path("files"))
    stream_settle(stream, sink, space.path("cp")).awaitTermination()
    got = states(sink.outcomes(FAR))

    opening = tables.address.select(F.col("user_id").alias("account"), "balance")
    run = settle_ledger(rows, tables.user, tables.username, tables.address, opening, address_check=_shaped)
    horizon = rows.agg(F.max("ts")).first()[0]
    late = F.col("was_pending") & (F.col("settled_at") > F.lit(horizon))
    want = run.outcomes.withColumn("state", F.when(late, "pending").otherwise(F.col("state")))
    assert got == states(want)
    assert {s for s, _, _ in got.values()} >= {"completed", "failed", "expired"}

    # Money is neither made nor lost: accounts, escrow and withdrawals add up.
    balances = sink.opening(4).agg(F.sum("balance")).first()[0]
    held = sink.tables["pending"].at(3).agg(F.coalesce(F.sum("amount"), F.lit(0))).first()[0]
    out = sink.outcomes(FAR).join(rows.select("action_id", "to_addr"), "action_id").join(
        run.outcomes.select("action_id", "to_user"), "action_id"
    ).where("state = 'pending' and to_user is null").agg(F.coalesce(F.sum("coin_val"), F.lit(0))).first()[0]
    assert balances + held + out == opening.agg(F.sum("balance")).first()[0]

    # Running a batch again gives the same tables.
    before = {n: sorted(map(str, sink.tables[n].at(3).collect())) for n in ("deltas", "pending", "outcomes")}
    last = rows.where(F.unix_micros("ts") > F.lit(sink.tables["clock"].at(2).first()["horizon"]))
    sink(last, 3)
    assert before == {n: sorted(map(str, sink.tables[n].at(3).collect())) for n in before}


def test_confirmations(spark, tables):
    space = Workspace(spark, "t-confirm")
    from tallybook.catalog.accounts import _DETAILS, _deposits
    from tallybook.catalog.streams import _ledger

    final = tables.sql(_DETAILS).withColumn("blocktime", F.col("blocktime").cast("bigint")).select(*DETAIL_COLUMNS)
    queued = final.join(tables.unprocessed.select("txid").distinct(), "txid", "left_semi")
    early = queued.withColumn("confirmations", F.lit(1).cast("bigint"))
    sink = ConfirmationStream(spark, space.path("state"), tables.address, tables.username, tables.service, _ledger(tables))
    sink.seed()
    sink(early, 0)
    assert sink.credited(FAR).isEmpty()
    sink(queued, 1)
    sink(queued, 2)  # a repeated report credits nothing again
    pick = lambda df: sorted(tuple(r) for r in df.select("txid", "address", "amount").collect())
    assert pick(sink.credited(FAR)) == pick(_deposits(tables).where("outcome = 'credited'"))


def test_rates(spark, tables):
    space = Workspace(spark, "t-rates")
    quotes = read_tickers(tables.ticker, {e: ["return.markets.k"] for e in ("ex_a", "ex_b", "ex_c")}).withColumn(
        "fiat_date", F.col("fiat_date").cast("timestamp")
    )
    source = space.path("quotes")
    files(quotes, "fiat_date", source)
    schema = quotes.schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    got = drain(stream_rates(stream), space, "out").collect()
    want = stream_rates(quotes).collect()
    # The stream holds back windows its watermark has not passed yet.
    edge = max(r["window_start"] for r in want) - dt.timedelta(hours=1)
    whole = lambda rows: sorted(tuple(r) for r in rows if r["window_start"] < edge)
    assert whole(got) == whole(want)
    assert not average_rates(quotes).isEmpty()


def test_rates_of_all_windows(spark, tables):
    """The stream has every window of the table when its input ends, the last ones included."""
    from tallybook.catalog import streams
    from tallybook.streaming.rates import RateStream, last_quotes

    shown = lambda df: sorted(tuple(r) for r in df.select("window_start", "thing_from", "thing_to", "rate").collect())
    assert shown(streams.stream_rates(tables)) == shown(streams.rates_by_window(tables))

    space = Workspace(spark, "t-rates-all")
    quotes = read_tickers(tables.ticker, {e: ["return.markets.k"] for e in ("ex_a", "ex_b", "ex_c")}).withColumn(
        "fiat_date", F.col("fiat_date").cast("timestamp")
    )
    source = space.path("quotes")
    files(quotes, "fiat_date", source)
    stream = spark.readStream.schema(quotes.schema).option("maxFilesPerTrigger", 1).parquet(source)
    sink = RateStream(spark, space.path("state"))
    started = (
        last_quotes(stream).writeStream.foreachBatch(sink).option("checkpointLocation", space.path("checkpoint"))
        .outputMode("update").trigger(availableNow=True).start()
    )
    started.awaitTermination()
    assert shown(sink.rates(FAR)) == shown(stream_rates(quotes))
    again = sink.table.at(1)
    sink(spark.createDataFrame(again.collect(), again.schema), 1)  # a batch that is run again
    assert shown(sink.rates(FAR)) == shown(stream_rates(quotes))
