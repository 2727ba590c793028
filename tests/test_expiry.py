"""Held tips end by timers."""

import datetime as dt
import time
from dataclasses import replace
from decimal import Decimal

from pyspark.sql import functions as F

from tallybook.operators import ledger
from tallybook.plans.lineage import Workspace
from tallybook.settings import DEFAULT
from tallybook.streaming.expiry import stream_expiry

DDL = "action_id long, ts timestamp, service_id long, type string, state string, from_user string, to_user string, coin_val decimal(20,8)"


def start(spark, space, folder, trigger, **options):
    stream = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(folder)
    return (
        stream_expiry(stream, **options).writeStream.format("parquet").option("path", space.path("out"))
        .option("checkpointLocation", space.path("checkpoint")).trigger(**trigger).start()
    )


def test_silent_input(spark):
    """Nothing arrives after the tips, and they end at their limit all the same."""
    space = Workspace(spark, "t-silent")
    now = dt.datetime.now()
    old = now - dt.timedelta(hours=1) + dt.timedelta(seconds=25)  # its limit is 25 seconds ahead
    rows = [(1, old, 1, "givetip", "pending", "Ann", "Cat", Decimal(5)), (2, now, 1, "givetip", "pending", "bob", "cat", Decimal(6))]
    spark.createDataFrame(rows, DDL).coalesce(1).write.parquet(space.path("in"))
    query = start(spark, space, space.path("in"), {"processingTime": "1 second"}, settings=replace(DEFAULT, expire_hours=1))
    found, until = [], time.time() + 120
    while not found and time.time() < until:
        time.sleep(1)
        assert query.exception() is None
        if query.recentProgress and query.lastProgress["batchId"] > 0:
            found = spark.read.schema("action_id long, state string, settled_at timestamp, credit string").parquet(space.path("out")).collect()
    query.stop()
    assert [(r.action_id, r.state, r.credit) for r in found] == [(1, "expired", "ann")]
    assert found[0].settled_at == old + dt.timedelta(hours=1)


def test_replay_equals_batch(spark, tables):
    """On the event clock: acceptances, refusals and expiries of a log in four files are those of the batch operators."""
    space = Workspace(spark, "t-replay")
    tips = tables.action.where("type = 'givetip' AND state = 'pending' AND to_user IS NOT NULL").select(
        "action_id", F.col("ts").cast("timestamp").alias("ts"), F.col("service_id").cast("long").alias("service_id"), "type", "state", "from_user", "to_user", "coin_val"
    )
    kind = F.when(F.col("action_id") % 3 == 1, "accept").otherwise("decline")
    moves = tips.where("action_id % 3 <> 0").select(
        (F.col("action_id") + 10**9).alias("action_id"), (F.col("ts") + F.make_interval(hours=(F.col("action_id") % 72).cast("int"))).alias("ts"),
        "service_id", kind.alias("type"), F.lit("completed").alias("state"), F.col("to_user").alias("from_user"),
        F.lit(None).cast("string").alias("to_user"), F.lit(None).cast("decimal(20,8)").alias("coin_val"),
    )
    last = spark.createDataFrame([(10**12, dt.datetime(2030, 1, 1), 1, "accept", "completed", "nobody", None, None), (10**12 + 1, dt.datetime(2030, 1, 2), 1, "accept", "completed", "nobody", None, None)], DDL)
    log = space.store(tips.unionByName(moves), "log")
    cuts = log.approxQuantile("action_id", [0.5], 0.1) and log.select(F.percentile_approx(F.unix_micros("ts"), [0.25, 0.5, 0.75])).first()[0]
    t = F.unix_micros("ts")
    for k, (low, high) in enumerate(zip([None, *cuts], [*cuts, None])):
        part = log.where((F.lit(True) if low is None else t > low) & (F.lit(True) if high is None else t <= high))
        part.coalesce(1).write.mode("append").parquet(space.path("in"))
    for r in (last.limit(1), last.where(f"action_id > {10**12}")):
        r.coalesce(1).write.mode("append").parquet(space.path("in"))
    query = start(spark, space, space.path("in"), {"availableNow": True}, clock="event", parts=4)
    query.awaitTermination()
    got = {r.action_id: (r.state, r.settled_at, r.credit, r.coin_val) for r in spark.read.parquet(space.path("out")).collect()}
    responses = log.where("type IN ('accept', 'decline')")
    # The batch form knows one kind of response; of two kinds the next one counts.
    line = {}
    for r in ledger.accept_pending(responses, tips).collect():
        line[r.action_id] = r.settled_at
    at = {(r.service_id, r.from_user.lower(), r.ts): r.type for r in responses.orderBy(F.desc("action_id")).collect()}
    want = {}
    for r in tips.collect():
        limit = r.ts + dt.timedelta(hours=48)
        if r.action_id in line:
            how = at[(r.service_id, r.to_user.lower(), line[r.action_id])]
            want[r.action_id] = ("completed", line[r.action_id], r.to_user.lower(), r.coin_val) if how == "accept" else ("declined", line[r.action_id], r.from_user.lower(), r.coin_val)
        else:
            want[r.action_id] = ("expired", limit, r.from_user.lower(), r.coin_val)
    assert got == want
    assert {s for s, *_ in got.values()} == {"completed", "declined", "expired"}
