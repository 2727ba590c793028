"""State of streams: merged blocks, keyed buckets, rows delivered twice, replayed batches."""

import random

from pyspark.sql import functions as F

from tallybook.catalog.settlement import _log, _shaped
from tallybook.operators.accounts import upsert_actions
from tallybook.plans.lineage import Workspace
from tallybook.streaming.actions import ActionStream, ArchiveStream
from tallybook.streaming.ledger_stream import LedgerStream
from tallybook.streaming.state import SEED, KeyedTable, VersionedTable

FAR = 1 << 30


def numbers(df):
    return sorted(r["x"] for r in df.collect())


def test_blocks_of_batches(spark):
    table = VersionedTable(spark, Workspace(spark, "t-blocks").path("state"), "x", fan=3)
    one = lambda k: spark.createDataFrame([(k,)], "x long").coalesce(1)
    table.write(one(-1), SEED)
    most = 0
    for k in range(29):
        if k == 13:  # a skipped id
            continue
        table.write(one(k), k)
        most = max(most, len(table.blocks(k + 1)))
        if k in (8, 9, 26, 28):
            table.write(one(k), k)  # run again
            assert numbers(table.appended(k)) == [x for x in range(-1, k) if x != 13]
            assert numbers(table.appended(k + 1)) == [x for x in range(-1, k + 1) if x != 13]
    assert numbers(table.appended(FAR)) == [x for x in range(-1, 29) if x != 13]
    assert [b.rsplit("/", 1)[1] for b in table.blocks(28)] == ["0--1", "3-26", "0-27"]
    assert most <= 1 + 3 * 2  # two blocks a level at most, and the seed


def test_folded_blocks(spark):
    root = Workspace(spark, "t-folds").path("state")
    fold = lambda df: df.groupBy("a").agg(F.sum("n").alias("n"), F.max("v").alias("v"))
    table = VersionedTable(spark, root, "x", fan=2, fold=fold)
    for k in range(9):
        table.write(spark.createDataFrame([("p", 1), ("q", k)], "a string, n long"), k)
    assert {r["a"]: r["n"] for r in fold(table.versions(FAR)).collect()} == {"p": 9, "q": 36}
    assert table.versions(8).count() == 2  # one block of eight batches


def test_keyed_buckets(spark):
    table = KeyedTable(spark, Workspace(spark, "t-keyed").path("state"), "x", "action_id", buckets=8)
    rows = lambda items: spark.createDataFrame([(k, s, None) for k, s in items], "action_id long, state string, txfee decimal(20,8)")
    shown = lambda df: {r["action_id"]: r["state"] for r in df.collect()}
    table.seed(rows([]))
    assert shown(table.at(SEED)) == {}
    rng, want = random.Random(4), {}
    for batch in range(6):
        change = [(rng.randrange(40), f"{batch}-{i}", i) for i in range(rng.choice([0, 3, 12]))]
        updates = spark.createDataFrame(change, "action_id long, state string, version long")
        before = table.manifest(batch - 1)
        table.merge(updates, batch, upsert_actions)
        table.merge(updates, batch, upsert_actions)  # run again
        want |= {k: s for k, s, _ in change}
        assert shown(table.at(batch)) == want
        touched = {b for b, v in table.manifest(batch).items() if v == batch}
        assert all(table.manifest(batch)[b] == v for b, v in before.items() if b not in touched)
        assert len(touched) <= len({k for k, _, _ in change})


def test_changes_of_actions(spark, tables):
    """Batches one after another, the last one twice, give what one batch over all changes gives."""
    base = tables.action.select("action_id", "state", "coin_val", (F.col("action_id") % 9).cast("decimal(20,8)").alias("txfee"))
    changes = base.select(
        (F.col("action_id") + F.when(F.col("action_id") % 5 == 0, 10**12).otherwise(0)).alias("action_id"),
        F.lit("completed").alias("state"), "coin_val", F.lit(1).alias("version"),
    ).unionByName(base.where("action_id % 3 = 0").select("action_id", F.lit("failed").alias("state"), "coin_val", F.lit(2).alias("version")))
    sink = ActionStream(spark, Workspace(spark, "t-changes").path("state"), buckets=4)
    sink.seed(base)
    for batch, part in enumerate(("version = 1 AND action_id % 2 = 0", "version = 1 AND action_id % 2 = 1", "version = 2", "version = 2")):
        sink(changes.where(part), min(batch, 2))
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(sink.actions()) == rows(upsert_actions(base, changes))


def test_archive_ids(spark):
    """Equal messages have ids of their own; a replay, dealt otherwise, gives every text the same ids."""
    sink = ArchiveStream(spark, Workspace(spark, "t-archive").path("archive"))
    texts = [("same",)] * 40 + [(f"m{i}",) for i in range(20)] + [(None,), ("",)]
    for batch in (0, 1):
        sink(spark.createDataFrame(texts, "message string").repartition(3), batch)
    ids = lambda: sorted((r["message"] or "-", r["message_id"]) for r in sink.archived().collect())
    first = ids()
    assert len(first) == 124 and len({k for _, k in first}) == 124
    random.Random(1).shuffle(texts)
    sink(spark.createDataFrame(texts, "message string").repartition(5), 1)
    assert ids() == first
    sink(spark.createDataFrame([], "message string"), 2)
    assert ids() == first


def test_log_delivered_twice(spark, tables):
    """Rows that come again, in their batch, in a later one or by another id, move no coins again."""
    log = _log(tables).withColumn("ts", F.col("ts").cast("timestamp")).withColumn(
        "config1", F.when(F.col("service_id") == 1, F.concat(F.lit("m"), F.col("action_id")))
    )
    space = Workspace(spark, "t-twice")
    log = space.store(log, "log")
    cut = log.select(F.percentile_approx(F.unix_micros("ts"), 0.5)).first()[0]
    early, late = log.where(F.unix_micros("ts") <= F.lit(cut)), log.where(F.unix_micros("ts") > F.lit(cut))
    other_id = early.where("type IN ('givetip', 'withdraw') AND service_id = 1").withColumn("action_id", F.col("action_id") + 10**12)

    def run(name, batches, **options):
        sink = LedgerStream(spark, space.path(name), address_check=_shaped, compact_every=2, **options)
        sink.seed(tables.user, tables.username.withColumn("joindate", F.lit(None).cast("timestamp")), tables.address)
        for k, batch in enumerate(batches):
            sink(batch, k)
        balances = {tuple(r) for r in sink.opening(len(batches)).where("balance <> 0").collect()}
        return balances, {r["action_id"]: (r["state"], r["coin_val"]) for r in sink.outcomes(FAR).collect()}

    balances, outcomes = run("once", [early, late])
    again, twice = run("twice", [early.unionByName(early), late, early.unionByName(other_id)])
    assert again == balances
    assert {k: v for k, v in twice.items() if k < 10**12} == outcomes
    assert {s for k, (s, _) in twice.items() if k >= 10**12} == {"ignored"}
    # With a limit, rows older than the keys that are kept are not settled either.
    shown, bounded = run("bounded", [early, late, early.unionByName(other_id)], guard_days=1)
    assert shown == balances and {s for k, (s, _) in bounded.items() if k >= 10**12} == {"ignored"}
