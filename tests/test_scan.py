"""Chunked running values and as-of joins against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tallybook.plans.asof import asof_join
from tallybook.plans.scan import Running, number_rows, plan_chunks, running
from tallybook.plans.topk import top_per_key


def rows_of(seed, n=2000, hot=0.4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = 0 if rng.random() < hot else rng.randrange(1, 20)
        t = 500 if rng.random() < 0.35 else rng.randrange(0, 1000)  # one crowded instant
        phase = rng.randrange(2)
        rows.append((key, t, phase, i, rng.choice([None, rng.randrange(-50, 50)])))
    return rows


def expected(rows, keyed, inclusive):
    state, out = {}, {}
    for key, t, phase, i, v in sorted(rows, key=lambda r: (r[1], r[2], r[3])):
        group = key if keyed else None
        total, top, last = state.get(group, (None, None, None))
        after = (
            total if v is None else (total or 0) + v,
            top if v is None else (v if top is None else max(top, v)),
            last if v is None else v,
        )
        out[i] = after if inclusive else (total, top, last)
        state[group] = after
    return out


@pytest.mark.parametrize("keyed", [True, False])
@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("chunks", [4, 30])
def test_running(spark, keyed, inclusive, chunks):
    rows = rows_of(chunks)
    df = spark.createDataFrame(rows, "k long, t long, phase int, id long, v long").repartition(4)
    keys = ("k",) if keyed else ()
    limits = plan_chunks(df, F.col("t"), F.col("id"), keys, chunks=chunks)
    assert limits.cuts
    values = {
        "total": Running("sum", F.col("v")),
        "top": Running("max", F.col("v")),
        "last": Running("last", F.col("v")),
    }
    got = running(df, keys, ("t", "phase", "id"), values, limits, inclusive)
    result = {r["id"]: (r["total"], r["top"], r["last"]) for r in got.collect()}
    assert result == expected(rows, keyed, inclusive)


def test_chunks_follow_the_order_and_stay_small(spark):
    rows = rows_of(3, n=6000)
    df = spark.createDataFrame(rows, "k long, t long, phase int, id long, v long")
    limits = plan_chunks(df, F.col("t"), F.col("id"), chunks=20)
    chunk = limits.chunk(F.col("t"), F.col("id"), F.col("phase"))
    got = [tuple(r) for r in df.select(chunk.alias("c"), "t", "phase", "id").collect()]
    ordered = sorted(got, key=lambda r: r[1:])
    assert [r[0] for r in ordered] == sorted(r[0] for r in got)
    sizes = {}
    for r in got:
        sizes[r[0]] = sizes.get(r[0], 0) + 1
    # A third of the rows share one instant, yet no chunk holds much more than its share.
    assert max(sizes.values()) <= 3 * len(rows) / 20


def test_only_hot_keys_are_cut(spark):
    df = spark.createDataFrame(rows_of(5), "k long, t long, phase int, id long, v long")
    limits = plan_chunks(df, F.col("t"), F.col("id"), ("k",), chunks=5)
    hot = df.where("k = 0").select(F.xxhash64("k")).first()[0]
    assert limits.hot_keys == [hot]


def test_number_rows(spark):
    df = spark.createDataFrame([(t % 7, t) for t in range(300)], "t long, id long")
    got = number_rows(df, ("t", "id"), "n", chunks=6).collect()
    assert [r["n"] for r in sorted(got, key=lambda r: (r["t"], r["id"]))] == list(range(1, 301))


def test_asof_join(spark):
    rng = random.Random(1)
    ticks = [(i, rng.randrange(1000), rng.random()) for i in range(300)]
    probes = [(i, rng.choice([400, rng.randrange(1100)])) for i in range(900)]
    right = spark.createDataFrame(ticks, "snap long, s long, rate double").withColumn("rts", F.timestamp_seconds("s"))
    left = spark.createDataFrame(probes, "id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = asof_join(left, right.drop("s"), "ts", "rts", "id", "snap", ["rate"], chunks=12)
    result = {r["id"]: r["rate"] for r in got.collect()}
    ordered = sorted((s, i, rate) for i, s, rate in ticks)
    for i, s in probes:
        before = [rate for at, _, rate in ordered if at <= s]
        assert result[i] == (before[-1] if before else None)


def test_deep_pages(spark):
    """Beyond the built-in limit the salted form gives the same rows."""
    df = spark.createDataFrame([(0, i * 37 % 5000, i) for i in range(5000)], "k long, v long, id long")
    order = [F.col("v").desc(), F.col("id").desc()]
    got = top_per_key(df, ["k"], order, 1501, 1510, salt_on=F.col("id"), salts=8).collect()
    want = sorted(((i * 37 % 5000, i) for i in range(5000)), reverse=True)[1500:1510]
    assert [(r["v"], r["id"]) for r in sorted(got, key=lambda r: r["rn"])] == want
