"""Keys of a stream share groups of state, and their results stay their own."""

import datetime as dt
from decimal import Decimal

import pandas as pd
import pytest

from tallybook.plans.lineage import Workspace
from tallybook.streaming import withdrawals
from tallybook.streaming.expiry import stream_expiry

REPORT_DDL = (
    "txid string, n int, category string, confirmations long, address string, amount decimal(20,8), fee decimal(20,8)"
)
LOG_DDL = "action_id long, ts timestamp, service_id long, type string, state string, from_user string, to_user string, coin_val decimal(20,8)"


def drained(spark, space, frame):
    """What ``frame``, a stream, puts out until its input is used up, and the most rows of state it had."""
    query = (
        frame.writeStream.format("parquet").option("path", space.path("out"))
        .option("checkpointLocation", space.path("checkpoint")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    most = max(op.numRowsTotal for p in query.recentProgress for op in p.stateOperators)
    return spark.read.schema(frame.schema).parquet(space.path("out")).collect(), most


def streams(spark, space, **tables):
    for name, df in tables.items():
        df.write.parquet(space.path(name))
    return [spark.readStream.schema(df.schema).parquet(space.path(name)) for name, df in tables.items()]


def test_withdrawals_share_state(spark):
    """300 transactions in 5 groups; every third is too young, every fifth comes in."""
    space = Workspace(spark, "t-share")
    reports = [
        (f"t{i}", n, "receive" if i % 5 == 0 else "send", 2 if i % 3 == 0 else 6, "a", Decimal(n), Decimal(-n))
        for i in range(300) for n in (2, 1)
    ]
    sent = [(1000 + i, f"t{i}") for i in range(0, 300, 2)] + [(5000, "t1"), (5001, "t1"), (5000, "t1"), (6000, "unseen")]
    parts = streams(
        spark, space, sent=spark.createDataFrame(sent, "action_id long, txid string"), reports=spark.createDataFrame(reports, REPORT_DDL)
    )
    rows, groups = drained(spark, space, withdrawals.stream_confirmed(*parts, groups=5))
    due = lambda i: i % 3 and i % 5
    want = [(1000 + i, f"t{i}") for i in range(0, 300, 2) if due(i)] + [(5000, "t1"), (5001, "t1")]
    assert sorted((r.action_id, r.txid) for r in rows) == sorted(want)
    assert {(r.state, r.txfee) for r in rows} == {("completed", Decimal(1))}
    assert groups <= 5


class State:
    """A group's state with a clock that the test sets."""

    def __init__(self):
        self.value, self.now, self.wait, self.hasTimedOut = None, 0, None, False

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def getCurrentProcessingTimeMs(self):
        return self.now

    def setTimeoutDuration(self, wait):
        self.wait = wait


def test_transactions_of_a_group_are_forgotten_one_by_one():
    run, state = withdrawals._meeting(6, 100), State()

    def batch(now, *rows):
        state.now = now
        frames = [pd.DataFrame(rows, columns=withdrawals.SIDES)] if rows else []
        return [i for f in run((0,), iter(frames), state) for i in f["action_id"]]

    report = lambda txid: (txid, True, 1, "", 6, "send", "-1")
    withdrawal = lambda txid, i: (txid, False, i, "", -1, None, None)
    assert batch(1000, report("a"), report("b")) == [] and state.wait == 100
    assert batch(1060, withdrawal("b", 1)) == [1] and state.wait == 40
    assert batch(1100) == [] and state.wait == 60  # a is forgotten, b is not
    assert batch(1110, withdrawal("a", 2), withdrawal("b", 3)) == [3]
    assert batch(1300) == [] and not state.exists


@pytest.mark.parametrize("groups", [1, 7])
def test_recipients_share_state(spark, groups):
    """Names that share a group, and one name on two services, do not answer for each other."""
    space = Workspace(spark, f"t-names-{groups}")
    start, hour = dt.datetime(2020, 1, 1), dt.timedelta(hours=1)
    log, want = [], {}
    for i in range(120):
        service, name = i % 2, f"Name{i // 4}"
        log.append((i, start + i * hour / 60, service, "givetip", "pending", "Ann", name, Decimal(i)))
        want[i] = ("expired", start + i * hour / 60 + 48 * hour, "ann")
    for k in range(30):
        if k % 3:  # the name answers on service 1 only
            log.append((1000 + k, start + (4 + k) * hour, 1, "accept" if k % 3 == 1 else "decline", "completed", f"NAME{k}", None, None))
            for i in (4 * k + 1, 4 * k + 3):
                want[i] = ("completed", start + (4 + k) * hour, f"name{k}") if k % 3 == 1 else ("declined", start + (4 + k) * hour, "ann")
    log.append((2000, start + 2000 * hour, 1, "accept", "completed", "nobody", None, None))
    log.append((2001, None, 1, "accept", "completed", "name0", None, None))
    rows, most = drained(spark, space, stream_expiry(*streams(spark, space, log=spark.createDataFrame(log, LOG_DDL)), clock="event", parts=2, groups=groups))
    assert {r.action_id: (r.state, r.settled_at, r.credit) for r in rows} == want and len(rows) == 120
    assert all(r.service_id == r.action_id % 2 and r.coin_val == r.action_id for r in rows)
    assert most <= groups
