"""Payloads of account reports, small expected values."""

import json
from decimal import Decimal

from test_operators import at

from tallybook.operators import notify
from tallybook.schemas import ACTION_DDL, ADDRESS_DDL, SERVICE_DDL, USERNAME_DDL, fields


def test_deposit_amounts_and_history_pages(spark):
    """A deposit report carries its amount; the history goes with the first part of many linked accounts only."""
    names = [(1, 10, 1, "ann", at(0))] + [(100 + i, 10, 2, f"ann{i:05d}", at(0)) for i in range(1500)] + [(2, 11, 1, "bob", at(0))]
    username = spark.createDataFrame(names, USERNAME_DDL)
    service = spark.createDataFrame([(1, "reddit"), (2, "twitch")], SERVICE_DDL)
    address = spark.createDataFrame([(1, 10, None, "dog", "A1", "w", Decimal(7)), (2, 11, None, "dog", "A2", "w", Decimal(3))], ADDRESS_DDL)
    columns = fields(ACTION_DDL).names
    row = dict.fromkeys(columns)
    tips = [{**row, "action_id": i, "service_id": 1, "type": "givetip", "state": "completed", "ts": at(i), "from_user": "ann", "to_user": "bob", "coin_val": Decimal(1), "coin": "dog"} for i in range(1, 4)]
    action = spark.createDataFrame([tuple(t[c] for c in columns) for t in tips], ACTION_DDL)
    requests = spark.createDataFrame(
        [(20, "history", "reddit", "ann", None), (21, "deposit", "reddit", "bob", Decimal("4.5")), (22, "info", "reddit", "bob", Decimal(9)), (23, "deposit", "reddit", "eve", Decimal(1))],
        "action_id long, type string, service_name string, from_user string, coin_val decimal(20,8)",
    )
    got = {(r["action_id"], r["part"]): (r["type"], json.loads(r["payload"])) for r in notify.notify_account(requests, username, service, address, action).collect()}
    assert set(got) == {(20, 0), (20, 1), (21, 0), (22, 0), (23, 0)}
    assert [h["ts"] is not None for h in got[20, 0][1]["history"]] == [True] * 3 and "history" not in got[20, 1][1]
    assert len(got[20, 0][1]["associated"]) + len(got[20, 1][1]["associated"]) >= 1500
    assert got[21, 0][0] == "deposit" and Decimal(got[21, 0][1]["coin_val"]) == Decimal("4.5")
    assert "coin_val" not in got[22, 0][1] and got[22, 0][1]["balance"].startswith("3")
    assert got[23, 0][0] == "not_registered"
