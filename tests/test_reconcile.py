"""Confirmed transactions are found once and serve deposits, withdrawals and the queue."""

from decimal import Decimal

from tallybook.operators import reconcile
from tallybook.plans.lineage import Workspace

DDL = (
    "txid string, n int, category string, confirmations long, address string, amount decimal(20,8), account string, "
    "fee decimal(20,8), blocktime long"
)


def test_details_are_dealt_once(spark):
    def detail(txid, n, category, confirmations, address, amount, account="a", fee=-1):
        return txid, n, category, confirmations, address, Decimal(amount), account, Decimal(fee), 100 + n

    space = Workspace(spark, "t-reconcile")
    details = space.store(
        spark.createDataFrame(
            [
                # Confirmed by its second detail; the address comes twice, first without an account.
                detail("in", 1, "receive", 1, "A", 1, None), detail("in", 2, "send", 6, "A", 2), detail("in", 3, "send", 2, "A", 3),
                detail("in", 4, "send", 2, "B", 4), detail("in", 5, "send", 2, None, 5, None),
                detail("out", 2, "receive", 6, "A", 6, fee=-7), detail("out", 1, "send", 0, "B", 7, fee=-3),
                detail("young", 1, "receive", 5, "A", 8), detail("unqueued", 1, "receive", 9, "A", 9),
                detail("move", 1, "move", 6, "A", 10), detail("lost", 1, "send", 6, "B", 11), detail(None, 1, "receive", 9, "A", 12),
            ],
            DDL,
        ),
        "details",
    )
    queue = spark.createDataFrame([(t,) for t in ("in", "in", "out", "young", "move", "lost", "absent", None)], "txid string")
    address = spark.createDataFrame([(1, 1, None, "A"), (2, 2, None, None)], "address_id long, user_id long, user_id_alias long, address string")
    username = spark.createDataFrame([(1, 1, 1, "ann"), (2, 2, 1, "bob")], "username_id long, user_id long, service_id long, username string")
    service = spark.createDataFrame([(1, "s")], "service_id long, service_name string")
    action = spark.createDataFrame([(5, "withdraw", "out", None), (6, "withdraw", "out", None), (7, "withdraw", "young", None)], "action_id long, type string, txid string, to_addr string")

    found = reconcile.confirmed(queue, details)
    deposits = reconcile.reconcile_deposits(queue, details, address, username, service, action, found=found)
    assert {(r.txid, r.address, r.outcome, r.amount, r.n_details, r.username) for r in deposits.collect()} == {
        ("in", "A", "credited", Decimal(2), 3, "ann"), ("in", "B", "unknown_owner", Decimal(4), 1, None),
        ("in", None, "no_account", None, 1, None),
    }
    sent = reconcile.confirm_withdrawals(queue, details, action, found=found)
    assert sorted((r.action_id, r.txfee) for r in sent.collect()) == [(5, Decimal(3)), (6, Decimal(3))]
    left = reconcile.unprocessed_after(queue, details, deposits, action, found=found)
    assert sorted(r.txid or "" for r in left.collect()) == ["", "absent", "lost", "young"]

    # The details themselves are behind none of them, given or not.
    own = [
        reconcile.reconcile_deposits(queue, details, address, username, service, action),
        reconcile.confirm_withdrawals(queue, details, action), reconcile.unprocessed_after(queue, details, deposits, action),
    ]
    for given, alone in zip((deposits, sent, left), own, strict=True):
        assert sorted(map(str, given.collect())) == sorted(map(str, alone.collect()))
        for df in (given, alone):
            assert not any("/details/" in file for file in df.inputFiles())
