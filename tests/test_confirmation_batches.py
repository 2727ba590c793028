"""A batch of chain reports is settled from one stored table of its confirmed transactions."""

from decimal import Decimal

from tallybook.plans.lineage import Workspace
from tallybook.streaming import confirmations
from tallybook.streaming.confirmations import ConfirmationStream


def test_batches_share_what_is_confirmed(spark, monkeypatch):
    given = []
    plain = confirmations.reconcile_deposits
    monkeypatch.setattr(confirmations, "reconcile_deposits", lambda *a: given.append(a[-1]) or plain(*a))

    def detail(txid, n, address, seen):
        return txid, n, address, "receive", Decimal(n), "a", Decimal(0), 100, seen

    sink = ConfirmationStream(
        spark, Workspace(spark, "t-batches").path("state"),
        spark.createDataFrame([(1, 1, None, "A")], "address_id long, user_id long, user_id_alias long, address string"),
        spark.createDataFrame([(1, 1, 1, "ann")], "username_id long, user_id long, service_id long, username string"),
        spark.createDataFrame([(1, "s")], "service_id long, service_name string"),
        spark.createDataFrame([], "action_id long, type string, txid string, to_addr string"),
    )
    sink.seed()
    columns = ["txid", "n", "address", "category", "amount", "account", "fee", "blocktime", "confirmations"]
    schema = "txid string, n int, address string, category string, amount decimal(20,8), account string, fee decimal(20,8), blocktime bigint, confirmations bigint"
    first = [detail("t", 1, "A", 2), detail("t", 1, "A", 3), detail("t", 2, "B", 2), detail("u", 1, "A", 1), detail(None, 1, "A", 9)]
    sink(spark.createDataFrame(first, schema).select(*columns), 0)
    assert sink.credited(1).count() == 0
    sink(spark.createDataFrame([detail("t", 1, "A", 6)], schema).select(*columns), 1)
    assert [(r.txid, r.address, r.amount, r.n_details) for r in sink.credited(2).collect()] == [("t", "A", Decimal(1), 1)]
    # "t" stays for the address without an owner, "u" and the row without a transaction for want of confirmations.
    left = sink.tables["waiting"].at(1).collect()
    assert sorted((r.txid or "", r.n, r.confirmations) for r in left) == [("", 1, 9), ("t", 1, 6), ("t", 2, 2), ("u", 1, 1)]
    assert len(given) == 2 and all("n_named" in found.columns for found in given)
