"""Edge cases of the batch operators on small tables."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallybook.fixtures import Tables
from tallybook.operators import accounts, commands, history, identity, ledger, notify, rates, reconcile
from tallybook.plans.lineage import Workspace
from tallybook.schemas import LEDGER_TABLES, fields
from tallybook.sources import sinks
from tallybook.sources.ledger import load_ledger

T0 = dt.datetime(2024, 1, 1)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def test_merges_follow_their_order(spark):
    """Names and balances end where a one-by-one run leaves them."""
    rng = random.Random(3)
    users = list(range(1, 31))
    merges = []
    for seq in range(40):
        main, merge = rng.sample(users, 2)
        merges.append((main, merge, seq))
    owner = {u: u for u in users}  # start holdings -> holder
    balance = {u: Decimal(u) for u in users}
    for main, merge, _ in merges:
        for u in users:
            if owner[u] == merge:
                owner[u] = main
        balance[main] += balance[merge]
        balance[merge] = Decimal(0)
    names = spark.createDataFrame([(u, u, 1, f"n{u}") for u in users], "username_id long, user_id long, service_id long, username string")
    address = spark.createDataFrame(
        [(u, u, None, "dog", f"a{u}", Decimal(u)) for u in users],
        "address_id long, user_id long, user_id_alias long, coin string, address string, balance decimal(20,8)",
    )
    df = spark.createDataFrame(merges, "user_id_main long, user_id_merge long, seq long")
    new_names, new_address = accounts.merge_accounts(df, names, address)
    assert {r["username_id"]: r["user_id"] for r in new_names.collect()} == owner
    assert {r["user_id"]: r["balance"] for r in new_address.collect()} == balance


def test_long_merge_chain(spark):
    merges = spark.createDataFrame([(i + 1, i, i) for i in range(1, 65)], "user_id_main long, user_id_merge long, seq long")
    got = accounts.merge_targets(merges).select("owner").distinct().collect()
    assert [r["owner"] for r in got] == [65]


def test_registration(spark):
    user = spark.createDataFrame([(4, T0)], "user_id long, joindate timestamp")
    names = spark.createDataFrame([(9, 4, 1, "Old")], "username_id long, user_id long, service_id long, username string")
    address = spark.createDataFrame([(2, 4)], "address_id long, user_id long")
    requests = spark.createDataFrame(
        [(1, at(3), 1, "B"), (2, at(2), 1, "a"), (3, at(5), 1, "A"), (4, at(1), 1, "OLD"), (5, at(2), 2, "a")],
        "action_id long, ts timestamp, service_id long, from_user string",
    )
    made = accounts.register_users(requests, user, names, address)
    got = sorted((r["user_id"], r["username_id"], r["service_id"], r["username"]) for r in made.username.collect())
    assert got == [(5, 10, 1, "a"), (6, 11, 2, "a"), (7, 12, 1, "b")]
    assert {r["action_id"]: r["error"] for r in made.outcomes.collect()} == {
        1: None, 2: None, 3: "already_registered", 4: "already_registered", 5: None,
    }
    assert {(r["address_id"], r["balance"]) for r in made.address.collect()} == {(3, 0), (4, 0), (5, 0)}


def test_upsert_keeps_the_fee(spark):
    base = spark.createDataFrame([(1, "pending", "x", Decimal(3)), (2, "pending", "y", Decimal(4))], "action_id long, state string, note string, txfee decimal(20,8)")
    updates = spark.createDataFrame([(1, "failed", 1), (1, "completed", 2), (3, "failed", 1)], "action_id long, state string, version int")
    got = {r["action_id"]: tuple(r)[1:] for r in accounts.upsert_actions(base, updates).collect()}
    assert got == {1: ("completed", None, Decimal(3)), 2: ("pending", "y", Decimal(4)), 3: ("failed", None, None)}


def test_deposit_outcomes(spark):
    ddl = "txid string, n int, category string, confirmations long, address string, amount decimal(20,8), account string, fee decimal(20,8), blocktime long"
    d = lambda tx, n, cat, conf, addr, amt, acct="a": (tx, n, cat, conf, addr, Decimal(amt), acct, Decimal("-0.5"), 100)
    details = spark.createDataFrame(
        [
            d("t1", 1, "receive", 6, "A1", 5), d("t1", 2, "receive", 6, "A1", 7), d("t1", 3, "receive", 6, "A2", 9),
            d("t2", 1, "receive", 5, "A1", 5),                      # too early
            d("t3", 1, "generate", 9, "XX", 5),                     # nobody's address
            d("t4", 1, "receive", 9, "A1", 5, None),                # no account
            d("t5", 1, "send", 9, "A1", 5), d("t6", 1, "move", 9, "A1", 5),
            d("t7", 1, "receive", 9, "A1", 5),                      # recorded
            d("t8", 1, "receive", 9, "A1", 5),                      # not queued
        ],
        ddl,
    )
    queue = spark.createDataFrame([(f"t{i}",) for i in (1, 1, 2, 3, 4, 5, 6, 7, 9)], "txid string")
    address = spark.createDataFrame([(1, 10, None, "A1"), (2, 99, 11, "A2")], "address_id long, user_id long, user_id_alias long, address string")
    names = spark.createDataFrame([(5, 10, 1, "ann"), (4, 10, 2, "ann2"), (6, 11, 1, "bob")], "username_id long, user_id long, service_id long, username string")
    service = spark.createDataFrame([(1, "reddit"), (2, "twitch")], "service_id long, service_name string")
    action = spark.createDataFrame([(1, "deposit", "t7", "A1"), (2, "withdraw", "t5", "Z")], "action_id long, type string, txid string, to_addr string")
    got = reconcile.reconcile_deposits(queue, details, address, names, service, action)
    assert {(r["txid"], r["address"]): (r["outcome"], r["username"], r["amount"]) for r in got.collect()} == {
        ("t1", "A1"): ("credited", "ann2", Decimal(5)),
        ("t1", "A2"): ("credited", "bob", Decimal(9)),
        ("t3", "XX"): ("unknown_owner", None, Decimal(5)),
        ("t4", "A1"): ("no_account", "ann2", None),
        ("t7", "A1"): ("repeat", "ann2", Decimal(5)),
    }
    confirmed = reconcile.confirm_withdrawals(queue, details, action).collect()
    assert [(r["action_id"], r["txfee"]) for r in confirmed] == [(2, Decimal("0.5"))]
    left = reconcile.unprocessed_after(queue, details, got, action)
    assert sorted(r["txid"] for r in left.collect()) == ["t2", "t3", "t9"]


def test_ledger_log(spark):
    """Escrow, acceptance, decline, expiry, whole balance and internal addresses in one log."""
    user = spark.createDataFrame([(1, T0), (2, T0)], "user_id long, joindate timestamp")
    names = spark.createDataFrame([(1, 1, 1, "ann"), (2, 2, 1, "bob")], "username_id long, user_id long, service_id long, username string")
    address = spark.createDataFrame(
        [(1, 1, None, "dog", "DA", Decimal(100)), (2, 2, None, "dog", "DB", Decimal(0))],
        "address_id long, user_id long, user_id_alias long, coin string, address string, balance decimal(20,8)",
    )
    log = [
        (1, at(1), "givetip", "ann", "cat", None, 10, False),     # held, accepted at 5
        (2, at(2), "givetip", "ann", "Cat", None, 10, False),     # same pair is pending: silent failure
        (3, at(3), "givetip", "ann", "dan", None, 20, False),     # held, declined at 6
        (4, at(4), "givetip", "ann", "eve", None, 30, False),     # held, expires at 52
        (5, at(5), "accept", "cat", None, None, None, False),
        (6, at(6), "decline", "dan", None, None, None, False),
        (7, at(7), "givetip", "cat", "bob", None, None, True),    # everything cat got
        (8, at(8), "withdraw", "ann", None, "DB", 5, False),      # bob's own address
        (9, at(9), "withdraw", "ann", None, "bad", 5, False),
        (10, at(10), "givetip", "zed", "bob", None, 5, False),
        (11, at(11), "givetip", "bob", "ann", None, 3, False),
        (12, at(12), "givetip", "bob", "ann", None, 500, False),
        (13, at(13), "withdraw", "bob", None, "Dx", 500, False),
        (14, at(60), "givetip", "ann", "bob", None, None, True),  # 100 - 10 - 5 after refunds
    ]
    rows = [(i, t, 1, k, f, u, a, None if v is None else Decimal(v), w) for i, t, k, f, u, a, v, w in log]
    actions = spark.createDataFrame(
        rows,
        "action_id long, ts timestamp, service_id long, type string, from_user string, to_user string, to_addr string, coin_val decimal(20,8), take_all boolean",
    )
    opening = address.select(F.col("user_id").alias("account"), "balance")
    check = lambda a: a.startswith("D")
    run = ledger.settle_ledger(actions, user, names, address, opening, address_check=check)
    got = {r["action_id"]: (r["state"], r["error"], None if r["coin_val"] is None else int(r["coin_val"])) for r in run.outcomes.collect()}
    assert got == {
        1: ("completed", None, 10),
        2: ("failed", None, 10),
        3: ("declined", None, 20),
        4: ("expired", None, 30),
        7: ("completed", None, 10),
        8: ("completed", None, 5),
        9: ("failed", "addr_invalid", 5),
        10: ("failed", "not_registered", 5),
        11: ("failed", "tip_below_minimum", 3),
        12: ("failed", "balance_too_low", 500),
        13: ("failed", None, 500),
        14: ("completed", None, 85),
    }


def test_history_of_self_and_linked_names(spark):
    names = spark.createDataFrame([(1, 7, 1, "ann"), (2, 7, 1, "ann2")], "username_id long, user_id long, service_id long, username string")
    service = spark.createDataFrame([(1, "reddit")], "service_id long, service_name string")
    acts = spark.createDataFrame(
        [(1, 1, "givetip", "completed", at(1), "ann", "ann"), (2, 1, "givetip", "completed", at(2), "Ann", "ANN2"), (3, 1, "info", "completed", at(3), "ann", None)],
        "action_id long, service_id long, type string, state string, ts timestamp, from_user string, to_user string",
    )
    got = history.user_history(names, acts, service).orderBy("position").collect()
    assert [(r["position"], r["action_id"]) for r in got] == [(1, 2), (2, 1)]


def test_find_actions(spark, tables):
    a = tables.action
    n = history.find_actions(a, from_user="CUSTOMER_000000007", command="givetip").count()
    assert n == a.where("from_user = 'customer_000000007' and type = 'givetip'").count()
    assert history.action_exists(a, command="redeem").first()["found"] is False


def test_missing_users_are_null_safe(spark):
    users = spark.createDataFrame([(1,), (2,)], "user_id long")
    address = spark.createDataFrame([(1, "dog"), (None, "dog")], "user_id long, coin string")
    assert [r["user_id"] for r in identity.users_missing_coin(users, address, "dog").collect()] == [2]


def test_deleted_parent(spark):
    msgs = spark.createDataFrame([("t1_1", None), ("t1_2", "[deleted]"), ("t1_3", "ann")], "fullname string, author string")
    memo = identity.remember_authors(msgs)
    assert {r["msg_id"]: r["username"] for r in memo.collect()} == {"t1_1": "[deleted]", "t1_2": "[deleted]", "t1_3": "ann"}
    comments = spark.createDataFrame([("c1", "t1_2"), ("c2", "t1_3"), ("c3", "t1_9")], "fullname string, parent_id string")
    got = identity.parent_author(comments, msgs).collect()
    assert {r["fullname"]: r["parent_author"] for r in got} == {"c1": None, "c2": "ann", "c3": None}


def test_failed_reading_drops_the_exchange(spark):
    q = spark.createDataFrame(
        [("dog", "btc", "x", 2.0), ("dog", "btc", "x", None), ("dog", "btc", "y", 4.0), ("dog", "btc", "z", -1.0), ("btc", "btc", "y", 9.0), ("btc", "usd", "x", None)],
        "thing_from string, thing_to string, exchange string, value double",
    )
    got = {(r["thing_from"], r["thing_to"]): r["rate"] for r in rates.average_rates(q).collect()}
    assert got == {("dog", "btc"): 4.0, ("btc", "btc"): 1.0, ("btc", "usd"): 0.0}


def test_saved_rates_read_back(spark):
    r = spark.createDataFrame([(1, "dog", "btc", 0.5), (1, "btc", "usd", 3.0), (1, "btc", "eur", 2.0), (2, "dog", "btc", 0.5)], "snap_id long, thing_from string, thing_to string, rate double")
    saved = rates.append_rates(r, by=("snap_id",))
    rows = rates.parse_rates(saved).collect()
    assert [(x["snap_id"], x["rate"]) for x in rows] == [(1, Decimal("1.5"))]


def test_notifications_of_an_accept(spark):
    ddl = "type string, state string, error string, from_user string, to_user string, to_addr string, ts timestamp, by_accept boolean, coin_val decimal(20,8)"
    df = spark.createDataFrame(
        [("givetip", "completed", None, "a", "b", None, T0, True, Decimal(1)), ("withdraw", "pending", None, "a", None, "D", T0, False, Decimal(1)), ("givetip", "failed", None, "a", "b", None, T0, False, Decimal(1))],
        ddl,
    )
    assert sorted(r["type"] for r in notify.notify(df).collect()) == ["tip_received", "tip_sent"]


def test_which_notifications_become_messages(spark):
    ddl = "command string, type string, from_user string, to_user string, coin_val decimal(20,8), verify boolean, is_new boolean"
    rows = [
        ("gold", "balance_too_low"), ("givetip", "balance_too_low"), ("givetip", "tip_below_minimum"), ("register", "already_registered"),
        ("withdraw", "addr_invalid"), ("withdraw", "tip_sent"), ("gold", "gold_sent"), ("gold", "gold_received"), ("deposit", "deposit"),
        ("history", "history"), ("accept", "accept"), ("register", "register"), ("gold", "fiat_error"), ("info", "not_registered"),
        ("givetip", "tip_sent"), ("givetip", "tip_received_sneaky"),
    ]
    df = spark.createDataFrame([(c, k, "ann", "bob", Decimal(5), False, False) for c, k in rows], ddl)
    got = {(r["command"], r["type"]): (r["recipient"], r["template"]) for r in notify.select_messages(df).collect()}
    assert got == {
        ("gold", "balance_too_low"): ("ann", "gold_low_balance"),
        ("withdraw", "addr_invalid"): ("ann", "address_invalid"),
        ("withdraw", "tip_sent"): ("ann", "confirmation"),
        ("gold", "gold_sent"): ("ann", "gold_confirm"),
        ("gold", "gold_received"): ("bob", "gold_not_registered"),
        ("deposit", "deposit"): ("ann", "deposit"),
        ("history", "history"): ("ann", "history"),
        ("accept", "accept"): ("ann", "info"),
        ("register", "register"): ("ann", "info"),
        ("gold", "fiat_error"): ("ann", "fiat_error"),
        ("info", "not_registered"): ("ann", "not_registered"),
        ("givetip", "tip_received_sneaky"): ("bob", "withdraw_sneaky_to"),
    }
    loud = df.where("type = 'tip_sent' and command = 'givetip'").withColumn("verify", F.lit(True)).withColumn("is_new", F.lit(True))
    assert sorted(r["template"] for r in notify.select_messages(loud).collect()) == ["tip_confirmation", "tip_sent"]


def test_texts(spark, tables):
    from tallybook.catalog.reports import _messages

    texts = notify.render(_messages(tables)).select("template", "text", "from_user").collect()
    assert all(r["text"] for r in texts)
    assert any("customer\\_0" in r["text"] for r in texts)
    assert not any("{" in r["text"] for r in texts)


def test_round_trip_of_ledger_tables(spark, tables):
    space = Workspace(spark, "t-ledger")
    tables.action.write.parquet(space.path("action"))
    tables.username.write.parquet(space.path("username"))
    loaded = load_ledger(spark, space.root, ("action", "username"))
    assert loaded["action"].columns == [f.name for f in fields(LEDGER_TABLES["action"]).fields]
    assert loaded["action"].count() == tables.action.count()


def test_sinks(spark, tables):
    space = Workspace(spark, "t-sinks")
    notes = spark.createDataFrame([("reddit", 1), ("email", 2), (None, 3)], "service string, n int")
    sinks.write_notifications(notes, space.path("notes"))
    back = spark.read.json(space.path("notes"))
    assert {(r["queue"], r["n"]) for r in back.collect()} == {("reddit", 1), ("rejected", 2), ("rejected", 3)}
    sinks.archive_raw(notes.select(F.to_json(F.struct("*")).alias("message")), space.path("raw"))
    assert spark.read.parquet(space.path("raw")).where("timestamp is not null").count() == 3
    sinks.append_wallet_balance(spark.createDataFrame([(T0, Decimal(1))], "ts timestamp, amount decimal(20,8)"), space.path("w"))
    sinks.append_wallet_balance(spark.createDataFrame([(at(1), Decimal(2))], "ts timestamp, amount decimal(20,8)"), space.path("w"))
    assert rates.latest_wallet_balance(spark.read.parquet(space.path("w"))).first()["amount"] == 2
    from tallybook.operators.reports import tips_page

    sinks.write_reports(tips_page(tables.action, limit=20), space.path("pages"))
    lines = spark.read.parquet(space.path("pages")).orderBy("page", "section", "k1", "k2").collect()
    assert lines[0]["line"] == "### All completed tips" and len(lines) == 24


def test_keyword_table_matches_the_derived_one(spark, tables):
    own = {tuple(r) for r in commands.keyword_table(spark).collect()}
    assert own == {tuple(r) for r in tables.keyword.collect()}


def test_checkpoint_folder_is_the_session_setting(spark):
    from tallybook.plans.lineage import checkpoint_root

    root = checkpoint_root(spark)
    assert spark.conf.get("spark.checkpoint.dir") == root == checkpoint_root(spark)


def test_queries_do_not_touch_views(spark):
    assert isinstance(Tables(spark, "/root/testdata/sf0.001").service.count(), int)
    assert not [t for t in spark.catalog.listTables() if not t.name.startswith("tallybook_stream")]


def test_pages_belong_to_a_name_of_a_service(tables):
    from tallybook.operators.reports import user_pages

    known = tables.username.select("service_id", F.lower("username").alias("name")).distinct()
    pages = user_pages(tables.username, tables.action)
    assert pages.select("page").distinct().count() == known.count() > known.select("name").distinct().count()
