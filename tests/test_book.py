"""One ledger: tips, withdrawals, gold and deposits against balances and the hot wallet."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallybook.operators.settle import CLAIM_DDL, audit_decisions, settle
from tallybook.schemas import fields

MINIMUM = Decimal(4)


def sequential(opening, wallets, claims, credits):
    """Claims one by one, each against its sender and its wallet."""
    balance, wallet, out = dict(opening), dict(wallets), {}
    for c in sorted([*claims, *credits], key=lambda c: (c["t"], c["action_id"])):
        via = c["via"]
        if c["src"] is None:
            balance[c["dst"]] = balance.get(c["dst"], 0) + c["amount"]
            if via is not None:
                wallet[via] = wallet.get(via, 0) + c["amount"]
            continue
        have = balance.get(c["src"], Decimal(0))
        amount = have if c["take_all"] else c["amount"]
        if c["take_all"] and have < MINIMUM:
            out[c["action_id"]] = (False, "tip_below_minimum", None)
        elif have < amount:
            out[c["action_id"]] = (False, c["short_error"], None)
        elif via is not None and wallet.get(via, 0) < amount:
            out[c["action_id"]] = (False, None, None)
        else:
            out[c["action_id"]] = (True, None, amount)
            balance[c["src"]] = have - amount
            if via is not None:
                wallet[via] = wallet.get(via, 0) - amount
            elif c["dst"] is not None:
                balance[c["dst"]] = balance.get(c["dst"], 0) + amount
    return out


def row(action_id, t, src, dst, amount, via=None, take_all=False, error="balance_too_low"):
    return dict(
        action_id=action_id, t=t, src=src, dst=dst, amount=amount, take_all=take_all, held=False, end_t=None, end_phase=0,
        end_id=action_id, refund=False, pair=None, short_error=error, via=via,
    )


def decided(spark, opening, wallets, claims, credits, **options):
    schema = fields(CLAIM_DDL + ", via bigint")
    frame = lambda rows: spark.createDataFrame([tuple(c[f.name] for f in schema.fields) for c in rows], schema)
    money = lambda of: spark.createDataFrame(list(of.items()), "account bigint, balance decimal(38,8)")
    result = settle(money(opening), frame(claims), frame(credits), second=money(wallets), **options)
    assert audit_decisions_fit(spark, money(opening), result, credits) is None
    return {r.action_id: (r.accepted, r.error, r.amount if r.accepted else None) for r in result.decisions.collect()}


def audit_decisions_fit(spark, opening, result, credits):
    """Without credits every decision on the sender's side fits its balance; the wallet's rejections carry no error."""
    if not credits:
        assert audit_decisions(opening, result.decisions).where("not consistent").isEmpty()


@pytest.mark.parametrize("options", [{}, {"chunks": 32}], ids=["rounds", "cut-wallets"])
def test_two_accounts_at_once(spark, options):
    """Withdrawals need their sender and the wallet of their time; deposits raise both."""
    rng = random.Random(str(options))
    opening, wallets, claims, credits, want = {}, {}, [], [], {}
    for ledger in range(30):
        base = ledger * 1000
        mine = {base + a: Decimal(rng.randrange(0, 60)) for a in range(rng.randrange(2, 6))}
        held = {base + w: Decimal(rng.randrange(0, 90)) for w in range(3)}
        rows, ins = [], []
        for i in range(rng.randrange(5, 25)):
            at, who, other = rng.randrange(30), rng.choice(list(mine)), rng.choice(list(mine))
            via = base + at // 10
            kind = rng.random()
            amount = Decimal(rng.randrange(4, 40))
            if kind < 0.4:
                rows.append(row(base + i, at, who, None, amount, via, rng.random() < 0.3, None))
            elif kind < 0.85:
                rows.append(row(base + i, at, who, other, amount, None, rng.random() < 0.2))
            else:
                ins.append(row(base + i, at, None, who, amount, via))
        opening |= mine
        wallets |= held
        claims += rows
        credits += ins
        want |= sequential(mine, held, rows, ins)
    assert decided(spark, opening, wallets, claims, credits, **options) == want
    assert {(a, e) for a, e, _ in want.values()} >= {(True, None), (False, None), (False, "balance_too_low")}


def test_whole_balance_against_a_small_wallet(spark):
    """All of 500 does not leave through a wallet of 1, nor does it block what is small enough."""
    claims = [row(1, 1, 10, None, None, 7, True, None), row(2, 2, 10, None, Decimal("0.5"), 7, False, None), row(3, 3, 10, None, Decimal("0.6"), 7, False, None)]
    got = decided(spark, {10: Decimal(500)}, {7: Decimal(1)}, claims, [])
    assert got == {1: (False, None, None), 2: (True, None, Decimal("0.5")), 3: (False, None, None)}


def test_a_wallet_without_opening_is_empty(spark):
    got = decided(spark, {10: Decimal(500)}, {}, [row(1, 1, 10, None, Decimal(4), 7)], [])
    assert got == {1: (False, None, None)}


T0 = dt.datetime(2024, 1, 1)
LOG = [
    # action_id, hours, type, from, to, address, amount, everything, message
    (1, 1, "givetip", "bob", "ann", None, 40, False, "m1"),      # bob has nothing yet
    (2, 2, "deposit", "bob", None, "DB", 100, False, None),
    (3, 3, "givetip", "bob", "ann", None, 40, False, "m3"),      # deposited coins can be tipped
    (4, 4, "givetip", "bob", "ann", None, 40, False, "m3"),      # the same message again
    (5, 5, "gold", "ann", "bob", None, None, False, None),       # costs 10,000
    (6, 6, "givetip", "ann", "bob", None, 5000, False, "m6"),    # spent on gold
    (7, 7, "givetip", "bob", "cat", None, 10, False, "m7"),      # held, accepted at 9 at another rate
    (8, 8, "withdraw", "bob", None, "DX", None, True, "m8"),     # 50 through a wallet of 30
    (9, 9, "accept", "cat", None, None, None, False, None),
    (10, 10, "withdraw", "bob", None, "DX", 20, False, "m10"),   # leaves 10 in the wallet
    (11, 11, "withdraw", "bob", None, "DX", 20, False, "m11"),   # the wallet is too low
    (12, 12, "deposit", "ann", None, "DA", 25, False, None),     # raises the wallet as well
    (13, 13, "withdraw", "bob", None, "DX", 20, False, "m13"),
    (14, 14, "history", "zed", None, None, None, False, None),
    (15, 15, "register", "zed", None, None, None, False, None),
    (16, 16, "register", "zed", None, None, None, False, None),
    (17, 17, "history", "zed", None, None, None, False, None),
    (18, 18, "decline", "zed", None, None, None, False, None),
    (19, 19, "deposit", "nobody", None, "DN", 7, False, None),
]
DDL = (
    "action_id long, ts timestamp, service_id long, type string, from_user string, to_user string, to_addr string, "
    "coin_val decimal(20,8), take_all boolean, config1 string"
)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def book_of(spark, log, **options):
    from tallybook.operators.book import settle_book

    user = spark.createDataFrame([(1, T0), (2, T0)], "user_id long, joindate timestamp")
    names = spark.createDataFrame([(1, 1, 1, "ann"), (2, 2, 1, "bob")], "username_id long, user_id long, service_id long, username string")
    address = spark.createDataFrame(
        [(1, 1, None, "dog", "DA", Decimal(10_010)), (2, 2, None, "dog", "DB", Decimal(0))],
        "address_id long, user_id long, user_id_alias long, coin string, address string, balance decimal(20,8)",
    )
    rates = spark.createDataFrame(
        [(1, at(0), Decimal("0.0004")), (2, at(8.5), Decimal("0.0010")), (3, at(9), Decimal(0))], "snap_id long, fiat_date timestamp, rate decimal(20,8)"
    )
    wallet = spark.createDataFrame([(at(0), Decimal(5)), (at(7.5), Decimal(30))], "ts timestamp, amount decimal(20,8)")
    rows = [(i, at(h), 1, k, f, u, a, None if v is None else Decimal(v), w, m) for i, h, k, f, u, a, v, w, m in log]
    opening = address.select(F.col("user_id").alias("account"), "balance")
    return settle_book(
        spark.createDataFrame(rows, DDL), user, names, address, opening, rates, F.lit(99), wallet,
        address_check=lambda a: a.startswith("D"), **options,
    )


def test_whole_log(spark):
    book = book_of(spark, LOG)
    got = {r.action_id: (r.state, r.error, r.coin_val, r.fiat_val) for r in book.outcomes.collect()}
    money = lambda v: None if v is None else Decimal(str(v))
    want = {
        1: ("failed", "balance_too_low", 40, "0.016"), 2: ("completed", None, 100, "0.04"), 3: ("completed", None, 40, "0.016"),
        4: ("ignored", None, 40, None), 5: ("completed", None, 10_000, 4), 6: ("failed", "balance_too_low", 5000, 2),
        7: ("completed", None, 10, "0.01"), 8: ("failed", None, None, 0), 9: ("completed", None, None, None),
        10: ("pending", None, 20, "0.02"), 11: ("failed", None, 20, "0.02"), 12: ("completed", None, 25, "0.025"),
        13: ("pending", None, 20, "0.02"), 14: ("failed", "not_registered", None, None), 15: ("completed", None, None, None),
        16: ("failed", "already_registered", None, None), 17: ("completed", None, None, None), 18: ("failed", None, None, None),
        19: ("failed", "not_registered", 7, None),
    }
    for i, (state, error, coins, fiat) in want.items():
        assert got[i][:3] == (state, error, money(coins)), i
        assert fiat is None and got[i][3] in (None, Decimal("0.007")) or got[i][3] == money(fiat), i
    balances = {r.account: r.balance for r in book.balances().collect()}
    # No coin is made or lost: openings and deposits are balances, gold included, and what was sent out.
    assert balances[1] == 10_010 + 40 - 10_000 + 25 and balances[2] == 100 - 40 - 10 - 20 - 20 and balances[99] == 10_000
    assert sum(balances.values()) == 10_010 + 125 - 40


def test_a_log_delivered_twice(spark):
    """The same rows again, and the same messages under new ids, change neither balances nor outcomes."""
    once = book_of(spark, LOG)
    messages = [(i + 100, h + 30, *rest) for i, h, *rest in LOG if rest[-1]]
    twice = book_of(spark, LOG + LOG + messages)
    pick = lambda df: {r.account: r.balance for r in df.collect()}
    assert pick(once.balances()) == pick(twice.balances())
    rows = lambda book: {r.action_id: tuple(r) for r in book.outcomes.collect()}
    first, second = rows(once), rows(twice)
    assert {i: second[i] for i in first} == first
    assert {second[i][10] for i in second if i > 100} == {"ignored"}


def test_messages_recorded_earlier(spark):
    recorded = spark.createDataFrame([("givetip", 1, "m3"), ("givetip", 1, None)], "type string, service_id long, config1 string")
    states = {r.action_id: r.state for r in book_of(spark, LOG, recorded=recorded).outcomes.collect()}
    assert states[3] == states[4] == "ignored" and states[1] == "failed" and states[7] == "completed"


def test_contested_wallet_takes_few_rounds(spark):
    """Withdrawals that fit and that do not fit by turns, each deposit letting some more pass."""
    rng = random.Random(5)
    opening, wallets = {a: Decimal(100) for a in range(150)}, {w: Decimal(50) for w in (7, 8, 9)}
    claims = [row(i, 10 * i, i, None, Decimal(rng.randrange(5, 40)), via=7 + i % 3, error=None) for i in range(150)]
    credits = [row(1000 + i, 10 * i + 5, None, i, Decimal(9), via=7 + i // 2 % 3) for i in range(0, 150, 2)]
    # One sender waits for another's tip, so the rows after it are in doubt for a while.
    opening[20] = Decimal(0)
    claims.append(row(2000, 1, 0, 20, Decimal(50)))
    schema = fields(CLAIM_DDL + ", via bigint")
    frame = lambda rows: spark.createDataFrame([tuple(c[f.name] for f in schema.fields) for c in rows], schema)
    money = lambda of: spark.createDataFrame(list(of.items()), "account bigint, balance decimal(38,8)")
    result = settle(money(opening), frame(claims), frame(credits), second=money(wallets), chunks=2)  # no wallet is cut
    got = {r.action_id: (r.accepted, r.error, r.amount if r.accepted else None) for r in result.decisions.collect()}
    assert got == sequential(opening, wallets, claims, credits)
    assert result.rounds <= 6  # by bounds of sums alone: one round for each change between fitting and not fitting
