"""Settlement against a strictly sequential model on random ledgers."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallybook.operators.settle import CLAIM_DDL, audit_decisions, closing_balances, settle
from tallybook.schemas import fields

MINIMUM = Decimal(4)
HOUR = 3_600_000_000


def random_ledger(rng, index, n_accounts, n_actions):
    """Claims and opening balances of one small ledger with ids of its own."""
    first = index * 1000
    accounts = [first + i for i in range(n_accounts)]
    opening = {a: Decimal(rng.choice([0, 5, 20, 60])) for a in accounts}
    claims = []
    for i in range(n_actions):
        action = index * 10_000 + i
        t = rng.randrange(0, 40) * HOUR
        src, dst = rng.choice(accounts), rng.choice(accounts)
        row = dict(
            action_id=action, t=t, src=src, dst=dst, amount=Decimal(rng.randrange(4, 30)), take_all=False,
            held=False, end_t=None, end_phase=0, end_id=action, refund=False, pair=None, short_error="balance_too_low",
        )
        kind = rng.random()
        if kind < 0.1:
            row.update(dst=None, short_error=None)
        elif kind < 0.5:
            target = rng.choice(accounts)
            end = rng.random()
            row.update(
                held=True,
                dst=target,
                pair=f"{src}|{target}",
                end_t=t + rng.randrange(0, 30) * HOUR,
                end_phase=1 if end < 0.6 else 0,
                end_id=action + 5_000 if end < 0.6 else action,
                refund=end > 0.3,
            )
            if row["end_phase"] == 0 and row["end_t"] == t:
                row["end_t"] = t + HOUR
        if rng.random() < 0.12:
            row.update(take_all=True, amount=None)
        claims.append(row)
    return opening, claims


def sequential(opening, claims):
    balance = dict(opening)
    events = [((c["t"], 1, c["action_id"]), 1, c) for c in claims]
    events += [((c["end_t"], c["end_phase"], c["end_id"]), 0, c) for c in claims if c["held"]]
    accepted, live, out = {}, {}, {}
    for order, is_claim, c in sorted(events, key=lambda e: (e[0], e[1])):
        if not is_claim:
            amount = accepted.get(c["action_id"])
            if amount is not None:
                who = c["src"] if c["refund"] else c["dst"]
                balance[who] = balance.get(who, 0) + amount
            continue
        have = balance.get(c["src"], Decimal(0))
        amount = have if c["take_all"] else c["amount"]
        blocked = c["held"] and any(
            (b["end_t"], b["end_phase"], b["end_id"]) > order for b in live.get(c["pair"], [])
        )
        if c["take_all"] and have < MINIMUM:
            out[c["action_id"]] = (False, "tip_below_minimum", None)
        elif have < amount:
            out[c["action_id"]] = (False, c["short_error"], None)
        elif blocked:
            out[c["action_id"]] = (False, None, None)
        else:
            out[c["action_id"]] = (True, None, amount)
            accepted[c["action_id"]] = amount
            balance[c["src"]] = have - amount
            if c["held"]:
                live.setdefault(c["pair"], []).append(c)
            elif c["dst"] is not None:
                balance[c["dst"]] = balance.get(c["dst"], 0) + amount
    return out, balance


def build(spark, ledgers):
    opening = [(a, b) for o, _ in ledgers for a, b in o.items()]
    schema = fields(CLAIM_DDL)
    rows = [tuple(c[f.name] for f in schema.fields) for _, cs in ledgers for c in cs]
    return (
        spark.createDataFrame(opening, "account bigint, balance decimal(38,8)"),
        spark.createDataFrame(rows, schema),
    )


@pytest.mark.parametrize(
    "options",
    [
        {},
        {"chunks": 2},
        {"chunks": 64},
    ],
    ids=["rounds", "few-chunks", "cut-accounts"],
)
def test_equals_sequential(spark, options):
    rng = random.Random(str(options))
    ledgers = [random_ledger(rng, i, rng.randrange(2, 6), rng.randrange(5, 25)) for i in range(40)]
    opening, claims = build(spark, ledgers)
    result = settle(opening, claims, **options)
    got = {
        r["action_id"]: (r["accepted"], r["error"], r["amount"] if r["accepted"] else None)
        for r in result.decisions.collect()
    }
    want, balances = {}, {}
    for o, cs in ledgers:
        decided, left = sequential(o, cs)
        want.update(decided)
        balances.update(left)
    assert got == want
    closing = {r["account"]: r["balance"] for r in closing_balances(opening, result.decisions).collect()}
    assert closing == balances
    assert audit_decisions(opening, result.decisions).where("not consistent").isEmpty()
    assert min(closing.values()) >= 0


def test_one_hot_account(spark):
    """A third of all rows on one account, cut into chunks."""
    rng = random.Random(7)
    opening = {a: Decimal(100) for a in range(50)}
    claims = []
    for i in range(600):
        src, dst = (0, rng.randrange(1, 50)) if i % 3 == 0 else (rng.randrange(1, 50), rng.randrange(0, 50))
        claims.append(
            dict(
                action_id=i, t=(0 if i % 3 == 0 else i) * HOUR, src=src, dst=dst, amount=Decimal(rng.randrange(4, 40)),
                take_all=False, held=False, end_t=None, end_phase=0, end_id=i, refund=False, pair=None,
                short_error="balance_too_low",
            )
        )
    opening_df, claims_df = build(spark, [(opening, claims)])
    result = settle(opening_df, claims_df, chunks=16)
    want, _ = sequential(opening, claims)
    got = {r["action_id"]: r["accepted"] for r in result.decisions.collect()}
    assert got == {k: v[0] for k, v in want.items()}


def test_conservation(spark, tables):
    from tallybook.operators.settle import claim

    opening = tables.opening.select(F.col("user_id").alias("account"), "balance")
    claims = tables.transfer.select(
        *claim(F.col("action_id"), F.col("ts"), F.col("from_id"), F.col("to_id"), F.col("amount"))
    )
    closing = closing_balances(opening, settle(opening, claims).decisions)
    total = lambda df: df.agg(F.sum("balance").cast("decimal(38,8)")).first()[0]
    assert total(closing) == total(opening)
    assert closing.where("balance < 0").isEmpty()


def test_audit_finds_a_wrong_decision(spark, tables):
    from tallybook.operators.settle import claim

    opening = tables.opening.select(F.col("user_id").alias("account"), "balance")
    claims = tables.transfer.select(
        *claim(
            F.col("action_id"), F.col("ts"), F.col("from_id"), F.col("to_id"), F.col("amount"),
            short_error=F.lit("balance_too_low"),
        )
    )
    decisions = settle(opening, claims).decisions
    rejected = decisions.where("not accepted").agg(F.min("action_id")).first()[0]
    flipped = F.col("action_id") == rejected
    wrong = decisions.withColumn("accepted", F.col("accepted") | flipped).withColumn(
        "error", F.when(~flipped, F.col("error"))
    )
    assert audit_decisions(opening, decisions).where("not consistent").isEmpty()
    assert rejected in [r["action_id"] for r in audit_decisions(opening, wrong).where("not consistent").collect()]


def plain_ledger(rng, index, unit, errors):
    """Transfers that are not held and name their amount, some to oneself or to nobody."""
    opening, claims = random_ledger(rng, index, rng.randrange(2, 6), rng.randrange(5, 30))
    opening = {a: b * unit for a, b in opening.items()}
    for c in claims:
        c.update(
            held=False, end_t=None, end_phase=0, refund=False, pair=None, take_all=False,
            amount=Decimal(rng.randrange(1, 30)) * unit, short_error=rng.choice(errors),
        )
    return opening, claims


@pytest.mark.parametrize(
    ("unit", "errors", "kind"),
    [
        ("1.00000001", ["balance_too_low"], "bigint"),
        ("0.00000007", ["balance_too_low", None, "other"], "bigint"),
        ("100000000", [None], "bigint"),
        ("100000000000000.000003", ["balance_too_low"], "decimal(38,8)"),
    ],
)
@pytest.mark.parametrize("chunks", [None, 64])
def test_plain_claims_move_what_differs_only(spark, monkeypatch, unit, errors, kind, chunks):
    """Rounds of plain transfers shuffle whole numbers and no column that is the same for all (before: all, as decimals)."""
    from tallybook.operators import settle as S

    written = {}
    store = S.Workspace.store

    def seen(space, df, name):
        written[name] = dict(df.dtypes)
        return store(space, df, name)

    monkeypatch.setattr(S.Workspace, "store", seen)
    rng = random.Random(unit)
    ledgers = [plain_ledger(rng, i, Decimal(unit), errors) for i in range(30)]
    opening, claims = build(spark, ledgers)
    result = settle(opening, claims, chunks=chunks)
    got = {
        r["action_id"]: (r["accepted"], r["error"], r["amount"] if r["accepted"] else None)
        for r in result.decisions.collect()
    }
    want, balances = {}, {}
    for o, cs in ledgers:
        decided, left = sequential(o, cs)
        want.update(decided)
        balances.update(left)
    assert got == want
    assert result.decisions.schema["amount"].dataType.simpleString() == S.MONEY
    closing = {r["account"]: r["balance"] for r in closing_balances(opening, result.decisions).collect()}
    assert closing == balances
    assert written["round-1"]["amount"] == written["round-1"]["base"] == kind
    assert not {"held", "pair", "end_t", "block_end", "via", "take_all", "need"} & written["round-1"].keys()
    assert ("short_error" in written["round-1"]) == (len(errors) > 1)


def test_far_amounts_that_no_account_gets(spark):
    """A credit to nobody, or a claim on nobody's coins, beyond whole numbers keeps decimals."""
    huge = Decimal(10) ** 20
    base = dict(t=0, take_all=False, held=False, end_t=None, end_phase=0, end_id=0, refund=False, pair=None, short_error=None)
    claims = [dict(base, action_id=1, src=1, dst=2, amount=Decimal(5)), dict(base, action_id=2, src=2, dst=2, amount=huge)]
    opening, rows = build(spark, [({1: Decimal(5)}, claims)])
    gift = build(spark, [({1: Decimal(5)}, [dict(base, action_id=3, src=None, dst=None, amount=huge)])])[1]
    for granted in (None, gift):
        got = {r["action_id"]: r["accepted"] for r in settle(opening, rows, granted).decisions.collect()}
        assert got == {1: True, 2: False}
    got = settle(opening, rows.where("action_id = 1"), gift).decisions.collect()
    assert [r["accepted"] for r in got] == [True]
