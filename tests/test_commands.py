"""Golden rows of the command language."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallybook.operators.commands import (
    accepted,
    build_action,
    extract_commands,
    keyword_table,
    price_keywords,
    read_commands,
    read_inbox_commands,
    rejected,
)
from tallybook.operators.rules import expand_rules

A = "DFundmtrigzA6E25Swr2pRe4Eb79bGP8G1"
B = "tipbot"

# text, public, action, rule, to_user, address, amount, keyword, verify
GOLDEN = [
    (f"+{B} 100 doge", True, "givetip", "a", None, None, "100", None, False),
    (f"+/u/{B} 5.5 DOGE verify", True, "givetip", "a", None, None, "5.5", None, True),
    (f"+{B} 10 dogecoins verify", True, "givetip", "a", None, None, "10", None, False),
    (f"+{B}   roll  doges verify", True, "givetip", "aa", None, None, None, "roll", False),
    (f"+{B} doge100 verify", True, "givetip", "g", None, None, "100", None, True),
    (f"+{B} @bob 5 doge", True, "givetip", "c", "bob", None, "5", None, False),
    (f"+{B} @bob megaflip verify", True, "givetip", "ccccc", "bob", None, None, "megaflip", True),
    (f"+{B} {A} 20 doge", True, "givetip", "b", None, A, "20", None, False),
    (f"+{B} {A} 20", True, "givetip", "bbbbbbbb", None, A, "20", None, False),
    (f"+{B} all", True, "givetip", "ggggg", None, None, None, "all", False),
    (f"+{B} allstars", True, "givetip", "ggggg", None, None, None, "all", False),
    (f"first line\n+{B} ALL\nlast line", True, "givetip", "ggggg", None, None, None, "all", False),
    (f"+{B} gold", True, "gold", "", None, None, None, None, False),
    (f"+{B} GOLD verify", True, "gold", "", None, None, None, None, False),
    (f"+withdraw {A} all doge", False, "withdraw", "aa", None, A, None, "all", False),
    (f"+withdraw {A} $5 doge", False, "withdraw", "b", None, A, "5", None, False),
    (f"+withdraw {A} ¥5 doge", False, "withdraw", "b", None, A, "5", None, False),
    ("hi +history and +info", False, "info", "", None, None, None, None, False),
    ("+balance", False, "info", "", None, None, None, None, False),
    ("+redeem doge", False, "redeem", "a", None, None, None, None, False),
    ("+rates", False, "rates", "", None, None, None, None, False),
]
NO_MATCH = [f"+{B} 100", f"+{B} @bob 5", f"+{B} 1,000 doge", f"+{B} 1234567890 doge", f"+{B} 10doge", "", "thanks"]


def test_rule_table():
    rules = expand_rules()
    assert len(rules) == 39
    assert Counter(r.action for r in rules)["givetip"] == 15
    assert Counter(r.action for r in rules)["withdraw"] == 16
    assert [r.fiat for r in rules if r.name == "b" and r.action == "withdraw"] == [
        "cny", "eur", "gbp", "jpy", "rub", "usd",
    ]


@pytest.mark.parametrize("public", [True, False])
def test_golden(spark, public):
    golden = [g for g in GOLDEN if g[1] or not public]
    df = spark.createDataFrame([(g[0],) for g in golden], "body string")
    got = {r["body"]: r for r in extract_commands(df, public).collect()}
    for text, _, *fields in golden:
        row = got[text]
        seen = [row[c] for c in ("action", "rule", "to_user", "address", "amount", "keyword", "verify")]
        assert seen == fields, text


def test_units(spark):
    df = spark.createDataFrame([(f"+withdraw {A} ¥5 doge",), (f"+withdraw {A} $5 doge",), (f"+{B} 5 Ð",)], "body string")
    got = {r["body"]: (r["coin"], r["fiat"]) for r in extract_commands(df, False).collect()}
    assert list(got.values()) == [("dog", "cny"), ("dog", "usd"), ("dog", None)]


def test_no_match(spark):
    df = spark.createDataFrame([(t,) for t in NO_MATCH] + [(None,)], "body string")
    assert extract_commands(df, False).where("action is not null").isEmpty()


def test_private_rules_do_not_apply_to_comments(spark):
    df = spark.createDataFrame([("+history",), (f"+withdraw {A} 5 doge",)], "body string")
    assert extract_commands(df, True).where("action is not null").isEmpty()


def test_long_text(spark):
    """The command is found wherever it stands in a long text."""
    text = "words and more words " * 20_000 + f"+{B} @bob 7 doge" + " and so on" * 20_000
    row = extract_commands(spark.createDataFrame([(text,)], "body string"), True).first()
    assert (row["to_user"], row["amount"]) == ("bob", "7")


def test_envelopes(spark):
    good = '{"id":"1","reservation_id":"r","body":"{\\"service\\":\\"reddit\\",\\"type\\":\\"givetip\\",\\"u_from\\":\\"A\\",\\"u_to\\":\\"b\\",\\"coin_val\\":\\"1,000.123456789\\"}"}'
    both = good.replace('\\"u_to\\"', '\\"addr_to\\":\\"Dx\\",\\"u_to\\"')
    whole = good.replace("1,000.123456789", "all")
    df = spark.createDataFrame([(t,) for t in (good, both, whole, "{", "null", "")], "message string")
    parsed = read_commands(df)
    ok = accepted(parsed).collect()
    assert sorted(str(r["amount"]) for r in ok) == ["1000.12345678", "None"]
    assert [r["take_all"] for r in ok if r["amount"] is None] == [True]
    reasons = Counter(r["reject_reason"] for r in rejected(parsed).collect())
    assert reasons == {"target_not_unique": 1, "no_body": 3}


def test_fiat_withdrawal(spark):
    df = spark.createDataFrame([("t4_1", f"+withdraw {A} $5 doge", "ann", None, None)], "fullname string, body string, author string, parent_author string, subreddit string")
    priced = price_keywords(read_inbox_commands(df), keyword_table(spark))
    plain = build_action(priced).first()
    assert (plain["coin_val"], str(plain["fiat_val"]), plain["fiat"], plain["to_addr"]) == (None, "5.0000000000", "usd", A)
    converted = build_action(priced, convert_fiat=F.lit(0.0003)).first()
    assert str(converted["coin_val"]) == "16666.66666666"
