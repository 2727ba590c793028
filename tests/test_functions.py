"""Golden values of scalar functions, cells and address validation."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallybook.functions import cells, scalars
from tallybook.functions.address import valid_address, validate_addresses

ADDRESSES = {
    "9tVpQDnpftNT9qpWbP6gz3GE4Y3a94cmyt": True,
    "DFundmtrigzA6E25Swr2pRe4Eb79bGP8G1": True,
    "1HTL18EnUAgCjb8n2x3NN7bmVUmmDcnzBZ": False,  # other version
    "DFundmtrigzA6E25Swr2pRe4Eb79bGP8G2": False,  # checksum
    "DFundmtrigzA6E25Swr2pRe4Eb79bGP8G0": False,  # not base58
    "zzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzz": False,  # too large a number
    "D": False,
    "": False,
}


@pytest.fixture(scope="module")
def one(spark):
    frame = spark.range(1)

    def evaluate(column):
        return frame.select(column.alias("x")).first()["x"]

    return evaluate


def test_addresses(spark):
    df = spark.createDataFrame([(a,) for a in ADDRESSES] * 3 + [(None,)], "a string")
    got = {r["a"]: r["ok"] for r in df.select("a", valid_address(F.col("a")).alias("ok")).collect()}
    assert got == {**ADDRESSES, None: False}
    joined = validate_addresses(df, "a").collect()
    assert len(joined) == 3 * len(ADDRESSES) + 1
    assert {r["a"]: r["addr_valid"] for r in joined} == {**ADDRESSES, None: False}


@pytest.mark.parametrize("text,want", [("1.123456789", "1.12345678"), ("-1.999999999", "-1.99999999"), ("5", "5.00000000")])
def test_trunc8(one, text, want):
    assert str(one(scalars.trunc8(F.lit(Decimal(text)).cast("decimal(20,10)")))) == want


def test_trunc8_double(one):
    assert one(scalars.trunc8_double(F.lit(0.123456789))) == Decimal("0.12345678")
    assert one(scalars.trunc8_double(F.lit(-0.5))) == Decimal("-0.5")


@pytest.mark.parametrize(
    "text,want",
    [("1,000.5", "1000.50000000"), ("7", "7.00000000"), ("1.999999999", "1.99999999"), ("x1", None), ("", None), (".", None), (None, None)],
)
def test_parse_amount(one, text, want):
    got = one(scalars.parse_amount(F.lit(text).cast("string")))
    assert (None if got is None else str(got)) == want


def test_clamp(one):
    assert one(scalars.clamp_nonneg(F.lit(None).cast("decimal(20,8)"))) == 0
    assert one(scalars.clamp_nonneg(F.lit(Decimal("-1")).cast("decimal(20,8)"))) == 0


@pytest.mark.parametrize(
    "doc,path,want",
    [
        ('{"return":{"markets":{"DOGE/BTC":{"lasttradeprice":"0.0000005"}}}}', "return.markets.DOGE/BTC.lasttradeprice", "0.0000005"),
        ('{"Last Trade":"5"}', "Last Trade", "5"),
        ('{"USD":{"15m":3.5}}', "USD.15m", "3.5"),
        ('[1,{"a":2}]', "1.a", "2"),
        ('{"a":1}', "b.c", None),
        ("not json", "a", None),
    ],
)
def test_json_at(one, doc, path, want):
    assert one(scalars.json_at(F.lit(doc), path)) == want


def test_ticker_path():
    assert scalars.expand_path("/{THING_FROM}_{THING_TO}", "dog", "BTC") == "/dog_btc"
    assert scalars.expand_path("{THING_FROM}", "dog", "btc", uppercase=True) == "DOG"


@pytest.mark.parametrize("rate,want", [(0.0002, 20000), (0.0005, None), (0.0, None), (-1.0, None)])
def test_gold_price(one, rate, want):
    assert one(scalars.gold_price(F.lit(rate))) == want


@pytest.mark.parametrize("value,want", [("100", "100"), ("0.00000001", "0.00000001"), ("10.50", "10.5"), ("0", "0")])
def test_fmt_coin(one, value, want):
    assert one(scalars.fmt_coin(F.lit(Decimal(value)).cast("decimal(20,8)"))) == want


@pytest.mark.parametrize("value,want", [(0.5, (500.0, "m", "milli")), (5.0, (5.0, "", "")), (2500.0, (2.5, "M", "Mega"))])
def test_si_scale(one, value, want):
    amount, short, long = scalars.si_scale(F.lit(value))
    assert tuple(one(F.struct(amount, short, long))) == want


def test_new_user(one):
    joined, now = F.lit(dt.datetime(2024, 1, 1, 23)), F.lit(dt.datetime(2024, 1, 8))
    assert one(scalars.is_new_user(joined, now)) is True
    assert one(scalars.is_new_user(joined, F.lit(dt.datetime(2024, 1, 9)))) is False
    assert one(scalars.is_new_user(F.lit(None).cast("timestamp"), now)) is True


def test_expiry(one):
    assert one(scalars.expires_at(F.lit(dt.datetime(2024, 1, 1)))) == dt.datetime(2024, 1, 3)
    assert scalars.expiry_text(48) == "2 days"


@pytest.mark.parametrize(
    "value,want", [(123456.0, "1.2346e+05"), (12345.6, "12346"), (0.5, "0.5"), (100.0, "100"), (99999.6, "1e+05"), (0.00001234, "1.234e-05"), (1.5, "1.5")]
)
def test_significant(one, value, want):
    assert one(cells.significant(F.lit(value), 5)) == want == f"{value:.5g}"


def test_cells(one):
    viewer = F.lit("Bob")
    cell = lambda name, v, compact=False: one(cells.fmt_cell(name, F.lit(v), viewer, compact))
    assert cell("to_addr", "DFundmtrigzA6E25Swr2pRe4Eb79bGP8G1").startswith("[DFundm...GP8G1](")
    assert cell("from_user", "bob", True) == "**/u/bob**"
    assert cell("from_user", "ann", True) == "/u/ann"
    assert cell("state", "completed") == "✓"
    assert cell("state", "pending") == "pending"
    assert cell("type", "givetip") == "tip"
    assert cell("type", "withdraw", True) == "w"
    assert cell("type", "withdraw") == "withdraw"
    assert cell("config3", "sub") == "/r/sub"
    assert cell("coin_val", 0.0) == "-"
    assert cell("coin_val", 12.5) == "Ð&nbsp;12.5"
    assert cell("fiat_val", 2.0) == "$&nbsp;2.00"
    assert cell("msg_link", "u") == "[link](u)"
    assert cell("created_utc", dt.datetime(2024, 5, 6, 7)) == "2024-05-06"
    assert cell("note", "") == "-"


def test_keyword_amount_is_stable_and_in_range(spark):
    df = spark.range(5000).select(F.concat(F.lit("t1_"), "id").alias("f"))
    draw = scalars.keyword_amount(F.lit(4), F.lit(80), F.lit(1), F.col("f"), 42)
    first = [r[0] for r in df.select(draw).collect()]
    assert first == [r[0] for r in df.select(draw).collect()]
    assert min(first) == 4 and max(first) == 80
