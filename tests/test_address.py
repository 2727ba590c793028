"""Addresses by columns against a plain decoder, one address at a time."""

import hashlib
import random

from pyspark.sql import functions as F

from tallybook.functions.address import BASE58, decode_base58, valid_address, validate_addresses


def twice(data):
    return hashlib.sha256(hashlib.sha256(data).digest()).digest()


def spelled(number):
    out = ""
    while number:
        number, digit = divmod(number, 58)
        out = BASE58[digit] + out
    return out


def genuine(version, body):
    raw = bytes([version]) + body
    return spelled(int.from_bytes(raw + twice(raw)[:4], "big"))


def plain(address):
    if address is None or not 27 <= len(address) <= 35 or set(address) - set(BASE58):
        return False
    number = 0
    for char in address:
        number = number * 58 + BASE58.index(char)
    if number >= 1 << 200 or address[0] == BASE58[0]:
        return False
    raw = number.to_bytes(25, "big")
    return raw[0] in (22, 30) and twice(raw[:21])[:4] == raw[21:]


def cases():
    rng = random.Random(8)
    found = [None, "", "z" * 35, "1" * 35, "1" * 27, "2" + "1" * 34, "D" * 33, "D" * 28 + "é", "0" * 30]
    for i in range(400):
        good = genuine(rng.choice((22, 30)), rng.randbytes(20) if i % 7 else bytes(19) + bytes([i % 256]))
        k = rng.randrange(len(good))
        changed = good[:k] + rng.choice(BASE58) + good[k + 1 :]
        found += [good, changed, "1" + good, good[:-1], good + good[0], good.lower(), genuine(rng.choice((0, 5, 23, 31, 255)), rng.randbytes(20))]
        found.append("".join(rng.choice(BASE58) for _ in range(rng.randrange(27, 36))))
    return found


def test_decoded_numbers():
    shaped = [a for a in cases() if a and 27 <= len(a) <= 35 and not set(a) - set(BASE58)]
    for address, raw in zip(shaped, decode_base58(shaped), strict=True):
        number = 0
        for char in address:
            number = number * 58 + BASE58.index(char)
        assert int.from_bytes(raw.tobytes(), "big") == number
    assert decode_base58([]).shape == (0, 28)


def test_verdicts(spark):
    rows = cases()
    df = spark.createDataFrame([(a,) for a in rows + rows[:50]], "a string")
    want = {a: plain(a) for a in rows}
    assert 400 <= sum(want.values()) < len(want)
    assert {r["a"]: r["ok"] for r in df.select("a", valid_address(F.col("a")).alias("ok")).collect()} == want
    joined = validate_addresses(df, "a").collect()
    assert len(joined) == len(rows) + 50 and all(r["addr_valid"] == want[r["a"]] for r in joined)
    assert validate_addresses(df.where("false"), "a").isEmpty()
