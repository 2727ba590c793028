import base64
import gzip
import hashlib
import random
import zlib
from collections import defaultdict
from pathlib import Path

import pytest

from tallybook.llm import warc as W
from tallybook.llm.common import Stage, table

SF = "/root/testdata/sf0.001"


def expected(rows):
    by_payload = defaultdict(list)
    for page, html in rows:
        by_payload[(html or "").encode()].append(page)
    out = []
    for payload, pages in by_payload.items():
        top = max(pages, key=lambda p: (p is not None, p or 0))
        sha = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out += [(p, len(payload), sha, *(("response", None) if p == top else ("revisit", top))) for p in pages]
    return sorted(out, key=repr)


def got(df):
    return sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()], key=repr)


@pytest.fixture
def pages(spark):
    rng = random.Random(1)
    rows = [(i, None if i % 17 == 0 else f"http://x/{i}?q=a b\r\n", rng.choice(["<p>hé</p>", None, "", "x" * 50, "".join(chr(rng.randint(32, 2000)) for _ in range(rng.choice([5, 3000, 60000])))])) for i in range(-5, 120)]
    rows += [rows[3], (500, "u", "only"), (500, "u", "only"), (501, "u", "long " * 300_000)]
    return rows, spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, payload string, sha1 string")


def test_round_trip(spark, pages):
    rows, df = pages
    assert got(W.round_trip(df)) == expected([(p, h) for p, _, h in rows])


@pytest.mark.parametrize("size", [1000, 40_001, 1 << 30])
def test_every_record_has_one_owner(spark, pages, size):
    rows, df = pages
    path = Stage(spark, "test").path("archive")
    W.write_archive(df.repartition(3), path)
    records = W.read_archive(spark, path, size)
    assert got(W.page_records(records)) == expected([(p, h) for p, _, h in rows])
    assert records.select("path", "offset").distinct().count() == len(rows)
    urls = {r.url for r in records.collect()}
    assert None in urls and not any("\n" in u or " " in u for u in urls if u)


def test_files_are_plain_gzip(spark, pages):
    rows, df = pages
    path = Stage(spark, "test").path("archive")
    W.write_archive(df, path)
    content = b"".join(gzip.decompress(f.read_bytes()) for f in Path(path.removeprefix("file:")).glob("part-*"))
    assert content.count(b"WARC/1.1\r\nWARC-Type: ") == len(rows)


def test_false_magic_and_broken_members(spark, tmp_path):
    good = W.member(7, "u", b"abc", hashlib.sha1(b"abc").digest(), 3, None, False, W.DATE)
    other = gzip.compress(b"no archive")
    broken = good[:40]
    (tmp_path / "f.gz").write_bytes(W.MAGIC + b"junk" + other + good + W.EMPTY + broken + good + W.MAGIC)
    for size in (1, 7, 1 << 20):
        rows = W.read_archive(spark, str(tmp_path), size).collect()
        assert len(rows) == 2 and all(r.payload == b"abc" for r in rows), size


def test_small_payloads_stay_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc"), (None, "u", "abc")], "page_id long, url string, html string")
    path = Stage(spark, "test").path("archive")
    W.write_archive(df, path, revisit_from=3)
    kinds = {(r.page_id, r.record_type, r.refers_to) for r in W.page_records(W.read_archive(spark, path)).collect()}
    assert kinds == {(1, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None), (None, "revisit", 4)}


def test_empty_and_whole_table(spark):
    df = table(spark, SF, "pages")
    assert W.round_trip(df.limit(0)).count() == 0
    assert got(W.round_trip(df)) == expected([(r.page_id, r.html) for r in df.collect()])
    assert zlib.decompress(W.EMPTY, 31) == b""
