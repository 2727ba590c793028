import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tallybook.llm import bpe
from tallybook.llm.common import table

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(4)
    pool = ["a", "é", "ß", "'s", "'", " ", "  ", "\n", "\t", "1", "23", "🙂", "word", "Über", "$", "<|endoftext|>", " ", "日本", "\x1c"]
    out = [None, "", " ", "   x", "'s's ''s", "a" * 200]
    out += ["".join(rng.choices(pool, k=rng.randint(1, 300))) for _ in range(80)]
    out += ["".join(rng.choices(pool, k=n)) for n in (70_000, 150_000)]
    # Seams inside long runs, at which nothing resynchronises.
    out += ["x " * (bpe.CHUNK // 2 - 200) + " " * 3000 + "y" * 90_000, "z" * 150_000, " " * 100_000, "1" * (3 * bpe.CHUNK), "\n" * bpe.CHUNK + "ab " * 40_000]
    return out + out[-3:] + out[:2]


def test_against_the_library(documents, plain):
    rows = texts()
    docs = documents(rows)
    got = {r.doc_id: r for r in bpe.bpe_report(docs, RANKS, public_tokenizers.PATTERN).collect()}
    assert len(got) == len(rows)
    for i, text in enumerate(rows):
        ids = np.array(plain.encode_ordinary(text or ""), "<u4")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_repeated_and_null_ids(spark):
    rows = spark.createDataFrame([(None, "ab " * 40_000), (None, "ab " * 40_000), (3, None)], "doc_id long, text string")
    out = bpe.encode(rows, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted((r.doc_id is None, len(r.ids)) for r in out)[0] == (False, 0) and len(out) == 3
    assert bpe.bpe_report(rows.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_whole_table(spark, plain):
    docs = table(spark, SF, "documents")
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in bpe.encode(docs, RANKS, public_tokenizers.PATTERN).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == plain.encode_ordinary(text[r.doc_id])
