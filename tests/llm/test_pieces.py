import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from tallybook.llm import pieces
from tallybook.llm.common import table

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def coder():
    return pieces.coder(MODEL)


def ids(coder, text):
    return [int.from_bytes(b, "little") for b in map(bytes, zip(*[iter(coder.encode(text))] * 4))]


def samples(coder):
    rng = random.Random(7)
    pool = ["a", "b", "th", "ing", " ", "  ", "    ", "▁", "\n", "\t", "é", "🙂", "日本", "<s>", "<0x41>", "\x00", "=", "-", "1", "�", "ﬁ", " the", "er", "ا", "──", "══"]
    out = ["".join(rng.choices(pool, k=rng.randint(1, 60))) for _ in range(1500)]
    out += ["".join(rng.choices(coder.piece, k=rng.randint(1, 30))).replace("▁", " ") for _ in range(1500)]
    out += ["".join(chr(rng.choice([rng.randint(0, 127), rng.randint(0, 0x2FFF), rng.randint(0x3000, 0xD7FF)])) for _ in range(30)) for _ in range(1500)]
    return out


def test_against_the_library(coder, library):
    for text in samples(coder):
        assert ids(coder, text) == library.encode(text)


def test_whole_texts_without_cuts(coder, library):
    """The table alone, over texts that are not cut into words."""
    for text in samples(coder)[::3]:
        plain = library.normalize(text)
        got = coder.recovered(plain, coder.table(plain))
        assert [int.from_bytes(got[i : i + 4], "little") for i in range(0, len(got), 4)] == library.encode(text)


def test_one_last_token_per_prefix(coder, library):
    """Of the pieces that end a prefix exactly one is compatible, and it is the last id of the prefix."""
    text = library.normalize("Unquestionably, the hhhheating  aaaab==-- étienne's 12")
    last = coder.table(text)
    for end in range(1, len(text) + 1):
        fitting = [
            k for k in range(len(coder.piece)) if text[:end].endswith(coder.piece[k])
            and (end == coder.length[k] or last[end - coder.length[k] - 1] < 0 or coder.apart(last[end - coder.length[k] - 1], k))
        ]
        assert fitting in ([last[end - 1]], []) and (fitting or last[end - 1] < 0)


def test_small_memories_change_nothing(coder, library, monkeypatch):
    monkeypatch.setattr(pieces, "WORDS", 3)
    monkeypatch.setattr(pieces, "PAIRS", 3)
    text = "one two three four five six " * 20
    assert ids(coder, text) == library.encode(text)


def test_report(documents, library):
    texts = [None, "", " ", "a" * 300_000, " " * 100_000, "=-" * 100_000, "x\n" * 50_000, "A word. Another one", "A word. Another one"]
    docs = documents(texts)
    got = {r.doc_id: r for r in pieces.piece_report(docs, MODEL).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        want = library.encode(text or "")
        assert got[i].n_tokens == len(want)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((library.decode(want) if want else "").encode()).hexdigest()
    assert pieces.piece_report(docs.limit(0), MODEL).count() == 0


def test_null_and_repeated_ids(spark):
    rows = spark.createDataFrame([(None, "ab"), (None, "ab"), (3, None)], "doc_id long, text string")
    assert sorted((r.doc_id is None, len(r.ids)) for r in pieces.encode(rows, MODEL).collect()) == [(False, 0), (True, 4), (True, 4)]


def test_refused_model(monkeypatch):
    class Odd(sentencepiece.SentencePieceProcessor):
        def is_unused(self, i):
            return i == 400

    monkeypatch.setattr(pieces.sentencepiece, "SentencePieceProcessor", Odd)
    with pytest.raises(ValueError):
        pieces.Coder(MODEL)


def test_whole_table(spark, library):
    docs = table(spark, SF, "documents")
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in pieces.decode(pieces.encode(docs, MODEL), MODEL).collect():
        want = library.encode(text[r.doc_id])
        assert r.listed == ",".join(map(str, want)) and r.text == library.decode(want)
