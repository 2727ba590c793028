import random
import zlib

import numpy as np
import pytest

from tallybook.llm import langid as L
from tallybook.llm.common import table

SF = "/root/testdata/sf0.01"
SOUNDS = {"en": "the ing tion wh er ou", "de": "sch ung ich ein ß ü", "es": "ción ado que ñ os", "fr": "eau oi ent é ç", "xx": "zq qx kz vv"}


def made(rng, lang, n):
    return " ".join("".join(rng.choices(SOUNDS[lang].split(), k=rng.randint(1, 3))) for _ in range(n))


def test_held_out_accuracy(spark):
    docs = table(spark, SF, "documents")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = L.identify(docs).collect()
    assert len(rows) == len(truth)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    out = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in out) >= 0.98 * len(out)


def test_labels_of_held_out_rows_are_not_used(spark, documents):
    rng = random.Random(1)
    langs = [rng.choice(list(SOUNDS)) for _ in range(300)]
    texts = [made(rng, lang, rng.randint(3, 60)) for lang in langs]
    held = [zlib.crc32(str(i).encode()) % 3 == 1 for i in range(300)]
    told = ["wrong" if h else lang for h, lang in zip(held, langs, strict=True)]
    a = {r.doc_id: r for r in L.identify(documents(texts, told)).collect()}
    b = {r.doc_id: r for r in L.identify(documents(texts, [None if h else x for h, x in zip(held, langs, strict=True)])).collect()}
    assert a == b and "wrong" not in {r.lang_pred for r in a.values()}
    assert np.mean([a[i].lang_pred == langs[i] for i in range(300) if held[i]]) > 0.95


def test_odd_rows(spark, documents):
    rng = random.Random(2)
    texts = [None, "", "123 !? \n", "é"] + [made(rng, lang, 30) for lang in ("en", "de") * 30] + [made(rng, "de", 300_000)]
    langs = ["en"] * 4 + ["en", "de"] * 30 + [None]
    got = {r.doc_id: r for r in L.identify(documents(texts, langs)).collect()}
    assert [got[i].lang_pred for i in range(3)] == ["und"] * 3 and got[0].score == 0.0
    assert got[3].lang_pred in ("en", "de") and got[64].lang_pred == "de"
    none = L.identify(documents(texts[4:9], [None] * 5)).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    one = L.identify(documents(texts[4:9], ["en"] * 5)).collect()
    assert {(r.lang_pred, r.score) for r in one} == {("en", 1.0)}
    assert L.identify(documents(["a"]).limit(0)).count() == 0
    unnamed = spark.createDataFrame([(None, "the", "en"), (None, None, None)], "doc_id long, text string, lang string")
    assert all(r.held_out and r.lang_pred == "und" for r in L.identify(unnamed).collect())


def test_long_texts_are_counted_whole():
    text = made(random.Random(3), "fr", 200_000)
    whole = L.vector(text)
    old, L.PIECE = L.PIECE, 1000
    try:
        np.testing.assert_allclose(L.vector(text), whole, rtol=1e-6)
    finally:
        L.PIECE = old


@pytest.mark.parametrize("hot", [0, 3])
def test_same_sample_for_rare_languages(spark, monkeypatch, hot):
    """Languages that meet their share by a shuffle give the training rows that a broadcast gives."""
    docs = table(spark, SF, "documents").where("doc_id < 300")
    shown = lambda: sorted(map(tuple, L.identify(docs, 60).collect()))
    want = shown()
    monkeypatch.setattr(L, "HOT", hot)
    assert shown() == want
