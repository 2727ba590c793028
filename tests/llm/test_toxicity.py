import random
import zlib

import numpy as np

from tallybook.llm import toxicity as T
from tallybook.llm.common import table

SF = "/root/testdata/sf0.1"
SMALL = "/root/testdata/sf0.01"


def test_held_out_quality(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = [r for r in T.rate(docs, labels).collect() if r.doc_id in truth]
    out = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    caught = [r.predicted for r in out if truth[r.doc_id]]
    wrong = [r.predicted for r in out if not truth[r.doc_id]]
    assert np.mean(caught) > 0.85 and np.mean(wrong) < 0.01


def test_held_out_labels_are_not_used(spark):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic")
    a, b = (sorted((r.doc_id, r.score) for r in T.rate(docs, x).collect()) for x in (labels, flipped))
    assert a == b


def test_odd_rows(spark, documents):
    rng = random.Random(1)
    clean = "tree house river stone cloud walk quiet".split()
    texts = [None, "", "!!! ???", "you " * 200_000] + [" ".join(rng.choices(clean, k=30)) + (" you moron" if i % 3 == 0 else "") for i in range(200)]
    docs = documents(texts)
    labels = spark.createDataFrame([(i, int(i >= 4 and (i - 4) % 3 == 0), "x") for i in range(len(texts))] + [(7, None, "y")], "doc_id long, toxic int, text string")
    got = {r.doc_id: r for r in T.rate(docs, labels).collect()}
    assert len(got) == len(texts) and all(r.score is not None for r in got.values())
    assert all(got[i].predicted == ((i - 4) % 3 == 0) for i in range(4, len(texts)))
    assert got[0].score == got[1].score
    none = T.rate(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.0} and len(none) == len(texts)
    assert T.rate(docs.limit(0), labels).count() == 0
    unnamed = spark.createDataFrame([(None, "a", None), (None, None, None)], "doc_id long, text string, lang string")
    assert all(r.held_out for r in T.rate(unnamed, labels).collect())


def test_rejected_rows_go(spark):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    kept = T.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    want = {r.doc_id for r in T.rate(docs, labels).collect() if not r.predicted}
    assert {r.doc_id for r in kept.collect()} == want


def test_features_see_obfuscation_and_address():
    weight = {"moron": 3.0}
    plain, hidden, near = (T.features(t, weight) for t in ("a moron there", "a m0ron there", "you moron there"))
    assert plain[0] > 0 and hidden[6] > 0 and near[8] == 1.0 and plain[8] == 0.0


def test_isotonic_fit_is_monotone():
    rng = np.random.default_rng(1)
    x = rng.normal(size=500)
    knots, share = T.isotonic(x, (rng.random(500) < 1 / (1 + np.exp(-3 * x))).astype(float))
    assert (np.diff(knots) > 0).all() and (np.diff(share) >= 0).all()
