import itertools
import re

import duckdb
import pytest

import corpus_pipeline as C
from tallybook.llm import near_text, packing, repeats, secret_scan, toxicity
from tallybook.llm.common import Stage, table
from tallybook.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def brute_force_kept(docs):
    """doc_ids that are the smallest of those reached by texts sharing 80 of 100 five-word shingles."""
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m.group().lower(), r.text or "")) for i, r in docs.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(docs), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i for i in docs if find(i) == i}


def test_stages_take_effect(spark):
    """Each stage against its operator's report on what the stage before has kept."""
    stage = Stage(spark, "test")
    docs = table(spark, SF, "documents")
    start = docs.columns
    after = []
    for k, (name, step) in enumerate(C.STAGES):
        docs = stage.store(step(spark, docs, SF), name)
        after.append(docs)
        assert k == 4 or docs.columns == start
    raw = table(spark, SF, "documents")
    rows = lambda df: {r.doc_id: r for r in df.collect()}
    rated = {r.doc_id for r in toxicity.rate(raw, table(spark, SF, "labels")).collect() if not r.predicted}
    assert set(rows(after[0])) == rated
    kept = {r.doc_id for r in near_text.group_texts(after[0], 80, 100).collect() if r.kept}
    assert set(rows(after[1])) == kept == brute_force_kept(rows(after[0]))
    cut = rows(repeats.repeat_report(after[1]))
    texts = rows(after[2])
    for i, r in rows(after[1]).items():
        assert (texts[i].text == r.text) == (cut[i].n_removed == 0)
        assert texts[i].n_chars == len(texts[i].text)
    assert rows(repeats.repeat_report(after[2])).keys() == texts.keys()
    found = rows(secret_scan.secret_report(after[2]))
    masked = rows(after[3])
    for i, r in texts.items():
        assert len(masked[i].text) == len(r.text) and (masked[i].text == r.text) == (found[i].spans == "")
    pieces = after[4].collect()
    assert {p.doc_id for p in pieces} == set(masked)
    assert sorted((p.doc_id, p.piece, p.ids_crc32) for p in pieces) == sorted(
        (p.doc_id, p.piece, p.ids_crc32) for p in packing.tokenize(after[3], C.VOCABULARY, with_ids=False).collect()
    )


def test_empty_and_odd_rows(spark):
    docs = spark.createDataFrame(
        [(None, None, None, None, None), (1, None, "en", "s", 0), (1, None, "en", "s", 0), (2, "", None, None, 0), (3, "a b " * 50_000, "en", "s", 200_000)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    for rows, n in ((docs, 5), (docs.limit(0), 0)):
        stage = Stage(spark, "test")
        for k, (name, step) in enumerate(C.STAGES):
            rows = stage.store(step(spark, rows, SF), name)
            assert rows.count() >= n if k == 4 else rows.count() == n


@pytest.mark.parametrize("name", ORACLES)
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(map(repr, result.fetchall()))
    assert sorted(repr(tuple(r)) for r in df.select(columns).collect()) == want
