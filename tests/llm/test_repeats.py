import hashlib
import random

import pytest

from tallybook.llm import repeats as R
from tallybook.llm.common import table

SF = "/root/testdata/sf0.001"


def brute(rows):
    """Per (doc_id, text): removed places, judged by the first start of every 100-byte string."""
    first = {}
    for doc, text in sorted(set(rows)):
        data = text.encode()
        for i in range(len(data) - R.LEAST + 1):
            first.setdefault(data[i : i + R.LEAST], (doc, i))
    out = {}
    for doc, text in set(rows):
        data = text.encode()
        gone = bytearray(len(data))
        for i in range(len(data) - R.LEAST + 1):
            if first[data[i : i + R.LEAST]] < (doc, i):
                gone[i : i + R.LEAST] = b"\1" * R.LEAST
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        spans = sum(g and not gone[i - 1] if i else g for i, g in enumerate(gone))
        out[doc, text] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def same(df, rows):
    want = brute([(d, t or "") for d, t in rows])
    got = sorted(tuple(r) for r in R.repeat_report(df).collect())
    assert got == sorted((d, *want[d, t or ""]) for d, t in rows)


def corpus(seed):
    rng = random.Random(seed)

    def words(n):
        return " ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 9))) for _ in range(n))

    line, passage, long = words(9), words(60), words(400)
    texts = [None, "", "x" * 99, "x" * 100, "x" * 101, "x" * 350, "ab" * 300, "🙂" * 60, "x" * 100]
    texts += [line + "\n" + words(rng.randint(1, 80)) + passage + words(rng.randint(1, 30)) for _ in range(30)]
    for _ in range(25):  # near copies, parts at any offset, repeats inside one text
        i, j = sorted(rng.sample(range(len(long)), 2))
        texts.append(words(5) + long[i:j] + rng.choice(["", long[j - 200 : j], "y"]))
    t = list(long)
    for _ in range(12):
        t[rng.randrange(len(t))] = "z"
        texts.append("".join(t))
    texts += [passage] * 3 + [long[:1500]] * 2 + [long[k : k + 100 + k % 3] for k in range(0, 300, 37)]
    rng.shuffle(texts)
    return list(enumerate(texts, -7))


@pytest.mark.parametrize("seed,run_bytes", [(1, 24 << 20), (2, 2000)])
def test_against_brute_force(spark, monkeypatch, seed, run_bytes):
    monkeypatch.setattr(R, "RUN_BYTES", run_bytes)
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "s", 1, 2, "x") for r in rows], "doc_id long, text string, source string, at int, start int, doc string")
    same(df.repartition(3), rows + [])


def test_repeated_and_unnamed_rows(spark):
    a, b = "one " * 10 + "two three four five six seven eight nine ten eleven " * 3, "q" * 30 + "A long tail that is repeated in other rows, letter by letter, up to its very end, and a little more than that."
    rows = [(4, a), (4, a), (2, b), (3, b + "!"), (None, b), (9, a), (9, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in R.repeat_report(df).collect()), key=repr)
    first = brute([(4, a)])[4, a][1]
    assert got == sorted([(4, len(a), first), (4, len(a), first), (2, len(b), 0), (3, len(b) + 1, len(b)), (None, len(b), 0), (9, len(a), 0), (9, len(b), 0)], key=repr)
    assert R.repeat_report(df.limit(0)).count() == 0
    out = R.cut_repeats(df.withColumnsRenamed({}))
    assert out.columns == df.columns and out.count() == len(rows)


def test_whole_table(spark):
    docs = table(spark, SF, "documents")
    same(docs, [(r.doc_id, r.text) for r in docs.collect()])


def test_merge_keeps_order_and_prefixes():
    rng = random.Random(3)
    for _ in range(60):
        runs = []
        for r in range(rng.randint(1, 9)):
            strings = sorted({bytes(rng.choices(b"ab", k=rng.randint(1, 12))) for _ in range(rng.randint(1, 30))})
            runs.append([(s, r, i, 0) for i, s in enumerate(strings)])

        def coded(run):
            shared, _ = R.front_coded([e[0] for e in run])
            return iter(list(zip(shared.tolist(), run, strict=True)))

        out = list(R.merged([coded(x) for x in runs]))
        assert [e[0] for _, e in out] == sorted(e[0] for x in runs for e in x)
        for (_, x), (k, y) in zip(out, out[1:], strict=False):
            n = next((i for i, (p, q) in enumerate(zip(x[0], y[0], strict=False)) if p != q), min(len(x[0]), len(y[0])))
            assert k == n
