import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallybook.llm import packing as P

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return t


def check(rows, texts, plain, length):
    """Every piece has its tokens; sequences are gapless and within their length. Returns their number."""
    by_doc, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    assert set(by_doc) == set(range(len(texts)))
    for doc, pieces in by_doc.items():
        ids = plain.encode(texts[doc] or "", add_special_tokens=False).ids + [P.END]
        pieces.sort(key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(-(-len(ids) // length)))
        for r in pieces:
            part = np.array(ids[r.piece * length : (r.piece + 1) * length], "<u4")
            assert (r.start, r.length, r.ids_crc32) == (r.piece * length, len(part), zlib.crc32(part.tobytes()))
    for held in bins.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
    return len(bins), -(-sum(r.length for r in rows) // length)


def test_pieces_and_sequences(documents, plain):
    rng = random.Random(2)
    pool = ["a", "B", "É", "é", "'s", "ΑΣ", "Σ", "İ", "1", "23", "🙂", " ", " ", "<|endoftext|>", "\x1c", "ß", "日本", "$$", "각", "ᄀ", "ᅡ", "\u0307", "\x85", "\x0b", "\u00ad", "ﬁ", "Ǆ", "¼"]
    glue = [" ", "", "\n", "\t ", "\r\n", " ́"]
    texts = [None, "", " \n", "x" * 300, "word " * 9000, "q" * 20_000]
    texts += ["".join(rng.choice(pool) + rng.choice(glue) for _ in range(rng.randint(1, 900))) for _ in range(60)]
    used, least = check(P.packed(documents(texts + texts[:2]), VOCABULARY).collect(), texts + texts[:2], plain, P.LENGTH)
    assert used == least


def test_several_shards_and_rounds(documents, plain, monkeypatch):
    monkeypatch.setattr(P, "SHARD", 40)
    rng = random.Random(6)
    texts = ["tree " * rng.choice([3, 17, 20, 33, 60, 61]) for _ in range(200)]
    used, least = check(P.packed(documents(texts), VOCABULARY, 100).collect(), texts, plain, 100)
    assert used <= least * 1.1 + 1


def test_whole_ids(documents, plain):
    texts = ["one two three", None]
    for r in P.tokenize(documents(texts), VOCABULARY).collect():
        want = plain.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [P.END]
        assert np.frombuffer(r.ids, "<u4").tolist() == want
    assert P.packed(documents(["a"]).limit(0), VOCABULARY).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_local_search(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([rng.randint(1, 100), rng.randint(30, 45)]) for _ in range(rng.randint(1, 300))]
    bins = P.Bins(sizes, 100)
    before, squares = bins.used(), sum(f * f for f in bins.fill)
    bins.improve()
    assert bins.used() <= before and sum(f * f for f in bins.fill) >= squares
    held = sorted(x for b in bins.items for x in b)
    assert held == sorted((s, i) for i, s in enumerate(sizes))
    assert bins.fill == [sum(s for s, _ in b) for b in bins.items] and max(bins.fill) <= 100


def test_search_empties_a_bin():
    # Best fit leaves 60+30, 55+40, 50; exchanges reach full bins.
    bins = P.Bins([60, 55, 45, 40], 100)
    bins.improve()
    assert bins.used() == 2


def test_added_tokens_as_the_library_has_them(spark, documents, tmp_path):
    """The query and the pipeline's stage against a tokenizer with default settings."""
    import corpus_pipeline
    from tallybook.llm.queries import op4_best_fit_packing

    rng = random.Random(5)
    pool = ["a", "Tree", "É", "e", "'s", "<|", "|>", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|<|endoftext|>|>", "1", "\u0301", "$", "x" * 70]
    texts = ["a<|endoftext|>b", "<|endoftext|>", "<|endoftext|><|endoftext|>", "e<|startoftext|>\u0301 \u0085<|endoftext|>\xa0", None, ""]
    texts += ["".join(rng.choice(pool) + rng.choice(["", "", " ", "\n"]) for _ in range(rng.randint(1, 300))) for _ in range(40)]
    default = Tokenizer.from_file(VOCABULARY)
    assert 49407 in default.encode(texts[0], add_special_tokens=False).ids
    docs = documents(texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for rows in (op4_best_fit_packing(spark, str(tmp_path)), corpus_pipeline.pack(spark, docs, "")):
        check(rows.collect(), texts, default, P.LENGTH)


def test_new_words_are_split_together(plain):
    """Some calls for many words (before: one a word), with the library's ids whatever stands in them."""

    class Counted:
        def __init__(self, pattern):
            self.pattern, self.calls = pattern, 0

        def findall(self, text):
            self.calls += 1
            return self.pattern.findall(text)

    rng = random.Random(8)
    pool = ["a", "É", "é", "Σ", "İ", "7", "'ll", "$$", "\0", "\x0b", "\x85", "\xff", "日本", "x" * 70]
    texts = ["".join(rng.choice(pool[:8]) for _ in range(5)) + f" w{k} é{k}" for k in range(4000)]
    texts += ["".join(rng.choice(pool) + rng.choice(["", " "]) for _ in range(30)) for _ in range(50)]
    w = P.Words(VOCABULARY)
    w.split = Counted(w.split)
    got = w.encode(texts[:4000])
    assert w.split.calls <= 20
    got += w.encode(texts[4000:]) + w.encode(texts[:10])
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts + texts[:10]]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in got] == want


def test_full_memory_of_words(plain, monkeypatch):
    monkeypatch.setattr(P, "MEMORY", 30)
    monkeypatch.setattr(P, "TOGETHER", 4)
    rng = random.Random(9)
    w = P.Words(VOCABULARY)
    for _ in range(40):
        texts = [" ".join(rng.choice(["tree", "Éa", "x1,"]) + str(rng.randrange(60)) for _ in range(20)) for _ in range(3)]
        want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
        assert [np.frombuffer(ids, "<u4").tolist() for ids in w.encode(texts)] == want
