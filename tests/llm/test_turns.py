import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from tallybook.llm import turns
from tallybook.llm.common import Stage, table

SF = "/root/testdata/sf0.001"
DDL = "conv_id long, turn long, role string, text string, part int, k string, j int, conv string"
EMPTY = hashlib.sha256(b"").hexdigest()


def make(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], DDL)


def cheapest(rows):
    """(cost, audit) of the best edits, and what is left, tried from every state; rows are (role, text, fault)."""

    @lru_cache(None)
    def best(i, state, room):
        # States by what has been put out: "", "s", "u", "a".
        found = []
        if i == len(rows) and state in ("", "a"):
            found.append((0, "", ()))
        follow = "assistant" if state == "u" else "user"
        if room:
            c, a, r = best(i, follow[0], room - 1)
            found.append((c + 2, "I" + a, ((follow, ""), *r)))
        if i < len(rows):
            role, text, fault = rows[i]
            c, a, r = best(i + 1, state, 2)
            found.append((c + 3, "D" + a, r))
            if fault not in ("blank", "duplicate"):
                late = fault == "truncated"
                if role[:1] == follow[0] or (role[:1] == "s" and state == ""):
                    c, a, r = best(i + 1, role[:1], 2)
                    found.append((c + late, "K" + a, ((role, text), *r)))
                c, a, r = best(i + 1, follow[0], 2)
                found.append((c + late + 2, "R" + a, ((follow, text), *r)))
        return min(found, key=lambda x: x[:2]) if found else (10**9, "", ())

    for i in range(len(rows), 0, -1):  # from the end, so that no call goes deep
        for state in ("", "s", "u", "a"):
            best(i, state, 2)
    return best(0, "", 2)


def plain(conversations):
    """Every conversation's row of the report, by the definition."""
    out = {}
    for conv, turn, role, text in conversations:
        held = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        held += [(turn, role, text)] * (2 if kind == 3 else 1)
    report = {}
    for conv, rows in out.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, judged = set(), []
        for _, role, text in rows:
            inner = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not inner else "duplicate" if (role, text) in seen else "truncated" if inner[-1] not in ".!?" else None
            seen.add((role, text))
            judged.append((role, text, fault))
        known = [t for t, _, _ in rows if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        pairs = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
        cost, audit, left = cheapest(judged)
        faults = [f for _, _, f in judged]
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()
        report[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), pairs, cost, audit, digest)
    return report


def check(spark, rows, **options):
    out = turns.damage_and_repair(make(spark, rows), **options).collect()
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in out}
    assert len(out) == len(got)
    want = plain(rows)
    assert set(got) == set(want)
    for conv in want:
        assert got[conv] == want[conv], conv


def chat(rng, conv, n):
    roles = ["user", "assistant", "system", "user", "assistant", "usher", "tool", "", "S", None]
    texts = ["Yes.", "No", " ", "", "Why?", "a. b", "x!\n", "…", "é.", None] + [f"text {i}." for i in range(n)]
    return [(conv, rng.choice([None, i, i, i, i // 2, 3 * i]), rng.choices(roles, [9, 9, 2, 5, 5, 1, 1, 1, 1, 1])[0], rng.choice(texts)) for i in range(n)]


@pytest.mark.parametrize("step", [1, 2, 64])
def test_against_every_edit(spark, step):
    """Blocks of one row, two rows and whole conversations give the same."""
    rng = random.Random(step)
    rows = [r for conv in [None, *range(40)] for r in chat(rng, conv, rng.choice([1, 2, 3, 8, 30]))]
    rng.shuffle(rows)
    check(spark, rows, step=step)


def test_a_conversation_over_many_tasks(spark):
    rng = random.Random(3)
    rows = [(7, i, rng.choice(["user", "assistant"]), rng.choice(["Ok.", "Ok", f"text {i}.", ""])) for i in range(600)]
    rows += [(i, 0, "user", "Hm.") for i in range(8, 40)]
    check(spark, rows, step=4)


def test_repeated_rows_of_one_turn(spark):
    check(spark, [(1, 5, "user", "Hello.")] * 300 + [(1, 6, "assistant", "Hi.")] * 2 + [(1, None, "system", " ")] * 50 + [(2, 1, "user", None)] * 9)


def test_many_turns_with_one_text(spark):
    check(spark, [(1, t, "user", "Yes.") for t in range(300)] + [(1, t, "assistant", f"No {t}.") for t in range(300)])


def test_long_texts_and_far_turns(spark):
    rows = [(1, 0, "user", "x " * 200_000 + "." + " " * 50_000), (1, 1, "assistant", "y" * 300_000), (2, -(2**63), "user", "A."), (2, 2**63 - 1, "assistant", "B.")]
    out = {r.conv_id: r for r in turns.damage_and_repair(make(spark, rows)).collect()}
    want = plain(rows)
    for conv in (1, 2):
        assert (out[conv].audit, out[conv].repaired_sha256, out[conv].cost) == (want[conv][6], want[conv][7], want[conv][5])
    assert out[2].gaps == (want[2][0] if want[2][0] < 2**63 else None)


def test_nothing_left_and_empty_tables(spark):
    gone = [(c, 0, "user", "Hi.") for c in range(100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    assert gone
    for r in turns.damage_and_repair(make(spark, gone)).collect():
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == (0, 0, 0, 0, 0, 0, "", EMPTY)
    assert turns.damage_and_repair(make(spark, gone).limit(0)).collect() == []


def test_repaired_rows(spark):
    """The operator's own output: the rows in their order, without the damage of the query."""
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "user", "Bye."), (1, 3, "user", "Bye.")]
    named = turns.named(make(spark, rows)).selectExpr("*", "1L AS times")
    out = turns.repair(named, Stage(spark, "turns")).rows.orderBy("part", "k", "j").collect()
    assert [(r.edit, r.role, r.text, r.turn) for r in out] == [
        ("K", "system", "Be kind.", 0), ("I", "user", "", None), ("K", "assistant", "Hello.", 1), ("K", "user", "Bye.", 2), ("I", "assistant", "", None)
    ]


def test_whole_table(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in table(spark, SF, "conversations").collect()]
    check(spark, rows)
