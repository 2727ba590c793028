"""Repair of conversation structure by a dynamic programme with checkpoints.

A conversation is right if the initials of its roles read ``(s?(ua)+)?``. Rows are kept
(cost 0), get the role user or assistant (2), or go (3); empty rows of user or assistant
may come in anywhere (2); a truncated row that stays costs 1 more. Blank rows and rows
whose role and text were there before must go. The cheapest edits are wanted, of equally
cheap ones those whose initials (D, I, K, R) come first.

The state between two rows is one of four: nothing yet, after the system's row, after a
user's, after an assistant's. Backward costs of all four states are kept only at the
checkpoints between blocks of rows; a block's own costs are computed again while its
edits are read off from its entry state. Blocks of one conversation grow by ``step`` rows
each, so n rows make about sqrt(2 n / step) blocks of at most sqrt(2 n step) rows:

1. equal rows are counted into one, rows are dealt by range of (conversation, turn, role,
   text), so that a hot conversation lies on many tasks, and each task cuts its blocks;
2. a block's costs from each entry to each exit state are put out; one walk back over a
   conversation's blocks gives the cost vector at every checkpoint;
3. every block, now that the costs after it are known, tells where each entry state
   leads; one walk forward over the blocks gives the entry states;
4. every block computes its costs again and emits its edits.

Only steps 2 and 3 see a conversation whole, as a few numbers per block; conversations
that lie in one block of one task skip them, since both ends are known. The digest of a
repaired conversation is sequential by definition: its rows pass one task as a sorted
stream, never held together.

Rows come by turn, nulls first; rows of one turn by role, then by the SHA-256 of their text. Null roles
and texts count as one blank. A null conversation is one of its own. Turns may be any longs; gaps
beyond a long are null. Of repeated rows all but the first are duplicates. A conversation
without rows has zeros, no edits and the digest of nothing; an empty table an empty result.
Texts of any length are moved whole. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import Stage, columns, ready, spread_join

STEP = 64  # rows by which blocks of one conversation grow

# Costs and legal pairs, as the operator is defined.
RENAME, DELETE, INSERT, LATE = 2, 3, 2, 1
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
KEEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}  # state after a kept row of that initial
GROW = (2, 2, 3, 2)  # state after a row of the only role that may follow
NAME = {2: "user", 3: "assistant"}
ENDS = (0, 4, 2, 0)  # cost of ending in each state
NEVER = 1 << 40

NONE = " "  # stands for a null
SPACE = " \t\n\x0b\x0c\r"

OK, LATE_ROW, BLANK, COPY = range(4)  # a row's first fault

_ROW = "turn long, role string, digest binary, fault int, copies long"
_PLACE = "conv string, part int, k int"
_BLOCK = f"{_PLACE}, whole boolean, costs array<long>, rows array<struct<{_ROW}>>"
_WALKED = (
    f"{_PLACE}, j int, edit string, turn long, role string, own string, digest binary, audit string, cost long, blank long, "
    "duplicate long, truncated long, illegal long, first_role string, last_role string, least long, most long, turns long"
)
_REPORT = (
    "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)


# --- the programme over one block ---------------------------------------------


@lru_cache(65_536)
def level(initial: str, late: bool, after: tuple[int, ...]) -> tuple[tuple[int, ...], int, str]:
    """Costs before a row from those after it, less their least, that least, and the first edit of each state."""
    extra, keep = LATE if late else 0, KEEP.get(initial, {})
    ways = [
        {"D": DELETE + after[q], "R": RENAME + extra + after[GROW[q]]} | ({"K": extra + after[keep[q]]} if q in keep else {})
        for q in range(4)
    ]
    base = [min(w.values()) for w in ways]
    # More than two rows put in between two others lead nowhere new.
    best = [min(base[q], INSERT + base[GROW[q]], 2 * INSERT + base[GROW[GROW[q]]]) for q in range(4)]
    for q in range(4):
        ways[q]["I"] = INSERT + best[GROW[q]]
    first = "".join(min(e for e, cost in ways[q].items() if cost == best[q]) for q in range(4))
    least = min(best)
    return tuple(min(b - least, NEVER) for b in best), least, first


def backward(rows: list[dict], after: tuple[int, ...]) -> tuple[list[str], list[int]]:
    """First edits of every row from the last to the first, and the costs before the first row; forced rows are left out of both."""
    base, firsts = min(after), []
    costs = tuple(a - base for a in after)
    for row in reversed(rows):
        if row["fault"] in (BLANK, COPY):
            firsts.append("DDDD")
            continue
        costs, least, first = level(row["role"][:1], row["fault"] == LATE_ROW, costs)
        base += least
        firsts.append(first)
    return firsts[::-1], [min(base + c, NEVER) for c in costs]


def through(rows: list[dict]) -> list[int]:
    """Cost from every entry to every exit state, entry by entry."""
    ends = [backward(rows, tuple(0 if q == e else NEVER for q in range(4)))[1] for e in range(4)]
    return [ends[e][q] for q in range(4) for e in range(4)]


def edits(rows: list[dict], after: tuple[int, ...], state: int, last: bool) -> tuple[list[tuple[str, int, dict | None]], int]:
    """(edit, state after it, row) in order from one entry state, and the exit state. Copies of a row are one edit here."""
    out: list[tuple[str, int, dict | None]] = []
    for row, first in zip(rows, backward(rows, after)[0]):
        while first[state] == "I":
            state = GROW[state]
            out.append(("I", state, None))
        edit = first[state]
        if edit != "D":
            state = KEEP[row["role"][:1]][state] if edit == "K" else GROW[state]
        out.append((edit, state, row))
    while last and ENDS[state]:
        state = GROW[state]
        out.append(("I", state, None))
    return out, state


def walked(place: dict, rows: list[dict], after: tuple[int, ...], state: int, last: bool) -> Iterator[dict]:
    """The block's figures, then the rows that its repaired part consists of."""
    audit, cost, kept = [], 0, []
    for edit, at, row in edits(rows, after, state, last)[0]:
        audit.append(edit)
        if row is None:
            cost += INSERT
            kept.append({"edit": edit, "role": NAME[at]})
            continue
        copies = row["copies"]
        if edit == "D":
            cost += DELETE
        else:
            cost += (RENAME if edit == "R" else 0) + (LATE if row["fault"] == LATE_ROW else 0)
            role = NAME[at] if edit == "R" else row["role"]
            kept.append({"edit": edit, "turn": row["turn"], "role": role, "own": row["role"], "digest": row["digest"]})
        if copies > 1:  # the others are duplicates, or blank as the first is
            audit.append("D" * (copies - 1))
            cost += DELETE * (copies - 1)
    count = lambda fault: sum(r["copies"] for r in rows if r["fault"] == fault)
    again = sum(r["copies"] - 1 for r in rows if r["fault"] in (OK, LATE_ROW))
    initials = [r["role"][:1] for r in rows]
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    yield place | {
        "j": -1, "audit": "".join(audit), "cost": cost, "blank": count(BLANK), "duplicate": count(COPY) + again,
        "truncated": sum(r["fault"] == LATE_ROW for r in rows),
        "illegal": sum(p not in LEGAL for p in zip(initials, initials[1:])) + sum(r["copies"] - 1 for r in rows),
        "first_role": initials[0], "last_role": initials[-1],
        "least": turns[0] if turns else None, "most": turns[-1] if turns else None, "turns": len(set(turns)),
    }
    for j, row in enumerate(kept):
        yield place | {"j": j} | row


# --- tasks -----------------------------------------------------------------------


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string, StructType

    schema = _parse_datatype_string(ddl)
    assert isinstance(schema, StructType)
    return to_arrow_schema(schema)


def _batches(rows: Iterable[dict], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    names, held = schema.names, []
    for row in rows:
        held.append({n: row.get(n) for n in names})
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _task(make, schema: pa.Schema, size: int = 512):
    """A task that turns a stream of rows into another one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(make(row for b in batches for row in b.to_pylist()), schema, size)

    return run


def _cut(step: int):
    def run(stream: Iterator[dict]) -> Iterator[dict]:
        part = TaskContext.get().partitionId()
        conv, k, rows, opening = None, 0, [], True

        def block(whole: bool) -> dict:
            return {"conv": conv, "part": part, "k": k, "whole": whole, "costs": None if whole else through(rows), "rows": rows}

        for row in stream:
            if row["conv"] != conv:
                if rows:
                    yield block(k == 0 and not opening)
                opening = conv is None
                conv, k, rows = row["conv"], 0, []
            rows.append(row)
            if len(rows) == step * (k + 1):
                yield block(False)
                k, rows = k + 1, []
        if rows:
            yield block(False)

    return run


def _checkpoints(stream: Iterator[dict]) -> Iterator[dict]:
    """Blocks from a conversation's last to its first: the costs after each."""
    conv, after = None, ENDS
    for b in stream:
        last = b["conv"] != conv
        if last:
            conv, after = b["conv"], ENDS
        yield {"conv": conv, "part": b["part"], "k": b["k"], "after": list(after), "last": last}
        costs = b["costs"]
        after = tuple(min(costs[4 * q + e] + after[e] for e in range(4)) for q in range(4))


def _exits(stream: Iterator[dict]) -> Iterator[dict]:
    for b in stream:
        yield b | {"exits": [edits(b["rows"], tuple(b["after"]), q, False)[1] for q in range(4)]}


def _entries(stream: Iterator[dict]) -> Iterator[dict]:
    """Blocks from a conversation's first to its last: the state before each."""
    conv, state = None, 0
    for b in stream:
        if b["conv"] != conv:
            conv, state = b["conv"], 0
        yield {"conv": conv, "part": b["part"], "k": b["k"], "entry": state}
        state = b["exits"][state]


def _walk(stream: Iterator[dict]) -> Iterator[dict]:
    for b in stream:
        place = {n: b[n] for n in ("conv", "part", "k")}
        yield from walked(place, b["rows"], tuple(b["after"]), b["entry"], b["last"])


def _reported(stream: Iterator[dict]) -> Iterator[dict]:
    """One row per conversation from its marker, figures and repaired rows in order."""
    conv = object()
    for row in stream:
        if row["conv"] != conv:
            if isinstance(conv, str):
                yield done()
            conv = row["conv"]
            total = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost", "turns"), 0)
            audit, digest, lines = [], hashlib.sha256(), 0
            least = most = role = None

            def done() -> dict:
                gaps = 0 if least is None else most - least + 1 - total["turns"]
                return total | {
                    "conv": conv, "gaps": gaps if gaps < 1 << 63 else None, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()
                }

        if row["part"] < 0:
            continue
        if row["j"] < 0:
            for name in total:
                total[name] += row[name]
            audit.append(row["audit"])
            if role is not None and (role, row["first_role"]) not in LEGAL:
                total["illegal"] += 1
            role = row["last_role"]
            if row["least"] is not None:
                if most == row["least"]:
                    total["turns"] -= 1
                least, most = row["least"] if least is None else least, row["most"]
        else:
            digest.update(("\n" if lines else "").encode() + f"{row['role']}:{row['text']}".encode())
            lines += 1
    if isinstance(conv, str):
        yield done()


# --- the operator ------------------------------------------------------------------


@dataclass(frozen=True)
class Repair:
    """``rows``: (conv, part, k, j, edit, turn, role, text), the repaired conversations in the order of (part, k, j).

    ``figures``: what each block counts, its edits and their cost.
    """

    rows: DataFrame
    figures: DataFrame


def named(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text) without nulls but for turns; conversations by name, so that the null one has one too."""
    rows = columns(conversations, ("conv_id", "turn", "role", "text"))
    full = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE)).alias(c)
    return rows.select(full("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), full("role"), full("text"))


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv, turn, role, text) with the faults that a hash of conversation and turn chooses, and ``times`` each is there."""
    kind = F.crc32(F.concat_ws(":", "conv", F.coalesce(F.col("turn").cast("string"), F.lit(NONE))).cast("binary")) % 20
    return (
        rows.withColumn("kind", kind).where("kind <> 0")
        .select(
            "conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
            F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("times"),
        )
    )


def _ordered(df: DataFrame) -> DataFrame:
    by = ("conv", "turn", "role", "digest")
    return df.repartitionByRange(*by).sortWithinPartitions(*by)


def _stream(df: DataFrame, *order) -> DataFrame:
    return df.repartition("conv").sortWithinPartitions("conv", *order)


def repair(rows: DataFrame, stage: Stage, step: int = STEP) -> Repair:
    """Repair of conversations given as (conv, turn, role, text, times)."""
    spark = rows.sparkSession
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")
    end = F.rtrim("text", F.lit(SPACE))
    fault = F.when(end == "", BLANK).when(F.right(end, F.lit(1)).isin(".", "!", "?"), OK).otherwise(LATE_ROW)
    count = Observation()
    met = stage.store(
        rows.select("conv", "turn", "role", digest, fault.alias("fault"), "times")
        .groupBy("conv", "turn", "role", "digest", "fault").agg(F.sum("times").alias("copies"))
        .observe(count, F.count(F.lit(1)).alias("n")),
        "met",
    )
    same = ["conv", "role", "digest"]
    firsts = met.groupBy(*same).agg(
        F.count("*").alias("met"), F.max(F.col("turn").isNull()).alias("at_null"), F.min("turn").alias("first")
    ).where("met > 1")
    # Of texts met in more turns than this there are at most 4 for every partition.
    share = count.get["n"] / (4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    first = F.col("met").isNull() | F.when(F.col("at_null"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("first"))
    judged = spread_join(met, firsts, same, F.col("met") > F.lit(share), "left").select(
        "conv", "turn", "role", "digest", F.when((F.col("fault") != BLANK) & ~first, COPY).otherwise(F.col("fault")).alias("fault"), "copies"
    )
    blocks = stage.store(_ordered(judged).mapInArrow(_task(_cut(step), _arrow(_BLOCK), 64), _BLOCK), "blocks")

    place = ["conv", "part", "k"]
    parts = blocks.where("NOT whole").drop("whole")
    back = f"{_PLACE}, after array<long>, last boolean"
    after = stage.store(
        _stream(parts.select(*place, "costs"), F.desc("part"), F.desc("k")).mapInArrow(_task(_checkpoints, _arrow(back)), back), "checkpoints"
    )
    known = parts.drop("costs").join(after, place)
    out = f"{_PLACE}, exits array<int>"
    ways = known.select(*place, "rows", "after").mapInArrow(_task(_exits, _arrow(out)), out)
    into = f"{_PLACE}, entry int"
    entry = _stream(ways, "part", "k").mapInArrow(_task(_entries, _arrow(into)), into)
    ready_blocks = known.join(entry, place).select(*place, "rows", "after", "last", "entry").unionByName(
        blocks.where("whole").select(
            *place, "rows", F.array(*map(F.lit, ENDS)).cast("array<bigint>").alias("after"), F.lit(True).alias("last"), F.lit(0).alias("entry")
        )
    )
    done = stage.store(ready_blocks.mapInArrow(_task(_walk, _arrow(_WALKED)), _WALKED), "walked")

    # A text is moved once, to the row that stays; equal rows are one before that.
    key = ["conv", "no_turn", "at", "own", "digest"]
    at = (F.col("turn").isNull().alias("no_turn"), F.coalesce("turn", F.lit(0)).alias("at"))
    texts = rows.select("conv", *at, F.col("role").alias("own"), digest, "text").dropDuplicates(key)
    kept = done.where("j >= 0 AND digest IS NOT NULL").select(*place, "j", "edit", "turn", "role", *at, "own", "digest")
    put_in = done.where("edit = 'I'").select(*place, "j", "edit", "turn", "role", F.lit("").alias("text"))
    final = kept.join(texts, key).select(*place, "j", "edit", "turn", "role", "text").unionByName(put_in)
    return Repair(final, done.where("j < 0").select(*place, "j", *_figures()))


def _figures() -> list[str]:
    return ["audit", "cost", "blank", "duplicate", "truncated", "illegal", "first_role", "last_role", "least", "most", "turns"]


def report(named_rows: DataFrame, repaired: Repair) -> DataFrame:
    """Figures, edits and the digest of the repaired rows, for every conversation of ``named_rows``."""
    marks = named_rows.select("conv").distinct().select("conv", F.lit(-1).alias("part"), F.lit(0).alias("k"), F.lit(-1).alias("j"))
    rows = marks.unionByName(repaired.figures, True).unionByName(repaired.rows.drop("edit", "turn"), True)
    out = _stream(rows, "part", "k", "j").mapInArrow(_task(_reported, _arrow(_REPORT)), _REPORT)
    return out.select(
        F.when(F.col("conv") != NONE, F.col("conv")).cast("long").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal",
        "cost", "audit", "repaired_sha256",
    )


def damage_and_repair(conversations: DataFrame, step: int = STEP) -> DataFrame:
    spark = ready(conversations.sparkSession)
    rows = named(conversations)
    return report(rows, repair(damaged(rows), Stage(spark, "turns"), step))
