"""Settlement: deciding an ordered action log against balances.

The decisions depend on each other (an accepted tip funds a later one of someone
else), so no single key partitions the work.  ``settle`` decides in rounds.  For
every open action the sender's balance at that moment is bounded from both sides:

    lo = decided balance - open debits before it
    hi = decided balance + open credits before it

``lo`` covers the amount: accept.  ``hi`` does not: reject.  Otherwise wait for
the next round.  The first open action always has lo = hi, so each round makes
progress, and the outcome equals a strictly sequential run.

Each round is one shuffle by account with running sums.  Rows that are decided
leave the loop; an accepted one stays for one more round to be added to the
decided balances of later actions.  Rounds are written to the checkpoint folder.

A claim may name a second account, ``via``, that must cover the same amount: a hot
wallet.  The claim is accepted when both cover it and is rejected without an error when
only the second is short.  An almost empty wallet would take and refuse one claim a
round, so its bounds follow its claims one by one, as a sorted stream: a claim whose
sender surely covers it is settled there and then, however many do not fit.  What an
account or a pair surely bars moves nothing any more and waits for its error only.

Columns that are the same for all claims of a run (nobody holds, nobody names a pair or a
second account) take no part in the shuffles, and sums run over whole numbers of the
smallest coin unless an account could hold too many of them.

Time order is (t, phase, id): t in microseconds, phase 0 for time limits and 1
for actions, id of the causing action.
"""

from __future__ import annotations

import decimal
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..plans.lineage import Workspace
from ..plans.scan import Chunking, Running, chunked, plan_chunks, running
from ..session import ship
from ..settings import DEFAULT, Settings

MONEY = "decimal(38,8)"
UNITS = "bigint"  # money in steps of 0.00000001, where no account can reach the ends of this type
_REACH = 2.0**62 / 10**8

# One row per action that moves coins.
CLAIM_DDL = (
    "action_id bigint, t bigint, src bigint, dst bigint, amount decimal(38,8), take_all boolean, "
    "held boolean, end_t bigint, end_phase int, end_id bigint, refund boolean, pair string, short_error string"
)
_END = ("end_t", "end_phase", "end_id")
_END_TYPE = "struct<end_t: bigint, end_phase: int, end_id: bigint>"


def claim(
    action_id: Column,
    ts: Column,
    src: Column,
    dst: Column,
    amount: Column,
    take_all: Column | None = None,
    end_t: Column | None = None,
    end_phase: Column | None = None,
    end_id: Column | None = None,
    refund: Column | None = None,
    pair: Column | None = None,
    short_error: Column | None = None,
    via: Column | None = None,
) -> list[Column]:
    """Claim columns; an action with ``end_t`` is held in escrow until then."""
    null = F.lit(None)
    end = null if end_t is None else end_t
    return [
        action_id.cast("bigint").alias("action_id"),
        F.unix_micros(ts.cast("timestamp")).alias("t"),
        src.cast("bigint").alias("src"),
        dst.cast("bigint").alias("dst"),
        amount.cast(MONEY).alias("amount"),
        F.coalesce(F.lit(False) if take_all is None else take_all, F.lit(False)).alias("take_all"),
        end.isNotNull().alias("held"),
        end.cast("bigint").alias("end_t"),
        (F.lit(0) if end_phase is None else end_phase).cast("int").alias("end_phase"),
        (action_id if end_id is None else end_id).cast("bigint").alias("end_id"),
        F.coalesce(F.lit(False) if refund is None else refund, F.lit(False)).alias("refund"),
        (null if pair is None else pair).cast("string").alias("pair"),
        (null if short_error is None else short_error).cast("string").alias("short_error"),
        *([] if via is None else [via.cast("bigint").alias("via")]),
    ]


@dataclass(frozen=True)
class Settlement:
    """``decisions``: every claim with accepted, error and the decided amount."""

    decisions: DataFrame
    rounds: int
    open_after: tuple[int, ...]


def _units(money: Column) -> Column:
    return (money.cast("decimal(20,8)") * F.lit(10**8).cast("decimal(9,0)")).cast(UNITS)


def _money(units: Column) -> Column:
    return (units.cast("decimal(20,0)") * F.lit("0.00000001").cast("decimal(8,8)")).cast(MONEY)


def _entries(money: str = MONEY) -> Column:
    """Ledger entries of one state row, as an array of structs.

    d: change of the decided balance.  lo, hi: changes of the two bounds;
    lo_all, hi_all: open whole-balance claims, which make a bound unknown.
    """
    zero, one = F.lit(0).cast(money), F.lit(1)
    is_open = F.col("status") == "open"
    amount = F.coalesce("amount", zero)
    unknown = F.col("take_all") & F.col("need").isNull()
    whole = F.when(is_open & unknown & ~F.col("barred"), 1).otherwise(0)
    fixed = F.when(unknown | F.col("barred"), zero).otherwise(F.coalesce("need", "amount", zero))

    # A transfer to oneself moves nothing; it only has to be covered.
    to_self = F.coalesce(F.col("src") == F.col("dst"), F.lit(False)) & ~F.col("held")

    def signed(value, sign):
        # Not multiplied: a product of decimals keeps six places only.
        return value if sign == 1 else F.when(to_self, zero).otherwise(-value)

    def entry(account, t, phase, oid, probe, sign, bound):
        open_part = F.when(is_open, signed(fixed, sign)).otherwise(zero).cast(money)
        return F.struct(
            account.alias("account"),
            t.alias("o_t"),
            phase.cast("int").alias("o_phase"),
            oid.alias("o_id"),
            F.lit(probe).alias("probe"),
            F.when(is_open, zero).otherwise(signed(amount, sign).cast(money)).alias("d"),
            (open_part if bound == "lo" else zero).alias("lo"),
            (F.lit(0) if bound == "hi" else -whole if sign == 1 else F.when(to_self, 0).otherwise(whole)).alias("lo_all"),
            (open_part if bound == "hi" else zero).alias("hi"),
            (whole if bound == "hi" else F.lit(0)).alias("hi_all"),
        )

    now = (F.col("t"), one, F.col("action_id"))
    end = (F.col("end_t"), F.col("end_phase"), F.col("end_id"))
    return F.array(
        F.when(F.col("src").isNotNull(), entry(F.col("src"), *now, True, -1, "lo")),
        F.when(
            F.col("dst").isNotNull() & ~F.col("held") & ~to_self,
            entry(F.col("dst"), *now, False, 1, "hi"),
        ),
        F.when(
            F.col("held") & ~F.col("refund") & F.col("dst").isNotNull(),
            entry(F.col("dst"), *end, False, 1, "hi"),
        ),
        F.when(F.col("held") & F.col("refund"), entry(F.col("src"), *end, False, 1, "lo")),
    )


def _final() -> list[Column]:
    """State columns of open claims, for those that are decided."""
    return [F.lit(None).cast(MONEY).alias("need"), F.lit(False).alias("barred")]


def _entry_rows(state: DataFrame, entries: Column, columns: Sequence[str] | None = None) -> DataFrame:
    exploded = state.select("*", F.explode(entries).alias("_e")).where(F.col("_e").isNotNull())
    # Only the sender's row carries the action, or ``columns`` of it; the others feed the sums.
    own = [F.when(F.col("_e.probe"), F.col(c)).alias(c) for c in (state.columns if columns is None else columns)]
    return exploded.select(*own, "_e.*")


def _sums(money: str, whole: bool) -> dict[str, Running]:
    unknown = ("lo_all", "hi_all") if whole else ()
    return {f"s_{n}": Running("sum", F.col(n), money) for n in ("d", "lo", "hi")} | {
        f"s_{n}": Running("sum", F.col(n), "bigint") for n in unknown
    }


def _with_pairs(state: DataFrame, limits: Chunking) -> DataFrame:
    """Latest end of earlier held claims of the same pair: decided and open ones."""
    held = state.where(F.col("held") & F.col("pair").isNotNull())
    rest = state.where(~(F.col("held") & F.col("pair").isNotNull()))
    end = F.struct(*_END)
    values = {
        "_sure": Running("max", F.when(F.col("status") == "new", end)),
        "_maybe": Running("max", F.when((F.col("status") == "open") & ~F.col("barred"), end)),
    }
    scanned = running(held, ("pair",), ("t", "action_id"), values, limits, inclusive=False)
    blocked = scanned.withColumn("block_end", F.greatest("block_end", "_sure"))
    missing = F.lit(None).cast(held.schema["block_end"].dataType)
    return blocked.drop("_sure").unionByName(rest.withColumn("_maybe", missing))


def _with_second(state: DataFrame, limits: Chunking) -> DataFrame:
    """Bounds ``v_lo`` and ``v_hi`` of the second account before each open claim that has one."""
    some, rest = state.where(F.col("via").isNotNull()), state.where(F.col("via").isNull())
    zero, is_open = F.lit(0).cast(MONEY), F.col("status") == "open"
    unknown = F.col("take_all") & F.col("need").isNull()
    amount = F.coalesce("need", "amount", zero)
    # A granted credit raises it; whatever has a sender lowers it.
    sign = F.when(F.col("src").isNull(), 1).otherwise(-1)
    moved = F.when(is_open, zero).otherwise((F.coalesce("amount", zero) * sign).cast(MONEY))
    asked = is_open & ~F.col("barred")
    values = {
        "d": Running("sum", moved, MONEY),
        "lo": Running("sum", F.when(asked & ~unknown, -amount).otherwise(zero).cast(MONEY), MONEY),
        "all": Running("sum", F.when(asked & unknown, 1).otherwise(0), "bigint"),
    }
    work, carry = chunked(some, ("via",), ("t", "action_id"), values, limits)
    if carry is not None:
        work = work.join(carry, ["via", "_chunk"], "left")
    before = {n: F.coalesce(f"_c_{n}", F.lit(0)) if carry is not None else F.lit(0) for n in values}
    work = work.select(
        *state.columns, "_chunk", moved.alias("_d"),
        # What a claim asks of the account: nothing, an amount, or one not known yet (null).
        F.when(~asked, zero).when(~unknown, amount).cast(MONEY).alias("_ask"),
        asked.alias("_asked"),
        # Its sender and its pair surely let it pass.
        (F.col("need").isNotNull() & ~(F.col("held") & F.col("pair").isNotNull())).alias("_sure"),
        before["d"].cast(MONEY).alias("_c_d"), before["lo"].cast(MONEY).alias("_c_lo"), (before["all"] > 0).alias("_c_open"),
    )
    # Each task reads its accounts, or chunks of them, in order and keeps a few numbers.
    dealt = work.repartition("via", "_chunk").sortWithinPartitions("via", "_chunk", "t", "action_id")
    ship(state.sparkSession)
    schema = f"{dealt.schema.simpleString()[7:-1]},v_d:{MONEY},v_lo:{MONEY},v_hi:{MONEY}"
    followed = dealt.mapInArrow(_follow, schema)
    based = followed.withColumn("via_base", (F.col("via_base") + F.coalesce("v_d", zero)).cast(MONEY))
    return based.select(*state.columns, "v_lo", "v_hi").unionByName(rest, allowMissingColumns=True)


_FOLLOWED = ("via", "_chunk", "via_base", "_d", "_ask", "_asked", "_sure", "_c_d", "_c_lo", "_c_open")
_EXACT = decimal.Context(prec=76)


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order with what is decided before them (v_d) and the bounds of their account (v_lo, unknown: null; v_hi).

    An account holds lo to hi coins.  A claim that asks for n is accepted only by n or
    more, so after one in doubt there are no fewer than lo or none, and no more than n
    less than hi or just too few for it.
    """
    add, subtract = _EXACT.add, _EXACT.subtract
    zero, least = decimal.Decimal(0), decimal.Decimal("0.00000001")
    key, lo, hi, done, last = None, None, zero, zero, None
    for b in batches:
        rows = zip(*(b.column(c).to_pylist() for c in _FOLLOWED), strict=True)
        out: list[list] = [[], [], []]
        for via, chunk, base, d, ask, asked, sure, c_d, c_lo, c_open in rows:
            if key != (via, chunk):
                key, last, done = (via, chunk), None, c_d
                lo, hi = None if c_open else add(c_d, c_lo), c_d
            if base is not None:
                # What was decided between two rows in earlier rounds is in the later one's base.
                step = base if last is None else subtract(base, last)
                last = base
                if step:
                    lo, hi = None if lo is None else add(lo, step), add(hi, step)
            for values, value in zip(out, (done, lo, hi), strict=True):
                values.append(value)
            if d:
                lo, hi, done = None if lo is None else add(lo, d), add(hi, d), add(done, d)
            if not asked or (ask is not None and hi < ask):
                continue
            if ask is not None and lo is not None and lo >= ask:
                lo = subtract(lo, ask)
                if sure:
                    hi = subtract(hi, ask)
                continue
            lo = None if lo is None else min(lo, zero)
            if sure:
                hi = max(subtract(hi, ask), subtract(ask, least))
        money = pa.decimal128(38, 8)
        yield pa.RecordBatch.from_arrays(
            [*b.columns, *[pa.array(v, money) for v in out]], [*b.schema.names, "v_d", "v_lo", "v_hi"]
        )


def _decision(settings: Settings, money: str, known: bool) -> list[Column]:
    """State columns after a round, with the new status, amount and error of a claim; ``known``: none takes all."""
    zero = F.lit(0).cast(money)
    base = (F.col("base") + F.coalesce("s_d", zero)).cast(money)
    lo = (base + F.coalesce("s_lo", zero)).cast(money)
    hi = (base + F.coalesce("s_hi", zero)).cast(money)
    lo_known = F.lit(True) if known else F.coalesce("s_lo_all", F.lit(0)) == 0
    hi_known = F.lit(True) if known else F.coalesce("s_hi_all", F.lit(0)) == 0
    minimum = F.lit(settings.minimum).cast(MONEY)
    minimum = _units(minimum) if money == UNITS else minimum
    now = F.struct(F.col("t").alias("end_t"), F.lit(1).alias("end_phase"), F.col("action_id").alias("end_id"))
    sure_block = F.coalesce(F.col("block_end") > now, F.lit(False))
    maybe_block = F.coalesce(F.col("_maybe") > now, F.lit(False))
    sure = F.col("need").isNotNull()
    whole = F.col("take_all") & ~sure
    exact = lo_known & hi_known & (lo == hi)
    is_open = F.col("status") == "open"
    covered = sure | F.when(whole, exact & (lo >= minimum)).otherwise(lo_known & (lo >= F.col("amount")))
    needed = F.coalesce(F.col("need"), F.when(whole, base).otherwise(F.col("amount")))
    at_least = F.when(covered | ~whole, needed).otherwise(minimum)
    second_covers = F.col("via").isNull() | F.coalesce(F.col("v_lo") >= needed, F.lit(False))
    second_short = F.col("via").isNotNull() & F.coalesce(F.col("v_hi") < at_least, F.lit(False))
    barred = F.col("barred") | sure_block | second_short
    short = ~sure & F.when(whole, hi_known & (hi < minimum)).otherwise(hi_known & (hi < F.col("amount")))
    status = (
        F.when(~is_open, "spent")
        .when(short, "rejected")
        .when(covered & barred, "rejected")
        .when(covered & ~maybe_block & second_covers, "new")
        .otherwise("open")
    )
    error = F.when(short, F.when(whole, "tip_below_minimum").otherwise(F.col("short_error")))
    return [
        F.col("action_id"),
        F.col("t"),
        F.col("src"),
        F.col("dst"),
        F.when(status == "new", needed).otherwise(F.col("amount")).cast(money).alias("amount"),
        (F.col("take_all") & (status != "new")).alias("take_all"),
        *[F.col(c) for c in ("held", *_END, "refund", "pair", "short_error", "via", "via_base")],
        base.alias("base"),
        F.col("block_end"),
        F.when(is_open & covered, needed).cast(money).alias("need"),
        F.coalesce(is_open & barred, F.lit(False)).alias("barred"),
        error.alias("error"),
        status.alias("status"),
    ]


def _used() -> dict[str, Column]:
    """What the claims of a run use at all, the largest amount, and the range of an error they may share."""
    is_open = F.col("status") == "open"
    sizes = [F.abs(F.col(c).cast("double")) for c in ("amount", "base")]
    return {
        "holds": F.count(F.when(~F.col("held").eqNullSafe(False), 1)),
        "pairs": F.count(F.when(F.col("held") & F.col("pair").isNotNull(), 1)),
        "via": F.count("via"),
        "take_all": F.count(F.when(~F.col("take_all").eqNullSafe(False), 1)),
        "largest": F.coalesce(F.max(F.greatest(*sizes)), F.lit(0.0)),
        "errors": F.count(F.when(is_open, F.col("short_error"))),
        "first_error": F.min(F.when(is_open, F.col("short_error"))),
        "last_error": F.max(F.when(is_open, F.col("short_error"))),
    }


def _same(used: dict, money: str) -> dict[str, Column]:
    """State columns, and bounds, with one value for all claims; only undecided ones need their error."""
    null, no = F.lit(None), F.lit(False)
    same: dict[str, Column] = {"error": null.cast("string")}
    if not used["holds"]:
        same |= {"held": no, "refund": no, "end_t": null.cast("bigint"), "end_phase": null.cast("int"), "end_id": null.cast("bigint")}
    if not used["pairs"]:
        same |= {"pair": null.cast("string"), "block_end": null.cast(_END_TYPE), "_maybe": null.cast(_END_TYPE)}
    if not used["via"]:
        same |= {"via": null.cast("bigint"), "via_base": null.cast(MONEY), "v_lo": null.cast(MONEY), "v_hi": null.cast(MONEY)}
    if not used["take_all"]:
        same["take_all"] = no
    if not used["pairs"] and not used["via"]:
        # Whatever is covered is decided at once.
        same |= {"need": null.cast(money), "barred": no}
    if used["errors"] == 0 or (used["errors"] == used["n"] and used["first_error"] == used["last_error"]):
        same["short_error"] = F.lit(used["first_error"]).cast("string")
    return same


def _reach(state: DataFrame) -> float:
    """The most that claims can move on one account, were all accepted or none."""
    rough = state.withColumns({c: F.col(c).cast("double") for c in ("amount", "need")})
    rows = _entry_rows(rough, _entries("double"), ())
    each = rows.groupBy("account").agg(F.sum(F.abs("d") + F.abs("lo") + F.abs("hi")).alias("r"))
    return each.agg(F.max("r")).first()[0] or 0.0


def settle(
    opening: DataFrame,
    claims: DataFrame,
    granted: DataFrame | None = None,
    settings: Settings = DEFAULT,
    chunks: int | None = None,
    on_round: Callable[[int, int], None] | None = None,
    second: DataFrame | None = None,
) -> Settlement:
    """Decide ``claims`` in order against ``opening`` (account, balance).

    ``granted`` are claims without a sender that are decided already: deposits
    and tips held since an earlier run.  ``second`` (account, balance) opens the
    accounts that ``via`` names; one it does not list is empty.  Rounds go on until no claim is open: each decides at least
    the earliest open claim of every account, so their number follows the longest chain of claims
    that wait for each other.
    """
    spark = claims.sparkSession
    space = Workspace(spark, "settle")
    first = opening.groupBy(F.col("account").cast("bigint").alias("_account")).agg(
        F.sum("balance").cast(MONEY).alias("_opening")
    )
    state = (
        claims.join(first, F.col("src") == F.col("_account"), "left")
        .withColumn("base", F.coalesce("_opening", F.lit(0)).cast(MONEY))
        .drop("_account", "_opening")
        .withColumns(
            {
                "block_end": F.lit(None).cast(_END_TYPE),
                "need": F.lit(None).cast(MONEY),
                "barred": F.lit(False),
                "error": F.lit(None).cast("string"),
                "status": F.lit("open"),
            }
        )
    )
    if "via" not in claims.columns:
        state = state.withColumn("via", F.lit(None).cast("bigint"))
    if second is None:
        state = state.withColumn("via_base", F.lit(0).cast(MONEY))
    else:
        wallets = second.groupBy(F.col("account").cast("bigint").alias("via")).agg(F.sum("balance").cast(MONEY).alias("_v"))
        state = state.join(wallets, "via", "left").withColumn("via_base", F.coalesce("_v", F.lit(0)).cast(MONEY)).drop("_v")
    if granted is not None:
        sure = granted.withColumns({"status": F.lit("new"), "barred": F.lit(False)})
        state = state.unionByName(sure, allowMissingColumns=True)
    state = _normal(state)
    state = space.store(state, "start")

    is_open = F.col("status") == "open"
    # Open claims, and those among them that are held or have a second account.
    counted = {
        "n": F.count(F.when(is_open, 1)),
        "held": F.count(F.when(is_open & F.col("held") & F.col("pair").isNotNull(), 1)),
        "second": F.count(F.when(is_open & F.col("via").isNotNull(), 1)),
    }
    todo = state.agg(*[c.alias(n) for n, c in (counted | _used()).items()]).first().asDict()
    money = MONEY if todo["take_all"] or todo["via"] or todo["largest"] + _reach(state) > _REACH else UNITS
    same = _same(todo, money)
    live = [c for c in state.columns if c not in same]
    if money == UNITS:
        state = state.withColumns({c: _units(F.col(c)) for c in ("amount", "base", "need")})
    state = state.select(*live)

    # Built once: every round uses the same expressions.
    entries, sums, decision = _entries(money), _sums(money, bool(todo["take_all"])), _decision(settings, money, not todo["take_all"])
    by_account = plan_chunks(
        _entry_rows(state.withColumns(same), entries, ()).select("account", "o_t", "o_id"),
        F.col("o_t"), F.col("o_id"), ("account",), chunks=chunks,
    )
    held = state.withColumns(same).where(F.col("held") & F.col("pair").isNotNull())
    none = Chunking(hot_keys=[])
    by_pair = plan_chunks(held, F.col("t"), F.col("action_id"), ("pair",), chunks=chunks) if todo["held"] else none
    with_second = state.withColumns(same).where(F.col("via").isNotNull())
    by_second = plan_chunks(with_second, F.col("t"), F.col("action_id"), ("via",), chunks=chunks) if todo["second"] else none

    def bounded(rows: DataFrame) -> DataFrame:
        # What no open claim depends on any more is not scanned.
        work, carried = rows.withColumns(same), list(live)
        if "pair" in live:
            work = _with_pairs(work, by_pair) if todo["held"] else work.withColumn("_maybe", F.col("block_end"))
            carried.append("_maybe")
        if "via" in live:
            work = (
                _with_second(work, by_second)
                if todo["second"]
                else work.withColumns({"v_lo": F.lit(None).cast(MONEY), "v_hi": F.lit(None).cast(MONEY)})
            )
            carried += ["v_lo", "v_hi"]
        entered = _entry_rows(work, entries, carried)
        return running(entered, ("account",), ("o_t", "o_phase", "o_id"), sums, by_account, inclusive=False)

    columns = ["action_id", "amount", "status", "error"]
    rounds, counts = 0, []
    stored = state.withColumns(same).where("status in ('spent', 'rejected')")  # no claim is decided yet
    while todo["n"]:
        rounds += 1
        result = bounded(state).where("probe").withColumns(same).select(*decision).where("status <> 'spent'")
        # The write itself counts what is left.
        left = Observation()
        stored = space.store(result.observe(left, *[c.alias(n) for n, c in counted.items()]).select(*live, "error"), f"round-{rounds}")
        state = stored.where("status in ('open', 'new')").select(*live)
        todo = left.get
        counts.append(todo["n"])
        if on_round:
            on_round(rounds, todo["n"])

    paths = [space.path(f"round-{k}") for k in range(1, rounds + 1)]
    done = spark.read.schema(stored.schema).parquet(*paths) if paths else stored
    parts = done.where("status in ('new', 'rejected')").select(*columns)
    if money == UNITS:
        parts = parts.withColumn("amount", _money(F.col("amount")))
    decided = space.store(
        parts.select("action_id", (F.col("status") == "new").alias("accepted"), "error", "amount"), "decisions"
    )
    space.drop("start", *(f"round-{k}" for k in range(1, rounds + 1)))
    decisions = claims.drop("amount").join(decided, "action_id")
    return Settlement(decisions, rounds, tuple(counts))


def _normal(state: DataFrame) -> DataFrame:
    return state.select(
        "action_id", "t", "src", "dst", "amount", "take_all", "held", *_END, "refund", "pair",
        "short_error", "via", "via_base", "base", "block_end", "need", "barred", "error", "status",
    )


def accepted_entries(decisions: DataFrame, until: Column | None = None) -> DataFrame:
    """Balance changes (account, o_t, o_id, d) of accepted claims, up to ``until``."""
    state = decisions.where("accepted").select(
        "action_id", "t", "src", "dst", F.col("amount").cast(MONEY).alias("amount"),
        F.lit(False).alias("take_all"), "held", *_END, "refund", F.lit("new").alias("status"), *_final(),
    )
    rows = state.select(F.explode(_entries()).alias("_e")).where(F.col("_e").isNotNull()).select(
        F.col("_e.account").alias("account"),
        F.col("_e.o_t").alias("o_t"),
        F.col("_e.o_phase").alias("o_phase"),
        F.col("_e.o_id").alias("o_id"),
        F.col("_e.d").alias("d"),
    )
    return rows if until is None else rows.where(F.col("o_t") <= F.unix_micros(until.cast("timestamp")))


def grant(action_id: Column, ts: Column, account: Column, amount: Column) -> list[Column]:
    """Claim columns of an unconditional credit."""
    return claim(action_id, ts, F.lit(None).cast("bigint"), account, amount)


def closing_balances(
    opening: DataFrame, decisions: DataFrame, granted: DataFrame | None = None, until: Column | None = None
) -> DataFrame:
    """Balance per account after the accepted claims; what is still held is in no account."""
    start = opening.select(F.col("account").cast("bigint").alias("account"), F.col("balance").cast(MONEY).alias("d"))
    parts = start.unionByName(accepted_entries(decisions, until).select("account", "d"))
    if granted is not None:
        sure = granted.withColumn("accepted", F.lit(True))
        parts = parts.unionByName(accepted_entries(sure, until).select("account", "d"))
    return parts.groupBy("account").agg(F.sum("d").cast(MONEY).alias("balance"))


def audit_decisions(opening: DataFrame, decisions: DataFrame, chunks: int | None = None) -> DataFrame:
    """Each claim with the balance its sender had and whether the decision fits it.

    Accepted claims must have been covered; claims rejected for want of coins must
    not.  A log in which every row is ``consistent`` is the sequential outcome.
    """
    start = opening.groupBy(F.col("account").cast("bigint").alias("_account")).agg(
        F.sum("balance").cast(MONEY).alias("_opening")
    )
    # Rejected claims move nothing but keep their row, so each sender's row
    # carries its claim and the sum over the rows before it is the balance.
    state = decisions.select(
        "action_id", "t", "src", "dst",
        F.when(F.col("accepted"), F.col("amount")).otherwise(F.lit(0)).cast(MONEY).alias("amount"),
        F.lit(False).alias("take_all"), "held", *_END, "refund", F.lit("new").alias("status"), *_final(),
        F.struct("accepted", "amount", "error", "short_error").alias("claim"),
    )
    rows = _entry_rows(state, _entries()).select("action_id", "claim", "account", "o_t", "o_phase", "o_id", "probe", "d")
    limits = plan_chunks(rows, F.col("o_t"), F.col("o_id"), ("account",), chunks=chunks)
    net = {"_net": Running("sum", F.col("d"), MONEY)}
    summed = running(rows, ("account",), ("o_t", "o_phase", "o_id"), net, limits, inclusive=False)
    joined = summed.where("probe").join(start, F.col("account") == F.col("_account"), "left")
    # One digit less on the left keeps all places of the sum.
    had = (F.coalesce("_opening", F.lit(0)).cast("decimal(37,8)") + F.coalesce("_net", F.lit(0)).cast("decimal(37,8)")).cast(MONEY)
    short = F.col("claim.short_error").isNotNull() & (F.col("claim.error") == F.col("claim.short_error"))
    fits = F.when(F.col("claim.accepted"), had >= F.col("claim.amount")).when(short, had < F.col("claim.amount"))
    return joined.select(
        "action_id",
        F.col("claim.accepted").alias("accepted"),
        F.col("claim.amount").alias("amount"),
        had.alias("available"),
        F.coalesce(fits, F.lit(True)).alias("consistent"),
    )
