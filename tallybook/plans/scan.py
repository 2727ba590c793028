"""Running aggregates in order, split so that no key lands in one task.

A plain ``Window.partitionBy(key).orderBy(t)`` sorts a whole key in a single
task, and a window without a key sorts the whole table there.  ``running`` does
the same work in two levels: the order is cut into chunks of bounded size, each
(key, chunk) is scanned by its own task, and the totals of earlier chunks, a
small table, are added as carry-in.  Only keys above a share of the rows are
cut; the rest keep one chunk and pay nothing.

Chunk limits come from approximate quantiles.  They steer the balance only: any
limits give the same result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Running:
    """One running value: kind is ``sum``, ``max`` or ``last`` (non-null)."""

    kind: str
    value: Column
    type: str | None = None


def _limits(values: list | None) -> list[int]:
    return sorted(int(v) for v in values or [])


@dataclass(frozen=True)
class Chunking:
    """Chunk limits over (t, phase, tie) and, for keyed scans, the keys to cut."""

    t_limits: list[int] = field(default_factory=list)
    tie_limits: list[int] = field(default_factory=list)
    hot_keys: list[int] | None = None  # hashes of the keys to cut; None: no key, every row is cut

    @property
    def cuts(self) -> bool:
        return bool(self.t_limits) and (self.hot_keys is None or bool(self.hot_keys))

    def chunk(self, t: Column, tie: Column, phase: Column | None = None) -> Column:
        """A number that never decreases along (t, phase, tie).

        A value of t that is itself a limit gets chunks of its own, which are
        cut further by tie, so that one crowded instant is divided too.
        """
        if not self.t_limits:
            return F.lit(0).cast("long")
        limits = sorted(set(self.t_limits))
        width = 2 * (len(self.tie_limits) + 2)
        below = _count_below(limits, t)
        repeated = _repeated(self.t_limits)
        crowded = t.isin(repeated) if repeated else F.lit(False)
        on_limit = F.get(_literals(limits), below.cast("int")) == t
        major = below * 2 + F.coalesce(on_limit, F.lit(False)).cast("long")
        minor = _count_below(sorted(set(self.tie_limits)), tie)
        if phase is not None:
            minor = minor + phase.cast("long") * F.lit(width // 2)
        return major * F.lit(width) + F.when(crowded, minor).otherwise(F.lit(0).cast("long"))


def _repeated(values: list[int]) -> list[int]:
    return sorted({v for v in values if values.count(v) > 1})


def _literals(values: list[int]) -> Column:
    """Constant array of longs, as one expression however many values it has."""
    return F.expr("array(" + ",".join(f"{v}L" for v in values) + ")")


def _count_below(limits: list[int], value: Column) -> Column:
    """How many limits lie below ``value``, in two steps of sqrt(n) comparisons."""
    if not limits:
        return F.lit(0).cast("long")
    step = max(1, isqrt(len(limits)))
    coarse = limits[::step]
    hit = F.size(F.filter(_literals(coarse), lambda b: b < value))
    start = F.greatest(hit - 1, F.lit(0)) * step
    fine = F.slice(_literals(limits), start + 1, step)
    return (start + F.size(F.filter(fine, lambda b: b < value))).cast("long")


def _chunk_count(df: DataFrame, chunks: int | None) -> int:
    if chunks is not None:
        return chunks
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def plan_chunks(
    df: DataFrame,
    t: Column,
    tie: Column,
    keys: Sequence[str] = (),
    chunks: int | None = None,
) -> Chunking:
    """Measure ``df`` once: quantiles of the order and the keys worth cutting.

    What reaches the driver is bounded by ``chunks``: two quantile arrays of
    that length and at most ``chunks`` keys, since each must hold at least
    1/chunks of the rows.
    """
    n = _chunk_count(df, chunks)
    hot: list[int] | None = None
    if keys:
        total = df.count()
        floor = max(1, total // n)
        if total < floor:
            return Chunking(hot_keys=[])
        counts = df.groupBy(_key_hash(keys).alias("_h")).agg(F.count(F.lit(1)).alias("_n"))
        hot = [r["_h"] for r in counts.where(F.col("_h").isNotNull() & (F.col("_n") >= floor)).collect()]
        if not hot:
            return Chunking(hot_keys=[])
        df = df.where(_is_hot(keys, hot))
    fractions = [i / n for i in range(1, n)]
    accuracy = F.lit(max(10_000, 20 * n))
    row = df.select(
        F.percentile_approx(t, fractions, accuracy).alias("t"),
        F.percentile_approx(tie, fractions, accuracy).alias("tie"),
    ).first()
    return Chunking(_limits(row["t"]), _limits(row["tie"]), hot)


def _key_hash(keys: Sequence[str]) -> Column:
    """Hash of a key; null if any part is, as null keys are never cut."""
    known = F.lit(True)
    for key in keys:
        known = known & F.col(key).isNotNull()
    return F.when(known, F.xxhash64(*keys))


def _is_hot(keys: Sequence[str], hot: list[int]) -> Column:
    # A key that only shares the hash of a hot one is cut as well, which is harmless.
    return F.coalesce(_key_hash(keys).isin(hot), F.lit(False))


def chunked(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Running], chunking: Chunking
) -> tuple[DataFrame, DataFrame | None]:
    """``df`` with ``_chunk``, and per cut (key, chunk) the values ``_c_<name>`` before it; None if nothing is cut."""
    t, tie = F.col(order[0]), F.col(order[-1])
    phase = F.col(order[1]) if len(order) == 3 else None
    if not keys and not chunking.cuts:
        chunking = Chunking(hot_keys=None)
    if chunking.cuts:
        chunk = chunking.chunk(t, tie, phase)
        if chunking.hot_keys is not None:
            chunk = F.when(_is_hot(keys, chunking.hot_keys), chunk).otherwise(F.lit(0).cast("long"))
    else:
        chunk = F.lit(0).cast("long")
    work = df.withColumn("_chunk", chunk)
    if not chunking.cuts:
        return work, None

    # Totals per cut (key, chunk): at most hot keys x chunks rows.
    group = [*keys, "_chunk"]
    cut = work if chunking.hot_keys is None else work.where(_is_hot(keys, chunking.hot_keys))
    totals = cut.groupBy(*group).agg(*[_total(v, order).alias(f"_c_{n}") for n, v in values.items()])
    before = (
        Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    return work, totals.select(
        *group, *[_carry(v, F.col(f"_c_{n}")).over(before).alias(f"_c_{n}") for n, v in values.items()]
    )


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: dict[str, Running],
    chunking: Chunking,
    inclusive: bool = True,
) -> DataFrame:
    """Add running values over ``order`` = (t, tie) or (t, phase, tie) per key.

    ``t`` and ``tie`` are integer columns.  With ``inclusive`` the current row
    counts, otherwise only the rows before it.
    """
    work, carry = chunked(df, keys, order, values, chunking)
    group = [*keys, "_chunk"]
    window = (
        Window.partitionBy(*group)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    local = work.select("*", *[_local(v, window).alias(n) for n, v in values.items()])
    if carry is None:
        return _finish(local.drop("_chunk"), df.columns, values)
    joined = local.join(carry, group, "left")
    merged = joined.select(
        *[F.col(c) for c in df.columns],
        *[_merge(v, F.col(n), F.col(f"_c_{n}")).alias(n) for n, v in values.items()],
    )
    return _finish(merged, df.columns, values)


def _finish(df: DataFrame, columns: list[str], values: dict[str, Running]) -> DataFrame:
    outs = [F.col(n).cast(v.type).alias(n) if v.type else F.col(n) for n, v in values.items()]
    return df.select(*[F.col(c) for c in columns], *outs)


def _local(v: Running, window) -> Column:
    if v.kind == "sum":
        return F.sum(v.value).over(window)
    if v.kind == "max":
        return F.max(v.value).over(window)
    return F.last(v.value, ignorenulls=True).over(window)


def _total(v: Running, order: Sequence[str]) -> Column:
    if v.kind == "sum":
        return F.sum(v.value)
    if v.kind == "max":
        return F.max(v.value)
    return F.max_by(v.value, F.when(v.value.isNotNull(), F.struct(*order)))


def _carry(v: Running, column: Column) -> Column:
    if v.kind == "sum":
        return F.sum(column)
    if v.kind == "max":
        return F.max(column)
    return F.last(column, ignorenulls=True)


def _merge(v: Running, local: Column, carry: Column) -> Column:
    if v.kind == "sum":
        both = F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))
        return F.when(local.isNotNull() | carry.isNotNull(), both)
    if v.kind == "max":
        return F.greatest(local, carry)
    return F.coalesce(local, carry)


def number_rows(df: DataFrame, order: Sequence[str], name: str, chunks: int | None = None) -> DataFrame:
    """Dense 1..n numbering of the whole table along (t, tie)."""
    limits = plan_chunks(df, F.col(order[0]), F.col(order[-1]), chunks=chunks)
    return running(df, (), order, {name: Running("sum", F.lit(1).cast("long"), "long")}, limits)
