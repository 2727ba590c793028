"""Whitening of embeddings over their distinct vectors.

Entries become whole numbers, x = floor(scale * c) + shift, and rows of equal x vectors
are one vector with a multiplicity. The fit list holds each distinct vector once: its
weight is one, or its multiplicity if asked for. Sums per dimension are exact whole
numbers; n * x - sum is exact too, so vectors are centred without a rounded mean. Every
task adds w (x - mean)(x - mean)' of its vectors by matrix products and puts out one
matrix of dims x dims; these are added by rows in the cluster, and the driver sees one.
Each distinct vector is projected and scaled once, and rows get the values back by a
join on the vector's SHA-256. Vectors that hold more than their share of the rows (at
most 4 for every shuffle partition) come by broadcast, so no task gets a hot one.

Rows whose vector is null, or holds null or non-finite entries, are dropped, and so are
rows whose length differs from the most common one (of equally common ones the longest; empty vectors never count).
Entries beyond 2 ** 52 after scaling count as that limit. Components of a variance below
1e-12 of the largest are left out, so a table with one distinct vector, or none, has no
result. ``deviation`` is a decimal(38,0), null beyond it. Null and repeated ids are kept:
each row has its result. Vectors longer than ``LARGEST`` raise a ``ValueError``, since a
matrix of that many rows must fit a task. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stage, columns, ready, spread_join

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
LARGEST = 2048
EDGE = 2.0**52  # entries are whole numbers up to here
WHOLE = 2**62  # products up to here fit 64 bits
FLAT = 1e-12  # share of the largest variance below which a direction is none

RESULT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Model:
    """The fit: n, sums per dimension, unit eigenvectors by row, their variances and the trace."""

    n: int
    sums: tuple[int, ...]
    directions: np.ndarray
    variances: np.ndarray
    trace: float

    @property
    def explained(self) -> list[float]:
        return (self.variances / self.trace).tolist()

    def whitener(self) -> np.ndarray:
        return (self.directions / np.sqrt(self.variances)[:, None]).T


def gridded(vectors: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, x): the rows whose vectors are whole, as whole numbers."""
    c = F.col("c")
    whole = lambda v: F.coalesce(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))
    number: Callable[[Column], Column] = lambda v: (
        F.floor(F.least(F.greatest(F.lit(float(scale)) * v, F.lit(-EDGE)), F.lit(EDGE))) + F.lit(shift)
    ).cast("long")
    rows = columns(vectors, ("vec_id", "embedding")).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("c")
    )
    return rows.where(c.isNotNull() & F.forall(c, whole)).select("vec_id", F.transform(c, number).alias("x"))


def keyed(grid: DataFrame, dims: int) -> DataFrame:
    """Rows of ``dims`` dimensions with the digest of their vector."""
    digest = F.unhex(F.sha2(F.array_join(F.col("x").cast("array<string>"), ",").cast("binary"), 256))
    return grid.where(F.size("x") == dims).select("vec_id", "x", digest.alias("key"))


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    return np.asarray(column.flatten()).reshape(len(column), -1)


def offsets(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - sums, exact: as 64-bit numbers if all fit, else as Python's."""
    if n * max(int(np.abs(x).max()), 1) < WHOLE and max(map(abs, sums)) < WHOLE:
        return n * x - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def squares(off: np.ndarray) -> list[int]:
    """Sum of the squares of every row, exact."""
    if off.dtype != object and (off.shape[1] * int(np.abs(off).max()) ** 2) < WHOLE:
        return (off * off).sum(1).tolist()
    wide = off.astype(object)
    return (wide * wide).sum(1).tolist()


def _totals(weights: str):
    """Per task: n, rows and the sums, one row per dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = rows = 0
        sums: list[int] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            x, copies = matrix(b.column("x")), b.column("copies").to_pylist()
            w = [1] * len(copies) if weights == "one" else copies
            # 1024 rows of up to 2 ** 53, times a weight, may pass 64 bits.
            small = int(np.abs(x).max()) * sum(w) < WHOLE
            part = (np.array(w) @ x).tolist() if small else (np.array(w, object) @ x.astype(object)).tolist()
            sums = part if sums is None else [a + c for a, c in zip(sums, part)]
            n, rows = n + sum(w), rows + sum(copies)
        if sums is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(sums)), pa.int32()), pa.array(sums, pa.decimal128(38, 0)), pa.array([n] * len(sums), pa.int64()),
                 pa.array([rows] * len(sums), pa.int64())],
                ["i", "total", "n", "rows"],
            )

    return run


def _products(centre: Callable[[pa.RecordBatch], np.ndarray], weights: str):
    """Per task: the sum of w v v' over its vectors v, one row of the matrix per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if not b.num_rows:
                continue
            v = centre(b)
            left = v if weights == "one" else v * np.asarray(b.column("copies"), float)[:, None]
            part = left.T @ v
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "row"]
            )

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one matrix row added up; a task holds each of its rows once."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for i, row in zip(b.column("i").to_pylist(), matrix(b.column("row")) if b.num_rows else ()):
            total[i] = total[i] + row if i in total else row
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int32()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], ["i", "row"]
    )


def covariance(vectors: DataFrame, centre: Callable[[pa.RecordBatch], np.ndarray], n: int, weights: str) -> np.ndarray:
    """The weighted covariance of centred vectors, divisor ``n``; only dims x dims numbers reach the driver."""
    schema = "i int, row array<double>"
    parts = vectors.mapInArrow(_products(centre, weights), schema).repartition("i").mapInArrow(_added, schema)
    rows = sorted(parts.collect())
    found = np.array([r.row for r in rows]) / n
    return (found + found.T) / 2


def _centred(n: int, sums: tuple[int, ...]) -> Callable[[pa.RecordBatch], np.ndarray]:
    return lambda b: (offsets(matrix(b.column("x")), n, sums) / n).astype(float)


def fit(distinct: DataFrame, components: int = COMPONENTS, weights: str = "one") -> tuple[Model | None, int]:
    """The model over distinct vectors (x, copies), none if nothing varies, and the number of rows behind them."""
    totals = distinct.select("x", "copies").mapInArrow(_totals(weights), "i int, total decimal(38,0), n long, rows long")
    sums = totals.groupBy("i").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.sum("rows").alias("rows")).orderBy("i").collect()
    if not sums:
        return None, 0
    n, total = sums[0].n, tuple(int(r.total) for r in sums)
    v = covariance(distinct.select("x", "copies"), _centred(n, total), n, weights)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    kept = e > max(e[0], 0) * FLAT
    if not kept.any():
        return None, sums[0].rows
    return Model(n, total, u[:, kept].T.copy(), e[kept].copy(), float(np.trace(v))), sums[0].rows


def _whitened(model: Model):
    projection, n, sums = model.whitener(), model.n, model.sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            off = offsets(matrix(b.column("x")), n, sums)
            values = (off / n).astype(float) @ projection
            deviation = pa.array([s if s < 10**38 else None for s in squares(off)], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), b.column("copies"), deviation, pa.array(values.tolist(), pa.list_(pa.float64()))],
                ["key", "copies", "deviation", "whitened"],
            )

    return run


def whiten(
    vectors: DataFrame, components: int = COMPONENTS, weights: str = "one", scale: int = SCALE, shift: int = SHIFT
) -> DataFrame:
    """Every row's whitened values, one row per component numbered from 1 by falling variance.

    ``weights``: ``one`` fits on each distinct vector once, ``copies`` on every row.
    ``identity_error`` is the largest absolute entry of the whitened values' covariance
    over the fit list, minus the identity; those values are centred as their vectors are.
    """
    if weights not in ("one", "copies"):
        raise ValueError("weights are 'one' or 'copies'")
    spark = ready(vectors.sparkSession)
    grid = gridded(vectors, scale, shift)
    common = grid.groupBy(F.size("x").alias("dims")).count().where("dims > 0").orderBy(F.desc("count"), F.desc("dims")).first()
    if common is None:
        return spark.createDataFrame([], RESULT)
    if common.dims > LARGEST:
        raise ValueError(f"vectors of {common.dims} dimensions, at most {LARGEST} are supported")
    stage = Stage(spark, "whitening")
    rows = keyed(grid, common.dims)
    distinct = stage.store(rows.groupBy("key", "x").agg(F.count("*").alias("copies")), "distinct")
    model, total = fit(distinct, components, weights)
    if model is None:
        return spark.createDataFrame([], RESULT)
    done = stage.store(
        distinct.mapInArrow(_whitened(model), "key binary, copies long, deviation decimal(38,0), whitened array<double>"), "whitened"
    )
    own = covariance(done.select("whitened", "copies"), lambda b: matrix(b.column("whitened")), model.n, weights)
    error = float(np.abs(own - np.eye(len(own))).max())
    stage.drop("distinct")

    # Vectors that hold more than this many rows: at most 4 for every partition, so they can be sent whole.
    share = total / (4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    values = spread_join(rows.select("vec_id", "key"), done, ["key"], F.col("copies") > F.lit(share))
    explained = F.array(*map(F.lit, model.explained))
    return (
        values.select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
        .select(
            "vec_id", (F.col("k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
            F.get(explained, F.col("k")).alias("explained"), F.lit(error).alias("identity_error"),
        )
    )


def whitening_report(vectors: DataFrame) -> DataFrame:
    """``whiten`` with ``deviation`` as a long, null where it is larger than one."""
    return whiten(vectors).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
