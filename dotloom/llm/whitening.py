"""Whitening of embeddings by matrix-free block subspace iteration.

Vectors become integers, so their sums are exact and every row can be centred exactly. A block Q of orthonormal columns
is driven towards the leading eigenvectors of the covariance V: one Spark pass computes V Q as the sum of c (c . Q) over
the centred rows c, without ever building V; Rayleigh-Ritz on the block gives eigenpairs and their residuals, and QR of
V Q the next block. The passes end when the residuals of all k components are at ``TOL`` of the largest eigenvalue (or at
what the sums' rounding lets them reach). Where the spectrum is so flat that the residuals' fall would take many passes,
the block is doubled, up to ``MOST_BLOCK`` columns; once it spans the whole space, one pass ends it.

A task sends one row of the vector's length for each column of the block; such rows are summed by column on the
cluster. The table is read by at most ``TASKS`` tasks, so what is summed doesn't grow with the input, and the driver
gets one matrix of the block's size a pass.

Defined results: rows with a null vector, null or non-finite entries, or entries beyond 2**42 are left out, and so are
vectors of another length than the most frequent (the least of equally frequent). Rows that repeat count each; null ids
stay. Components whose eigenvalue is not above 1e-12 of the largest are not given, so vectors that are all equal, and
empty tables, give no rows. A ``deviation`` beyond a long is null. Further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dotloom.llm.common import Stored, stored, with_only

#: Components, columns of the block at first and at most, residual relative to the largest eigenvalue, passes worth waiting for.
K, BLOCK, MOST_BLOCK, TOL, PATIENCE = 8, 24, 512, 1e-13, 6
#: Tasks that read the table, rows worked on at once, and the scale and shift of integer vectors.
TASKS, ROWS, SCALE, SHIFT = 4096, 2048, 1024, 100_000


def _matrix(col: pa.Array) -> np.ndarray:
    """A list column without nulls and of one length as a matrix."""
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1)


def _slices(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def integers(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows that take part: x = floor(1024 * c) + 100000 for each entry c."""
    d = with_only(vectors, key, column).select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
    good = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: F.coalesce(F.abs(c) < 2.0**42, F.lit(False)))

    def run(batches):
        for batch in _slices(batches):
            if not batch.num_rows:
                continue
            v = batch.column("v")
            x = (np.floor(SCALE * v.flatten().to_numpy(zero_copy_only=False)) + SHIFT).astype(np.int64)
            off = np.concatenate([[0], np.cumsum(v.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.ListArray.from_arrays(pa.array(off), pa.array(x))], ["vec_id", "x"])

    return d.where(good).mapInArrow(run, "vec_id long, x array<long>")


def _summed(parts: DataFrame, keys: int) -> np.ndarray:
    """The sum of rows (k, v array<double>) for each k below ``keys``, added up on the cluster."""

    def add(batches):
        have: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch.column("k").to_pylist(), _matrix(batch.column("v")), strict=True):
                have[k] = have[k] + v if k in have else v.copy()
        if have:
            yield pa.RecordBatch.from_arrays([pa.array(list(have), pa.int32()), pa.array([v.tolist() for v in have.values()], pa.list_(pa.float64()))], ["k", "v"])

    rows = parts.repartition(min(keys, 64), "k").mapInArrow(add, "k int, v array<double>").toArrow()
    order = np.argsort(rows.column("k").to_numpy())
    return _matrix(rows.column("v").combine_chunks())[order] if rows.num_rows else np.zeros((0, 0))


@dataclass
class Fit:
    rows: Stored  # (vec_id, x) of one length
    n: int
    sums: np.ndarray  # exact, per dimension

    def centred(self, batch: pa.RecordBatch) -> np.ndarray:
        """n * x - S of the rows, exact."""
        x = _matrix(batch.column("x"))
        if self.n * int(np.abs(x).max(initial=0)) >= 1 << 62:
            x = x.astype(object)
        return self.n * x - self.sums


def fit_list(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> Fit | None:
    """The vectors that take part, stored, with their exact sums; none for an empty table."""
    every = stored(integers(vectors, key, column), "vectors")
    sizes = every.df.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"))
    most = sizes.orderBy(F.desc("n"), "d").first()
    if most is None:
        every.drop()
        return None
    every.df = every.df.where(F.size("x") == most.d)

    def run(batches):
        total = None
        for batch in _slices(batches):  # a slice's sums fit a long
            part = _matrix(batch.column("x")).sum(axis=0).astype(object)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array([Decimal(int(v)) for v in total], pa.decimal128(38, 0))], ["at", "s"])

    sums = every.df.select("x").coalesce(TASKS).mapInArrow(run, "at int, s decimal(38,0)").groupBy("at").agg(F.sum("s").alias("s")).collect()
    exact = [int(r.s) for r in sorted(sums, key=lambda r: r.at)]
    return Fit(every, most.n, np.array(exact, np.int64 if max(map(abs, exact)) < 1 << 62 else object))


def covariance_times(fit: Fit, q: np.ndarray) -> tuple[np.ndarray, float]:
    """V Q and the trace of V, in one pass."""
    shared = fit.rows.spark.sparkContext.broadcast(q)
    bare = Fit(None, fit.n, fit.sums)

    def run(batches):
        q, y, trace = shared.value, None, 0.0
        for batch in _slices(batches):
            c = bare.centred(batch).astype(np.float64) / bare.n
            part = c.T @ (c @ q)
            y = part if y is None else y + part
            trace += float((c * c).sum())
        if y is not None:
            rows = np.vstack([y.T, np.full((1, y.shape[0]), trace)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows), dtype=np.int32)), pa.array(rows.tolist(), pa.list_(pa.float64()))], ["k", "v"])

    rows = _summed(fit.rows.df.select("x").coalesce(TASKS).mapInArrow(run, "k int, v array<double>"), q.shape[1] + 1) / fit.n
    shared.destroy()
    return rows[:-1].T, float(rows[-1, 0])


@dataclass
class Components:
    values: np.ndarray
    vectors: np.ndarray  # dimensions x components
    trace: float
    residual: float
    passes: int


def components(fit: Fit, k: int = K, block: int = BLOCK, tol: float = TOL) -> Components:
    """The k leading eigenpairs of the covariance, falling; fewer where its rank is less."""
    d = len(fit.sums)
    k = min(k, d)
    rng, p = np.random.default_rng(7), min(d, max(block, k))
    q = np.linalg.qr(rng.standard_normal((d, p)))[0]
    worst, passes = [], 0
    while True:
        passes += 1
        y, trace = covariance_times(fit, q)
        t = q.T @ y
        values, u = np.linalg.eigh((t + t.T) / 2)
        values, u = values[::-1], u[:, ::-1]
        z, vz = q @ u, y @ u
        top = max(values[0], np.finfo(float).tiny)
        worst.append(float(np.linalg.norm(vz[:, :k] - z[:, :k] * values[:k], axis=0).max() / top))
        # At the sums' rounding the residuals fall no more.
        floor = len(worst) > 3 and worst[-1] < 1e-11 and worst[-1] > 0.5 * min(worst[:-1])
        if worst[-1] <= tol or floor or p == d or trace == 0:
            break
        slow = len(worst) > 1 and np.log(tol / worst[-1]) / min(np.log(min(worst[-1] / worst[-2], 0.999)), -1e-9) > PATIENCE
        if slow and p < min(d, MOST_BLOCK):
            p = min(d, MOST_BLOCK, 2 * p)
            vz, worst = np.hstack([vz, top * rng.standard_normal((d, p - vz.shape[1])) / np.sqrt(d)]), []
        q = np.linalg.qr(vz)[0]
    keep = [i for i in range(k) if values[i] > 1e-12 * top and trace > 0]
    return Components(values[keep], z[:, keep], trace, worst[-1], passes)


def identity_error(fit: Fit, c: Components) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, from a pass over them."""
    bare, matrix = Fit(None, fit.n, fit.sums), c.vectors / np.sqrt(c.values)

    def run(batches):
        total = None
        for batch in _slices(batches):
            w = bare.centred(batch).astype(np.float64) / bare.n @ matrix
            part = np.vstack([w.T @ w, w.sum(axis=0)])
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total.tolist(), pa.list_(pa.float64()))], ["k", "v"])

    rows = _summed(fit.rows.df.select("x").coalesce(TASKS).mapInArrow(run, "k int, v array<double>"), len(c.values) + 1) / fit.n
    return float(np.abs(rows[:-1] - np.outer(rows[-1], rows[-1]) - np.eye(len(c.values))).max())


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _deviation(y: np.ndarray) -> list:
    """Exact sums of squares; null beyond a long."""
    if y.dtype != object and (y.astype(np.float64) ** 2).sum(axis=1).max(initial=0) < 2.0**62:
        return (y * y).sum(axis=1).tolist()
    exact = [sum(int(v) ** 2 for v in row) for row in y]
    return [v if v < 1 << 63 else None for v in exact]


def whitened(vectors: DataFrame, k: int = K, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """RESULT: each vector's centred projection on each of the k leading components, over the root of its eigenvalue."""
    fit = fit_list(vectors, key, column)
    c = components(fit, k) if fit else None
    if c is None or not len(c.values):
        return vectors.sparkSession.createDataFrame([], RESULT)
    bare, matrix, m = Fit(None, fit.n, fit.sums), c.vectors / np.sqrt(c.values), len(c.values)
    explained, error = c.values / c.trace, identity_error(fit, c)

    def run(batches):
        for batch in _slices(batches):
            y = bare.centred(batch)
            w, rows = y.astype(np.float64) / bare.n @ matrix, batch.num_rows
            each = np.repeat(np.arange(rows), m)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), rows)), pa.array(np.full(rows * m, bare.n)),
                    pa.array(_deviation(y), pa.int64()).take(pa.array(each)), pa.array(w.ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * m, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return fit.rows.df.mapInArrow(run, RESULT)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` whitened on their eight leading components."""
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
