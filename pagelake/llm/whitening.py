"""Operator 11: whitening of embeddings.

Entries become integers, ``floor(64 * c) + 1000000`` (``SCALE``, ``OFFSET``). The *fit list* holds every distinct integer vector
once: a third of all rows may be copies of one vector and still weigh one. Over it come, in two passes of per-task partial
sums, the exact count and sums, then the covariance of the centred entries (divisor n). The covariance has one row and column
for each dimension, however many vectors there are, and its leading eigenpairs are found on the driver: Householder
reflections make it tridiagonal, bisection on Sturm counts brackets the eigenvalues, inverse iteration gives the vectors,
reorthogonalised within clusters of near eigenvalues, and the reflections carry them back. The components are broadcast
(components x dimensions numbers) and every row is projected where it lies.

Shuffles: the integer vectors once, for the distinct list (kept as Parquet in the shared folder); else only partial sums.

Defined results: a null vector, or one with a null, NaN or infinite entry, is left out. Vectors of another length than most
distinct ones have (of equally many: the longer) are left out too, as no covariance spans two lengths. Entries beyond
+-2**50 count as +-2**50. Repeated rows each get their results; null ids stay null. Components without variance (an eigenvalue
within rounding of 0) are not numbered, so one distinct vector, or an empty table, gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, pa_schema

SCALE, OFFSET = 64, 1_000_000
#: Entries beyond this count as this (their integers would leave 64 bits).
LIMIT = float(1 << 50)
#: Cells of a vector block that numpy holds at one time.
CELLS = 1 << 21


@dataclass(frozen=True)
class Whitening:
    """``n`` distinct vectors with exact ``sums``; ``components`` (rows: unit eigenvectors of the covariance) by falling
    ``values``; ``trace`` of the covariance; ``identity_error`` of the whitened fit list."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact: 64-bit integers where they suffice, else Python's."""
        means = np.array([s // self.n for s in self.sums], np.int64)
        rest = [s % self.n for s in self.sums]
        y = x - means
        if len(y) and int(np.abs(y).max()) * self.n >= 1 << 52:
            return y.astype(object) * self.n - np.array(rest, object)
        return y * self.n - np.array(rest, np.int64)

    def whiten(self, centred: np.ndarray) -> np.ndarray:
        return (centred.astype(np.float64) / self.n) @ (self.components / np.sqrt(self.values)[:, None]).T


#: The whitening of nothing: no component.
NONE = Whitening(0, (), np.zeros(0), np.zeros((0, 0)), 1.0)


# -- from rows to integer vectors --------------------------------------------------------------------------------

def integers(vector: Column) -> Column:
    return F.transform(vector, lambda c: (F.floor(F.least(F.greatest(c.cast("double"), F.lit(-LIMIT)), F.lit(LIMIT)) * SCALE) + OFFSET).cast("long"))


def usable(vector: Column) -> Column:
    return F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")))


def blocks(batches, column: int, dims: int):
    """(batch slice, matrix) for runs of rows of an Arrow list column; rows all have ``dims`` entries."""
    step = max(1, CELLS // max(1, dims))
    for batch in batches:
        for lo in range(0, batch.num_rows, step):
            part = batch.slice(lo, step)
            yield part, part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dims)


# -- fitting -----------------------------------------------------------------------------------------------------

def fit(df: DataFrame, vector: str = "embedding", components: int = 16) -> Whitening | None:
    """The whitening of the vectors of ``df``; None where there is no usable vector or none has variance."""
    xs = materialize(df.where(usable(F.col(vector))).select(integers(F.col(vector)).alias("x")).distinct(), "whitening-fit")
    lengths = xs.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None or lengths.d == 0:
        return None
    dims, n = lengths.d, lengths.n
    xs = xs.where(F.size("x") == dims)
    sums = column_sums(xs, dims)
    start = Whitening(n, sums, np.ones(1), np.zeros((1, dims)), 1.0)
    cov = covariance(xs, dims, lambda x: start.centred(x).astype(np.float64) / n)
    values, vectors = leading_eigenpairs(cov, min(components, dims))
    trace = float(np.trace(cov))
    keep = values > dims * np.finfo(float).eps * trace
    if not trace > 0 or not keep.any():
        return None
    found = Whitening(n, sums, values[keep], vectors[keep], trace)
    white = covariance(xs, dims, lambda x: found.whiten(found.centred(x)))
    return Whitening(n, sums, found.values, found.components, trace, float(np.abs(white - np.eye(len(white))).max()))


def column_sums(xs: DataFrame, dims: int) -> tuple[int, ...]:
    """Exact sums of each dimension: the high and low halves of the integers are summed apart."""
    def partial(batches):
        high, low = np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for _, x in blocks(batches, 0, dims):
            high += (x >> 31).sum(0)
            low += (x & 0x7FFFFFFF).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array(high), pa.array(low)], names=["d", "high", "low"])

    wide = "decimal(38,0)"
    rows = (xs.mapInArrow(partial, "d int, high long, low long").groupBy("d")
            .agg(F.sum(F.col("high").cast("decimal(20,0)")).cast(wide).alias("high"), F.sum(F.col("low").cast("decimal(20,0)")).cast(wide).alias("low")).collect())
    found = {r.d: (int(r.high) << 31) + int(r.low) for r in rows}
    return tuple(found[d] for d in range(dims))


def covariance(xs: DataFrame, dims: int, values) -> np.ndarray:
    """Covariance (divisor: rows) of values(matrix of integers). A task keeps count, mean and centred products of its rows
    and joins those of each block to them; the tasks' triples are joined in the same way, by a tree of groups."""
    def partial(batches):
        have = None
        for _, x in blocks(batches, 0, dims):
            v = values(x)
            mean = v.mean(0)
            have = joined(have, (len(v), mean, (v - mean).T @ (v - mean)))
        if have is not None:
            yield packed(have)

    def packed(triple):
        n, mean, prod = triple
        return pa.RecordBatch.from_arrays([pa.array([zlib.crc32(mean.tobytes()) % 4096], pa.int32()), pa.array([n], pa.int64()), pa.array([mean.tobytes()], pa.binary()),
                                           pa.array([prod.tobytes()], pa.binary())], schema=out)

    def gathered(table):
        have = None
        for n, mean, prod in zip(*(table.column(c).to_pylist() for c in ("n", "mean", "prod")), strict=True):
            mean = np.frombuffer(mean)
            have = joined(have, (n, mean, np.frombuffer(prod).reshape(len(mean), len(mean))))
        return pa.Table.from_batches([packed(have)])

    ddl = "g int, n long, mean binary, prod binary"
    out = pa_schema(xs.sparkSession, ddl)
    parts = xs.mapInArrow(partial, ddl)
    for groups in (256, 16, 1):
        parts = parts.withColumn("g", F.col("g") % groups).groupBy("g").applyInArrow(gathered, ddl)
    row = parts.first()
    mean = np.frombuffer(row["mean"])
    return np.frombuffer(row["prod"]).reshape(len(mean), len(mean)) / row["n"]


def joined(a, b):
    """Count, mean and centred products of two sets of rows together."""
    if a is None:
        return b
    n = a[0] + b[0]
    step = b[1] - a[1]
    return n, a[1] + step * (b[0] / n), a[2] + b[2] + np.outer(step, step) * (a[0] * b[0] / n)


# -- eigenpairs of a symmetric matrix ------------------------------------------------------------------------------

def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, reflectors): Q.T @ a @ Q is tridiagonal, Q the product of I - 2 v v.T over the reflectors."""
    a, n = a.copy(), len(a)
    reflectors = []
    for k in range(n - 2):
        v = np.zeros(n)
        x = a[k + 1 :, k]
        scale = np.abs(x[1:]).max()
        if scale > 0:
            length = np.linalg.norm(x)
            v[k + 1 :] = x
            v[k + 1] += length if x[0] >= 0 else -length
            v /= np.linalg.norm(v)
            p = a @ v
            w = 2.0 * (p - (v @ p) * v)
            a -= np.outer(v, w) + np.outer(w, v)
        reflectors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def sturm_counts(d: np.ndarray, e: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal lie below each point: negative pivots of its LDL factorisation."""
    tiny = np.finfo(float).tiny * max(1.0, float((e * e).max(initial=0.0)))
    below = np.zeros(len(at), np.int64)
    for i in range(len(d)):
        q = d[i] - at - (e[i - 1] * e[i - 1] / q if i else 0.0)
        q = np.where(np.abs(q) < tiny, -tiny, q)
        below += q < 0
    return below


def largest_values(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, each bisected until its bracket can't shrink."""
    radius = np.abs(np.concatenate((e, [0.0]))) + np.abs(np.concatenate(([0.0], e)))
    lo = np.full(k, (d - radius).min() - 1.0)
    hi = np.full(k, (d + radius).max() + 1.0)
    rank = len(d) - 1 - np.arange(k)  # this many eigenvalues lie below the wanted one
    for _ in range(200):
        mid = lo + (hi - lo) / 2
        if not ((mid > lo) & (mid < hi)).any():
            break
        above = sturm_counts(d, e, mid) <= rank
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    return lo + (hi - lo) / 2


def solve_shifted(d: np.ndarray, e: np.ndarray, shift: float, b: np.ndarray, least: float) -> np.ndarray:
    """x with (T - shift) x = b by elimination with row exchanges; pivots smaller than ``least`` count as that."""
    n = len(d)
    u0, u1, u2 = (d - shift).copy(), np.append(e, 0.0), np.zeros(n)
    b = b.copy()
    for i in range(n - 1):
        below, diag, over = e[i], u0[i + 1], u1[i + 1]
        if abs(u0[i]) >= abs(below):
            pivot = u0[i] if abs(u0[i]) >= least else least
            u0[i] = pivot
            f = below / pivot
            u0[i + 1], u1[i + 1] = diag - f * u1[i], over - f * u2[i]
            b[i + 1] -= f * b[i]
        else:
            f = u0[i] / below
            u0[i + 1], u1[i + 1] = u1[i] - f * diag, -f * over
            u0[i], u1[i], u2[i] = below, diag, over
            b[i], b[i + 1] = b[i + 1], b[i] - f * b[i + 1]
    if abs(u0[-1]) < least:
        u0[-1] = least
    x = np.zeros(n + 2)
    for i in range(n - 1, -1, -1):
        x[i] = (b[i] - u1[i] * x[i + 1] - u2[i] * x[i + 2]) / u0[i]
    return x[:n]


def leading_eigenpairs(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues (falling) and unit eigenvectors (rows) of a symmetric matrix."""
    size = float(np.abs(a).max(initial=0.0))
    if size == 0:
        return np.zeros(k), np.eye(len(a))[:k]
    d, e, reflectors = tridiagonal(a / size)
    norm = float((np.abs(d) + np.abs(np.append(e, 0)) + np.abs(np.append(0, e))).max())
    values = largest_values(d, e, k)
    eps = np.finfo(float).eps
    rng = np.random.default_rng(11)
    found, first, shift = [], 0, np.inf
    for i, value in enumerate(values):
        if i and values[i - 1] - value > 1e-3 * norm:  # a new cluster
            first = i
        shift = min(float(value), shift - 10 * eps * norm)  # equal values: shifts apart, so that solutions differ
        x = rng.standard_normal(len(d))
        for _ in range(6):
            x = solve_shifted(d, e, shift, x / np.linalg.norm(x), eps * norm)
            for _ in range(2):
                for y in found[first:]:
                    x -= (x @ y) * y
        found.append(x / np.linalg.norm(x))
    out = np.array(found)
    for v in reversed(reflectors):
        out -= 2.0 * np.outer(out @ v, v)
    return values * size, out


# -- every row -----------------------------------------------------------------------------------------------------

def project(df: DataFrame, model: Whitening | None, vector: str = "embedding", keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """For each usable row of the model's length: the ``keep`` columns, ``whitened`` (one double for each component),
    ``deviation`` (squared distance from the mean times n squared, exact; null where 64 bits don't hold it) and
    ``deviation_exact`` (the same as decimal(38,0))."""
    rows = df.select(*keep, F.when(usable(F.col(vector)), integers(F.col(vector))).alias("_x"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    ddl = f"{types}, deviation decimal(38,0), whitened array<double>"
    if model is None:
        return with_long(rows.limit(0).select(*keep, F.lit(None).cast("decimal(38,0)").alias("deviation"), F.lit(None).cast("array<double>").alias("whitened")))
    dims, out = len(model.sums), pa_schema(df.sparkSession, ddl)
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        from decimal import Decimal
        m = held.value
        for part, x in blocks(batches, len(keep), dims):
            y = m.centred(x)
            deviation = pa.array([Decimal(s) if s < 10**38 else None for s in square_sums(y)], pa.decimal128(38, 0))
            w = m.whiten(y)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
            columns = [c.cast(f.type) for c, f in zip(part.columns[:-1], out, strict=False)]
            yield pa.RecordBatch.from_arrays([*columns, deviation, lists.cast(out.field("whitened").type)], schema=out)

    return with_long(rows.where(F.size("_x") == dims).mapInArrow(run, ddl))


def with_long(rows: DataFrame) -> DataFrame:
    return rows.withColumnRenamed("deviation", "deviation_exact").withColumn("deviation", F.col("deviation_exact").try_cast("long"))


def square_sums(y: np.ndarray) -> list[int]:
    """Exact sums of squares of each row, as Python integers."""
    if y.dtype == object:
        return [sum(int(v) ** 2 for v in row) for row in y]
    y = np.abs(y)
    high, low = y >> 26, y & ((1 << 26) - 1)
    parts = ((high * high).sum(1), (high * low).sum(1), (low * low).sum(1))
    return [(a << 52) + (b << 27) + c for a, b, c in zip(*(p.tolist() for p in parts), strict=True)]
