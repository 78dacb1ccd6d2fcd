"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import saved, small_batches
from .vectors import matrix

#: Columns that travel together, so that one pass over the rows serves as many Lanczos vectors. At least as many as components are
#: wanted, which also finds deviations that occur as often as that.
WIDTH = 8
#: Parts of the whole extent below which a left direction counts as empty, a right one as chance, and a residual as nought.
EMPTY, CHANCE, SETTLED = 1e-7, 1e-15, 1e-14
#: Where a vector's whole numbers stop growing, so that products with the number of rows stay exact.
FAR = 1 << 52


def whole_numbers(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """``vec_id, x``: ``floor(1024 * c) + 100000`` of each entry; vectors that are null or hold null or non-finite entries go."""
    bad = F.exists(column, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    fine = rows.where(F.col(column).isNotNull()).where(~bad)
    far = float(FAR)
    moved = F.transform(column, lambda c: F.floor(F.greatest(F.lit(-far), F.least(F.lit(far), c.cast("double") * 1024))).cast("long") + 100000)
    return fine.select(F.col("vec_id").cast("long").alias("vec_id"), moved.alias("x"))


@dataclass(frozen=True)
class Fit:
    """What whitening needs to know of the vectors of one length."""

    n: int
    sums: np.ndarray  # of the whole numbers, exact
    components: np.ndarray  # a column for each
    eigenvalues: np.ndarray
    trace: float

    def spread(self, x: np.ndarray) -> np.ndarray:
        """``n * x - sums``, in Python's own numbers where 64 bits are too few."""
        wide = self.n * (int(np.abs(x).max(initial=0)) + 1) + int(np.abs(self.sums.astype(float)).max(initial=0)) >= 1 << 62
        return x.astype(object) * self.n - self.sums if wide else x * self.n - self.sums.astype(np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.spread(x).astype(float) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.eigenvalues)

    def deviations(self, x: np.ndarray) -> list[int]:
        s = self.spread(x)
        most = int(np.abs(s).max(initial=0))
        s = s if most * most * max(1, s.shape[1]) < 1 << 63 else s.astype(object)
        return (s * s).sum(1).tolist()


def _total(rows: DataFrame, shapes: list[tuple[int, ...]], part, exact: bool = False) -> list[np.ndarray]:
    """Sums over all rows of the arrays that ``part`` makes of a matrix of some rows.

    Each task adds up its own batches; what is left has as many numbers as ``shapes`` say and is added up by place.
    """
    sizes = [int(np.prod(s)) for s in shapes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                new = np.concatenate([np.ravel(a) for a in part(matrix(batch.column("x")))])
                new = new.astype(object) if exact else new
                held = new if held is None else held + new
        if held is not None:
            values = pa.array([str(v) for v in held]) if exact else pa.array(held.astype(float))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(held), dtype=np.int32)), values], names=["at", "v"])

    parts = rows.select("x").mapInArrow(run, f"at int, v {'string' if exact else 'double'}")
    found = parts.groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)") if exact else F.col("v")).alias("v")).collect()
    out = np.zeros(sum(sizes), object if exact else float)
    for r in found:
        out[r["at"]] = int(r["v"]) if exact else r["v"]
    return [a.reshape(s) for a, s in zip(np.split(out, np.cumsum(sizes)[:-1]), shapes, strict=True)]


def _orthogonal(w: np.ndarray, to: np.ndarray) -> np.ndarray:
    """``w`` without its parts along the orthonormal columns ``to``; twice is enough."""
    for _ in range(2):
        w = w - to @ (to.T @ w)
    return w


def _next_block(w: np.ndarray, basis: np.ndarray, width: int, least: float, rng: np.random.Generator) -> np.ndarray:
    """Orthonormal columns for what ``w`` adds to ``basis``; where that is less than ``width``, random directions fill up."""
    width = min(width, len(basis) - basis.shape[1])
    q, s, _ = np.linalg.svd(_orthogonal(w, basis), full_matrices=False)
    out = q[:, s > least][:, :width]
    while out.shape[1] < width:
        both = np.concatenate([basis, out], 1)
        fresh = _orthogonal(rng.normal(size=(len(basis), width - out.shape[1])), both)
        out = np.concatenate([out, np.linalg.qr(fresh)[0]], 1)
    return np.linalg.qr(_orthogonal(out, basis))[0]


def bidiagonal(rows: DataFrame, fit: Fit, wanted: int, width: int = WIDTH, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The largest singular values of the centred rows X and their right vectors.

    Blocks of ``width`` columns go back and forth: X v makes the next left block, X' u the next right one, each orthogonalised against
    all before it, and the factors that this leaves are the blocks of an upper bidiagonal matrix B with X V = U B.  A left block is as
    long as the table, so it is never stored: every u is X c for a short column c, and a pass makes X c and its products anew from
    the rows.  Two passes serve a block; the left block is orthogonalised and scaled in both.  Directions in which X has nothing are
    left out of U, and where V can't go on by itself random directions join it, so that all of the space is met in the end; it stops
    before that when the wanted values have settled.
    """
    d, rng = len(fit.sums), np.random.default_rng(seed)
    scale = np.sqrt(max(fit.trace * fit.n, 0.0))
    v = np.zeros((d, 0))
    c = np.zeros((d, 0))  # U = X c
    ut_x = np.zeros((0, d))  # U' X
    links: list[tuple[slice, slice, np.ndarray]] = []
    block = _next_block(np.zeros((d, width)), v, width, 0.0, rng)
    before: tuple[slice, np.ndarray] | None = None  # columns of U and their part of B in front of this block
    while block.shape[1]:
        here = slice(v.shape[1], v.shape[1] + block.shape[1])
        v = np.concatenate([v, block], 1)
        k = block if before is None else block - c[:, before[0]] @ before[1]
        scaled = np.eye(block.shape[1])  # of the block in terms of its orthonormal columns
        z = np.zeros((d, 0))
        for least in ((EMPTY * scale) ** 2, 0.25):
            m, b = c.shape[1], k.shape[1]

            def part(x: np.ndarray, k: np.ndarray = k, c: np.ndarray = c) -> list[np.ndarray]:
                y = fit.centred(x)
                p = y @ k
                return [(y @ c).T @ p, p.T @ p, y.T @ p]

            h, gram, z = _total(rows, [(m, b), (b, b), (d, b)], part)
            # By linearity: the block without its parts along U, and X' times it.
            k, z, gram = k - c @ h, z - ut_x.T @ h, gram - h.T @ h
            s, q = np.linalg.eigh((gram + gram.T) / 2)
            some = s > least
            root, q = np.sqrt(s[some]), q[:, some]
            k, z = k @ (q / root), z @ (q / root)
            scaled = (root[:, None] * q.T) @ scaled
            if not k.shape[1]:
                break
        left = slice(c.shape[1], c.shape[1] + k.shape[1])
        c, ut_x = np.concatenate([c, k], 1), np.concatenate([ut_x, z.T])
        if before is not None:
            links.append((before[0], here, before[1]))
        links.append((left, here, scaled))
        small = np.zeros((c.shape[1], v.shape[1]))
        for at, of, a in links:
            small[at, of] = a
        # What X' u has beyond V goes into the next block.
        w = z - v[:, here] @ scaled.T if k.shape[1] else np.zeros((d, 1))
        block = _next_block(w, v, width, CHANCE * scale, rng) if v.shape[1] < d else np.zeros((d, 0))
        before = (left, (block.T @ z).T) if block.shape[1] else None
        if block.shape[1] and small.shape[0] >= 2 * wanted:
            p, s, _ = np.linalg.svd(small)
            if np.abs(before[1].T @ p[left, :wanted]).max(initial=0) <= SETTLED * s[0]:
                break
    _, s, qt = np.linalg.svd(small, full_matrices=False)
    return s[:wanted], v @ qt[:wanted].T


def fit(rows: DataFrame, length: int, n: int, wanted: int = 8) -> Fit:
    """Means, components and deviations of ``rows(x)``, which all have ``length`` numbers."""

    def sums(x: np.ndarray) -> list[np.ndarray]:
        return [x.astype(object).sum(0) if int(np.abs(x).max(initial=0)) * len(x) >= 1 << 62 else x.sum(0)]

    (total,) = _total(rows, [(length,)], sums, exact=True)
    start = Fit(n, total, np.zeros((length, 0)), np.zeros(0), 0.0)
    (trace,) = _total(rows, [(1,)], lambda x: [np.array([(start.centred(x) ** 2).sum()])])
    start = Fit(n, total, start.components, start.eigenvalues, float(trace[0]) / n)
    if not start.trace > 0:
        return start
    s, components = bidiagonal(rows, start, min(wanted, length))
    real = s > EMPTY * s[0]
    return Fit(n, total, components[:, real], s[real] ** 2 / n, start.trace)


def whiten(rows: DataFrame, components: int = 8, column: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every usable vector, a row for each component.

    Vectors that are null or hold null or non-finite entries are left out of the fit and of the result; zero and repeated vectors
    take part like others.  Vectors of different lengths have no covariance in common: those of each length are fitted on their own
    and ``n`` counts these.  There are as many components as the vectors have directions of some extent, so one vector, equal vectors
    and empty ones give no rows, as does an empty table.  ``deviation`` is decimal, as it outgrows 64 bits, and null beyond 38 digits.  Entries beyond 2**42
    count as that.  Equal eigenvalues may share any basis of their space.  Other columns are ignored.
    """
    small_batches(rows.sparkSession)
    usable = saved(whole_numbers(rows, column), "vectors")
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    out = None
    for r in usable.groupBy(F.size("x").alias("length")).count().orderBy("length").collect():
        if r["length"]:
            some = _whitened(usable.where(F.size("x") == r["length"]), fit(usable.where(F.size("x") == r["length"]), r["length"], r["count"], components), schema)
            out = some if out is None else out.unionAll(some)
    return rows.sparkSession.createDataFrame([], schema) if out is None else out


def _whitened(rows: DataFrame, found: Fit, schema: str) -> DataFrame:
    k = found.components.shape[1]
    error = 0.0
    if k:
        total, gram = _total(rows, [(k,), (k, k)], lambda x: [(w := found.whitened(x)).sum(0), w.T @ w])
        error = float(np.abs(gram / found.n - np.outer(total, total) / found.n**2 - np.eye(k)).max())
    explained = found.eigenvalues / found.trace if k else np.zeros(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and k:
                x = matrix(batch.column("x"))
                many = len(x) * k
                columns = [
                    pa.array(np.repeat(np.asarray(batch.column("vec_id").fill_null(0)), k), mask=np.repeat(np.asarray(batch.column("vec_id").is_null()), k)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(many, found.n)),
                    pa.array([str(v) if v < 10**38 else None for v in found.deviations(x)], pa.string()).cast(pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(len(x)), k))),
                    pa.array(found.whitened(x).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(many, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
