"""Embedding whitening by upper-triangle column aggregates.

The covariance of the distinct vectors comes from one aggregation whose SQL
expressions, one for each pair of dimensions i <= j, sum the products of the
centred columns. The driver sees dims * (dims + 1) / 2 sums, mirrors them and
decomposes the matrix with LAPACK; the projection is a narrow map.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alphaloom.llm._spark import checkpoint

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Whitening:
    """Means, unit eigenvectors (columns) and eigenvalues of the fit list, the share each explains, and what whitening leaves."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float
    fits_long: bool

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n*x - S)^2, exact; null where it exceeds a long."""
        if self.fits_long:
            return ((x * self.n - np.array(self.sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
        wide = ((x.astype(object) * self.n - np.array(self.sums, dtype=object)) ** 2).sum(axis=1)
        return [int(v) if v < 2**63 else None for v in wide]


def grid_vectors(embeddings: DataFrame) -> DataFrame:
    """``vec_id, x``: usable vectors on an integer grid, floor(64 c) + 1000000 for each entry.

    Left out are rows whose vector is null, empty, or holds a null or non-finite
    entry, and those not of the most frequent length (ties: the longer one),
    which share no axes with the rest.
    """
    usable = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("c")).where(
        F.col("c").isNotNull() & (F.size("c") > 0) & F.forall("c", lambda v: v.isNotNull() & (F.abs(v) < float("inf")))
    )
    lengths = usable.groupBy(F.size("c").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    grid = F.transform("c", lambda v: F.floor(v * SCALE).cast("long") + OFFSET)
    return usable.where(F.size("c") == (lengths.dims if lengths else 0)).select("vec_id", grid.alias("x"))


def upper_triangle(columns: list[str]) -> list[Column]:
    """SQL sums of products of every pair of columns, the first index not above the second."""
    return [F.expr(f"sum({a} * {b}) as `{i}_{j}`") for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j]


def covariance(centred: DataFrame, n: int) -> np.ndarray:
    """Covariance (divisor ``n``) of columns that are centred already, in one aggregation; partial sums meet in one row a task."""
    dims = len(centred.columns)
    sums = centred.agg(*upper_triangle([f"`{c}`" for c in centred.columns])).first()
    found = np.zeros((dims, dims))
    found[np.triu_indices(dims)] = [v / n for v in sums]
    return np.triu(found) + np.triu(found, 1).T


def _projected(fitted: DataFrame, whitening: Whitening) -> DataFrame:
    """The whitened columns of the fit list."""
    names = [f"w{k}" for k in range(len(whitening.values))]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in whitening.project(_matrix(batch, len(whitening.sums))).T], names)

    return fitted.mapInArrow(project, ", ".join(f"{c} double" for c in names))


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def fit_whitening(grid: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Whitening of the distinct vectors of ``grid``; none for an empty table.

    Copies are combined before the shuffle. Components whose eigenvalue does not
    stand out from rounding (rank below ``components``) are left out. The
    identity error is measured: the covariance of the whitened fit list by the
    same aggregation, less the identity.
    """
    fitted = checkpoint(grid.select("x").distinct())
    first = fitted.first()
    if first is None:
        return None
    dims = len(first.x)
    at = [F.element_at("x", i + 1) for i in range(dims)]
    totals = fitted.agg(F.count("*"), *(f(x if f is not F.sum else x.cast("decimal(38,0)")) for x in at for f in (F.sum, F.min, F.max))).first()
    n, sums, low, high = int(totals[0]), [int(v) for v in totals[1::3]], totals[2::3], totals[3::3]
    worst = sum(max(n * b - s, s - n * a) ** 2 for s, a, b in zip(sums, low, high, strict=True))
    fits_long = worst < 2**63 and max(n * max(abs(a), abs(b)) for a, b in zip(low, high, strict=True)) < 2**63
    centred = fitted.select(*((x.cast("double") - F.lit(s / n)).alias(f"c{i}") for i, (x, s) in enumerate(zip(at, sums, strict=True))))
    v = covariance(centred, n)
    values, vectors = np.linalg.eigh(v)
    values, vectors, trace = values[::-1][:components], vectors[:, ::-1][:, :components], float(np.trace(v))
    kept = values > trace * dims * np.finfo(float).eps
    found = Whitening(n, tuple(sums), np.ascontiguousarray(vectors[:, kept]), values[kept], values[kept] / (trace or 1.0), 0.0, fits_long)
    if not kept.any():
        return found
    left = covariance(_projected(fitted, found), n) - np.eye(int(kept.sum()))
    return Whitening(n, found.sums, found.vectors, found.values, found.explained, float(np.abs(left).max()), fits_long)


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row for each usable vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    Repeated rows and copies under other ids are each returned, but count once
    in the fit, as does a vector that a third of the rows hold; null ids stay
    null; other columns are ignored. An empty table, or one with fewer than two
    distinct vectors, gives an empty result; equal eigenvalues leave the
    directions between them to LAPACK, the same for all rows.
    """
    grid = grid_vectors(embeddings)
    whitening = fit_whitening(grid, components)
    if whitening is None or not len(whitening.values):
        return embeddings.sparkSession.createDataFrame([], SCHEMA)
    count = len(whitening.values)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                m = batch.num_rows
                x = _matrix(batch, len(whitening.sums))
                ids = np.repeat(np.arange(m), count)
                columns = [
                    batch.column("vec_id").take(pa.array(ids)),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * count, whitening.n, dtype=np.int64)),
                    pa.array(whitening.deviations(x), pa.int64()).take(pa.array(ids)),
                    pa.array(whitening.project(x).ravel()),
                    pa.array(np.tile(whitening.explained, m)),
                    pa.array(np.full(m * count, whitening.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return grid.mapInArrow(rows, SCHEMA)
