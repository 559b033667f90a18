"""Linear algebra: tall data are folded, batch by batch, into p * p matrices
(their Gram matrix, or their R), where p is a few hundred at most; the rest is
numpy on the driver.  What is tall stays a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.missing import as_nan

SMALL = 1e-12


def _rows(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*[as_nan(c).alias(f"c{i}") for i, c in enumerate(names)])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)


def _folded(rows: DataFrame, start: np.ndarray, step: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(v): step() over the batches of each task, one flat matrix a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = start
        for batch in batches:
            if batch.num_rows:
                held = step(held, _matrix(batch))
        yield pa.RecordBatch.from_arrays([pa.array([held.ravel().tolist()], pa.list_(pa.float64()))], ["v"])

    return rows.mapInArrow(run, "v array<double>")


def gram(df: DataFrame, cols: Sequence[str], others: Sequence[str] = ()) -> np.ndarray:
    """The sums of products of cols with cols and others, row by row of cols: one
    matrix product a batch, one partial sum a task, summed by cell."""
    names = [*cols, *others]
    if not names:
        return np.zeros((0, 0))
    m = len(names)
    parts = _folded(_rows(df, names), np.zeros((m, m)), lambda held, x: held + x.T @ x)
    sums = parts.select(F.posexplode("v").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(m * m)
    for r in sums:
        out[r["at"]] = r["v"]
    out = out.reshape(m, m)
    return (out + out.T) / 2


def tall_r(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """R of the rows of df, diagonal not negative: each task folds its batches
    into an R of its own, and those are folded again until one is left."""
    p = len(cols)
    triangle = lambda held, x: np.linalg.qr(np.concatenate((held, x)), mode="r")[:p]
    parts = _folded(_rows(df, cols), np.zeros((0, p)), triangle)
    groups = max(1, int(df.sparkSession.sparkContext.defaultParallelism ** 0.5))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, p))
        for batch in batches:
            for v in batch.column(0).to_pylist():
                held = triangle(held, np.array(v).reshape(-1, p))
        yield pa.RecordBatch.from_arrays([pa.array([held.ravel().tolist()], pa.list_(pa.float64()))], ["v"])

    r = np.zeros((0, p))
    for row in sorted(tuple(row["v"]) for row in parts.repartition(groups).mapInArrow(again, "v array<double>").collect()):
        r = triangle(r, np.array(row).reshape(-1, p))
    r = np.concatenate((r, np.zeros((p - len(r), p))))
    return np.where(np.diag(r) < 0, -1.0, 1.0)[:, None] * r


def times(cols: Sequence[str], by: np.ndarray) -> list[Column]:
    """The columns of the product of the row of cols with a small matrix."""
    out = []
    for j in range(by.shape[1]):
        terms = [as_nan(c) * F.lit(float(by[i, j])) for i, c in enumerate(cols) if by[i, j] != 0]
        total = F.lit(0.0)
        for t in terms:
            total = total + t
        out.append(total)
    return out


def qr_tall(df: DataFrame, cols: Sequence[str], prefix: str = "q") -> tuple[DataFrame, np.ndarray]:
    """(df with the columns of Q, R): X = QR for the rows of df as they are, Q
    orthonormal, R's diagonal not negative.  Columns that depend on earlier ones
    have no Q of their own: zeros."""
    r = tall_r(df, cols)
    solid = np.abs(np.diag(r)) > SMALL * max(1.0, np.abs(r).max(initial=0))
    inverse = np.zeros_like(r)
    inverse[np.ix_(solid, solid)] = np.linalg.inv(r[np.ix_(solid, solid)])
    return df.withColumns(dict(zip([f"{prefix}{i}" for i in range(len(cols))], times(cols, inverse), strict=True))), r


def svd_tall(df: DataFrame, cols: Sequence[str], prefix: str = "u") -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(df with the columns of U, descending s, V), by way of R; U is zero where s
    is.  The largest element of each column of V is positive."""
    _, s, vt = np.linalg.svd(tall_r(df, cols))
    at = np.argmax(np.abs(vt), axis=1)
    v = (vt * np.sign(vt[np.arange(len(vt)), at])[:, None]).T
    scale = np.where(s > SMALL * max(1.0, s.max(initial=0)), 1 / np.maximum(s, 1e-300), 0.0)
    return df.withColumns(dict(zip([f"{prefix}{i}" for i in range(len(cols))], times(cols, v * scale), strict=True))), s, v


def least_squares(df: DataFrame, cols: Sequence[str], target: str, tol: float = SMALL) -> np.ndarray:
    """The coefficients of target on cols over the rows of df, of least norm where
    the columns depend on each other."""
    g = gram(df, [*cols, target])
    return solve_spd(g[:-1, :-1], g[:-1, -1], tol)


def mgs(q: np.ndarray) -> np.ndarray:
    """Columns made orthonormal one after another; those that vanish stay."""
    q = np.array(q, float)
    for j in range(q.shape[1]):
        for i in range(j):
            q[:, j] -= (q[:, i] @ q[:, j]) * q[:, i]
        n = np.linalg.norm(q[:, j])
        if n > 1e-14:
            q[:, j] /= n
    return q


def modified_qr(x: np.ndarray) -> tuple[bool, np.ndarray, np.ndarray]:
    """(whether x has full column rank, Q, R) by modified Gram-Schmidt."""
    x = np.array(x, float)
    q, r = np.zeros_like(x), np.zeros((x.shape[1], x.shape[1]))
    for j in range(x.shape[1]):
        v = x[:, j].copy()
        for i in range(j):
            r[i, j] = q[:, i] @ v
            v -= r[i, j] * q[:, i]
        r[j, j] = np.linalg.norm(v)
        if r[j, j] <= SMALL:
            return False, q, r
        q[:, j] = v / r[j, j]
    return True, q, r


def eig_sym(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending eigenvalues and their vectors (signs are arbitrary)."""
    return np.linalg.eigh(np.asarray(s, float))


def qr_full(a: np.ndarray) -> np.ndarray:
    """The square Q."""
    return np.linalg.qr(np.asarray(a, float), mode="complete")[0]


def svd(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(U, descending s, V) of a small matrix; V is square."""
    u, s, vt = np.linalg.svd(np.asarray(a, float), full_matrices=True)
    return u, s, vt.T


def svd_right(df: DataFrame, cols: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(descending s, V) of the rows of df, from their Gram matrix."""
    values, vectors = eig_sym(gram(df, cols))
    return np.sqrt(np.maximum(values[::-1], 0)), vectors[:, ::-1]


def solve_spd(a: np.ndarray, b: np.ndarray, tol: float = SMALL) -> np.ndarray:
    """The solution, or that of least norm where a is singular."""
    return inv_sym(a, tol) @ np.asarray(b, float)


def inv_sym(a: np.ndarray, tol: float = SMALL) -> np.ndarray:
    """The inverse of a symmetric matrix, or its pseudo-inverse."""
    values, vectors = eig_sym(a)
    keep = np.abs(values) > tol * max(np.abs(values).max(initial=0), 1e-300)
    return (vectors[:, keep] / values[keep]) @ vectors[:, keep].T
