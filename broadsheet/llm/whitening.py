"""Whitening of embeddings by shifted CholeskyQR.

The vectors are scaled to integers, so their sums, and so the centred entries, are exact up to one rounding.
Each Gram pass multiplies the centred rows with the inverse of the R found so far (triangular solves, block by
block) and adds up the products of the outcome; its Cholesky factor, after a small shift of the diagonal
that keeps it positive, is composed into R. When the rows come out orthonormal, R's singular vectors are the components.
To the driver come sums of dimension squared cells, at any number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What makes an entry an integer; components at most; Gram passes at most; how near to orthonormal is enough.
SCALE, OFFSET, COMPONENTS, PASSES, ENOUGH = 64, 1_000_000, 32, 8, 1e-12
#: Integers end here on both sides, so that differences fit a long.
FAR = 2.0**61


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers; an empty vector has no entries, so it isn't."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def scaled(vector: Column) -> Column:
    """array<long>: floor(64 c) + 1,000,000 of each entry; what is beyond 2^61 becomes that."""
    return F.transform(vector, lambda c: F.floor(F.least(F.greatest(c.cast("double") * SCALE, F.lit(-FAR)), F.lit(FAR))) + F.lit(OFFSET).cast("long"))


def matrix(x: pa.Array) -> np.ndarray:
    """A list<long> column as rows of integers."""
    flat = pc.list_flatten(x).to_numpy(zero_copy_only=False)
    return flat.reshape(len(x), -1).astype(np.int64, copy=False) if len(x) else np.empty((0, 0), np.int64)


@dataclass(frozen=True)
class Centre:
    """n and the sums S of n rows. n x - S is taken about the mean's whole part, so it stays small and exact."""

    n: int
    sums: tuple[int, ...]

    def off(self, x: np.ndarray) -> np.ndarray:
        """n x - S, as integers; Python's own where 64 bits might not hold them."""
        whole = [s // self.n for s in self.sums]
        rest = [s - self.n * w for s, w in zip(self.sums, whole, strict=True)]
        near = x - np.array(whole, np.int64)
        if len(x) and float(np.abs(near.astype(float)).max()) * self.n >= 2.0**62:
            return near.astype(object) * self.n - np.array(rest, object)
        return near * np.int64(self.n) - np.array(rest, np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.off(x) / self.n).astype(np.float64)

    def deviation(self, x: np.ndarray) -> list[int]:
        """The sum of (n x - S)^2 over the dimensions of each row, exact."""
        off = self.off(x)
        if off.dtype == object or (len(off) and float(np.abs(off).max()) ** 2 * off.shape[1] >= 2.0**62):
            off = off.astype(object)
        return [int(v) for v in (off * off).sum(axis=1)]


def cells(rows: DataFrame, values: Callable[[np.ndarray], np.ndarray], dims: int) -> np.ndarray:
    """The sum over all rows of the outer product of ``values`` with itself, with one row more: the sum of the
    values. Each task adds up its own rows, so what is shuffled is a number for each cell and task."""
    at = np.arange((dims + 1) * dims, dtype=np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims + 1, dims))
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                v = values(matrix(batch.column(0)[start : start + 4096]))
                total[:dims] += v.T @ v
                total[dims] += v.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel())], ["cell", "v"])

    found = rows.select("x").mapInArrow(run, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((dims + 1) * dims)
    for r in found:
        out[r.cell] = r.v
    return out.reshape(dims + 1, dims)


def solved(v: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """Rows times the inverse of each upper factor in turn, by triangular solves."""
    for r in factors:
        q = np.empty_like(v)
        for j in range(v.shape[1]):
            q[:, j] = (v[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
        v = q
    return v


def cholesky(gram: np.ndarray, relative: float) -> np.ndarray:
    """The upper factor of a Gram matrix with its diagonal shifted; the shift grows until there is one."""
    shift = relative * max(np.trace(gram), np.finfo(float).tiny)
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(len(gram))).T
        except np.linalg.LinAlgError:
            shift *= 10


def rank(r: np.ndarray) -> int:
    """How many directions of R have variance beyond rounding."""
    s = np.linalg.svd(r, compute_uv=False)
    return int((s > s[0] * len(s) * np.finfo(float).eps * 4).sum()) if s[0] > 1e-150 else 0


def r_factor(rows: DataFrame, centre: Centre, basis: np.ndarray) -> np.ndarray:
    """R of the centred rows, seen in ``basis``, with as many columns as there are dimensions. A pass is shifted
    by the rounding that its products may hold, until the rows are nearly orthonormal. A direction without
    variance gets smaller with each shifted pass; when the rest is clear, the passes start anew in the others."""
    dims, factors = basis.shape[1], []
    relative = 11 * (dims + 4096 + 1) * dims * np.finfo(float).eps
    composed = np.eye(dims)
    for k in range(PASSES):
        gram = cells(rows, lambda x, f=tuple(factors): solved(centre.centred(x) @ basis, list(f)), dims)[:dims]
        gram = (gram + gram.T) / 2
        off = np.abs(gram - np.eye(dims)).max()
        factors.append(cholesky(gram, 0.0 if off < 0.5 else relative))
        composed = factors[-1] @ composed
        if k and off < ENOUGH:
            break
        if k >= 3 and (held := rank(composed)) < dims:
            return r_factor(rows, centre, basis @ np.linalg.svd(composed)[2][:held].T) if held else np.zeros((1, len(basis)))
    return composed @ basis.T


def components(r: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(unit components by row, their eigenvalues falling, the trace of the covariance), of the directions that have any variance."""
    _, s, v = np.linalg.svd(r, full_matrices=False)
    k = min(most, rank(r))
    return v[:k], (s**2 / n)[:k], float((s**2 / n).sum())


OUT = "vec_id long, n long, deviation decimal(38,0), whitened array<double>"


def whiten(embeddings: DataFrame, vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each usable row and component up to ``most``.

    A row is left out if its vector is null or empty, or an entry is null or not finite; so are rows that
    don't have the commonest number of entries (the least of equally common ones). Equal vectors and ids are
    rows of their own, null ids stay null; other columns are ignored. Directions without variance
    have no component, so equal vectors, and an empty table, give no rows.
    A deviation of over 38 digits is null.
    """
    spark = embeddings.sparkSession
    rows = embeddings.where(usable(F.col(vector))).select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col(vector)).alias("x"))
    empty = spark.createDataFrame([], "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    sizes = sorted(rows.groupBy(F.size("x").alias("d")).count().collect(), key=lambda r: (-r["count"], r.d))
    if not sizes:
        return empty
    dims, n = sizes[0].d, sizes[0]["count"]
    rows = rows.where(F.size("x") == dims)
    # Sums of whole numbers, in decimals: exact at any number of rows.
    sums = rows.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("s")).collect()
    centre = Centre(n, tuple(int(r.s) for r in sorted(sums, key=lambda r: r.i)))
    unit, eigen, trace = components(r_factor(rows, centre, np.eye(dims)), n, most)
    if not len(eigen):
        return empty
    project = unit.T / np.sqrt(eigen)
    held = cells(rows, lambda x: centre.centred(x) @ project, len(eigen))
    mean = held[-1] / n
    error = float(np.abs(held[:-1] / n - np.outer(mean, mean) - np.eye(len(eigen))).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1))
            if len(x):
                w = centre.centred(x) @ project
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
                exact = pa.array([Decimal(v) if v < 10**38 else None for v in centre.deviation(x)], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(x), n)), exact, lists], [c.split()[0] for c in OUT.split(", ")])

    share = F.lit([float(e / trace) for e in eigen])
    out = rows.mapInArrow(run, OUT).select("vec_id", F.posexplode("whitened").alias("i", "whitened"), "n", "deviation")
    return out.select("vec_id", (F.col("i") + 1).alias("component"), "n", "deviation", "whitened", F.get(share, F.col("i")).alias("explained"), F.lit(error).alias("identity_error"))
