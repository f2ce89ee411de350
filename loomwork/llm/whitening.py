"""Whitening of embeddings by matrix-free block Lanczos.

Entries become whole numbers, floor(scale c), so that sums, deviations and the
centre are exact.  The covariance is never formed: each Lanczos step is one
distributed pass that adds Xᵀ(X Q) of centred rows, a block of columns at a
time.  New directions are made orthogonal to all earlier ones, twice; columns
that break down are started anew from random directions, so that repeated and
missing eigenvalues do no harm.  The true residuals of the wanted components
stop the iteration; at the latest it ends with a basis of the whole space.

Rows whose vector is null, empty, or holds a null or a number that is not
finite, and vectors that are not of the most frequent length, give nothing.
Repeated vectors count once in the fit, and each of their rows is whitened.
Entries beyond 2^60 / scale count as that bound.  Components of an eigenvalue
that is 0 (under 1e-12 of the largest) are left out: fewer than ``components``
where the rank is less, none for a single distinct vector or an empty table.
A deviation that no long holds is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm._shared import documents, finite_vectors, materialise

BOUND = 2**60


def _matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column without nulls, all of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def whole_numbers(rows: DataFrame, scale: int) -> DataFrame:
    """id, x: floor(scale c) of every entry."""
    entry = lambda c: F.floor(F.greatest(F.lit(-float(BOUND)), F.least(F.lit(float(BOUND)), c * scale))).cast("long")
    return rows.select("id", F.transform("v", entry).alias("x"))


def _sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Rows of the fit list, and the exact sum of every dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = 0, 0
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0))
                safe = int(np.abs(x).max(initial=0)) < 2**62 // len(x)
                total, count = total + (x.sum(axis=0) if safe else x.astype(object).sum(axis=0)).astype(object), count + len(x)
        if count:
            whole = pa.decimal128(38, 0)
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(total)), pa.int32()), pa.array([count, *map(int, total)], whole)], names=["i", "s"])

    got = fit.select("x").mapInArrow(run, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()
    return (int(got[0]["s"]), [int(r["s"]) for r in got[1:]]) if got else (0, [])


def _centre(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The mean as its whole part and the rest, so that whole numbers are subtracted first."""
    whole = np.array([s // n for s in sums], dtype=np.int64)
    return whole, np.array([(s % n) / n for s in sums])


def _added(fit: DataFrame, centre: tuple, product: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum over all rows of ``product`` of the centred rows, one pass: a task sends ``shape`` numbers."""
    names = [f"c{k}" for k in range(shape[1])]
    whole, rest = centre

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            if b.num_rows:
                total += product((_matrix(b.column(0)) - whole).astype(float) - rest)
        yield pa.RecordBatch.from_arrays([pa.array(range(shape[0]), pa.int32()), *map(pa.array, total.T)], names=["i", *names])

    parts = fit.select("x").mapInArrow(run, "i int, " + ", ".join(f"{c} double" for c in names))
    got = parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).orderBy("i").collect()
    return np.array([[r[c] for c in names] for r in got])


def _orthogonal(block: np.ndarray, basis: np.ndarray | None, width: int, least: float, rng: np.random.Generator) -> np.ndarray:
    """Up to ``width`` orthonormal columns of ``block``, orthogonal to ``basis``; random ones stand in for those that break down."""
    found = basis if basis is not None else np.zeros((len(block), 0))
    for _ in range(2):
        block = block - found @ (found.T @ block)
    u, size, _ = np.linalg.svd(block, full_matrices=False)
    new = u[:, size > least][:, :width]
    while new.shape[1] < width:
        fresh = rng.normal(size=(len(block), 1))
        for _ in range(3):
            for held in (found, new):
                fresh = fresh - held @ (held.T @ fresh)
            fresh = fresh / np.linalg.norm(fresh)
        new = np.hstack([new, fresh])
    for _ in range(2):
        new = np.linalg.qr(new - found @ (found.T @ new))[0]
    return new


def block_lanczos(apply: Callable[[np.ndarray], np.ndarray], d: int, wanted: int, block: int = 16, tolerance: float = 1e-13, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and unit eigenvectors of the symmetric d x d map ``apply``."""
    rng = np.random.default_rng(seed)
    basis = _orthogonal(rng.normal(size=(d, min(block, d))), None, min(block, d), 0.0, rng)
    image = apply(basis)
    while True:
        t = basis.T @ image
        values, vectors = np.linalg.eigh((t + t.T) / 2)
        order = np.argsort(-values)[:wanted]
        values, vectors = values[order], vectors[:, order]
        residual = np.linalg.norm(image @ vectors - (basis @ vectors) * values, axis=0)
        left = d - basis.shape[1]
        if not left or (len(values) >= min(wanted, d) and residual.max() <= tolerance * max(abs(values[0]), 1e-300)):
            found = basis @ vectors
            return values, found * np.where(found[np.abs(found).argmax(axis=0), range(len(order))] < 0, -1.0, 1.0)
        new = _orthogonal(image[:, -min(block, basis.shape[1]) :], basis, min(block, left), 1e-10 * max(abs(values[0]), 1e-300), rng)
        basis, image = np.hstack([basis, new]), np.hstack([image, apply(new)])


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - s)^2, in whole numbers; null beyond a long."""
    s = np.array(sums, dtype=object)
    rough = ((n * x.astype(float) - s.astype(float)) ** 2).sum(axis=1)
    small = (rough < 2.0**62) & (np.abs(x).max(axis=1) < 2**62 // n)
    exact = [None] * len(x)
    if small.any():
        part = n * x[small] - np.array([v if abs(v) < 2**63 else 0 for v in sums], dtype=np.int64)
        for k, v in zip(np.nonzero(small)[0], (part * part).sum(axis=1).tolist(), strict=True):
            exact[k] = v
    for k in np.nonzero(~small & (rough < 2.0**64))[0]:
        v = sum((n * int(a) - b) ** 2 for a, b in zip(x[k], sums, strict=True))
        exact[k] = v if v < 2**63 else None
    return exact


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(df: DataFrame, components: int = 16, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 16) -> DataFrame:
    """Every row's coordinates along the largest components, each of variance 1.

    Columns: vec_id, component (from 1), n (distinct vectors), deviation,
    whitened, explained (the component's share of all variance) and
    identity_error (how far the covariance of the result is from the identity).
    The signs are fixed: the greatest entry of a component is positive.
    """
    rows = whole_numbers(finite_vectors(df, id_col, vector_col), scale)
    fit = materialise(rows.select("x").dropDuplicates(), "whitening-fit")
    n, sums = _sums(fit)
    nothing = df.sparkSession.createDataFrame([], SCHEMA)
    if n < 2:
        return nothing
    d, centre = len(sums), _centre(n, sums)
    spread = float(_added(fit, centre, lambda x: np.array([[(x * x).sum()]]), (1, 1))[0, 0])
    values, axes = block_lanczos(lambda q: _added(fit, centre, lambda x: x.T @ (x @ q), q.shape) / n, d, min(components, d), block)
    kept = values > 1e-12 * max(values[0], 1e-300)
    if not kept.any():
        return nothing
    values, axes = values[kept], axes[:, kept]
    k, explained = len(values), values / (spread / n)
    map_ = axes / np.sqrt(values)
    covariance = _added(fit, centre, lambda x: (x @ map_).T @ (x @ map_), (k, k)) / n
    error = float(np.abs(covariance - np.eye(k)).max())
    whole, rest = centre

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = b.num_rows
            if not m:
                continue
            x = _matrix(b.column(1))
            z = ((x - whole).astype(float) - rest) @ map_
            each = np.repeat(np.arange(m), k)
            columns = [
                b.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, dtype=np.int64)),
                pa.array(_deviations(x, n, sums), pa.int64()).take(pa.array(each)), pa.array(z.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])

    return rows.mapInArrow(run, SCHEMA)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usable embeddings along 16 components."""
    return whiten(documents(spark, sf_dir, "embeddings"))
