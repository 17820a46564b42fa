"""Embedding whitening (operator 13): principal components by block Lanczos, without a covariance matrix.

Vectors are whole numbers x = floor(1024 * c) + 100000, so counts, sums and deviations are exact. The
covariance V = Xc' Xc / n of the centred rows is never formed: each pass over the table returns V times a
block of vectors, as partial products of its tasks that Spark adds up entry by entry. Blocks go through
Lanczos with full reorthogonalisation (twice) against all blocks before; V's action on the basis is
kept, so residuals of the Ritz pairs are computed and not estimated. A block that has lost rank (a
breakdown) goes on with random directions orthogonal to the basis. The passes end when the wanted
pairs' residuals are below the tolerance, or when the basis spans the whole space, where Ritz pairs are
eigenpairs. The driver holds the basis, dimensions times at most dimensions, and never rows.

The trace of V comes from the rows' exact deviations, which needs no eigenvalue besides the wanted ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritext.llm.common import materialise

SCALE, SHIFT = 1024, 100_000


@dataclass
class Components:
    """Count, sums, eigenvalues (falling) and unit eigenvectors (columns), trace, passes over the table."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    passes: int


def whole_vectors(rows: DataFrame, vector: str = "embedding", ident: str = "vec_id") -> DataFrame:
    """(ident, x) of the rows whose vector is neither null nor empty and has finite entries only.

    Vectors that are shorter than the longest one lack entries and go as those with null entries do.
    """
    c = F.col(vector)
    fine = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    x = F.transform(c, lambda e: F.floor(e.cast("double") * SCALE).cast("long") + SHIFT)
    kept = materialise(rows.filter(c.isNotNull() & (F.size(c) > 0)).filter(fine).select(F.col(ident), x.alias("x")), "whole-vectors")
    sizes = kept.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    return kept if sizes[0] == sizes[1] else kept.filter(F.size("x") == sizes[1])


def _matrix(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _totals(table: DataFrame, step: Callable[[pa.RecordBatch], np.ndarray], kind: str = "double") -> np.ndarray:
    """Sum over all rows of what ``step`` makes of each batch (an array of fixed length); each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                part = step(b)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["i", "v"])

    sums = table.mapInArrow(run, f"i int, v {kind}").groupBy("i").agg(F.sum("v").alias("v"))
    return np.array([r.v for r in sorted(sums.collect(), key=lambda r: r.i)])


def _offsets(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums, exact: in long where that surely fits, else in Python's whole numbers."""
    if x.size and (float(np.abs(x).max()) + 1) * n + float(np.abs(sums).max()) < 2**62:
        return n * x - sums
    return n * x.astype(object) - sums.astype(object)


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    d = _offsets(x, n, sums)
    if d.dtype == object or float(np.abs(d).max(initial=0)) ** 2 * d.shape[1] >= 2**62:
        d = d.astype(object)
    return (d * d).sum(axis=1)


def _orthogonal(block: np.ndarray, basis: np.ndarray, room: int, r: np.random.Generator, scale: float) -> np.ndarray:
    """At most ``room`` orthonormal columns orthogonal to ``basis``, from ``block`` first; columns that depend on the others (a breakdown) are drawn anew."""
    out: list[np.ndarray] = []
    for k in range(min(block.shape[1], room)):
        v, low = block[:, k], 1e-13 * scale
        while True:
            for _ in range(2):
                v = v - basis @ (basis.T @ v)
                for q in out:
                    v = v - q * (q @ v)
            size = np.linalg.norm(v)
            if size > low:
                break
            v, low = r.standard_normal(len(v)), 1e-8
        v = v / size
        for q in (*basis.T, *out):
            v = v - q * (q @ v)
        out.append(v / np.linalg.norm(v))
    return np.stack(out, axis=1) if out else np.empty((len(basis), 0))


def block_lanczos(
    apply: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int = 8, block: int = 8, tolerance: float = 1e-13, seed: int = 1
) -> tuple[np.ndarray, np.ndarray, int]:
    """The largest eigenvalues (falling), their unit vectors (columns) and the passes for a symmetric operator that is only applied.

    ``tolerance`` bounds each wanted pair's residual, as a share of the largest eigenvalue.
    """
    r = np.random.default_rng(seed)
    wanted = min(wanted, dim)
    basis = _orthogonal(r.standard_normal((dim, max(block, wanted))), np.empty((dim, 0)), dim, r, 1.0)
    new, image, passes = basis, np.empty((dim, 0)), 0
    while True:
        image = np.concatenate([image, apply(new)], axis=1)
        passes += 1
        t = basis.T @ image
        values, y = np.linalg.eigh((t + t.T) / 2)
        values, y = values[::-1][:wanted], y[:, ::-1][:, :wanted]
        vectors = basis @ y
        residual = np.linalg.norm(image @ y - vectors * values, axis=0).max(initial=0.0)
        top = max(abs(values).max(initial=0.0), np.finfo(float).tiny)
        if residual <= tolerance * top or basis.shape[1] >= dim:
            return values, vectors / np.linalg.norm(vectors, axis=0), passes
        new = _orthogonal(image[:, -new.shape[1] :], basis, dim - basis.shape[1], r, top)
        basis = np.concatenate([basis, new], axis=1)


def principal_components(table: DataFrame, wanted: int = 8, block: int = 8, tolerance: float = 1e-13) -> Components | None:
    """Components of ``table`` (column x, whole numbers of one length) with the covariance's divisor n; None for an empty table.

    Components whose eigenvalue is zero (below 1e-12 of the largest) are left out, as nothing can be scaled by it.
    The sign of a vector is such that its largest entry is positive.
    """
    n = table.count()
    if not n:
        return None
    sums = _totals(table, lambda b: _matrix(b).sum(axis=0), "long")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = sum(int(_deviations(_matrix(b), n, sums).sum()) for b in batches if b.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array([str(whole)])], names=["v"])

    deviation = table.select("x").mapInArrow(exact, "v string").agg(F.sum(F.col("v").cast("decimal(38,0)"))).first()[0]
    trace = float(Fraction(int(deviation), n**3))

    def apply(q: np.ndarray) -> np.ndarray:
        def step(b: pa.RecordBatch) -> np.ndarray:
            c = (_offsets(_matrix(b), n, sums) / n).astype(float)
            return (c.T @ (c @ q)).ravel()

        return _totals(table.select("x"), step).reshape(q.shape) / n

    values, vectors, passes = block_lanczos(apply, len(sums), wanted, block, tolerance)
    fine = values > 1e-12 * max(values.max(initial=0.0), np.finfo(float).tiny)
    values, vectors = values[fine], vectors[:, fine]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]) if vectors.size else 1.0
    return Components(n, sums, values, vectors * signs, trace, passes)


def whiten(rows: DataFrame, wanted: int = 8, vector: str = "embedding", ident: str = "vec_id", block: int = 8, tolerance: float = 1e-13) -> DataFrame:
    """One row for each usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null, empty, shorter than the longest, or hold null or non-finite entries are dropped. Repeated rows
    and ids each count and are each returned; a null id is kept. Equal eigenvalues (ties) get any orthonormal
    vectors of their space, the same for all rows. Components of eigenvalue zero, as all are when the vectors are equal,
    have no row; an empty table has none. Deviations beyond a long are an error, not a wrong number. Other columns are
    not read.
    """
    spark = rows.sparkSession
    table = whole_vectors(rows, vector, ident)
    found = principal_components(table, wanted, block, tolerance)
    kind = table.schema[ident].dataType.simpleString()
    empty = spark.createDataFrame([], f"`{ident}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    if found is None or not len(found.values):
        return empty
    n, sums, scaled = found.n, found.sums, found.vectors / np.sqrt(found.values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b) if b.num_rows else np.empty((0, len(sums)), dtype=np.int64)
            w = (_offsets(x, n, sums) / n).astype(float) @ scaled
            deviation = pa.array([int(v) for v in _deviations(x, n, sums)], pa.int64())
            ends = pa.array(np.arange(0, w.size + 1, w.shape[1]), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(ident), deviation, pa.ListArray.from_arrays(ends, pa.array(w.ravel()))], names=[ident, "deviation", "w"])

    done = materialise(table.mapInArrow(project, f"`{ident}` {kind}, deviation long, w array<double>"), "whitened")
    mean = _totals(done.select("w"), lambda b: _matrix(b, "w").sum(axis=0)) / n

    def products(b: pa.RecordBatch) -> np.ndarray:
        c = _matrix(b, "w") - mean
        return (c.T @ c).ravel()

    k = len(mean)
    error = float(np.abs(_totals(done.select("w"), products).reshape(k, k) / n - np.eye(k)).max())
    shares = F.array(*[F.lit(float(e / found.trace)) for e in found.values])
    out = done.select(F.col(ident), "deviation", F.posexplode("w").alias("nth", "whitened"))
    return out.select(
        ident, (F.col("nth") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("nth")).alias("explained"), F.lit(error).alias("identity_error"),
    )
