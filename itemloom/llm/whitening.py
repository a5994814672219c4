"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

Vectors become integers, x = floor(256 c); each distinct x is one row of the fit list. Spark
computes the products: the centred rows times v, and their transpose times u, in turn. A left
vector is one number for each row of the table; as it lies in the range of the rows it is kept as the few
coefficients c with u = Xc, so no left vector is ever stored or sent, and a lost task only
re-reads its part of the fit list. Left vectors are orthogonalised twice against all earlier
ones (once in each product), right ones twice on the driver, where they are as short as a
vector. The singular values of the small bidiagonal matrix give the deviations, its vectors the
components. A product sends one number for each dimension and each step.

Steps run to the full width up to ``FULL_WIDTH`` dimensions, so that repeated eigenvalues are
found too; wider vectors stop when the residual of the asked components is below ``TOLERANCE``.

Defined results: vectors that are null or hold null or non-finite entries go. Of the others
those with the most frequent length stay (ties: the longer); a vector of another length goes,
as no covariance holds both. Entries beyond the range of long saturate. Repeated vectors count once
in the fit and all get rows; equal or null ids are kept. Directions without variance are no
components, so constant or single vectors, empty vectors and empty tables give no rows. A
deviation beyond the range of long is null. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

COMPONENTS = 4
SCALE = 256
FULL_WIDTH = 256
TOLERANCE = 1e-14
RANK = 1e-11  # share of the largest singular value below which a direction is no direction
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def integers(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id and x (longs) of every usable vector."""
    v = F.col(vector).cast("array<double>")
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("v").isNotNull()).filter(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(c * float(scale)).cast("long")).alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.Array) else column.combine_chunks().flatten()
    return np.asarray(flat, dtype=np.int64).reshape(-1, width)


def _added(fit: DataFrame, width: int, of, size: int, kind: str = "double") -> np.ndarray:
    """Sums over the fit list of the ``size`` numbers that ``of(x)`` gives for a block of rows."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of(_matrix(batch.column(0), width))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["i", "s"])

    out = np.zeros(size, dtype=np.int64 if kind == "long" else np.float64)
    for r in fit.mapInArrow(run, f"i long, s {kind}").groupBy("i").agg(F.sum("s").alias("s")).collect():  # size rows
        out[r.i] = r.s
    return out


def _fresh(width: int, seed: int, against: list[np.ndarray]) -> np.ndarray | None:
    """A unit vector at right angles to those given."""
    return _upright(np.random.default_rng(seed).standard_normal(width), against)[0]


def _upright(v: np.ndarray, against: list[np.ndarray]) -> tuple[np.ndarray | None, float]:
    """``v`` less its projections, of length 1, and its length; None where nothing is left."""
    before = np.linalg.norm(v)
    if against:
        basis = np.stack(against)
        for _ in range(2):
            v = v - basis.T @ (basis @ v)
    size = float(np.linalg.norm(v))
    return (v / size, size) if size > RANK * max(before, 1e-300) and before > 0 else (None, 0.0)


def bidiagonal(product, adjoint, width: int, wanted: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Largest singular values of a tall matrix and its right singular vectors (rows).

    ``product(C, v)`` gives [Uᵀ(Xv), |Xv|²] and ``adjoint(C, c)`` gives [Xᵀ(Xc), Uᵀ(Xc), |Xc|²] with
    U = XC. Both are jobs; everything here has the size of a vector.
    """
    right, left, back = [], [], []  # v, coefficients c of u = Xc, Xᵀu
    b = np.zeros((width, width + 1))
    scale, fresh = 0.0, True
    v = _fresh(width, seed, [])
    while v is not None and len(right) < width:
        right.append(v)
        col, known = len(right) - 1, np.stack(left, axis=1) if left else np.zeros((width, 0))
        got = product(known, v)
        c = v - known @ got[:-1]
        got = adjoint(known, c)
        z, g, square = got[:width], got[width:-1], got[-1] - float(got[width:-1] @ got[width:-1])
        alpha = float(np.sqrt(max(square, 0.0)))
        scale = max(scale, alpha)
        if alpha <= RANK * max(scale, 1e-300) or scale == 0.0:
            if fresh:
                break  # a vector of any direction finds nothing new: the range is used up
            v, fresh = _fresh(width, seed + len(right), right), True
            continue
        c = (c - known @ g) / alpha
        z = (z - (np.stack(back, axis=1) @ g if back else 0.0)) / alpha
        row = len(left)
        left.append(c)
        back.append(z)
        b[row, col] = alpha
        v, beta = _upright(z - alpha * right[col], right)
        if v is None or beta <= RANK * scale:
            v, fresh = _fresh(width, seed + len(right), right), True
            continue
        b[row, col + 1] = beta
        scale, fresh = max(scale, beta), False
        if width > FULL_WIDTH and len(left) >= wanted:
            p, s, _ = np.linalg.svd(b[:row + 1, :col + 1], full_matrices=False)
            if (beta * np.abs(p[row, :wanted]) <= TOLERANCE * s[:wanted]).all():
                break
    if not left:
        return np.zeros(0), np.zeros((0, width))
    _, s, q = np.linalg.svd(b[:len(left), :len(right)], full_matrices=False)
    keep = s[:wanted] > RANK * s[0]
    vectors = q[:wanted][keep] @ np.stack(right)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    at = np.abs(vectors).argmax(axis=1)
    return s[:wanted][keep], vectors * np.sign(vectors[np.arange(len(at)), at])[:, None]


def fitted(fit: DataFrame, width: int, wanted: int = COMPONENTS) -> dict:
    """n, sums, components (rows), deviations, explained shares and the error of the identity."""
    first = _added(fit, width, lambda x: np.concatenate(([len(x)], x.sum(axis=0))), width + 1, "long")
    n, sums = int(first[0]), first[1:]
    out = {"n": n, "sums": sums, "components": np.zeros((0, width)), "deviations": np.zeros(0), "explained": np.zeros(0), "error": 0.0}
    if n < 2:
        return out
    mean = sums / n

    def product(known, v):
        def of(x):
            y = x - mean
            t = y @ v
            return np.append((y @ known).T @ t, t @ t)
        return _added(fit, width, of, known.shape[1] + 1)

    def adjoint(known, c):
        def of(x):
            y = x - mean
            u = y @ c
            return np.concatenate((y.T @ u, (y @ known).T @ u, [u @ u]))
        return _added(fit, width, of, width + known.shape[1] + 1)

    values, vectors = bidiagonal(product, adjoint, width, wanted)
    if not len(values):
        return out
    deviations, k = values / np.sqrt(n), len(values)

    def of(x):
        y = x - mean
        t = (y @ vectors.T) / deviations
        return np.concatenate(((t.T @ t).ravel(), t.sum(axis=0), [(y * y).sum()]))

    got = _added(fit, width, of, k * k + k + 1)
    middle = got[k * k:-1] / n
    covariance = got[:k * k].reshape(k, k) / n - np.outer(middle, middle)
    return out | {"components": vectors, "deviations": deviations, "explained": values * values / got[-1], "error": float(np.abs(covariance - np.eye(k)).max())}


def whitened(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """One row for each usable vector and component: its whitened coordinate and the figures of the fit."""
    spark = df.sparkSession
    rows = materialise(integers(df, vec_id, vector, scale))
    usual = rows.groupBy(F.size("x").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    if usual is None or not usual.w:
        return spark.createDataFrame([], SCHEMA)
    width = int(usual.w)
    rows = rows.filter(F.size("x") == width)
    fit = materialise(rows.select("x").distinct())
    most = int(fit.select(F.max(F.greatest(F.abs(F.array_max("x")), F.abs(F.array_min("x"))))).first()[0] or 0)
    model = fitted(fit, width, components)
    n, sums, k = model["n"], model["sums"], len(model["deviations"])
    if not k:
        return spark.createDataFrame([], SCHEMA)
    mean = sums / n
    small = width * (2 * n * most) ** 2 < 1 << 62  # no sum of squares passes 64 bits

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(batch.schema.get_field_index("x")), width)
            far = n * x.astype(np.int64 if small else object) - (sums if small else sums.astype(object))
            deviation = (far * far).sum(axis=1)
            deviation = pa.array(deviation if small else [v if v < 1 << 63 else None for v in deviation.tolist()], pa.int64())
            t = ((x - mean) @ model["components"].T) / model["deviations"]
            each = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays([
                batch.column(batch.schema.get_field_index("vec_id")).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(x) * k, n)), deviation.take(each), pa.array(t.ravel()),
                pa.array(np.tile(model["explained"], len(x))), pa.array(np.full(len(x) * k, model["error"]))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, SCHEMA)
