"""PCA whitening of embeddings by a distributed covariance and mixed-precision eigenvectors.

Entries become whole numbers, so the sums are exact.  One pass counts and sums, a second adds up the centred outer
products in the tasks; only matrices of dimension x dimension reach the driver.  There the eigenvectors are found in
float32 and corrected in long double by Ogita-Aishima iterations, which need matrix products only.  Eigenvalues nearer
to each other than the iteration can separate form a cluster: the iteration settles the space that their vectors span,
and a sub-solve of the covariance within that space, refined the same way, settles the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contract: x = floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Larger entries count as this, so that x stays exact in a double.
MOST = float(1 << 52)
COMPONENTS = 32
WIDE = np.longdouble


def refine(a: np.ndarray, x: np.ndarray, turns: int = 12, depth: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and orthonormal eigenvectors of the symmetric ``a`` in its own precision, from approximate ``x``.

    Each turn takes R = I - X'X and S = X'AX, estimates the eigenvalues s_ii / (1 - r_ii) and corrects X by E with
    e_ij = (s_ij + l_j r_ij) / (l_j - l_i), or r_ij / 2 where l_i and l_j lie within the error bound of each other.
    Runs of such neighbours are clusters; each is solved again within its own space, where it is scaled up.
    """
    n = len(a)
    size = float(np.sqrt((a * a).sum()))
    values = np.zeros(n, a.dtype)
    if n == 0 or size == 0:
        return values, x
    eps = float(np.finfo(a.dtype).eps)
    near = np.zeros((n, n), bool)
    error = np.inf
    for _ in range(turns):
        r = np.eye(n, dtype=a.dtype) - x.T @ x
        s = x.T @ (a @ x)
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(values)
        bound = 2 * (np.sqrt((off * off).sum()) + size * np.sqrt((r * r).sum()))
        apart = values[None, :] - values[:, None]
        near = np.abs(apart) <= max(float(bound), 4 * n * eps * size)
        with np.errstate(divide="ignore", invalid="ignore"):
            e = np.where(near, r / 2, (s + values[None, :] * r) / apart)
        x = x + x @ e
        last, error = error, float(np.abs(e).max())
        if error <= 8 * n * eps or error >= last / 2 and error < 1e-6:
            break
    for _ in range(2):  # pairs that the bound can't separate may leave the vectors short of orthonormal
        x = x + x @ (np.eye(n, dtype=a.dtype) - x.T @ x) / 2
    order = np.argsort(-values, kind="stable")
    values, x, near = values[order], x[:, order], near[np.ix_(order, order)]
    start = 0
    while start < n:
        stop = start + 1
        while stop < n and near[stop - 1, stop]:
            stop += 1
        if stop - start > 1 and depth < 6:
            part = x[:, start:stop]
            middle = values[start:stop].mean()
            # What is left of A within the cluster's space after its common value: small, but with separations of its own.
            inner = part.T @ (a @ part - middle * part)
            inner = (inner + inner.T) / 2
            if float(np.abs(inner).max()) > 4 * n * eps * size:
                scaled = inner / np.abs(inner).max()
                got, turned = refine(scaled, np.linalg.eigh(scaled.astype(np.float64))[1].astype(a.dtype), turns, depth + 1)
                values[start:stop] = middle + got * np.abs(inner).max()
                x[:, start:stop] = part @ turned
        start = stop
    order = np.argsort(-values, kind="stable")
    return values[order], x[:, order]


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, to double precision."""
    n = len(v)
    top = np.abs(v).max() if v.size else 0
    if not top > 0:
        return np.zeros(n), np.eye(n)
    a = v.astype(WIDE) / WIDE(top)
    a = (a + a.T) / 2
    rough = np.linalg.eigh(a.astype(np.float32))[1]
    values, x = refine(a, rough.astype(WIDE))
    x = x / np.sqrt((x * x).sum(0))
    # Either sign is right: the largest entry is made positive.
    x = x * np.sign(x[np.abs(x).argmax(0), np.arange(n)])
    return (values * WIDE(top)).astype(np.float64), x.astype(np.float64)


@dataclass
class Whitening:
    """What a fit keeps: the number of vectors, exact sums, eigenvalues and the scaled directions (dimension x components)."""

    n: int
    sums: np.ndarray
    trace: float
    values: np.ndarray
    directions: np.ndarray
    identity_error: float = 0.0


def usable(df: DataFrame) -> DataFrame:
    """vec_id and c (array<double>) of the rows whose vector has entries, all of them finite."""
    c = F.col("embedding").cast("array<double>")
    fine = F.col("embedding").isNotNull() & F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return df.where(fine & (F.size("embedding") > 0)).select("vec_id", c.alias("c"))


def _whole(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    c = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return np.clip(np.floor(c * SCALE), -MOST, MOST).astype(np.int64) + SHIFT


def _slices(batch: pa.RecordBatch, dim: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about 4 MB of entries."""
    step = max(1, (1 << 19) // max(dim, 1))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def fit(vectors: DataFrame, dim: int, components: int = COMPONENTS) -> Whitening | None:
    """Fit on all of ``vectors`` (c of ``dim`` entries).  None for an empty table."""
    half = 1 << 20

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high = 0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        for batch in batches:
            for part in _slices(batch, dim):
                x = _whole(part.column(0), dim)
                n += len(x)
                # In two halves neither sum can pass 64 bits.
                low += (x % half).sum(0)
                high += (x // half).sum(0)
        total = [str(int(h) * half + int(l)) for h, l in zip(high, low, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), pa.array(total)], ["i", "n", "s"])

    rows = vectors.select("c").mapInArrow(add, "i int, n bigint, s string").groupBy("i").agg(
        F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()
    if not rows or not rows[0]["n"]:
        return None
    n, sums = int(rows[0]["n"]), np.array([int(r["s"]) for r in rows], object)

    def second_moments(maps, width: int) -> np.ndarray:
        """Sum over all rows of the outer product of ``maps(x)``: one matrix a task, added up entry by entry in the shuffle."""

        def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((width, width))
            for batch in batches:
                for part in _slices(batch, dim):
                    z = maps(_whole(part.column(0), dim))
                    total += z.T @ z
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "v"])

        parts = vectors.select("c").mapInArrow(outer, "i int, v array<double>")
        got = parts.groupBy("i").agg(F.array(*[F.sum(F.col("v")[j]) for j in range(width)]).alias("v")).orderBy("i").collect()
        return np.array([r["v"] for r in got])

    v = second_moments(lambda x: centred(x, n, sums), dim) / n
    values, directions = eigen((v + v.T) / 2)
    k = min(components, dim)
    trace = float(np.trace(v))
    scale = np.array([e ** -0.5 if e > trace * dim * 1e-14 else 0.0 for e in values[:k]])
    model = Whitening(n, sums, trace, values[:k], directions[:, :k] * scale)
    # The centred rows add up to zero exactly, so the whitened ones have no mean to take off.
    w = second_moments(lambda x: centred(x, n, sums) @ model.directions, k) / n
    model.identity_error = float(np.abs(w - np.diag((scale > 0).astype(float))).max())
    return model


def _differences(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exact: 64-bit where that holds it, Python's whole numbers else."""
    most = n * max(int(np.abs(x).max()) if x.size else 0, 1)
    if most < 1 << 61 and all(abs(int(s)) < 1 << 61 for s in sums):
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n, from the exact difference n * x - S."""
    return _differences(x, n, sums).astype(np.float64) / n


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    """Sum over the dimensions of (n * x - S)^2, exact."""
    d = _differences(x, n, sums)
    if d.dtype != object and (not d.size or int(np.abs(d).max()) ** 2 * d.shape[1] < 1 << 62):
        return (d * d).sum(1).tolist()
    d = d.astype(object)
    return [int(v) for v in (d * d).sum(1)]


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable vector and component.

    Rows whose vector is null, empty, or has a null or non-finite entry are left out.  Vectors can only share a
    covariance if they are equally long: of several lengths the commonest counts (the longest of equally common ones)
    and other rows are left out.  Entries beyond 2^52 / 64 in size count as that.  Rows that repeat a vec_id or a vector each count and
    each have their rows.  A direction without variance (a constant dimension, fewer vectors than dimensions) has
    whitened 0 and isn't in identity_error.  ``deviation`` is decimal(38,0), since n grows it beyond a long.  An empty
    table gives an empty result; other columns are ignored.
    """
    vectors = usable(embeddings)
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    schema = (f"vec_id {kind}, component int, n bigint, deviation string, whitened double, explained double, identity_error double")
    names = [f.strip().split()[0] for f in schema.split(",")]
    lengths = vectors.groupBy(F.size("c").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    model = None
    if lengths is not None:
        dim = lengths["dim"]
        vectors = vectors.where(F.size("c") == dim)
        model = fit(vectors, dim, components)
    if model is None:
        return embeddings.sparkSession.createDataFrame([], schema).withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))
    k = model.directions.shape[1]
    explained = model.values / model.trace if model.trace > 0 else np.zeros(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, dim):
                x = _whole(part.column(1), dim)
                m = len(x)
                w = centred(x, model.n, model.sums) @ model.directions
                far = pa.array([str(d) for d in deviations(x, model.n, model.sums)])
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)),
                    far.take(each), pa.array(w.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, model.identity_error))], names)

    return vectors.mapInArrow(run, schema).withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))
