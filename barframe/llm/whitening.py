"""Whitening of embeddings: principal components by contour integration (FEAST) over intervals of the covariance's spectrum."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 64.0
SHIFT = 1_000_000  # of the integers x; what is left after centring doesn't depend on it, so the work is done without
WIDEST = 2.0**62  # a vector with a larger entry takes no part
NODES = 8  # of the quadrature on the upper half circle
GROUP = 6  # components sought in an interval, about
ROUNDS = 30
SUMS = pa.schema([("size", pa.int32()), ("pos", pa.int32()), ("s", pa.decimal128(38, 0)), ("n", pa.int64())])
CELLS = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("v", pa.float64())])
PAIRS = pa.schema([("interval", pa.int64()), ("value", pa.float64()), ("vector", pa.list_(pa.float64()))])
OUT_SQL = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
OUT = pa.schema([
    ("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()),
    ("identity_error", pa.float64()),
])


# --- the covariance's eigenvectors ---------------------------------------------------------------------------------------


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal) of a tridiagonal matrix with the inertia of the symmetric ``a`` at every shift."""
    a, n = a.copy(), len(a)
    off = np.zeros(max(n - 1, 0))
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        off[k] = -np.copysign(np.linalg.norm(v), v[0])
        v[0] -= off[k]
        size = np.linalg.norm(v)
        if not size:
            continue
        v /= size
        rest = a[k + 1 :, k + 1 :]
        w = rest @ v
        w -= (v @ w) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
    if n > 1:
        off[n - 2] = a[n - 1, n - 2]
    return np.diag(a).copy(), off


def count_above(diagonal: np.ndarray, off: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Inertia: number of eigenvalues above each shift, from the signs of the pivots of the shifted matrix."""
    least = np.finfo(float).tiny ** 0.5
    above, pivot = np.zeros(len(shifts), np.int64), np.ones(len(shifts))
    for k in range(len(diagonal)):
        pivot = diagonal[k] - shifts - (off[k - 1] ** 2 / pivot if k else 0.0)
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        above += pivot > 0
    return above


def intervals(cov: np.ndarray, k: int) -> list[tuple[float, float, int]]:
    """(from, to, number of eigenvalues by inertia) of intervals that hold the ``k`` largest eigenvalues.

    An interval is no wider than twice the way to the third eigenvalue outside, so that its circle damps all but a few others: an
    eigenvalue far above the next ones has an interval of its own. Beyond its eigenvalues it reaches no further than it is wide.
    """
    diagonal, off = tridiagonal(cov)
    reach = np.abs(np.append(off, 0)) + np.abs(np.append(0, off))
    k = min(k, len(diagonal))
    wanted = min(k + GROUP + 4, len(diagonal))
    lo = np.full(wanted, (diagonal - reach).min())
    hi = np.full(wanted, (diagonal + reach).max())
    span = max(hi[0] - lo[0], 1e-3 * max(abs(hi[0]), abs(lo[0])))
    lo, hi = lo - 1e-3 * span, hi + 1e-3 * span
    for _ in range(46):  # bisection for each rank; only places of gaps are needed
        middle = (lo + hi) / 2
        enough = count_above(diagonal, off, middle) > np.arange(wanted)
        lo, hi = np.where(enough, middle, lo), np.where(enough, hi, middle)
    rank = (lo + hi) / 2
    around = np.concatenate([np.full(3, rank[0] + 2 * span), rank, np.full(3, rank[-1] - (0 if wanted < len(diagonal) else 2 * span))])
    gaps = around[2:-3] - around[3:-2]  # above each rank, and below the last
    found, at = [], 0
    while at < k:
        size = 1
        for s in range(2, min(GROUP + 3, len(rank) - at) + 1):
            width = rank[at] - rank[at + s - 1]
            if width <= 2 * min(around[at] - rank[at], rank[at + s - 1] - around[at + s + 5]):
                size = s
        while at + size < len(rank) and gaps[at + size] < 1e-9 * span:  # equal eigenvalues stay together
            size += 1
        above, below, width = gaps[at] / 2, gaps[at + size] / 2, rank[at] - rank[at + size - 1]
        if at + size == len(rank) < len(diagonal):  # the next one isn't known
            below = 1e-9 * span
        margin = max(width, min(above, below), 1e-9 * span)
        top, cut = rank[at] + min(above, margin), rank[at + size - 1] - min(below, margin)
        number = int(count_above(diagonal, off, np.array([cut]))[0] - count_above(diagonal, off, np.array([top]))[0])
        found.append((float(cut), float(top), number))
        at += max(size, number)
    return found


def feast(cov: np.ndarray, lo: float, hi: float, number: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of the symmetric ``cov`` in an interval that holds ``number`` of them.

    A subspace is projected by the resolvent's integral over a circle through the interval's ends, a Gauss-Legendre
    quadrature of shifted solves; Rayleigh-Ritz in it gives the next subspace, until the residuals are rounding errors.
    Where they shrink slowly, as many others lie close to the interval, the subspace grows, if need be to the whole space.
    Raises if the eigenvalues found aren't as many as the inertia says.
    """
    d = len(cov)
    if not number:
        return np.zeros(0), np.zeros((d, 0))
    scale = np.abs(cov).sum(axis=1).max()
    random = np.random.default_rng(seed)
    space = random.standard_normal((d, min(d, 2 * number + 4)))
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    turns = np.exp(0.5j * np.pi * (1 + nodes))
    centre, radius, best = (lo + hi) / 2, (hi - lo) / 2, np.inf
    for _ in range(ROUNDS):
        image = np.zeros_like(space)
        for turn, weight in zip(turns, weights):
            solved = np.linalg.solve((centre + radius * turn) * np.eye(d) - cov, space.astype(complex))
            image += 0.5 * weight * (radius * turn * solved).real
        basis, sizes, _ = np.linalg.svd(image, full_matrices=False)
        basis = basis[:, sizes > 1e-15 * sizes[0]]
        values, turned = np.linalg.eigh(basis.T @ cov @ basis)
        space = basis @ turned
        inside = np.flatnonzero((values > lo) & (values <= hi))
        residuals = np.linalg.norm(cov @ space[:, inside] - space[:, inside] * values[inside], axis=0) / scale
        inside = np.sort(inside[np.argsort(residuals, kind="stable")[:number]])  # directions of mere rounding errors have large residuals
        residual = np.sort(residuals)[number - 1] if len(inside) == number else np.inf
        if residual < 1e-13 and residual > best / 2:  # rounding errors don't shrink further
            return values[inside], space[:, inside]
        if residual > 1e-13 and (residual > best / 10 or residual == np.inf) and space.shape[1] < d:
            space = np.hstack([space, random.standard_normal((d, min(d - space.shape[1], space.shape[1])))])
        best = min(best, residual)
    if len(inside) == number and residual < 1e-11:
        return values[inside], space[:, inside]
    raise ArithmeticError(f"{len(inside)} of {number} eigenvalues found between {lo} and {hi}")


# --- passes over the vectors ---------------------------------------------------------------------------------------------


def _integers(column: pa.Array, size: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, floor(64 c) as a matrix of whole longs) for the vectors that take part, by their length."""
    starts, valid = column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
    values = column.values.to_numpy(zero_copy_only=False).astype(float)  # null becomes nan
    lengths = np.where(valid, np.diff(starts), -1)
    for length in np.unique(lengths) if size is None else [size]:
        rows = np.flatnonzero(lengths == length)
        if length < 1 or not len(rows):
            continue
        with np.errstate(over="ignore"):
            part = np.floor(SCALE * values[starts[:-1][rows][:, None] + np.arange(length)])
        good = (np.abs(part) < WIDEST).all(axis=1)  # false for nan
        yield rows[good], part[good].astype(np.int64)


def _centred(y: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * y - S exactly, as longs where they fit and as Python's integers where not."""
    most = int(np.abs(y).max(initial=0)) * n + max(map(abs, sums))
    if most < 1 << 63:
        return y * n - np.array(sums, np.int64)
    return y.astype(object) * n - np.array(sums, object)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, list] = {}
    for b in batches:
        for rows, y in _integers(b.column(0)):
            if not len(rows):
                continue
            small = int(np.abs(y).max()) < (1 << 62) // len(rows)
            n, s = totals.get(y.shape[1], (0, [0] * y.shape[1]))
            more = y.sum(axis=0).tolist() if small else y.astype(object).sum(axis=0).tolist()
            totals[y.shape[1]] = (n + len(rows), [a + b for a, b in zip(s, more)])
    for size, (n, s) in totals.items():
        columns = [[size] * size, range(size), list(map(Decimal, s)), [n] * size]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SUMS)], schema=SUMS)


def _cells(total: np.ndarray) -> pa.RecordBatch:
    i, j = np.triu_indices(total.shape[1])
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (i.astype(np.int32), j.astype(np.int32), total[i, j])], schema=CELLS)


def _products(shared, whitened: bool):
    """Sums of products of the centred vectors' entries, or of the whitened ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, turn = shared.value
        total = None
        for b in batches:
            for _, y in _integers(b.column(0), len(sums)):
                rows = (_centred(y, n, sums) / n).astype(float)
                if whitened:
                    rows = rows @ turn
                total = rows.T @ rows + (0 if total is None else total)
        if total is not None:
            yield _cells(total)

    return run


def _matrix(rows: DataFrame, n: int, d: int) -> np.ndarray:
    """The sums of all tasks as a matrix over n; d * d numbers come to the driver, whatever the number of vectors."""
    cells = rows.groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((d, d))
    out[cells["i"], cells["j"]] = cells["v"] / n
    return np.triu(out) + np.triu(out, 1).T


def _solved(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cov, found = shared.value
        for b in batches:
            for k in b.column(0).to_pylist():
                values, vectors = feast(cov, *found[k], seed=k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * len(values), pa.int64()), pa.array(values), pa.array(vectors.T.tolist(), pa.list_(pa.float64()))], schema=PAIRS
                )

    return run


def principal(spark, cov: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of the ``k`` largest, falling; a task works on one interval each.

    Eigenvalues that are rounding errors of the largest are left out. The sign makes a vector's largest entry positive.
    """
    found = intervals(cov, min(k, len(cov))) if cov.any() else []
    if not found:
        return np.zeros(0), np.zeros((len(cov), 0))
    shared = spark.sparkContext.broadcast((cov, found))  # d * d numbers
    pairs = spark.range(0, len(found), 1, len(found)).mapInArrow(_solved(shared), "interval long, value double, vector array<double>").collect()
    shared.unpersist()
    basis = np.linalg.qr(np.array([p.vector for p in pairs]).T)[0]
    values, turned = np.linalg.eigh(basis.T @ cov @ basis)  # sets right what rounding left between the intervals
    values, vectors = values[::-1][:k], (basis @ turned)[:, ::-1][:, :k]
    real = values > 10 * len(cov) * np.finfo(float).eps * values[0]
    values, vectors = values[real], vectors[:, real]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values, vectors * sign


def _whiten(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, turn, explained, error = shared.value
        k = len(explained)
        for b in batches:
            for rows, y in _integers(b.column(1), len(sums)):
                exact = _centred(y, n, sums)
                white = (exact / n).astype(float) @ turn
                most = int(np.abs(exact).max(initial=0))
                if most * most * len(sums) < 1 << 63:
                    deviation = pa.array((exact * exact).sum(axis=1).astype(np.int64))
                else:
                    wide = exact.astype(object)
                    deviation = pa.array([int(x) if x < 1 << 63 else None for x in (wide * wide).sum(axis=1)], pa.int64())
                for lo in range(0, len(rows), 2048):
                    at = pa.array(np.repeat(np.arange(lo, min(lo + 2048, len(rows))), k))
                    here = len(at) // k
                    yield pa.RecordBatch.from_arrays([
                        b.column(0).take(pa.array(rows)).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), here)), pa.array(np.full(len(at), n)),
                        deviation.take(at), pa.array(white[lo : lo + here].ravel()), pa.array(np.tile(explained, here)), pa.array(np.full(len(at), error)),
                    ], schema=OUT)

    return run


def whiten(vectors: DataFrame, k: int = 32, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` per vector and component.

    An entry c counts as x = floor(64 c) + 1,000,000. Sums and deviations (sum of (n x - S)^2) are exact; the covariance
    is summed from centred entries, divisor n. Its ``k`` largest components come from ``principal``; a vector's centred
    entries, projected on a component and divided by its deviation, are ``whitened``. ``explained`` is the eigenvalue's
    share of the trace, ``identity_error`` the largest entry of whitened's covariance less the identity, from a pass of its own.

    Vectors that are null or empty, hold a null or non-finite entry, or one beyond 2^62 / 64 take no part, nor do those
    whose length isn't the most frequent one (the larger of two). Repeated rows count each; ids may be null. A
    deviation beyond a long is null. Components without variance aren't returned, so equal vectors give no rows. Other columns
    aren't read. The driver holds a matrix of the vectors' length squared, whatever their number.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).alias("embedding"))
    only = rows.select("embedding")
    sums = only.mapInArrow(_sums, "size int, pos int, s decimal(38,0), n long").groupBy("size", "pos").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    size = sums.filter("pos = 0").orderBy(F.desc("n"), F.desc("size")).select("size").first()
    if size is None:
        return spark.createDataFrame([], OUT_SQL)
    held = sums.filter(F.col("size") == size[0]).orderBy("pos").collect()
    n, total = int(held[0].n), [int(r.s) for r in held]

    def matrix(turn, whitened: bool, d: int) -> np.ndarray:
        shared = spark.sparkContext.broadcast((n, total, turn))
        out = _matrix(only.mapInArrow(_products(shared, whitened), "i int, j int, v double"), n, d)
        shared.unpersist()
        return out

    cov = matrix(None, False, len(total))
    values, components = principal(spark, cov, k)
    if not len(values):
        return spark.createDataFrame([], OUT_SQL)
    turn = components / np.sqrt(values)
    error = float(np.abs(matrix(turn, True, len(values)) - np.eye(len(values))).max())  # the centred vectors' mean is zero
    shared = spark.sparkContext.broadcast((n, total, turn, values / np.trace(cov), error))
    return rows.mapInArrow(_whiten(shared), OUT_SQL)
