"""Whitening of embeddings on the leading principal components, which contour integration finds.

Spark sums the exact means and the centred covariance. On that small matrix, inertia counts place the wanted eigenvalues in separate
intervals. Every interval is a task of its own: the integral of the resolvent around it, taken by Gauss-Legendre quadrature of complex
shifted solves, projects a random block onto the interval's eigenvectors, and a Rayleigh-Ritz step extracts them (FEAST). An interval is
done when it has as many converged vectors as its inertia count says, so none is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarium.llm.vectors import matrix, scaled_floor, sound_vectors

COMPONENTS = 32
FACTOR = 64
OFFSET = 1_000_000
#: Largest scaled entry without its offset.
MOST = 1 << 46
#: Eigenvalues of one interval, quadrature points on the upper half circle, refinements.
PER_INTERVAL = 8
POINTS = 8
SWEEPS = 30
ROWS = 2000


# --- the covariance, over all rows --------------------------------------------------------------------------------------


def _shifted(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The integer entries without their common offset, which no covariance depends on."""
    return scaled_floor(matrix(batch.column("embedding"), width), FACTOR, MOST)


def count_and_sums(vectors: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of rows and exact sum of each dimension (without the offset); one row per task and dimension is shuffled."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * width
        for batch in batches:
            x = _shifted(batch, width)
            n += len(x)
            # halves of 32 bits cannot overflow in a batch; Python's integers add them exactly
            high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
            total = [t + (int(h) << 32) + int(w) for t, h, w in zip(total, high, low, strict=True)]
        rows = [pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64()), pa.array(map(str, total), pa.string())]
        yield pa.RecordBatch.from_arrays(rows, ["dim", "n", "total"])

    each = vectors.select("embedding").mapInArrow(add, "dim int, n long, total string")
    rows = each.groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("dim").collect()
    return (rows[0]["n"] if rows else 0), [int(r["total"]) for r in rows]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - S`` exactly: 64-bit integers where they fit, else Python's."""
    far = n * max(int(np.abs(x).max(initial=0)), 1) + max(map(abs, sums), default=0)
    kind = np.int64 if far < 1 << 62 else object
    return n * x.astype(kind) - np.array(sums, kind)


def second_moments(vectors: DataFrame, width: int, n: int, sums: list[int], onto: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sums and sums of products of the centred rows, or of their images under ``onto``; one row per task and dimension is shuffled."""
    wide = width if onto is None else onto.shape[1]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(wide), np.zeros((wide, wide))
        for batch in batches:
            y = centred(_shifted(batch, width), n, sums).astype(np.float64) / n
            y = y if onto is None else y @ onto
            first += y.sum(axis=0)
            second += y.T @ y
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(wide), pa.int32()), pa.array(first), pa.array(list(second), pa.list_(pa.float64()))], ["dim", "first", "second"]
        )

    each = vectors.select("embedding").mapInArrow(add, "dim int, first double, second array<double>")
    columns = F.array(*[F.sum(F.get("second", F.lit(i))) for i in range(wide)])
    rows = each.groupBy("dim").agg(F.sum("first").alias("first"), columns.alias("second")).orderBy("dim").collect()
    return np.array([r["first"] for r in rows]), np.array([r["second"] for r in rows])


def covariance(first: np.ndarray, second: np.ndarray, n: int) -> np.ndarray:
    """Covariance with divisor ``n`` from sums and sums of products; made exactly symmetric."""
    v = second / n - np.outer(first / n, first / n)
    return (v + v.T) / 2


# --- inertia: how many eigenvalues lie below a number ---------------------------------------------------------------------


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a tridiagonal matrix with the eigenvalues of ``v``, by Householder reflections."""
    t = v.copy()
    for k in range(len(t) - 2):
        x = t[k + 1 :, k].copy()
        x[0] += np.copysign(np.linalg.norm(x), x[0])
        size = x @ x
        if size:
            h = 2 / size * x
            t[k + 1 :, k:] -= np.outer(h, x @ t[k + 1 :, k:])
            t[k:, k + 1 :] -= np.outer(t[k:, k + 1 :] @ x, h)
    return np.diag(t).copy(), np.diag(t, 1).copy()


def eigenvalues_below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each number of ``at`` the negative pivots of the shifted matrix's factors, which are the eigenvalues below it."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    pivot = diagonal[0] - at
    count = (pivot < 0).astype(np.int64)
    for d, e in zip(diagonal[1:], off, strict=True):
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        pivot = d - at - e * e / pivot
        count += pivot < 0
    return count


def locate(diagonal: np.ndarray, off: np.ndarray) -> np.ndarray:
    """All eigenvalues, falling, to rounding, by halving intervals until the counts leave no room."""
    reach = np.abs(diagonal).max() + 2 * np.abs(off).max(initial=0.0) + np.finfo(float).tiny
    low, high = np.full(len(diagonal), -reach), np.full(len(diagonal), reach)
    rank = np.arange(len(diagonal))
    for _ in range(80):
        middle = (low + high) / 2
        above = eigenvalues_below(diagonal, off, middle) <= rank
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    return ((low + high) / 2)[::-1]


def intervals(v: np.ndarray, wanted: int, most: int = PER_INTERVAL) -> list[tuple[float, float, int]]:
    """``(low, high, count)`` of intervals that hold the ``wanted`` largest eigenvalues, cut where the gaps are widest.

    Eigenvalues that rounding cannot tell apart stay together, so an interval may hold more than ``most``, and the last one may reach
    beyond ``wanted``. ``count`` is the difference of the inertia counts at both ends.
    """
    diagonal, off = tridiagonal(v)
    values = locate(diagonal, off)
    scale = np.abs(values).max()
    gaps = np.append(values[:-1] - values[1:], np.inf)
    apart = gaps > 64 * np.finfo(float).eps * scale * len(values)
    end = next(k for k in range(min(wanted, len(values)) - 1, len(values)) if apart[k]) + 1
    cuts = [0]
    while cuts[-1] < end:
        room = [k for k in range(cuts[-1], end) if apart[k]]
        near = [k for k in room if cuts[-1] + most // 2 <= k + 1 <= cuts[-1] + most] or room[:1]
        cuts.append(max(near, key=lambda k: gaps[k]) + 1 if end - cuts[-1] > most else end)
    pad = scale if scale else 1.0
    edge = [values[0] + pad * 0.01]
    edge += [(values[k - 1] + values[k]) / 2 if k < len(values) else values[-1] - pad * 0.01 for k in cuts[1:]]
    below = eigenvalues_below(diagonal, off, np.array(edge))
    return [(float(edge[i + 1]), float(edge[i]), int(below[i] - below[i + 1])) for i in range(len(cuts) - 1)]


# --- one interval ---------------------------------------------------------------------------------------------------------


def contour_eigenpairs(v: np.ndarray, low: float, high: float, count: int, points: int = POINTS) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs of ``v`` in ``(low, high)``, values falling.

    The contour is the circle over the interval; for a real symmetric matrix the lower half follows from the upper one. Too few converged
    values are an error, after the block has grown to the whole space.
    """
    d, scale = len(v), np.abs(v).max()
    centre, radius = (low + high) / 2, (high - low) / 2
    nodes, weights = np.polynomial.legendre.leggauss(points)
    angles = np.pi / 2 * (1 - nodes)
    turns = np.exp(1j * angles)
    shifted = np.stack([(centre + radius * t) * np.eye(d) - v for t in turns])
    factors = (weights / 2 * radius * turns)[:, None, None]
    size, rng = min(d, count + max(4, count // 2)), np.random.default_rng(7)
    block = rng.standard_normal((d, size))
    while True:
        for _ in range(SWEEPS):
            image = (factors * np.linalg.solve(shifted, block.astype(complex)[None])).real.sum(axis=0)
            basis, _ = np.linalg.qr(image)
            basis, _ = np.linalg.qr(basis)
            values, mixed = np.linalg.eigh(basis.T @ v @ basis)
            block = basis @ mixed
            inside = (values > low) & (values < high)
            error = np.linalg.norm(v @ block[:, inside] - block[:, inside] * values[inside], axis=0)
            if inside.sum() == count and error.max(initial=0) <= 1e-13 * scale * np.sqrt(d):
                return values[inside][::-1], block[:, inside][:, ::-1]
        if size == d:
            raise ArithmeticError(f"{inside.sum()} of {count} eigenvalues found between {low} and {high}")
        size = min(d, 2 * size)
        block = np.hstack([block, rng.standard_normal((d, size - block.shape[1]))])


def leading_components(spark: SparkSession, v: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of ``v`` with unit eigenvectors as columns, ``wanted`` of them at most, zero ones left out.

    Each interval is solved by a task of its own. A last Rayleigh-Ritz step over all of them makes vectors of different intervals
    orthogonal to rounding. The entry of largest size of a vector is positive.
    """
    if not len(v) or not np.abs(v).max():
        return np.zeros(0), np.zeros((len(v), 0))
    plan = intervals(v, wanted)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, vectors = contour_eigenpairs(v, row["low"], row["high"], row["count"])
                yield pa.RecordBatch.from_arrays([pa.array(list(vectors.T), pa.list_(pa.float64()))], ["vector"])

    jobs = spark.createDataFrame(plan, "low double, high double, count int").repartition(len(plan))
    rows = jobs.mapInArrow(solve, "vector array<double>").collect()  # at most as many vectors as the matrix has rows
    basis, _ = np.linalg.qr(np.array([r["vector"] for r in rows]).T)
    values, mixed = np.linalg.eigh(basis.T @ v @ basis)
    order = np.argsort(-values)[:wanted]
    order = order[values[order] > np.finfo(float).eps * len(v) * np.abs(v).max()]
    vectors = basis @ mixed[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))])
    return values[order], vectors * signs


# --- whitening --------------------------------------------------------------------------------------------------------------

OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(df: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Per sound row of ``df (vec_id, embedding)`` and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    Dropped are null and empty vectors, vectors with null or non-finite entries, and those that have not the table's usual length
    (:func:`sonarium.llm.vectors.sound_vectors`). All other rows are fitted, repeated ones as often as they occur. Components whose
    eigenvalue is zero to rounding cannot be whitened and give no rows, so constant vectors, a single row, or few rows give fewer
    components or none. Equal eigenvalues share their subspace in some order. A deviation beyond 64 bits is null; entries beyond 2**40 are an error. Null ids stay. An
    empty table gives no rows; extra columns are ignored.
    """
    vectors, width = sound_vectors(df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))
    n, sums = count_and_sums(vectors, width) if width else (0, [])
    v = covariance(*second_moments(vectors, width, n, sums), n) if n else np.zeros((0, 0))
    values, directions = leading_components(df.sparkSession, v, components)
    onto = directions / np.sqrt(values)
    wide = len(values)
    explained = values / np.trace(v) if wide else values
    error = float(np.abs(covariance(*second_moments(vectors, width, n, sums, onto), n) - np.eye(wide)).max()) if wide else 0.0

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                batch = whole.slice(at, ROWS)
                y = centred(_shifted(batch, width), n, sums)
                if y.dtype != object and width * int(np.abs(y).max(initial=0)) ** 2 >= 1 << 63:
                    y = y.astype(object)
                deviation = [int(s) if s < 1 << 63 else None for s in (y * y).sum(axis=1)]
                ids = batch.column("vec_id").to_pylist()
                rows = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([i for i in ids for _ in range(wide)], pa.int64()),
                        pa.array(np.tile(np.arange(1, wide + 1, dtype=np.int32), rows)),
                        pa.array(np.full(rows * wide, n, np.int64)),
                        pa.array([s for s in deviation for _ in range(wide)], pa.int64()),
                        pa.array((y.astype(np.float64) / n @ onto).ravel()),
                        pa.array(np.tile(explained, rows)),
                        pa.array(np.full(rows * wide, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return vectors.mapInArrow(project, OUT)
