"""Whitening of embeddings: principal components by Golub-Kahan-Lanczos bidiagonalisation.

The rows, centred, are a tall matrix ``X``. From a start vector ``v``, products ``X v`` and ``Xt u`` by
turns give orthonormal right vectors ``v_j`` and left vectors ``u_j`` with ``X V = U B``, ``B`` upper
bidiagonal; the SVD of the small ``B`` gives the components (right) and deviations of ``X``. Both sides
are orthogonalised anew against all vectors before, in each step.

A left vector has an entry for each row of the table, so it is never stored: it is ``X c`` with a short
``c``, which is exact since left vectors are combinations of ``X v``. One pass over the rows then does a
whole step: each task forms its part of ``w = X p`` and of the left vectors so far, and adds up
``Xt w``, ``Ut w`` and ``wt w``. What leaves a task are ``d + j + 1`` numbers, combined in a shuffle;
the driver holds vectors of the length of a row only, at most ``d`` of each kind.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotline.llm.common import ship
from lotline.llm.vectors import common_length, matrix, of_length, usable
from lotline.storage import keep

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
#: Deviations below this share of the largest are rounding: the rows do not vary in that direction.
LEAST_DEVIATION = 1e-10
#: Entries beyond it have no exact ``x``.
LARGEST = float(2**52)
_ROWS = 4_096

SCHEMA = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Whitening:
    """``n`` fitted rows with sums ``sums``; ``components`` has a unit vector per column, by falling eigenvalue."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def whole(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        return np.array([s % self.n for s in self.sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - sums / n``: the integers are subtracted before anything is rounded."""
        return (x - self.whole).astype(np.float64) - self.rest / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.eigenvalues)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Of each row the sum of ``(n * x - sums) ** 2``, exact; None where it is beyond 63 bits."""
        apart = x - self.whole
        most = float(np.abs(apart).max(initial=0) + 1) * self.n
        if most * most * x.shape[1] < 2.0**62:
            return (((apart * self.n - self.rest) ** 2).sum(axis=1)).tolist()
        rest = self.rest.tolist()
        exact = [sum((self.n * a - r) ** 2 for a, r in zip(row, rest, strict=True)) for row in apart.tolist()]
        return [v if v < 1 << 63 else None for v in exact]


def integral(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, x``: each entry ``c`` as ``floor(64 c) + 1000000``."""
    rows = usable(vectors, id_col, vector_col).where(F.forall("vector", lambda c: F.abs(c) * SCALE < LARGEST))
    return rows.select("vec_id", F.transform("vector", lambda c: F.floor(c * SCALE).cast("bigint") + SHIFT).alias("x"))


def _summed(rows: DataFrame, width: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of what ``part`` gives for a block of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            block = matrix(batch.column(0), width)
            for start in range(0, len(block), _ROWS):
                found = part(block[start : start + _ROWS])
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "value"])

    each = rows.select("x").mapInArrow(run, "i int, value double")
    found = each.groupBy("i").agg(F.sum("value").alias("value")).collect()
    return np.array([r.value for r in sorted(found, key=lambda r: r.i)])


def _sums(rows: DataFrame, width: int) -> tuple[int, ...]:
    """Exact sums by dimension: high and low bits are added by themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high = low = np.zeros(width, np.int64)
        for batch in batches:
            block = matrix(batch.column(0), width)
            high, low = high + (block >> 26).sum(axis=0), low + (block & (1 << 26) - 1).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(high), pa.array(low)], ["i", "high", "low"])

    each = rows.select("x").mapInArrow(run, "i int, high bigint, low bigint")
    exact = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    found = {r.i: (int(r.high) << 26) + int(r.low) for r in each.groupBy("i").agg(*exact).collect()}
    return tuple(found[i] for i in range(width))


def bidiagonalise(
    product: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, float]], width: int, size: float, steps: int | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """``V, B`` after ``steps`` steps, or as many as there are dimensions.

    ``product(C, p)`` gives ``Xt w``, ``Ut w`` and ``wt w`` for ``w = X p`` and ``U = X C``; ``size`` is
    the Frobenius norm of ``X``. Where a step finds nothing new, it goes on with another start vector
    at right angles to those before, so that equal deviations are all found.
    """
    steps = min(width, steps or width)
    random = np.random.Generator(np.random.PCG64(42))
    nothing = size * np.finfo(float).eps * width
    right, left, back = (np.zeros((width, steps)) for _ in range(3))
    bidiagonal = np.zeros((steps, steps))
    fresh, beta = random.standard_normal(width), 0.0
    vector = fresh / np.linalg.norm(fresh)
    for j in range(steps):
        right[:, j] = vector
        p = vector - beta * left[:, j - 1] if j else vector
        product_back, overlaps, square = product(left[:, :j], p)
        c, xu = p - left[:, :j] @ overlaps, product_back - back[:, :j] @ overlaps
        alpha = float(np.sqrt(max(square - overlaps @ overlaps, 0.0)))
        if alpha > nothing:
            left[:, j], back[:, j], bidiagonal[j, j] = c / alpha, xu / alpha, alpha
        if j + 1 == steps:
            break
        vector = back[:, j] - bidiagonal[j, j] * vector
        vector, beta = _at_right_angles(vector, right[:, : j + 1])
        if beta <= nothing:
            fresh, beta = random.standard_normal(width), 0.0
            vector = _at_right_angles(fresh, right[:, : j + 1])[0]
        bidiagonal[j, j + 1] = beta
    return right, bidiagonal


def _at_right_angles(vector: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, float]:
    """The part of ``vector`` at right angles to orthonormal columns, as a unit vector, and its length."""
    for _ in range(2):
        vector = vector - to @ (to.T @ vector)
    length = float(np.linalg.norm(vector))
    return vector / length if length else vector, length


def fit(rows: DataFrame, width: int, components: int = COMPONENTS, steps: int | None = None) -> Whitening | None:
    """The whitening of ``rows``, distinct arrays ``x`` of ``width`` entries in a written table; None if they do not vary.

    Without ``steps`` there are as many as dimensions, which leaves nothing out. With fewer, the
    largest components come first and are as exact as the steps allow.
    """
    ship(rows.sparkSession)
    n = rows.count()
    if not n:
        return None
    base = Whitening(n, _sums(rows, width), np.zeros((width, 0)), np.zeros(0), 0.0)
    square = float(_summed(rows, width, lambda x: np.array([np.square(base.centred(x)).sum()]))[0])
    if square <= 0:
        return None

    def product(left: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        sides = np.column_stack([p, left])

        def part(x: np.ndarray) -> np.ndarray:
            centred = base.centred(x)
            both = centred @ sides
            w = both[:, 0]
            return np.concatenate([centred.T @ w, both[:, 1:].T @ w, [w @ w]])

        found = _summed(rows, width, part)
        return found[:width], found[width:-1], float(found[-1])

    right, bidiagonal = bidiagonalise(product, width, square**0.5, steps)
    _, deviations, turn = np.linalg.svd(bidiagonal)
    count = min(components, int((deviations > LEAST_DEVIATION * deviations[0]).sum()))
    vectors = right @ turn[:count].T
    vectors /= np.linalg.norm(vectors, axis=0)
    found = Whitening(n, base.sums, vectors, deviations[:count] ** 2 / n, square / n)
    return Whitening(n, found.sums, found.components, found.eigenvalues, found.trace, _identity_error(rows, width, found))


def _identity_error(rows: DataFrame, width: int, found: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity."""
    count = len(found.eigenvalues)

    def part(x: np.ndarray) -> np.ndarray:
        white = found.whitened(x)
        return np.concatenate([(white.T @ white).ravel(), white.sum(axis=0)])

    total = _summed(rows, width, part) / found.n
    mean = total[count * count :]
    covariance = total[: count * count].reshape(count, count) - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(count)).max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each usable row and component.

    Rows with a null or empty vector or with a null or non-finite entry drop out, and so do those with an
    entry of 2**46 or more, whose ``x`` is not exact. If vectors differ in length, those of the most
    frequent length take part (the greater of ties). The fit counts each distinct ``x`` once. Rows that
    repeat are whitened each, a null id stays null, other columns are not read. Directions in which the
    rows do not vary are no components: an empty table, or one vector only, gives no rows. ``deviation``
    is null where it does not fit a bigint.
    """
    spark = ship(vectors.sparkSession)
    every = integral(vectors, id_col, vector_col)
    width = common_length(every, "x")
    every = every.where(of_length("x", width))
    found = fit(keep(every.select("x").distinct()), width, components) if width else None
    if found is None:
        return spark.createDataFrame([], SCHEMA)
    count = len(found.eigenvalues)
    explained = found.eigenvalues / found.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                part = batch.slice(start, _ROWS)
                x = matrix(part.column(1), width)
                each = np.repeat(np.arange(len(x)), count)
                columns = [
                    part.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(each), found.n)),
                    pa.array(found.deviations(x), pa.int64()).take(pa.array(each)),
                    pa.array(found.whitened(x).ravel()),
                    pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(len(each), found.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return every.mapInArrow(run, SCHEMA)
