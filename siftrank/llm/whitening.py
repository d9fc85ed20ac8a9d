"""Principal components and whitening by shifted CholeskyQR: a few passes of Gram matrices over rows that stay in place.

Entries are scaled to whole numbers, and each distinct vector counts once.  With
the centred vectors as rows of C:

1. a pass sums C'C; its Cholesky factor R1, with a shift that keeps the matrix
   positive, makes the rows of C nearly orthogonal: Q = C / R1;
2. further passes sum Q'Q with Q solved row by row through all factors so far,
   and add one factor, until Q is orthonormal where C has a component at all;
3. the product R of the factors has the singular values and right vectors of C,
   so its SVD on the driver gives the components.  Unlike an eigenvalue of C'C a
   singular value of R keeps small components to double precision.

What travels are matrices of the vectors' dimension, one per task, merged a few
at a time; the driver and the tasks hold factors of that size and no vectors.
Sums are of whole numbers, exact at any order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftrank.llm.common import bound_batches, merged_state, named, tidy
from siftrank.scratch import materialize

PASSES = 12             # of Gram matrices; three do for vectors in general position
BLOCK_ROWS = 4096       # rows multiplied at once
ROUNDING = np.finfo(np.float64).eps / 2


def whole_vectors(vectors: DataFrame, scale: int, vec_id: str, embedding: str) -> DataFrame:
    """(id, x) of the rows whose vector has finite entries only, x being the floors of the scaled entries."""
    v = named(vectors, embedding)
    rows = vectors.select(named(vectors, vec_id).alias("id"), F.transform(v, lambda c: c.cast("double")).alias("v"))
    good = F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.filter(F.coalesce(good, F.lit(False)))
    return rows.select("id", F.transform("v", lambda c: F.floor(c * F.lit(float(scale))).cast("long")).alias("x"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of lists of ``width`` whole numbers as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, width)


@dataclass
class Centre:
    """Number and sums of the fit list, and how to subtract its mean without loss."""

    n: int
    sums: np.ndarray  # long

    def __post_init__(self) -> None:
        self.near = np.array([round(s / self.n) for s in self.sums.tolist()], dtype=np.int64)
        self.rest = self.sums - self.n * self.near  # what the rounded mean leaves, at most about n / 2

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean: a whole number less a fraction."""
        return (x - self.near).astype(np.float64) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Exact sum of (n * x - sum)^2 over the dimensions."""
        far = np.abs(x - self.near).max(initial=0)
        if x.shape[1] * ((int(far) + 1) * self.n) ** 2 < 1 << 63:
            apart = self.n * (x - self.near) - self.rest
            return np.einsum("ij,ij->i", apart, apart)
        exact = [sum((self.n * a - b) ** 2 for a, b in zip(row, self.sums.tolist())) for row in x.tolist()]
        if max(exact, default=0) >= 1 << 63:
            raise OverflowError("a deviation is beyond a long")
        return np.array(exact, dtype=np.int64)


def solved(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """Q with Q * (last factor * ... * first factor) = rows, by one triangular solve per factor."""
    for factor in factors:
        out = np.empty_like(rows)
        for j in range(rows.shape[1]):
            out[:, j] = (rows[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
        rows = out
    return rows


def add_all(states: list[bytes]) -> bytes:
    total = np.frombuffer(states[0], dtype=np.float64).copy()
    for state in states[1:]:
        total += np.frombuffer(state, dtype=np.float64)
    return total.tobytes()


def gram(fit: DataFrame, centre: Centre, columns: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """Sum of the products of the columns that ``columns`` makes of the centred rows."""
    dims = len(centre.sums)

    def sum_up(batches: Iterator[pa.RecordBatch]) -> bytes:
        total = np.zeros((width, width))
        for batch in batches:
            x = matrix(batch.column(0), dims)
            for at in range(0, len(x), BLOCK_ROWS):
                some = columns(centre.centred(x[at:at + BLOCK_ROWS]))
                total += some.T @ some
        return total.tobytes()

    return np.frombuffer(merged_state(fit, sum_up, add_all, "gram"), dtype=np.float64).reshape(width, width)


def centre_of(fit: DataFrame, dims: int) -> Centre:
    """Number and sums of the distinct vectors; their bounds tell whether the sums fit a long."""
    def sum_up(batches: Iterator[pa.RecordBatch]) -> bytes:
        state = np.zeros((4, dims), dtype=np.int64)
        state[2], state[3] = np.iinfo(np.int64).max, np.iinfo(np.int64).min
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0), dims)
                state[0] += len(x)
                state[1] += x.sum(axis=0)
                state[2], state[3] = np.minimum(state[2], x.min(axis=0)), np.maximum(state[3], x.max(axis=0))
        return state.tobytes()

    def merge(states: list[bytes]) -> bytes:
        all_ = np.stack([np.frombuffer(s, dtype=np.int64).reshape(4, dims) for s in states])
        return np.stack([all_[:, 0].sum(axis=0), all_[:, 1].sum(axis=0), all_[:, 2].min(axis=0), all_[:, 3].max(axis=0)]).tobytes()

    state = np.frombuffer(merged_state(fit, sum_up, merge, "sums"), dtype=np.int64).reshape(4, dims)
    centre = Centre(int(state[0, 0]), state[1])
    furthest = max(abs(int(v)) for v in (state[2].min(), state[3].max()))
    if furthest * centre.n >= 1 << 63:
        raise OverflowError("the sum of a dimension is beyond a long")
    return centre


def cholesky(square: np.ndarray, shift: float) -> np.ndarray:
    """Upper factor; the shift grows until the matrix is positive."""
    dims = len(square)
    least = dims * ROUNDING * np.linalg.norm(square, 2)
    for _ in range(40):
        try:
            return np.linalg.cholesky(square + shift * np.eye(dims)).T
        except np.linalg.LinAlgError:
            shift = max(10 * shift, least)
    raise np.linalg.LinAlgError("no shift makes the Gram matrix positive")


def components_of(fit: DataFrame, centre: Centre) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of the centred rows, falling, and their unit right vectors as columns; directions without any spread left out."""
    dims = len(centre.sums)
    factors: list[np.ndarray] = []
    whole = np.eye(dims)
    for number in range(PASSES):
        square = gram(fit, centre, lambda rows: solved(rows, factors), dims)
        shift = 0.0
        if number == 0:
            spread = np.linalg.norm(square, 2)
            if not spread:
                return np.zeros(0), np.zeros((dims, 0))
            shift = 11 * dims * (min(centre.n, BLOCK_ROWS) + dims + 1) * ROUNDING * spread
        else:
            left, values, right = np.linalg.svd(whole)
            real = values > 64 * dims * ROUNDING * values[0]
            off = left[:, real].T @ square @ left[:, real] - np.eye(int(real.sum()))
            if np.abs(off).max() <= 1e-13 * dims:
                vectors = right[real].T
                turn = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
                return values[real], vectors * turn
        factors.append(cholesky(square, shift))
        whole = factors[-1] @ whole
    raise np.linalg.LinAlgError("the rows did not become orthogonal")


def whiten(vectors: DataFrame, components: int = 4, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each usable row and leading component.

    Rows whose vector is null or holds a null or non-finite entry are left out,
    and so are vectors of another length than the most frequent one (of equally
    frequent ones the longest), which have no place in one covariance.  The
    others' entries become x = floor(scale * entry).  The covariance is that of
    the ``n`` distinct x, so copies weigh nothing, however many there are; all
    rows get values.  ``deviation`` is the exact sum over dimensions of
    (n * x - sum)^2, ``explained`` the component's share of the variance, and
    ``identity_error`` the largest entry of the whitened covariance less the
    identity, measured by a pass of its own.  Components come by falling
    variance, the largest entry of each is positive, and a direction without
    variance is no component: equal vectors alone, or an empty table, give no
    rows.  Null ids stay null; repeated ids have rows of their own.
    """
    bound_batches(vectors)
    rows = whole_vectors(vectors, scale, vec_id, embedding)
    kind = rows.schema["id"].dataType.simpleString()
    out = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    lengths = rows.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if not lengths or not lengths["dims"]:
        return rows.sparkSession.createDataFrame([], out)
    dims = lengths["dims"]
    rows = rows.filter(F.size("x") == dims)
    fit = materialize(rows.select("x").distinct(), "fit_list")
    centre = centre_of(fit, dims)
    spreads, axes = components_of(fit, centre)
    values = spreads ** 2 / centre.n
    top = min(components, len(values))
    if not top:
        return rows.sparkSession.createDataFrame([], out)
    turn = axes[:, :top] / np.sqrt(values[:top])
    shares = values[:top] / values.sum()
    error = float(np.abs(gram(fit, centre, lambda c: c @ turn, top) / centre.n - np.eye(top)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), dims)
            white = centre.centred(x) @ turn
            own = pa.array(np.repeat(np.arange(len(x)), top), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(own), pa.array(np.tile(np.arange(1, top + 1), len(x)), pa.int32()),
                 pa.array(np.full(len(own), centre.n), pa.int64()), pa.array(np.repeat(centre.deviation(x), top), pa.int64()),
                 pa.array(white.ravel()), pa.array(np.tile(shares, len(x))), pa.array(np.full(len(own), error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(tidy(project), out)
