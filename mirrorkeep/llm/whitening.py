"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The covariance matrix is never formed. A pass over the vectors turns a thin block Q into Xᵀ(XQ) / n, with X centred: tasks
multiply their rows, Spark adds up what they have by dimension, and only a matrix as small as Q comes to the driver. A round filters the block
by a Chebyshev polynomial in the covariance, one pass for each degree: it stays small on the unwanted part of the spectrum, up to the
smallest value the block has found, and grows fast above. Where that part begins is 0 in the first round, and then what a few Lanczos steps,
which share the passes of that round, say with certainty. After the filter the block is made orthonormal (QR), and one more pass gives the best
vectors within it (Rayleigh-Ritz) and their residuals. Rounds end when every wanted component is certified: its
residual is within ``TOLERANCE`` of its eigenvalue, or as near to that as doubles come.

A block has more columns than components are wanted, so the values that the filter has to part are far apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorkeep.common import materialize

# An entry c becomes floor(SCALE * c) + SHIFT.
SCALE = 1024
SHIFT = 100_000
COMPONENTS = 8
# Columns of the block for each component wanted, degree of the filter, and rounds after which the search is given up.
OVERSAMPLING = 4
DEGREE = 8
MAX_ROUNDS = 60
# Share of an eigenvalue that its residual may have; share that is enough where a round no longer improves it; share
# of the whole variance below which a direction counts as having none.
TOLERANCE = 1e-13
ROUNDED = 1e-10
NO_VARIANCE = 1e-12
# Rows that a task multiplies at a time.
TOGETHER = 8192
# Entries whose exact sums stay within 64 bits.
SAFE = 2.0**62


@dataclass(frozen=True)
class Spectrum:
    """The leading components of a covariance: size of the fit list, sums by dimension, eigenvalues, vectors (columns), trace, rounds needed."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    rounds: int


def integer_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, x of the rows of ``embeddings`` (vec_id, embedding) whose vector is whole: neither null nor with null or non-finite entries."""
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = rows.where(F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(False)))
    return whole.select("vec_id", F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT).alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a column of lists of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for start in range(0, len(batch), TOGETHER):
            part = batch.slice(start, TOGETHER)
            yield part, matrix(part.column(column))


def added(rows: DataFrame, width: int, partial) -> np.ndarray:
    """The sum over all rows of ``partial``, a function of a block of x with a matrix of ``width`` columns as its result.

    Every task adds up its own rows; the matrices of the tasks are added by their rows in Spark.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in blocks(batches, 0):
            part = partial(x)
            total = part if total is None else total + part
        if total is not None:
            columns = [pa.array(np.arange(len(total)), pa.int32()), *(pa.array(np.ascontiguousarray(c)) for c in total.T)]
            yield pa.RecordBatch.from_arrays(columns, ["i", *(f"c{k}" for k in range(width))])

    fields = ", ".join(["i int", *(f"c{k} double" for k in range(width))])
    found = rows.select("x").mapInArrow(sums, fields).groupBy("i").agg(*(F.sum(f"c{k}").alias(f"c{k}") for k in range(width)))
    return found.orderBy("i").drop("i").toPandas().to_numpy(dtype=float).reshape(-1, width)


def covariance_times(rows: DataFrame, n: int, mean: np.ndarray, q: np.ndarray) -> np.ndarray:
    """V Q, for the covariance V (divisor n) of the rows: one pass."""

    def partial(x: np.ndarray) -> np.ndarray:
        centred = x - mean
        return centred.T @ (centred @ q)

    return added(rows, q.shape[1], partial) / n


def filtered(apply, q: np.ndarray, low: float, high: float, top: float, degree: int) -> np.ndarray:
    """Chebyshev polynomial of V times the block, scaled by its size at ``top``: small on [low, high], growing above."""
    centre, half = (high + low) / 2, (high - low) / 2
    scale = half / (top - centre)
    first = scale
    before, now = q, (apply(q) - centre * q) * (scale / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - scale)
        before, now = now, (apply(now) - centre * now) * (2 * following / half) - scale * following * before
        scale = following
    return now


class LowerEnd:
    """Lanczos steps on one vector beside the columns of a block, for a lower bound of the spectrum."""

    def __init__(self, start: np.ndarray):
        self.basis = [start / np.linalg.norm(start)]
        self.images: list[np.ndarray] = []

    def along(self, apply, block: np.ndarray) -> np.ndarray:
        both = apply(np.column_stack([block, self.basis[-1]]))
        self.images.append(both[:, -1])
        rest = both[:, -1]
        for _ in range(2):
            rest = rest - sum(v * (v @ rest) for v in self.basis)
        size = np.linalg.norm(rest)
        # A space that the covariance maps onto itself ends the steps.
        self.basis.append(rest / size if size > NO_VARIANCE * np.linalg.norm(both[:, -1]) else self.basis[-1])
        return both[:, :-1]

    def bound(self) -> float:
        """The least value found, less its residual and as much again."""
        v, image = np.column_stack(self.basis[: len(self.images)]), np.column_stack(self.images)
        small = v.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        residual = np.linalg.norm(image @ turn[:, 0] - v @ turn[:, 0] * values[0])
        return max(0.0, float(values[0] - 2 * residual))


def spectrum(rows: DataFrame, components: int = COMPONENTS, oversampling: int = OVERSAMPLING, degree: int = DEGREE, seed: int = 1) -> Spectrum | None:
    """The leading components of the written table ``rows`` (x); none if it has no rows or no entries.

    Directions without variance are no components, so fewer than ``components`` may come out.
    """
    totals = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"))
    found = sorted(totals.collect())
    if not found:
        return None
    n, sums = found[0]["n"], [int(r["s"]) for r in found]
    size = len(sums)
    # Sums are exact; the mean is the nearest double.
    mean = np.array([s / n for s in sums])
    trace = float((added(rows, 1, lambda x: ((x - mean) ** 2).sum(axis=0)[:, None]) / n).sum())
    if trace == 0.0:
        return Spectrum(n, sums, np.empty(0), np.empty((size, 0)), 0.0, 0)
    width = min(size, max(components * oversampling, components + 8))
    wanted = min(components, size)

    def apply(q: np.ndarray) -> np.ndarray:
        return covariance_times(rows, n, mean, q)

    dice = np.random.default_rng(seed)
    q = np.linalg.qr(dice.standard_normal((size, width)))[0]
    bottom = LowerEnd(dice.standard_normal(size))
    low, before = 0.0, np.inf
    for count in range(MAX_ROUNDS + 1):
        product = apply(q)
        projected = q.T @ product
        values, turn = np.linalg.eigh((projected + projected.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors = q @ turn
        residual = np.linalg.norm(product @ turn - vectors * values, axis=0)
        has = values[:wanted] > NO_VARIANCE * trace
        worst = max((residual[:wanted][has] / values[:wanted][has]).tolist(), default=0.0)
        if worst <= TOLERANCE or (worst <= ROUNDED and 2 * worst > before):
            return Spectrum(n, sums, values[:wanted][has], vectors[:, :wanted][:, has], trace, count)
        before = worst
        # A value below the bound would show that it is none, as the filter grows there too.
        low = 0.0 if values[-1] <= low else low
        high = max(values[-1], NO_VARIANCE * trace)
        top = max(values[0], high * (1 + 1e-6))
        if count:
            block = filtered(apply, vectors, low, high, top, degree)
        else:
            block = filtered(lambda x: bottom.along(apply, x), vectors, low, high, top, degree)
            low = bottom.bound()
        q = np.linalg.qr(block)[0]
    raise ArithmeticError(f"no certified components after {MAX_ROUNDS} rounds")


def exact_deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - S)^2 of each row, exact; none where it needs more than 64 bits."""
    largest = max(abs(n * int(x.max()) - min(sums)), abs(n * int(x.min()) - max(sums))) if x.size else 0
    if float(largest) ** 2 * max(x.shape[1], 1) < SAFE and n * (abs(int(x.max(initial=0))) + 1) < SAFE:
        return ((n * x - np.array(sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
    plain = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [d if d < 1 << 63 else None for d in plain]


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each whole vector and component.

    Rows whose vector is null or holds a null or non-finite entry are left out, and so are those whose number of entries is not the
    commonest one of the table (of equally common ones, the largest). Rows may repeat and vec_id be null: each row counts and is returned. Directions without
    variance are no components; a table without rows, entries or variance gives no rows. ``deviation`` is null where it exceeds 64 bits. Further columns are not read.
    """
    spark = embeddings.sparkSession
    id_type = embeddings.schema["vec_id"].dataType.simpleString()
    fields = f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = integer_vectors(embeddings)
    sizes = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if sizes is None or sizes["size"] == 0:
        return spark.createDataFrame([], fields)
    rows = materialize(rows.where(F.size("x") == sizes["size"]), "integer-vectors")
    found = spectrum(rows, components)
    if found is None or not len(found.values):
        return spark.createDataFrame([], fields)
    n, sums, k = found.n, found.sums, len(found.values)
    mean = np.array([s / n for s in sums])
    onto = found.vectors / np.sqrt(found.values)
    # Whitened values are centred by the mean of what they are in doubles, which is 0 but for rounding.
    moments = added(rows, k + 1, lambda x: (lambda w: np.hstack([w.T @ w, w.sum(axis=0)[:, None]]))((x - mean) @ onto)) / n
    covariance = moments[:, :k] - np.outer(moments[:, k], moments[:, k])
    error = float(np.abs(covariance - np.eye(k)).max())
    explained = found.values / found.trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in blocks(batches, 1):
            whitened = (x - mean) @ onto
            repeat = pa.array(np.repeat(np.arange(len(x)), k))
            deviation = pa.array(exact_deviation(x, n, sums), pa.int64())
            columns = [
                pc.take(part.column(0), repeat),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(x) * k, n)),
                pc.take(deviation, repeat),
                pa.array(whitened.ravel()),
                pa.array(np.tile(explained, len(x))),
                pa.array(np.full(len(x) * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in fields.split(", ")])

    return rows.mapInArrow(project, fields)
