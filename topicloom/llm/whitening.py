"""Whitening of embeddings by the leading eigenvectors of their covariance, found by FEAST contour integration.

Tasks sum integer vectors and centred products; the covariance is a matrix of dimension x dimension whatever the
number of rows. Its leading eigenvalues are bracketed by inertia counts (signs of the pivots of V - s I), cut into
intervals, and each interval's eigenvectors are found by projecting a block of vectors onto the interval with a contour
integral of complex shifted solves, followed by Rayleigh-Ritz. An interval is done when it holds as many Ritz pairs of
small residual as its inertia counts say, so none is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.scale import ship_with_tasks

# An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
NODES = 8  # quadrature points on the upper half of a contour
MOST_INSIDE = 8  # eigenvalues that one contour should enclose
RATIO = 64.0  # upper end of an interval over its lower end
RESIDUAL = 1e-13  # of a Ritz pair, relative to the largest eigenvalue
ROUNDS = 40
ROWS = 4096  # rows that a task holds as numbers
LARGEST = 1 << 53  # entries are kept within this, where doubles are still whole numbers


# Eigenvalues of a symmetric matrix


def inertia_above(v: np.ndarray, shift: float) -> int:
    """Number of eigenvalues of symmetric ``v`` above ``shift``: positive pivots of a symmetric factorisation of v - shift I.

    Pivots are single entries or blocks of two (Bunch and Kaufman), a block counting once above and once below.
    """
    a = v - shift * np.eye(len(v))
    bound = (1 + 17**0.5) / 8
    above = 0
    while len(a):
        if len(a) == 1:
            return above + int(a[0, 0] > 0)
        column = np.abs(a[1:, 0])
        r = int(column.argmax()) + 1
        most, width = column[r - 1], 1
        if abs(a[0, 0]) < bound * most:
            others = np.abs(a[r]).copy()
            others[r] = 0
            if abs(a[0, 0]) * others.max() < bound * most**2:
                if abs(a[r, r]) >= bound * others.max():
                    swap = (0, r)
                else:
                    swap, width = (1, r), 2
                order = np.arange(len(a))
                order[list(swap)] = order[list(swap[::-1])]
                a = a[np.ix_(order, order)]
        rest = a[width:, :width]
        if width == 1:
            above += int(a[0, 0] > 0)
            a = a[1:, 1:] - (np.outer(rest[:, 0], rest[:, 0]) / a[0, 0] if a[0, 0] else 0)
        else:
            above += 1
            a = a[2:, 2:] - rest @ np.linalg.solve(a[:2, :2], rest.T)
    return above


def intervals(v: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """``(low, high, count)`` from the top down: intervals that enclose the ``wanted`` largest eigenvalues of ``v``.

    Eigenvalues below rounding of the largest are left out. Ends are placed by halving, so that no interval holds more than
    ``MOST_INSIDE`` unless they are too close to be told apart.
    """
    top = float(np.abs(v).sum(1).max()) * (1 + 1e-9)
    if top == 0:
        return []
    noise = top * len(v) * np.finfo(float).eps * 4
    wanted = min(wanted, inertia_above(v, noise))

    def split(low: float, high: float, over: int, below: int) -> list[tuple[float, float, int]]:
        """``over`` eigenvalues lie above ``high``, ``below`` above ``low``."""
        count = below - over
        if count == 0 or over >= wanted:
            return []
        close = high - low <= 1e-9 * top
        if close or (count <= MOST_INSIDE and high <= RATIO * low and below <= wanted):
            return [(low, high, count)]
        middle = (low * high) ** 0.5 if high > 4 * low else (low + high) / 2
        between = inertia_above(v, middle)
        return split(middle, high, over, between) + split(low, middle, between, below)

    return split(noise, top, 0, inertia_above(v, noise))


def _orthonormal(block: np.ndarray) -> np.ndarray:
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    return u[:, s > s[0] * 1e-12] if len(s) and s[0] > 0 else block[:, :0]


def feast(v: np.ndarray, low: float, high: float, count: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs of ``v`` with eigenvalues between ``low`` and ``high``, largest first.

    The projector onto the interval is the integral of (z I - v)^-1 around it, by Gauss-Legendre points on a circle through
    both ends; solves at conjugate points are conjugate, so half of the circle is enough.
    """
    d = len(v)
    points, weights = np.polynomial.legendre.leggauss(NODES)
    angles = np.pi / 2 * (1 - points)
    centre, radius = (low + high) / 2, max((high - low) / 2, 1e-9 * high)
    width = min(d, max(count + 4, int(1.5 * count) + 1))
    block = np.random.default_rng(seed).standard_normal((d, width))
    largest = float(np.abs(v).sum(1).max())
    for turn in range(ROUNDS):
        projected = np.zeros_like(block)
        for angle, weight in zip(angles, weights, strict=True):
            z = np.exp(1j * angle)
            solved = np.linalg.solve((centre + radius * z) * np.eye(d) - v, block.astype(complex))
            projected += (weight / 2 * radius * z * solved).real
        base = _orthonormal(projected)
        values, mixed = np.linalg.eigh(base.T @ v @ base)
        vectors = base @ mixed
        small = np.linalg.norm(v @ vectors - vectors * values, axis=0) <= RESIDUAL * d * largest
        inside = (values > low) & (values <= high) & small
        if inside.sum() == count:
            order = np.argsort(-values[inside], kind="stable")
            return values[inside][order], vectors[:, inside][:, order]
        block = vectors
        if turn % 8 == 7 and width < d:  # a block too narrow for what lies close outside
            width = min(d, 2 * width)
            block = np.hstack([vectors, np.random.default_rng(seed + turn).standard_normal((d, width - vectors.shape[1]))])
    raise ArithmeticError(f"{int(inside.sum())} of {count} eigenvalues found between {low} and {high}")


def leading_eigenpairs(v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a covariance and their vectors as columns; fewer if the rank is lower.

    The largest entry of a vector is positive. The vectors of all intervals go through one more Rayleigh-Ritz step together.
    """
    found = [feast(v, *interval) for interval in intervals(v, wanted)]
    if not found:
        return np.zeros(0), np.zeros((len(v), 0))
    base = np.linalg.qr(np.hstack([vectors for _, vectors in found]))[0]
    values, mixed = np.linalg.eigh(base.T @ v @ base)
    order = np.argsort(-values, kind="stable")[:wanted]
    vectors = (base @ mixed)[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(order))])
    return values[order], vectors * signs


# Sums over the rows


@dataclass(frozen=True)
class Whitening:
    """What was fitted: number of rows, sums of the integer vectors, eigenvalues, eigenvectors as columns, trace."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def usable(embeddings: DataFrame, length: int | None = None) -> DataFrame:
    """Rows whose vector is not null, not empty, holds only finite entries, and has the given or else the most common length.

    Of lengths that are equally common the smallest counts.
    """
    v = F.col("embedding")
    finite = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    whole = embeddings.where(v.isNotNull() & (F.size(v) > 0) & finite)
    if length is None:
        most = whole.groupBy(F.size(v).alias("length")).count().orderBy(F.desc("count"), "length").first()
        length = most["length"] if most else 0
    return whole.where(F.size(v) == length)


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Runs of rows as integer vectors, each with its first row."""
    column = batch.column(batch.schema.get_field_index("embedding"))
    for start in range(0, len(column), ROWS):
        part = column.slice(start, ROWS)
        flat = part.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), -1)
        yield start, np.clip(np.floor(SCALE * flat), -LARGEST, LARGEST).astype(np.int64) + SHIFT


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n, the whole part subtracted as integers."""
    return (x - sums // n) - (sums % n) / n


def _sums(rows: DataFrame) -> tuple[int, np.ndarray]:
    def task(batches):
        n, total = 0, None
        for batch in batches:
            for _, x in _vectors(batch):
                n += len(x)
                total = x.sum(0) + (0 if total is None else total)
        if n:
            place = pa.array(np.arange(len(total)), pa.int32())
            yield pa.RecordBatch.from_arrays([place, pa.array(total), pa.array(np.full(len(total), n))], ["dim", "s", "n"])

    parts = rows.select("embedding").mapInArrow(task, "dim int, s long, n long")
    found = parts.groupBy("dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).orderBy("dim").collect()
    return (found[0]["n"] if found else 0), np.array([int(r["s"]) for r in found], dtype=np.int64)


def _products(rows: DataFrame, of) -> np.ndarray:
    """Sum of outer products of the rows that ``of`` makes of integer vectors; a task sends one matrix."""

    def task(batches):
        total = None
        for batch in batches:
            for _, x in _vectors(batch):
                y = of(x)
                total = y.T @ y + (0 if total is None else total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(list(total))], ["dim", "p"])

    parts = rows.select("embedding").mapInArrow(task, "dim int, p array<double>")
    summed = parts.groupBy("dim").agg(vector_to_array(Summarizer.sum(array_to_vector(F.col("p")))).alias("p"))
    return np.array([r["p"] for r in summed.orderBy("dim").collect()])


def fit(embeddings: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Leading eigenpairs of the covariance (divisor n, centred before multiplying) of all usable rows; None without rows.

    Two passes over the rows. The driver holds matrices of dimension x dimension, no rows.
    """
    rows = usable(embeddings)
    n, sums = _sums(rows)
    if n == 0:
        return None
    raw = _products(rows, lambda x: _centred(x, n, sums))
    covariance = (raw + raw.T) / (2 * n)
    return Whitening(n, sums, *leading_eigenpairs(covariance, components), float(np.trace(covariance)))


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """Sum of (n x - S)^2 by row, exact: in 64 bits where that is enough, else in Python's integers."""
    most = float(np.abs(x.astype(np.float64) * n - sums).max(initial=0))
    exact = x if most**2 * x.shape[1] < 2**62 and n * float(np.abs(x).max(initial=0)) < 2**62 else x.astype(object)
    return ((n * exact - sums) ** 2).sum(1)


def whiten(embeddings: DataFrame, fitted: Whitening) -> DataFrame:
    """Usable rows with ``deviation`` (exact; null if it does not fit 64 bits) and ``whitened``, one entry per component.

    All columns of the input are kept, so repeated rows stay repeated.
    """
    rows = usable(embeddings, len(fitted.sums))
    carried = F.struct(*[c for c in embeddings.columns if c not in ("deviation", "whitened")]).alias("row")
    shared = embeddings.sparkSession.sparkContext.broadcast(fitted)

    def task(batches):
        m = shared.value
        scale = m.vectors / np.sqrt(m.values)
        for batch in batches:
            for start, x in _vectors(batch):
                fits = [d if d < 2**63 else None for d in _deviations(x, m.n, m.sums).tolist()]
                made = _centred(x, m.n, m.sums) @ scale
                columns = [batch.column(0).slice(start, len(x)), pa.array(fits, pa.int64()), pa.array(list(made), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, ["row", "deviation", "whitened"])

    given = rows.select(carried, "embedding")
    schema = T.StructType([given.schema["row"], *T._parse_datatype_string("deviation long, whitened array<double>").fields])
    return given.mapInArrow(task, schema).select("row.*", "deviation", "whitened")


def identity_error(embeddings: DataFrame, fitted: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened rows minus the identity; 0.0 without components."""
    k = len(fitted.values)
    if k == 0:
        return 0.0
    scale = fitted.vectors / np.sqrt(fitted.values)
    n, sums = fitted.n, fitted.sums
    products = _products(usable(embeddings, len(sums)), lambda x: _centred(x, n, sums) @ scale)
    return float(np.abs(products / n - np.eye(k)).max())


def whitened_components(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per usable row and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    Null ids and repeated rows stay as they are. Components whose eigenvalue is zero up to rounding are left out, so a table
    of equal vectors, or an empty one, gives no rows. Vectors are compared by length as in :func:`usable`.
    """
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    fitted = fit(embeddings, components)
    if fitted is None or len(fitted.values) == 0:
        empty = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return embeddings.sparkSession.createDataFrame([], empty)
    explained = F.array(*[F.lit(float(e / fitted.trace)) for e in fitted.values])
    error = identity_error(embeddings, fitted)
    rows = whiten(embeddings.select("vec_id", "embedding"), fitted)
    long = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return long.select(
        "vec_id",
        (F.col("place") + 1).cast("int").alias("component"),
        F.lit(fitted.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(explained, F.col("place") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


ship_with_tasks(__name__)
