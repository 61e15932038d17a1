"""Whitening of embeddings: distributed covariance, mixed-precision eigenvectors.

The covariance is gathered on Spark, as partial sums per task and pair of dimensions; only it, whose
size is that of the vectors' dimension squared, comes to the driver. Its eigenvectors are
computed in float32 and corrected by iterations that consist of matrix
products in higher precision (Ogita and Aishima 2018); eigenvalues too close
for that are told apart by eigenproblems of their own (Ogita and Aishima 2019).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import arrow_rows, landed, long_id, with_null_ids
from .registry import query

SCALE = 256
COMPONENTS = 4
ITERATIONS = 30
CHUNK = 4096  # vectors handled at a time


def usable(vector: Column) -> Column:
    """The vector holds numbers only: not null, not empty, no null, infinite or NaN entry."""
    doubles = vector.cast("array<double>")
    odd = F.exists(doubles, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(odd, F.lit(False))


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """Entries as whole numbers, floor(scale * c)."""
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(c * scale))


# ---- eigenvectors -----------------------------------------------------------


def cut(matrix: np.ndarray, bits: int) -> list[np.ndarray]:
    """Doubles that add up to the matrix, each with at most ``bits`` bits below its row's leading one."""
    parts, rest = [], matrix
    for _ in range(-(-64 // bits)):
        top = np.abs(rest).max(axis=1, keepdims=True)
        unit = np.exp2(np.ceil(np.log2(np.where(top > 0, top, 1))) - bits)
        parts.append((np.rint(rest / unit) * unit).astype(np.float64))
        rest = rest - parts[-1]
    return parts


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b in extended precision, as products of doubles that are exact (Ozaki and others 2012)."""
    bits = (53 - max(1, len(b)).bit_length()) // 2
    left, right = cut(a, bits), [p.T for p in cut(b.T, bits)]
    total = np.zeros((len(a), b.shape[1]), np.longdouble)
    for i in reversed(range(len(left))):  # small ones first
        for j in reversed(range(len(right) - i)):
            total += left[i] @ right[j]
    return total


EQUAL = 8 * float(np.finfo(np.float64).eps)  # eigenvalues this close, next to the greatest entry, count as equal


def corrected(matrix: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """One step of Ogita and Aishima: (better vectors, eigenvalues, size of the correction, resolution).

    ``vectors`` need neither be orthogonal nor exact. R is what they lack of orthogonality, S the matrix
    in their coordinates; both give the correction of each pair of vectors to first
    order. Pairs whose eigenvalues differ by less than the resolution are only made orthogonal.
    """
    n = len(matrix)
    lack = np.eye(n) - product(vectors.T, vectors)
    seen = product(vectors.T, product(matrix, vectors))
    values = np.diag(seen) / (1 - np.diag(lack))
    off = seen - np.diag(np.diag(seen))
    resolution = 2 * (np.sqrt((off**2).sum()) + np.abs(values).max() * np.sqrt((lack**2).sum()))
    resolution = max(float(resolution), EQUAL)
    gaps = values[None, :] - values[:, None]
    apart = np.abs(gaps) > resolution
    step = np.where(apart, (seen + values[None, :] * lack) / np.where(apart, gaps, 1), lack / 2)
    return vectors + product(vectors, step), values, float(np.abs(step).max()), resolution


def clusters(values: np.ndarray, resolution: float) -> Iterator[np.ndarray]:
    """Indices of eigenvalues that neighbours closer than ``resolution`` connect, two or more."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > resolution) + 1
    yield from (c for c in np.split(order, cuts) if len(c) > 1)


def eigen(matrix: np.ndarray, iterations: int = ITERATIONS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues by falling size, unit eigenvectors as columns) of a symmetric matrix, to double precision.

    Starts from float32 eigenvectors and corrects them in extended precision until
    a step is below what a double shows or gets no smaller. Steps converge
    quadratically where eigenvalues are apart. Those that aren't form clusters: the matrix, less the
    cluster's mean, is seen in the cluster's own vectors, where the small differences
    are all there is, its float32 eigenvectors turn the cluster, and the iteration goes on.
    Within equal eigenvalues any orthonormal vectors are right.
    """
    wide = np.asarray(matrix, np.longdouble)
    size = float(np.abs(wide).max(initial=0))
    if size == 0:
        return np.zeros(len(wide)), np.eye(len(wide))
    wide = wide / size
    vectors = np.linalg.eigh(wide.astype(np.float32))[1].astype(np.longdouble)
    last, turned = np.inf, True
    for k in range(iterations):
        vectors, values, step, resolution = corrected(wide, vectors)
        if step < EQUAL / 64 or (not turned and step < 1e-8 and step > last / 4):
            break
        last, turned = step, False
        # The last steps only correct, as what no sub-solve has told apart by then is equal.
        for c in clusters(values, resolution) if 2 * k < iterations else ():
            own = vectors[:, c]
            inner = product(own.T, product(wide, own)) - values[c].mean() * product(own.T, own)
            spread = float(np.abs(inner).max())
            if spread > EQUAL:
                turn = np.linalg.eigh(((inner + inner.T) / (2 * spread)).astype(np.float32))[1]
                vectors[:, c] = product(own, turn.astype(np.longdouble))
                turned = True
    values = np.diag(product(vectors.T, product(wide, vectors))) / (vectors**2).sum(axis=0)
    vectors = vectors / np.sqrt((vectors**2).sum(axis=0))
    order = np.argsort(-values, kind="stable")
    return (values[order] * size).astype(np.float64), vectors[:, order].astype(np.float64)


# ---- sums over all rows -----------------------------------------------------


def matrix_of(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors of whole numbers of a batch, as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, dims)


def task_sums(rows: DataFrame, dims: int, fn, width: int) -> np.ndarray:
    """Sum over all rows of the arrays ``fn(vectors)`` of ``width`` doubles; a task sends one array, as (place, value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = fn(matrix_of(batch.column(0).slice(at, CHUNK), dims))
                total = part if total is None else total + part
        if total is not None:
            yield {"place": np.arange(width), "value": total}

    schema = pa.schema([("place", pa.int64()), ("value", pa.float64())])
    sums = rows.select("x").mapInArrow(arrow_rows(run, schema), "place long, value double").groupBy("place").agg(F.sum("value").alias("value"))
    out = np.zeros(width)
    for place, value in sums.collect():  # as many as ``width``, however many rows
        out[place] = value
    return out


def exact_sums(rows: DataFrame, dims: int) -> tuple[int, list[int]]:
    """(number of rows, sum of each dimension) as whole numbers of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total = [0] * (dims + 1)
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                x = matrix_of(batch.column(0).slice(at, CHUNK), dims)
                # High and low halves apart, so that no sum of a chunk leaves 64 bits.
                part = [(int(h) << 32) + int(low) for h, low in zip((x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0))]
                total = [a + b for a, b in zip(total, [len(x), *part])]
        yield {"place": np.arange(dims + 1), "value": [Decimal(t) for t in total]}

    schema = pa.schema([("place", pa.int64()), ("value", pa.decimal128(38, 0))])
    parts = rows.select("x").mapInArrow(arrow_rows(run, schema), "place long, value decimal(38,0)")
    by_place = {r.place: int(r.value) for r in parts.groupBy("place").agg(F.sum("value").alias("value")).collect()}
    return by_place.get(0, 0), [by_place.get(i + 1, 0) for i in range(dims)]


@dataclass
class Whitening:
    """What was fitted: n vectors, their exact sums per dimension, eigenvalues and unit eigenvectors (columns), trace."""

    dims: int
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def centre(self) -> np.ndarray:
        return np.array([float(Fraction(s, self.n)) for s in self.sums])

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Whole-number vectors to whitened coordinates."""
        return (x - self.centre) @ (self.vectors / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Per row the sum over dimensions of (n * x - sum) ** 2, exactly; raises if that exceeds 64 bits."""
        rough = ((float(self.n) * x - np.array(self.sums, np.float64)) ** 2).sum(axis=1)
        if len(rough) and rough.max() > 2.0**61:
            return np.array([sum((self.n * int(v) - s) ** 2 for v, s in zip(row, self.sums)) for row in x], object)
        moved = self.n * x - np.array(self.sums, np.int64)
        return (moved * moved).sum(axis=1)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit on ``vectors`` (x: array of long), which hold each vector once; None without rows.

    Sums are exact. Rows are centred before they are multiplied. At most ``components`` are
    kept, and none whose eigenvalue is 0 up to rounding.
    """
    first = vectors.select(F.size("x").alias("d")).first()
    if first is None:
        return None
    dims = first.d
    n, sums = exact_sums(vectors, dims)
    centre = np.array([float(Fraction(s, n)) for s in sums])
    upper = np.triu_indices(dims)

    def scatter(x: np.ndarray) -> np.ndarray:
        moved = x - centre
        return (moved.T @ moved)[upper]

    covariance = np.zeros((dims, dims))
    covariance[upper] = task_sums(vectors, dims, scatter, len(upper[0])) / n
    covariance = covariance + np.triu(covariance, 1).T
    values, axes = eigen(covariance)
    held = values[:components] > dims * np.finfo(np.float64).eps * max(values[0], 0)
    kept = int(held.sum())
    return Whitening(dims, n, sums, values[:kept], axes[:, :kept], float(np.trace(covariance)))


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance less the identity, from all of ``vectors``."""
    k = len(model.values)

    def products(x: np.ndarray) -> np.ndarray:
        z = model.whiten(x)
        return np.concatenate([z.sum(axis=0), (z.T @ z).ravel()])

    sums = task_sums(vectors, model.dims, products, k + k * k) / model.n
    covariance = sums[k:].reshape(k, k) - np.outer(sums[:k], sums[:k])
    return float(np.abs(covariance - np.eye(k)).max(initial=0.0))


def whitened(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE
) -> DataFrame:
    """One row per usable row of ``df`` and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Entries become whole numbers x = floor(scale * c). The fit covers each distinct vector once: n vectors with sums S per
    dimension. Component j is the unit eigenvector of their covariance (divisor n) with the j-th
    greatest eigenvalue e, of either sign. ``whitened`` is (x - S / n) on it over sqrt(e), ``deviation`` the sum of
    (n * x - S) ** 2, ``explained`` e / trace, ``identity_error`` how far the whitened covariance is off.

    Vectors that are null, empty or hold null or non-finite entries are left out, and so are those of another
    length than most have (of equally many, the greater length). Repeated vectors count once in the fit and all come out; rows that repeat an id
    are separate, a null id stays null. Components with eigenvalue 0 (all, if only one vector is left) have
    no rows; an empty table gives none. Only the two named columns are read.
    """
    spark = df.sparkSession
    rows = df.where(usable(F.col(vector_col))).select(long_id(id_col).alias("vec_id"), quantised(F.col(vector_col), scale).alias("x"))
    rows = landed(rows, "whole-vectors")
    common = rows.groupBy(F.size("x").alias("d")).count().agg(F.max(F.struct("count", "d")).alias("most")).first()
    kinds = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if common.most is None:
        return spark.range(0).select(*[F.lit(None).cast(k.split()[1]).alias(k.split()[0]) for k in kinds.split(", ")])
    rows = rows.where(F.size("x") == common.most.d)
    distinct = landed(rows.select("x").distinct(), "distinct-vectors")
    model = fit(distinct, components)
    error = identity_error(distinct, model)
    schema = pa.schema([
        ("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
        ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        k = len(model.values)
        for batch in batches:
            for at in range(0, batch.num_rows if k else 0, CHUNK):
                part = batch.slice(at, CHUNK)
                x = matrix_of(part.column(1), model.dims)
                m = len(x)
                yield {
                    "vec_id": np.repeat(part.column(0).to_numpy(zero_copy_only=False), k),
                    "component": np.tile(np.arange(1, k + 1, dtype=np.int32), m), "n": np.full(m * k, model.n),
                    "deviation": np.repeat(model.deviation(x), k), "whitened": model.whiten(x).ravel(),
                    "explained": np.tile(model.values / model.trace, m), "identity_error": np.full(m * k, error),
                }

    return with_null_ids(rows.mapInArrow(arrow_rows(run, schema), kinds), "vec_id")


@query("op12_refined_whitening")
def op12_refined_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
