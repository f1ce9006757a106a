"""Whitened embeddings: leading principal components of whole-number vectors, each row projected to unit variance.

A component c becomes ``floor(scale * c)``.  The model is fitted to the distinct vectors: exact sums, then the covariance,
centred on the rounded means before multiplying and summed as whole numbers, so that the model is the same under any
partitioning.  Tasks give sums over their rows; the driver gets one number per pair of dimensions and finds the leading
eigenvectors there: Householder reflections to tridiagonal form, bisection on Sturm counts for the eigenvalues, inverse
iteration for the vectors, with those of close eigenvalues made orthogonal to each other in every step.  Mean and
components travel to the tasks, which project their rows.

Size: the driver and a task hold a few squares of the width of the vectors, whatever the number of rows.

Defined results: rows whose vector is null or holds null or non-finite entries go; a shorter vector counts as padded with
zeros to the longest; repeated rows repeat their results and count once in the fit; a null id is an id.  Components
without variance (eigenvalue within rounding of zero: few or dependent vectors, constant dimensions) are not returned, so
that equal vectors throughout, a single row or no rows give no rows.  An eigenvector's largest entry is positive.  Entries
of 2^40 and more after scaling raise an error.  ``deviation`` is null where it has more than 38 digits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from labourlens.session import stored

LARGEST = float(2**40)
#: Eigenvalues closer than this share of the matrix's norm are one cluster.
CLUSTER = 1e-3
SUMS = "i int, j int, total decimal(38,0)"


@dataclass(frozen=True)
class Model:
    n: int  # distinct vectors
    sums: tuple[int, ...]  # per dimension
    values: np.ndarray  # leading eigenvalues of the covariance, falling
    vectors: np.ndarray  # their unit eigenvectors, by row
    trace: float


# --- eigenvectors of a symmetric matrix ------------------------------------------------------------------------------


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray | None]]:
    """Diagonal and off-diagonal of H a H, and the vectors of the Householder reflections that make up H."""
    a, reflections = a.astype(float).copy(), []
    for k in range(len(a) - 2):
        v = a[k + 1:, k].copy()
        if not v[1:].any():
            reflections.append(None)
            continue
        to = -math.copysign(np.linalg.norm(v), v[0])
        v[0] -= to
        v /= np.linalg.norm(v)
        rest = a[k + 1:, k + 1:]
        p = rest @ v
        w = p - (p @ v) * v
        rest -= 2 * np.outer(v, w) + 2 * np.outer(w, v)
        a[k + 1, k] = to
        reflections.append(v)
    return a.diagonal().copy(), a.diagonal(-1).copy(), reflections


def reflected(x: np.ndarray, reflections: list[np.ndarray | None]) -> np.ndarray:
    """H x: from the tridiagonal matrix's coordinates back."""
    x = x.copy()
    for k in range(len(reflections) - 1, -1, -1):
        v = reflections[k]
        if v is not None:
            x[k + 1:] -= 2 * (v @ x[k + 1:]) * v
    return x


def below(diagonal: np.ndarray, off: np.ndarray, x: float, least: float) -> int:
    """Sturm count: eigenvalues of the tridiagonal matrix under ``x``."""
    count, q = 0, 1.0
    for k, d in enumerate(diagonal):
        q = d - x - (off[k - 1] ** 2 / q if k else 0.0)
        if abs(q) < least:
            q = -least
        count += q < 0
    return count


def eigenvalue(diagonal: np.ndarray, off: np.ndarray, rank: int) -> float:
    """The eigenvalue with ``rank`` larger ones, by bisection down to neighbouring floats or rounding of the norm."""
    reach = np.abs(np.concatenate([off, [0]])) + np.abs(np.concatenate([[0], off]))
    low, high = float((diagonal - reach).min()), float((diagonal + reach).max())
    norm = max(abs(low), abs(high))
    least = max(norm * 1e-300, np.finfo(float).tiny)
    low, high = low - norm * 1e-15, high + norm * 1e-15
    while high - low > norm * 1e-17:
        middle = (low + high) / 2
        if middle in (low, high):
            break
        if below(diagonal, off, middle, least) > len(diagonal) - 1 - rank:
            high = middle
        else:
            low = middle
    return (low + high) / 2


def solved(diagonal: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray, least: float) -> np.ndarray:
    """(T - shift) x = b by elimination with row exchanges; a pivot of zero counts as ``least``."""
    n = len(diagonal)
    main, upper, second, x = diagonal - shift, np.append(off, 0.0), np.zeros(n), b.copy()
    for k in range(n - 1):
        under, nxt, nxt_up = off[k], main[k + 1], upper[k + 1]
        if abs(under) > abs(main[k]):  # rows k and k + 1 change places
            f = main[k] / under
            main[k], old = under, upper[k]
            upper[k], second[k] = nxt, nxt_up
            main[k + 1], upper[k + 1] = old - f * nxt, -f * nxt_up
            x[k], x[k + 1] = x[k + 1], x[k] - f * x[k + 1]
        else:
            if abs(main[k]) < least:
                main[k] = least
            f = under / main[k]
            main[k + 1] = nxt - f * upper[k]
            x[k + 1] -= f * x[k]
    if abs(main[-1]) < least:
        main[-1] = least
    for k in range(n - 1, -1, -1):
        rest = (upper[k] * x[k + 1] if k + 1 < n else 0.0) + (second[k] * x[k + 2] if k + 2 < n else 0.0)
        x[k] = (x[k] - rest) / main[k]
    return x


def leading(a: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``many`` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors by row."""
    size = len(a)
    many = min(many, size)
    scale = float(np.abs(a).max()) if size else 0.0
    if scale == 0.0:
        return np.zeros(many), np.eye(many, size)
    diagonal, off, reflections = tridiagonal(a / scale)
    values = np.array([eigenvalue(diagonal, off, k) for k in range(many)])
    norm = float(np.abs(diagonal).max() + 2 * (np.abs(off).max() if len(off) else 0.0))
    rng, vectors = np.random.default_rng(1), []
    for k, value in enumerate(values):
        first = k
        while first and values[first - 1] - values[first] < CLUSTER * norm:
            first -= 1
        x = rng.standard_normal(size)
        for _ in range(6):
            x = solved(diagonal, off, value, x / np.linalg.norm(x), norm * np.finfo(float).eps)
            x /= np.abs(x).max()
            for other in vectors[first:] * 2:  # twice, so that rounding of the first time goes too
                x -= (other @ x) * other
        vectors.append(x / np.linalg.norm(x))
    out = np.array([reflected(v, reflections) for v in vectors])
    out *= np.sign(out[np.arange(many), np.abs(out).argmax(axis=1)])[:, None]
    return values * scale, out


# --- the distributed part --------------------------------------------------------------------------------------------


def quantised(df: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """The rows with a usable vector, as ``row`` and whole-number ``x``."""
    usable = F.col(vector).isNotNull() & ~F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    whole = F.transform(vector, lambda v: F.when(F.abs(v.cast("double") * scale) < LARGEST, F.floor(v.cast("double") * scale)).otherwise(
        F.raise_error(F.lit("an entry is too large"))))
    return df.where(usable).select(F.struct(*([c for c in df.columns if c != vector] or [F.lit(0).alias("n")])).alias("row"), whole.alias("x"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def outer_sums(y: np.ndarray) -> np.ndarray:
    """y' y, exact: in floats while every sum stays under 2^53, else in whole numbers of any size."""
    if float(np.abs(y).max(initial=0)) ** 2 * len(y) < 2**53:
        return (y.T.astype(float) @ y.astype(float)).astype(np.int64).astype(object)
    y = y.astype(object)
    return y.T @ y


def _totals(vectors: DataFrame, width: int, part) -> dict[tuple[int, int], int]:
    """Sums over all rows of what ``part(matrix)`` gives, an array of whole numbers, one row or one column for each dimension."""
    schema = to_arrow_schema(T.StructType().add("i", T.IntegerType()).add("j", T.IntegerType()).add("total", T.DecimalType(38, 0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in batches:
            if b.num_rows:
                total = total + part(matrix(b.column(0), width))
        if isinstance(total, np.ndarray):
            i, j = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([Decimal(int(v)) for v in total[i, j]], pa.decimal128(38, 0))], schema=schema)

    summed = vectors.select("x").mapInArrow(run, SUMS).groupBy("i", "j").agg(F.sum("total").alias("total"))
    return {(r["i"], r["j"]): int(r["total"]) for r in summed.collect()}


def fit(distinct: DataFrame, width: int, components: int = 4) -> Model:
    """The model of a table of distinct vectors ``x``, all of one width."""
    n = distinct.count()
    first = _totals(distinct, width, lambda x: x.sum(axis=0, dtype=object)[None, :])
    sums = tuple(first.get((0, k), 0) for k in range(width))
    if not n or not width:
        return Model(n, sums, np.zeros(0), np.zeros((0, width)), 0.0)
    middle = np.array([(2 * s + n) // (2 * n) for s in sums], dtype=np.int64)
    products = _totals(distinct, width, lambda x: np.triu(outer_sums(x - middle)))
    rest = [s - n * int(m) for s, m in zip(sums, middle)]
    covariance = np.zeros((width, width))
    for i in range(width):
        for j in range(i, width):
            covariance[i, j] = covariance[j, i] = (n * products.get((i, j), 0) - rest[i] * rest[j]) / (n * n)  # whole numbers, rounded once
    trace = float(covariance.trace())
    values, vectors = leading(covariance, components)
    kept = values > trace * width * np.finfo(float).eps * 8
    return Model(n, sums, values[kept], vectors[kept], trace)


def projected(x: np.ndarray, model: Model) -> np.ndarray:
    mean = np.array([s / model.n for s in model.sums])
    return ((x - mean) @ model.vectors.T) / np.sqrt(model.values)


def deviations(x: np.ndarray, model: Model) -> list[Decimal | None]:
    """Sum over dimensions of (n x - S)^2, exact."""
    n, sums = model.n, np.array(model.sums, dtype=object)
    largest = int(np.abs(x).max(initial=0))
    if largest * max(largest, *map(abs, model.sums)) * max(x.shape[1], 1) < 2**62:
        s = sums.astype(np.int64)
        squares, products = (x * x).sum(axis=1), x @ s
    else:
        squares, products = (x.astype(object) ** 2).sum(axis=1), x.astype(object) @ sums
    own = sum(int(s) ** 2 for s in model.sums)
    out = [n * n * int(a) - 2 * n * int(b) + own for a, b in zip(squares, products)]
    return [Decimal(v) if v < 10**38 else None for v in out]


def identity_error(distinct: DataFrame, width: int, model: Model) -> float:
    """Largest entry of the whitened vectors' covariance, measured over the fit list, less the identity."""
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for b in batches:
            if b.num_rows:
                w = projected(matrix(b.column(0), width), model)
                total += np.vstack([w.T @ w, w.sum(axis=0)])
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], names=["i", "j", "total"])

    total = np.zeros((k + 1, k))
    for r in distinct.select("x").mapInArrow(run, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect():
        total[r["i"], r["j"]] = r["total"]
    mean = total[k] / model.n
    return float(np.abs(total[:k] / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(df: DataFrame, vector: str = "embedding", components: int = 4, scale: int = 256) -> DataFrame:
    """All columns but the vector, a row per input row and component: ``component`` from 1, ``n`` (distinct vectors),
    ``deviation`` (decimal), ``whitened``, ``explained`` and ``identity_error``."""
    made = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = stored(quantised(df, vector, scale), "vectors")
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    rows = rows.withColumn("x", F.when(F.size("x") == width, F.col("x")).otherwise(F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x")))))
    distinct = stored(rows.select("x").distinct(), "fit")
    model = fit(distinct, width, components)
    kept = [c for c in rows.schema["row"].dataType.names if c not in made]
    error = identity_error(distinct, width, model) if len(model.values) else 0.0
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("deviation", T.DecimalType(38, 0)),
                           T.StructField("whitened", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(1), width)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(deviations(x, model), pa.decimal128(38, 0)), pa.array(list(projected(x, model)), pa.list_(pa.float64()))],
                                                 names=["row", "deviation", "whitened"])

    out = rows.select("row", "x").mapInArrow(run, schema) if len(model.values) else rows.limit(0).select("row", F.lit(None).cast("decimal(38,0)").alias("deviation"), F.array().cast("array<double>").alias("whitened"))
    explained = F.element_at(F.array(*[F.lit(float(v / model.trace)) for v in model.values] or [F.lit(0.0)]), F.col("component"))
    out = out.select("row", "deviation", F.posexplode("whitened").alias("component", "whitened")).withColumn("component", F.col("component") + 1)
    return out.select(*[F.col("row").getField(c).alias(c) for c in kept], "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                      explained.alias("explained"), F.lit(error).alias("identity_error"))
