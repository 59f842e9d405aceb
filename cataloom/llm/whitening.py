"""Whitening of embeddings: a distributed centred scatter, and its eigenvectors by cyclic Jacobi rotations on the driver.

The driver only ever holds matrices of dimensions by dimensions. Entries are turned into integers, so sums and deviations
are exact; centring comes before multiplying, and rotations go on until each off-diagonal entry is negligible beside its own
two diagonal entries, which keeps small eigenvalues accurate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An entry c counts as floor(SCALE * c) + SHIFT; components that are returned at most.
SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Rounds of rotations at most; an eigenvalue below so much of the trace, for each dimension, counts as zero.
SWEEPS, ZERO = 60, 4e-16
LONG = (1 << 63) - 1


def integers(lists: pa.Array, dims: int) -> np.ndarray:
    """Vectors of ``dims`` entries as rows of long integers."""
    flat = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    # Entries that a long integer can't hold stay at a bound.
    return np.clip(flat, -(2.0**62), 2.0**62).astype(np.int64).reshape(-1, dims) + SHIFT


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly: long integers, or Python's where those don't hold it."""
    if n * int(np.abs(x).max(initial=0)) < 1 << 62 and max(map(abs, sums), default=0) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def squared_length(d: np.ndarray) -> list[int | None]:
    """The exact sum of squares of each row; None where it is beyond a long integer."""
    if not d.size:
        return [0] * len(d)
    bound = d.shape[1] * int(np.abs(d).max()) ** 2
    if bound <= LONG:
        return (d * d).sum(axis=1).tolist()
    exact = (int(x) for x in (d.astype(object) ** 2).sum(axis=1))
    return [x if x <= LONG else None for x in exact]


def cyclic_jacobi(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix.

    Each sweep turns every pair of axes so that its off-diagonal entry vanishes; it ends when a whole sweep finds none that
    matters beside its diagonal entries. Of either sign, a vector's largest entry is made positive."""
    a = np.array(matrix, np.float64)
    d = len(a)
    v = np.eye(d)
    eps = np.finfo(np.float64).eps
    floor = eps * 1e-6 * max(float(np.abs(np.diag(a)).sum()), np.finfo(np.float64).tiny)
    for _ in range(SWEEPS):
        turned = False
        for p in range(d - 1):
            for q in range(p + 1, d):
                off = a[p, q]
                if abs(off) <= max(eps * np.sqrt(abs(a[p, p] * a[q, q])), floor):
                    continue
                turned = True
                theta = (a[q, q] - a[p, p]) / (2 * off)
                t = (1.0 if theta >= 0 else -1.0) / (abs(theta) + np.hypot(theta, 1.0))
                c = 1 / np.hypot(t, 1.0)
                s = t * c
                app, aqq = a[p, p] - t * off, a[q, q] + t * off
                row_p, row_q = c * a[p] - s * a[q], s * a[p] + c * a[q]
                a[p], a[q], a[:, p], a[:, q] = row_p, row_q, row_p, row_q
                a[p, p], a[q, q], a[p, q], a[q, p] = app, aqq, 0.0, 0.0
                v[:, p], v[:, q] = c * v[:, p] - s * v[:, q], s * v[:, p] + c * v[:, q]
        if not turned:
            break
    else:
        raise RuntimeError(f"rotations did not settle in {SWEEPS} sweeps")
    order = np.argsort(-np.diag(a), kind="stable")
    values, v = np.diag(a)[order], v[:, order]
    if d:
        v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(d)] < 0, -1.0, 1.0)
    return values, v


def scatter(rows: DataFrame, width: int, transform: Callable[[pa.Array], np.ndarray]) -> np.ndarray:
    """The sum over all rows of y * y^T, where ``transform`` gives the rows y of a batch of vectors.

    A partition adds up its own rows and gives one row for each row of the matrix; those are added by Spark."""
    schema = pa.schema([("i", pa.int32()), ("part", pa.list_(pa.float64()))])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            y = transform(batch.column("v"))
            total += y.T @ y
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], schema=schema)

    added = rows.select("v").mapInArrow(partial, "i int, part array<double>").groupBy("i").agg(F.array(*[F.sum(F.col("part")[k]) for k in range(width)]).alias("total"))
    out = np.zeros((width, width))
    for row in added.collect():  # one row for each dimension
        out[row["i"]] = row["total"]
    return out


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): each row's whitened coordinates.

    An entry c is the long integer x = floor(64 * c) + 1000000. n vectors with per-dimension sums S give the covariance V
    (divisor n) of x; components are its unit eigenvectors by falling eigenvalue e, from 1, at most ``components``.
    deviation is the sum over dimensions of (n * x - S)^2, exact; whitened is x - S / n projected on the component, over
    sqrt(e); explained is e / trace(V); identity_error is the largest absolute entry of whitened's covariance, measured over
    all rows, minus the identity.

    Rows are left out where the vector is null or has a null or non-finite entry, or is of another length than most vectors
    (of equally many, the longest count). Where e is zero (fewer rows than dimensions, constant vectors), whitened is null
    and the component has no part in identity_error, which is 0 if none is left; explained is null where the trace is zero,
    and deviation where it is beyond a long integer. Repeated rows and null ids are rows like others; other columns are
    ignored; an empty table gives an empty result.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark, id_type = vectors.sparkSession, vectors.schema[id_column].dataType
    finite = F.forall(vector_column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    given = vectors.where(F.col(vector_column).isNotNull() & finite).select(F.col(id_column).alias("id"), F.col(vector_column).alias("v"))
    common = given.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    kinds = f"id {id_type.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if common is None or not common["dims"]:
        return spark.createDataFrame([], kinds)
    dims, n = common["dims"], common["n"]
    rows = given.where(F.size("v") == dims)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * dims
        for batch in batches:
            x = integers(batch.column("v"), dims)
            wide = len(x) * int(np.abs(x).max(initial=0)) >= 1 << 63
            total = [a + int(b) for a, b in zip(total, (x.astype(object) if wide else x).sum(axis=0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array(map(Decimal, total), pa.decimal128(38, 0))], names=["i", "total"])

    added = rows.select("v").mapInArrow(add_up, "i int, total decimal(38,0)").groupBy("i").agg(F.sum("total").alias("total"))
    sums = [int(row["total"]) for row in added.orderBy("i").collect()]  # one row for each dimension

    def centred(lists: pa.Array) -> np.ndarray:
        return (deviations(integers(lists, dims), n, sums) / n).astype(np.float64)

    values, axes = cyclic_jacobi(scatter(rows, dims, centred) / n)
    count, trace = min(components, dims), float(values.sum())
    real = values[:count] > ZERO * dims * trace
    weights = axes[:, :count] / np.sqrt(np.where(real, values[:count], 1.0))
    matrix = spark.sparkContext.broadcast(weights)  # dims by components

    def projected(lists: pa.Array) -> np.ndarray:
        """Whitened coordinates and a one, whose products give their sums."""
        y = centred(lists) @ matrix.value
        return np.hstack([y, np.ones((len(y), 1))])

    moments = scatter(rows, count + 1, projected) / n
    mean = moments[-1, :-1]
    error = np.abs(moments[:-1, :-1] - np.outer(mean, mean) - np.eye(count))[np.ix_(real, real)]
    identity_error = float(error.max()) if error.size else 0.0
    explained = pa.array((values[:count] / trace).tolist() if trace > 0 else [None] * count, pa.float64())
    schema = pa.schema([("id", to_arrow_type(id_type)), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.num_rows
            d = deviations(integers(batch.column("v"), dims), n, sums)
            y = (d / n).astype(np.float64) @ matrix.value
            row, which = pa.array(np.repeat(np.arange(size), count)), np.tile(np.arange(count), size)
            whitened = pa.array(y.ravel(), pa.float64(), mask=~real[which])
            lengths = pa.array(squared_length(d), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(row), pa.array((which + 1).astype(np.int32)), pa.array(np.full(len(which), n)), lengths.take(row), whitened, explained.take(pa.array(which)), pa.array(np.full(len(which), identity_error))], schema=schema)

    return rows.mapInArrow(project, kinds)
