"""Vectors as packed bytes, and their principal axes."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def number_type(df: DataFrame, vector: str) -> np.dtype:
    """float32 for arrays of floats, float64 for all other numbers."""
    element = df.schema[vector].dataType.elementType
    return np.dtype(np.float32 if isinstance(element, T.FloatType) else np.float64)


def packed(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, dim, x) of every row: x holds the vector's bytes, null if it can't be compared.

    That is one that is null, empty, of length zero, or has null or non-finite components.
    """
    dtype = number_type(df, vector)

    def pack(values) -> bytes | None:
        if values is None or len(values) == 0 or values.null_count:
            return None
        x = values.to_numpy(zero_copy_only=False).astype(dtype) + dtype.type(0)  # one zero, not two
        return x.tobytes() if np.isfinite(x).all() and x.any() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs = [pack(v.values) for v in batch.column(1)]
            dims = [len(x) // dtype.itemsize if x else None for x in xs]
            columns = [batch.column(0), pa.array(dims, pa.int32()), pa.array(xs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "dim", "x"])

    kind = "array<float>" if dtype == np.float32 else "array<double>"
    return df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(kind)).mapInArrow(run, "id long, dim int, x binary")


def matrix(column, dtype: np.dtype) -> np.ndarray:
    """Packed vectors of one length as the rows of a matrix in double precision."""
    parts = column.to_pylist() if hasattr(column, "to_pylist") else list(column)
    return np.frombuffer(b"".join(parts), dtype).reshape(len(parts), -1).astype(np.float64)


def unit(x: np.ndarray) -> np.ndarray:
    # Scaled first, so that the squares neither overflow nor vanish.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def by_dim(batch: pa.RecordBatch, dims: int, dtype: np.dtype, xs: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For every length in the batch: (length, rows that have it, their matrix)."""
    found = batch.column(dims).to_numpy(zero_copy_only=False)
    for dim in np.unique(found):
        rows = np.flatnonzero(found == dim)
        yield int(dim), rows, matrix(batch.column(xs).take(pa.array(rows)), dtype)


def principal_axes(vectors: DataFrame, dtype: np.dtype) -> dict[int, np.ndarray]:
    """For every length of vectors, orthonormal axes as columns, those first along which unit vectors are longest.

    vectors: dim, x. The products are summed by Spark; the driver gets length x length numbers per length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, _, x in by_dim(batch, 0, dtype, 1):
                u = unit(x)
                total[dim] = total.get(dim, 0) + u.T @ u
        for dim, products in total.items():
            columns = [np.full(dim * dim, dim, np.int32), np.arange(dim * dim, dtype=np.int32), products.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["dim", "at", "v"])

    sums = vectors.select("dim", "x").mapInArrow(run, "dim int, at int, v double").groupBy("dim", "at").agg(F.sum("v").alias("v"))
    found = sums.toPandas()
    axes = {}
    for dim, rows in found.groupby("dim"):
        products = np.zeros(dim * dim)
        products[rows["at"].to_numpy()] = rows["v"].to_numpy()
        _, basis = np.linalg.eigh(products.reshape(dim, dim))
        axes[int(dim)] = np.ascontiguousarray(basis[:, ::-1])
    return axes
