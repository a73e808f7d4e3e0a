"""Rows of vectors as whole numbers, shared by the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Squared norms up to this keep every product and squared distance of two vectors within a long.
MOST = float(1 << 60)


def scaled(vector: Column, factor: int) -> Column:
    """floor(factor * x) of every component, as doubles."""
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(x * F.lit(float(factor))).cast("double"))


def finite(vector: Column) -> Column:
    """A vector that is there, without null, NaN or infinite components."""
    return F.coalesce(F.forall(vector.cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def whole(rows: DataFrame, vector: Column, factor: int, *columns: Column, most: float = MOST) -> DataFrame:
    """(columns, q array<int>) of the rows with a finite vector.

    A row whose squared norm is over `most` after scaling is left out like one that is
    not finite: its products and distances are no longs.
    """
    known = rows.where(finite(vector)).select(*columns, scaled(vector, factor).alias("_x"))
    size = F.aggregate("_x", F.lit(0.0), lambda total, x: total + x * x)
    return known.where(size <= F.lit(most)).withColumn("q", F.col("_x").cast("array<int>")).drop("_x")


def matrix(lists: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of numbers as rows of int64, short ones filled up with zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    size = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
    if len(flat) == len(lists) * width and (size == width).all():
        return flat.reshape(len(lists), width)
    out = np.zeros((len(lists), width), np.int64)
    out[np.repeat(np.arange(len(lists)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of rows of int64, exact; by floating point where every partial sum is a whole number below 2^53."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T
