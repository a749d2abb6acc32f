"""Vectors in Spark and in numpy: which take part, classes of equal vectors, Arrow lists as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid(vector: Column) -> Column:
    """Not null, not zero, and all components finite numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def usable(rows: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """Rows (id, v) that have an id and a valid vector of the most common length of all rows (the longest at a tie), and that length."""
    clean = rows.where(F.col(key).isNotNull() & valid(F.col(vector))).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    most = clean.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).first()
    length = most["n"] if most else 1
    return clean.where(F.size("v") == length), length


def keyed(classes: DataFrame, least: str) -> DataFrame:
    """``classes`` (v, ...) with a key ``rep`` of each vector that grows with its smallest id, the column ``least``.

    An id alone would not do: it can stand on rows with different vectors. To be written before it is used, so that the
    keys stay the same.
    """
    order = [F.col(least), F.xxhash64("v")]
    return classes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("rep", F.monotonically_increasing_id())


def matrix(column: pa.Array | pa.ChunkedArray, length: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)


def directions(seed: int, rows: int, length: int) -> np.ndarray:
    """Orthonormal rows (random unit rows where there are more rows than dimensions), the same for a seed anywhere."""
    drawn = np.random.default_rng(seed).normal(size=(rows, length))
    if rows <= length:
        return np.linalg.qr(drawn.T)[0].T
    return drawn / np.linalg.norm(drawn, axis=1, keepdims=True)
