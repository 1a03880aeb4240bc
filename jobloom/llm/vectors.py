"""What the operators on vectors share: rows that take part, and vectors as fixed-width bytes.

A row takes part if it has an id and a vector without null or non-finite components.  Of several rows
with one id the smallest stays (by the further columns, then by the vector), so a repeated row counts
once.  Vectors of different lengths are taken as padded with zeros.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, key: str, vector: str, **more) -> DataFrame:
    """(_key, further columns, _vec array<double>), one row for each id that takes part.

    A row with a null in a further column takes no part either.
    """
    infinite = F.lit(float("inf"))
    rows = df.select(F.col(key).cast("long").alias("_key"), *[c.alias(n) for n, c in more.items()],
                     F.col(vector).cast("array<double>").alias("_vec"))
    for name in ("_key", *more, "_vec"):
        rows = rows.where(F.col(name).isNotNull())
    rows = rows.where(~F.exists("_vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == infinite)))
    one = rows.groupBy("_key").agg(F.min(F.struct(*more, "_vec")).alias("_row"))
    return one.select("_key", "_row.*")


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column as rows of ``dims`` numbers, zero-padded."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(size), dims), dtype=flat.dtype)
    out[np.arange(dims)[None, :] < size[:, None]] = flat
    return out


def fixed(column: pa.Array, kind) -> np.ndarray:
    """A column of byte strings of equal length as rows of numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0), dtype=kind)
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), -1)


def as_bytes(rows: np.ndarray) -> pa.Array:
    """Rows of numbers as a column of byte strings."""
    return pa.array([r.tobytes() for r in np.ascontiguousarray(rows)], type=pa.binary())
