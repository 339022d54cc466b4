"""Tables of vectors: which rows take part, and their matrices inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_finite(vector: Column) -> Column:
    """True for a vector that is there and holds no null, NaN or infinite component."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))


def of_one_length(rows: DataFrame, vector_col: str) -> tuple[DataFrame, int]:
    """Rows whose vectors have the commonest length (the shorter of two alike) above 0, and that length (0 for an empty table)."""
    rows = rows.filter(F.size(vector_col) > 0)
    sizes = rows.groupBy(F.size(vector_col).alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    most = sizes.orderBy(F.desc("n"), "dim").first()
    dim = most.dim if most else 0
    return rows.filter(F.size(vector_col) == dim), dim


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of a list column as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
