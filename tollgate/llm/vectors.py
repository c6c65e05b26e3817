"""What the two vector operators share: which vectors take part, and exact cosines."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, vector`` of the vectors that take part, as doubles: not null, not zero, all components there and finite. A null
    id takes no part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & ~F.coalesce(bad, F.lit(True))
                      & F.exists("vector", lambda x: x != 0))


def by_width(rows: DataFrame, run: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """``run`` on the vectors of each width, one width after the other: vectors of different widths have no cosine. None if
    there are no vectors."""
    widths = sorted(r[0] for r in rows.select(F.size("vector")).distinct().collect())
    parts = [run(rows.where(F.size("vector") == w) if len(widths) > 1 else rows) for w in widths]
    return reduce(DataFrame.unionByName, parts) if parts else None


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """One row per vector."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows, summed from the first component to the last, so equal vectors get equal sums in any batch."""
    total = np.zeros(max(len(a), len(b)) if len(a) and len(b) else 0)
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


def norms(a: np.ndarray) -> np.ndarray:
    return np.sqrt(dots(a, a))
