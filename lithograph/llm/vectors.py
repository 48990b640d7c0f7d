"""Arrow lists of numbers as matrices, for the two operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(lists: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, usable): the lists as rows of doubles, and which are neither null nor zero and hold finite numbers only.

    Only lists of `dim` numbers are usable; without dim, of as many as the first non-null list has.
    """
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    n = len(lists)
    sizes = np.asarray(lists.value_lengths().fill_null(-1), dtype=np.int64) if n else np.zeros(0, np.int64)
    if dim is None:
        dim = int(next((s for s in sizes if s > 0), 1))
    fits = sizes == dim
    out = np.zeros((n, dim))
    flat = lists.filter(pa.array(fits)).flatten()
    values = np.asarray(flat.cast(pa.float64()).fill_null(float("nan")), dtype=np.float64) if len(flat) else np.zeros(0)
    out[fits] = values.reshape(-1, dim)
    usable = fits & np.isfinite(out).all(axis=1) & (out != 0).any(axis=1)
    return out, usable


def dimension(df, column: str) -> int:
    """The most usual length of the column's lists, the longer of two as usual; 1 without any."""
    from pyspark.sql import functions as F

    top = df.where(F.size(column) > 0).groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return top.d if top else 1
