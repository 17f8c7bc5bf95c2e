"""Vector columns: which rows take part, and their matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Different lengths of vectors in a table; each is a table of its own, since vectors of two lengths have no product.
MAX_LENGTHS = 64


def usable(rows: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, list[int]]:
    """``(vec_id, x)`` of the rows that take part, and their different lengths.

    Null ids, null or zero vectors and vectors with a null or non-finite component take no part."""
    x = F.col(vec_col).cast("array<double>")
    fine = (F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) > 0)
            & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
            & F.exists(x, lambda v: v != 0))
    some = rows.where(F.coalesce(fine, F.lit(False))).select(
        F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))
    lengths = sorted(r["d"] for r in some.select(F.size("x").alias("d")).distinct().limit(MAX_LENGTHS + 1).collect())
    if len(lengths) > MAX_LENGTHS:
        raise ValueError(f"vectors of more than {MAX_LENGTHS} lengths")
    return some, lengths


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """A list column whose rows all have ``d`` numbers, as a double matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), d)


def lists(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as a list column."""
    n, d = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * d + 1, d or 1, dtype=np.int32)[:n + 1]),
                                    pa.array(np.ascontiguousarray(x, np.float64).reshape(-1)))


def sample(rows: DataFrame, total: int, wanted: int, seed: int, d: int) -> np.ndarray:
    """About ``wanted`` of ``total`` vectors, picked by a hash of their id, in id order."""
    share = min(1.0, wanted / max(1, total))
    draw = (F.xxhash64("vec_id", F.lit(seed)).cast("double") + 2.0 ** 63) / 2.0 ** 64
    table = rows.where(draw < share).toArrow().sort_by([("vec_id", "ascending")])
    return matrix(table.column("x"), d) if table.num_rows else np.empty((0, d))
