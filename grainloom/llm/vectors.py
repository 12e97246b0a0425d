"""What both vector searches share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, id_col: str, vector_col: str, also: Column | None = None) -> tuple[DataFrame, int, int]:
    """(vec_id, v) of the vectors that take part, their dimension and number.

    Left out: rows with a null id or vector, or a null or non-finite component, those for which also is false, and those
    that haven't the commonest length (of several, the smallest). Of rows with equal ids, the smallest vector counts.
    """
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size("v") > 0) & fine)
    rows = rows.where(also) if also is not None else rows
    common = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if common is None:
        return rows, 0, 0
    return rows.where(F.size("v") == common["d"]).groupBy("vec_id").agg(F.min("v").alias("v")), common["d"], common["n"]


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
