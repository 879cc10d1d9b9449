"""What the operators on embeddings share: whole-number vectors and their rows in Arrow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import named

#: Components must stay below it in magnitude, so that sums of products fit a long.
LARGEST = 1 << 26


def sound(vector: Column) -> Column:
    """Whether a vector is there, isn't empty, and all its components are there and finite."""
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))


def floored(rows: DataFrame, vec_id: str, label: str, vector: str, scale: int) -> DataFrame:
    """vec_id, label and q, the components floor(scale * x), of the rows with a sound vector.

    All vectors have the length of the one that comes first (by id, then by its
    components; a missing id comes last); those of another length have no part in it.
    """
    found = rows.select(named(vec_id).alias("vec_id"), named(label).alias("label"), named(vector).alias("v")).where(sound(F.col("v")))
    made = found.select("vec_id", "label", F.transform("v", lambda x: F.floor(x.cast("double") * F.lit(float(scale)))).alias("q"))
    first = made.orderBy(F.col("vec_id").asc_nulls_last(), "q").select(F.size("q")).first()
    return made.where(F.size("q") == first[0]) if first else made


def matrix(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of equal length as rows; ValueError if a component is too large."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(flat) and np.abs(flat).max() >= LARGEST:
        raise ValueError(f"a component of {LARGEST} or more: scaled vectors must stay below it")
    return flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 1), np.int64)
