"""What both vector operators need: valid vectors as packed bytes, and matrices from them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_valid(embedding: Column) -> Column:
    """Not null, no null or non-finite component, some component that is not zero."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(embedding.isNotNull() & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def packed(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, str]:
    """(id, vec) of the valid vectors, components as little-endian floats of the column's own width, and that numpy type.
    Vectors of different lengths are an error of the data; the first length seen in a task does not hide it."""
    narrow = isinstance(vectors.schema[embedding].dataType.elementType, T.FloatType)
    kind = "<f4" if narrow else "<f8"
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast(f"array<{'float' if narrow else 'double'}>").alias("vec"))

    def run(batches):
        for batch in batches:
            vec = batch.column("vec")
            values = vec.flatten().to_numpy(zero_copy_only=False).astype(kind)
            at = np.r_[0, np.cumsum(np.diff(vec.offsets.to_numpy()))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([values[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())], names=["id", "vec"])

    return rows.where(is_valid(F.col("vec"))).mapInArrow(run, "id long, vec binary"), kind


def matrix(column, kind: str) -> np.ndarray:
    """Rows of packed vectors as doubles."""
    raw = column.to_pylist() if not isinstance(column, list) else column
    if not raw:
        return np.zeros((0, 0))
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
