"""Vector columns as numpy matrices inside Arrow tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Larger scaled entries are refused: they are no embeddings, and sums of them wouldn't fit in a long.
LARGEST = float(1 << 40)


def entries(col: str) -> Column:
    """The vector column as doubles."""
    return F.col(col).cast("array<double>")


def common_width(df: DataFrame, col: str) -> int:
    """The most frequent length of the vectors that aren't null, the larger of equally frequent ones; 0 without vectors."""
    counted = df.where(F.col(col).isNotNull()).groupBy(F.size(col).alias("width")).count()
    found = counted.orderBy(F.desc("count"), F.desc("width")).first()
    return found["width"] if found else 0


def matrix(col: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The positions of the rows whose vector has so many entries, all of them finite, and these vectors."""
    sizes = pc.fill_null(pc.list_value_length(col), -1).to_numpy(zero_copy_only=False)
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    starts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
    at = np.flatnonzero(sizes == width)
    found = flat.reshape(-1, width) if len(at) == len(sizes) and width else flat[starts[at][:, None] + np.arange(width)]
    ok = np.isfinite(found).all(axis=1)
    return at[ok], found[ok]


def floored(v: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * v) as longs."""
    out = np.floor(scale * v)
    if out.size and max(out.max(), -out.min()) > LARGEST:
        raise ValueError(f"an entry is larger than 2**40 / {scale}")
    return out.astype(np.int64)
