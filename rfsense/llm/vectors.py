"""What both vector operators need: which vectors take part, classes of equal ones, Arrow lists as matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Not null, not empty, every component finite and not null, not all zero."""
    v = F.col(vector)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(whole & F.exists(v, lambda x: x != 0), F.lit(False))


def wide_hash(*columns: str) -> Column:
    """128 bits: equal values, for all that any table can hold."""
    return F.struct(F.xxhash64(*columns).alias("x"), F.xxhash64(F.lit(1), *columns).alias("y"))


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows of doubles."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch, bool]]:
    """Rows sorted by ``keys`` as (key, rows, whether the key is new); a key may come in several pieces."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        starts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:], strict=False):
            key = tuple(c[a] for c in columns)
            yield key, batch.slice(a, b - a), key != last
            last = key


def dealt(df: DataFrame, keys: list[str], *then: str) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, *then)
