"""Hand every ordered group to a numpy function, many groups per Arrow batch.

A row number over the group's order puts each group on one task, sorted, and marks where
it begins. Where the input is already partitioned and sorted that way, no further shuffle
or sort is added. Groups cost microseconds each, so a million small devices are as cheap as
one large one, and a large one is passed on batch by batch with the state carried between.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Columns = dict[str, np.ndarray]


def _numpy(a: pa.Array) -> np.ndarray:
    if pa.types.is_timestamp(a.type):
        return a.cast(pa.int64()).to_numpy(zero_copy_only=False)
    return a.to_numpy(zero_copy_only=False)


def _arrow(v: np.ndarray, t: pa.DataType) -> pa.Array:
    if pa.types.is_timestamp(t):
        return pa.array(np.asarray(v, dtype=np.int64), type=pa.int64()).cast(t)
    if pa.types.is_list(t):
        return pa.array(list(v), type=t)
    return pa.array(v, type=t)


def walk(df: DataFrame, part: list[str], order: list[str], cols: list[str],
         step: Callable[[Columns, Any], tuple[Columns, Any]], schema: str, whole: bool = False) -> DataFrame:
    """``step(columns, state)`` gets the next rows of a group in order and the state it returned for
    the rows before (None at the start), and returns output columns and the new state.

    With ``whole`` the rows of a group are gathered and passed at once.
    """
    rn = F.row_number().over(Window.partitionBy(*part).orderBy(*order)).alias("_rn")
    need = list(dict.fromkeys([*part, *cols]))
    arrow_schema = to_arrow_schema(StructType.fromDDL(schema))
    names = arrow_schema.names

    def pack(done: list[Columns]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [_arrow(np.concatenate([np.asarray(d[n]) for d in done]) if len(done) > 1 else done[0][n], f.type)
             for n, f in zip(names, arrow_schema)], schema=arrow_schema)

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[bool, Columns]]]:
        """Per batch its runs of one group: whether the group begins there, and the rows."""
        for b in batches:
            if b.num_rows:
                data = {c: _numpy(b.column(b.schema.get_field_index(c))) for c in need}
                first = _numpy(b.column(b.schema.get_field_index("_rn"))) == 1
                cuts = [0, *(np.flatnonzero(first[1:]) + 1).tolist(), b.num_rows]
                yield [(bool(first[lo]), {c: v[lo:hi] for c, v in data.items()}) for lo, hi in zip(cuts, cuts[1:])]

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for runs in slices(batches):
            done = []
            for begins, rows in runs:
                out, state = step(rows, None if begins else state)
                done.append(out)
            yield pack(done)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[Columns] = []

        def close() -> Columns:
            group = {c: np.concatenate([p[c] for p in parts]) for c in need}
            parts.clear()
            return step(group, None)[0]

        for runs in slices(batches):
            done = []
            for begins, rows in runs:
                if begins and parts:
                    done.append(close())
                parts.append(rows)
            if done:
                yield pack(done)
        if parts:
            yield pack([close()])

    return df.select(*need, rn).mapInArrow(gathered if whole else carried, schema)
