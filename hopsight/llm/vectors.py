"""Integer vectors: the finite rows of a table of embeddings, scaled, floored and kept as bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut

#: Integer components lie within this, so that sums of squares of 256 of them fit a long.
LARGEST = 1 << 27


def finite(vectors: DataFrame) -> DataFrame:
    """The rows whose embedding is not null and holds no null or non-finite component."""
    return vectors.filter(F.coalesce(F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))), F.lit(False)))


def integers(column: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x) of every component of a list column, one after the other."""
    values = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if len(values) and np.abs(values).max() > LARGEST:
        raise ValueError(f"a component lies beyond {LARGEST // scale}")
    return values.astype(np.int64)


def packed(values: np.ndarray, kind: type) -> pa.Array:
    """Each row of `values` as bytes."""
    values = np.ascontiguousarray(values, kind)
    width = values.itemsize * (values.size // max(1, len(values)))
    data, at = pa.py_buffer(values.tobytes()), pa.py_buffer(np.arange(len(values) + 1, dtype=np.int64) * width)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(values), [None, at, data]).cast(pa.binary())


def unpacked(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def scaled(rows: DataFrame, keep: list[str], scale: int, more: Callable | None = None) -> DataFrame:
    """(`keep`..., ints binary[, more binary]) of rows of one dimension, written; `more` maps the integers to float rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ints = integers(batch.column("embedding"), scale).reshape(batch.num_rows, -1)
                extra = [packed(more(ints), np.float32)] if more else []
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], packed(ints, np.int32), *extra],
                                                 names=[*keep, "ints", *(["more"] if more else [])])
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keep]
    fields = [next(f for f in fields if f.split()[0] == c) for c in keep] + ["ints binary"] + (["more binary"] if more else [])
    return cut(rows.select(*keep, "embedding").mapInArrow(run, ", ".join(fields)))


def by_dimension(rows: DataFrame, run: Callable[[DataFrame, int], DataFrame], empty: Callable[[], DataFrame]) -> DataFrame:
    """`run` over the rows of each dimension; vectors of different dimension have nothing in common."""
    dims = sorted(r["dim"] for r in rows.select(F.size("embedding").alias("dim")).distinct().collect())
    parts = [run(rows.filter(F.size("embedding") == dim), dim) for dim in dims]
    return reduce(DataFrame.unionByName, parts) if parts else empty()
