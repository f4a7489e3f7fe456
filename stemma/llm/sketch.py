"""Arrays that all tasks fill and that are merged slice by slice: counters and bit fields sized from the data."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLICES = 16


def sized(entries: int, least: int, most: int) -> int:
    """The power of two from ``least`` to ``most`` that is not below ``entries``."""
    n = least
    while n < min(entries, most):
        n *= 2
    return n


def saturating(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of two arrays of one kind of integers, held at its largest value."""
    return np.minimum(a.astype(np.int64) + b, np.iinfo(a.dtype).max).astype(a.dtype)


def merged(rows: DataFrame, fill: Callable[[Iterable[pa.RecordBatch]], np.ndarray], length: int, kind, join: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """One array of ``length`` numbers from the arrays that ``fill`` makes of each task's batches.

    Each task sends its array compressed and in slices; the slices are joined in as many tasks,
    so that the driver gets one array of the stated length, however large the collection.
    """
    schema, names = "slice int, part binary", ["slice", "part"]

    def parts(got: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(got), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in got.values()], pa.binary())], names)

    def first(batches):
        a = fill(batches)
        if a.any():
            yield parts(dict(enumerate(np.split(a, SLICES))))

    def later(batches):
        got: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, blob in zip(batch.column("slice").to_pylist(), batch.column("part").to_pylist()):
                a = np.frombuffer(zlib.decompress(blob), kind)
                got[i] = join(got[i], a) if i in got else a
        yield parts(got)

    out = np.zeros((SLICES, length // SLICES), kind)
    for r in rows.mapInArrow(first, schema).repartition(SLICES, "slice").mapInArrow(later, schema).collect():
        out[r["slice"]] = np.frombuffer(zlib.decompress(r["part"]), kind)
    return out.ravel()
