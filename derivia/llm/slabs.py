"""Fixed-size vectors of counts gathered over all rows: each task fills its own, and slices of them are added up in Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLAB_SCHEMA = "slab int, cells binary"
#: Cells in one slab row.
SLAB = 1 << 16


def slab_rows(cells: np.ndarray) -> pa.RecordBatch:
    """The slabs of a vector that have anything in them."""
    at = [k for k in range(0, len(cells), SLAB) if cells[k : k + SLAB].any()]
    return pa.RecordBatch.from_arrays([pa.array([k // SLAB for k in at], pa.int32()), pa.array([cells[k : k + SLAB].tobytes() for k in at], pa.binary())], ["slab", "cells"])


def added(slabs: DataFrame, dtype: type, total: type | None = None, fold: Callable = np.add) -> np.ndarray | list:
    """Slab rows folded cell by cell in Spark; the driver gets each slab once (a vector of a size fixed beforehand)."""
    total = total or dtype

    def fold_group(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            for cells in batch.column("cells"):
                part = np.frombuffer(cells.as_buffer(), dtype).astype(total)
                out = part if out is None else fold(out, part)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["slab", "cells"])

    return slabs.groupBy("slab").applyInArrow(fold_group, SLAB_SCHEMA).collect()


def gathered(slabs: DataFrame, size: int, dtype: type, total: type | None = None, fold: Callable = np.add) -> np.ndarray:
    """The folded vector of `size` cells."""
    total = total or dtype
    out = np.zeros(size, total)
    for row in added(slabs, dtype, total, fold):
        part = np.frombuffer(row["cells"], total)
        out[row["slab"] * SLAB : row["slab"] * SLAB + len(part)] = part
    return out
