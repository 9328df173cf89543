"""Arrow functions on partitions, for work that column expressions cannot state."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def map_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package on the import path of the Python workers."""
    environment = df.sparkSession.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, paths)])
    return df.mapInArrow(function, schema)


def slices(batches: Iterable[pa.RecordBatch], text: int, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in batches of about ``max_bytes`` of the string column at ``text``.

    A text longer than that makes a batch of its own.
    """
    for batch in batches:
        first = held = 0
        for row, size in enumerate(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()):
            if row > first and held + size > max_bytes:
                yield batch.slice(first, row - first)
                first, held = row, 0
            held += size
        if first < batch.num_rows:
            yield batch.slice(first)
