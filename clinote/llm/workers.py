"""Python workers: where they import from, and Arrow helpers for ``mapInArrow`` functions."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def map_batches(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package on the workers' import path."""
    environment = df.sparkSession.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, paths)])
    return df.mapInArrow(function, schema)


def slices(
    batches: Iterable[pa.RecordBatch], text: str, max_bytes: int = 4 << 20, max_rows: int = 1 << 15
) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in batches of about ``max_bytes`` of the string column ``text``.

    A text longer than that makes a batch of its own.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        first = held = 0
        for row, size in enumerate(sizes):
            if row > first and (held + size > max_bytes or row - first >= max_rows):
                yield batch.slice(first, row - first)
                first, held = row, 0
            held += size
        if first < len(sizes):
            yield batch.slice(first)

