"""Batches that a Python worker reads, bounded by bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of a batch's texts: what a task reads at a time, unless one text alone is longer. What Python makes of them (trees
#: of pages, rows that wait for the batch to end) is many times as large, and a worker gives little of it back.
BYTES = 256 << 10


def by_bytes(batches: Iterator[pa.RecordBatch], at: int, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose column ``at`` has at most ``size`` bytes, or one row."""
    for b in batches:
        column = b.column(at).cast(pa.large_string())
        ends = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
        row = 0
        while row < b.num_rows:
            to = max(row + 1, int(np.searchsorted(ends, ends[row] + size, "right")) - 1)
            yield b.slice(row, to - row)
            row = to


def each_text(df: DataFrame, key: str, text: str, rows: Callable[[object, str], list[tuple]], schema: str) -> DataFrame:
    """The rows that ``rows(key, text)`` makes of each row of ``df``; a null text counts as empty."""
    names, kinds = zip(*(c.strip().split(" ", 1) for c in schema.split(",")), strict=True)
    arrow = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 1):
            found = [r for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in rows(k, t or "")]
            columns = zip(*found, strict=True) if found else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), arrow[kind]) for c, kind in zip(columns, kinds, strict=True)], list(names))

    return df.select(key, text).mapInArrow(of, schema)
