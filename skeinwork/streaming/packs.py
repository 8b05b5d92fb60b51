"""Rows of a bucket as one packed row of columns."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


def values(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers that may be null are objects, as floats would round them."""
    return np.array(column.to_pylist(), dtype=object) if column.null_count and not pa.types.is_string(column.type) else column.to_numpy()


def packer(names: list[str], at: str, rows: int = 1 << 19) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pack up to ``rows`` rows of an input partition, those of a bucket into one: (bucket, the latest ``at``, columns ``names``).
    The state store and Python's side of it cost some microseconds a row, and a pack is one row."""

    def packed(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        bucket = table["bucket"].to_numpy()
        order = np.argsort(bucket, kind="stable")
        columns, bucket, last = [values(table[c])[order] for c in names], bucket[order], table[at].to_numpy()[order]
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        blobs = [pickle.dumps([c[a:b] for c in columns], 5) for a, b in zip(first, np.r_[first[1:], len(bucket)])]
        return pa.RecordBatch.from_arrays([pa.array(bucket[first]), pa.array(np.maximum.reduceat(last, first)), pa.array(blobs, pa.binary())], ["bucket", "last", "packed"])

    def pack(batches):
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held, n = [*held, batch], n + batch.num_rows
            if n >= rows:
                yield packed(held)
                held, n = [], 0
        if held:
            yield packed(held)

    return pack
