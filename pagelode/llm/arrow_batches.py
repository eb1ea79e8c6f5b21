"""Helpers for passes over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute


def by_size(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in slices whose texts hold about `most` bytes, one row at least."""
    for batch in batches:
        texts = batch.column(column)
        if not len(texts):
            continue
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0)).cumsum()
        start = 0
        while start < len(texts):
            base = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, base + most)))
            yield batch.slice(start, stop - start)
            start = stop
