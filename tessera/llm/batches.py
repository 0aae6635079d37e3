"""Arrow batches cut to a bounded amount of text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def by_size(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``limit`` bytes of a text column, at least one row each; order and rows are kept."""
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(size) - size) // limit
        edges = [*np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(size)] if len(size) else []
        for a, e in zip(edges, edges[1:]):
            yield b.slice(a, e - a)
