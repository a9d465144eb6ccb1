"""Arrow batches in stretches of a bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text that a Python task holds as objects at a time.
HELD_BYTES = 1_000_000


def stretches(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, number of rows) of stretches with HELD_BYTES of text at most, or one row.

    A batch has a bounded number of rows, not of bytes; what is built from a text is several times as large.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(ends):
        limit = HELD_BYTES + (ends[start - 1] if start else 0)
        end = max(start + 1, int(np.searchsorted(ends, limit, side="right")))
        yield start, end - start
        start = end
