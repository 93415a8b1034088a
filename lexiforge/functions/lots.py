"""Arrow batches in lots, so that what a task holds as Python objects does not grow with the rows of a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LOT = 1 << 20  # bytes of text that a task holds as Python strings at once


def lots(batch: pa.RecordBatch, size: int, *columns: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices, in order, whose values in the columns (strings and binaries: bytes, lists: members) come to `size`
    together at most; a row with more is a slice of its own."""
    many = np.zeros(batch.num_rows, dtype=np.int64)
    for c in columns:
        column = batch.column(c)
        length = pc.list_value_length(column) if pa.types.is_list(column.type) else pc.binary_length(column)
        many += length.fill_null(0).to_numpy(zero_copy_only=False)
    upto, lo = np.cumsum(many), 0
    while lo < len(many):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + size, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi
