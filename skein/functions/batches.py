"""Arrow batches in portions, so that a Python task holds what becomes of one portion, not of a whole batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a scanner takes at once.
TEXT_AT_ONCE = 1 << 20


def portions(batch: pa.RecordBatch, sizes: pa.Array, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose sizes add up to about most, a larger row alone."""
    seen = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.flatnonzero(np.diff(seen // most)) + 1
    for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        yield batch.slice(begin, end - begin)


def texts(batches: Iterator[pa.RecordBatch], column: str, most: int = TEXT_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Batches in portions of about most bytes of the text column."""
    for batch in batches:
        if batch.num_rows:
            yield from portions(batch, pc.binary_length(batch.column(column)), most)
