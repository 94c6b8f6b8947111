"""Arrow batches taken apart by the length of their texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a text is never cut, so a longer one is alone.
MOST = 2_000_000


def slices(b: pa.RecordBatch, text: int, most: int = MOST) -> Iterator[pa.RecordBatch]:
    """Stretches of a batch's rows, all of them in order, of at most so many bytes in the column at place text, or of one row."""
    end = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < b.num_rows:
        before = int(end[i - 1]) if i else 0
        j = max(i + 1, int(np.searchsorted(end, before + most, "right")))
        yield b.slice(i, j - i)
        i = j
