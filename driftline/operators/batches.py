"""Arrow batches in bounded pieces."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _text_bytes(column: pa.Array) -> list[int]:
    """Bytes of text by row, of texts or of lists of texts."""
    if not pa.types.is_list(column.type):
        return pc.binary_length(column).fill_null(0).to_pylist()
    ends = np.cumsum(pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False))
    total = np.concatenate([[0], np.cumsum(pc.binary_length(column.flatten()).fill_null(0).to_numpy(zero_copy_only=False))])
    return np.diff(total[ends], prepend=0).tolist()


def slices(batches: Iterable, most_bytes: int = 4 << 20) -> Iterator:
    """The rows of Arrow batches again, in slices that hold about `most_bytes` of text each (of the first column).

    So temporary arrays stay small, whatever the session's batch size. A batch is one array or a tuple of columns.
    """
    for batch in batches:
        columns = batch if isinstance(batch, tuple) else (batch,)
        start, held = 0, 0
        for i, n in enumerate(_text_bytes(columns[0]) + [most_bytes + 1]):
            if i > start and held + n > most_bytes:
                part = tuple(c.slice(start, i - start) for c in columns)
                yield part if isinstance(batch, tuple) else part[0]
                start, held = i, 0
            held += n
        pa.default_memory_pool().release_unused()
