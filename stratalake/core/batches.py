"""Arrow batches in smaller pieces, so that what a task's Python holds doesn't follow the size of Spark's batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

#: Bytes of a piece, on the average of its batch.
PIECE_BYTES = 1 << 22


def pieces(batches: Iterable[pa.RecordBatch], size: int = PIECE_BYTES, rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, cut into pieces of some `size` bytes and of `rows` rows at most, one row at least."""
    for batch in batches:
        step = max(1, batch.num_rows * size // max(batch.nbytes, 1))
        step = step if rows is None else max(1, min(step, rows))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)
