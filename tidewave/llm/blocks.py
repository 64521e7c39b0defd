"""Rows of a sorted partition, as Arrow tables that hold whole groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 8_192, size: int = 1 << 24) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(table, cuts) of rows sorted by integer keys: each table holds whole groups, and about so many rows or bytes unless one group has more;
    cuts are the places where groups begin, and the end. What is held back for the next table is copied, so that it does not keep the last one alive."""
    held: list[pa.RecordBatch] = []
    n = bytes_ = 0

    def cut(last: bool) -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        key = np.stack([np.asarray(table.column(c)) for c in keys])
        inner = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        cuts = np.concatenate([[0], inner, [len(table)]]).astype(np.int64)
        if not last:  # the last group may go on in the next batch
            held[:] = table.take(pa.array(np.arange(cuts[-2], cuts[-1]))).combine_chunks().to_batches() if len(cuts) > 2 else table.to_batches()
            return table.slice(0, int(cuts[-2])), cuts[:-1]
        return table, cuts

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n, bytes_ = n + batch.num_rows, bytes_ + batch.nbytes
        if n >= rows or bytes_ >= size:
            table, cuts = cut(False)
            n = bytes_ = 0
            if len(cuts) > 1:
                yield table, cuts
            del table
            pa.default_memory_pool().release_unused()
    if held:
        yield cut(True)
