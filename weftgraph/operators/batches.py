"""Functions over many whole groups at a time, so small groups share what a call costs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows and bytes that a call gets about, and more only where one group has more.
BATCH_ROWS, BATCH_BYTES = 1 << 16, 1 << 24


def column(table: pa.Table, name: str) -> pa.Array:
    """A column as one array."""
    c = table.column(name)
    return c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)


def codes(values: pa.Array) -> np.ndarray:
    """Numbers that are equal where the values are, -1 for null."""
    return values.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)


def group_starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """First rows of the groups of a table in which the rows of a group follow each other."""
    new = np.zeros(table.num_rows, dtype=bool)
    new[:1] = True
    for k in keys:
        c = codes(column(table, k))
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def expand(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers ``first``, ``first + 1``, ... of every range, one range after the other."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


def in_batches(rows: DataFrame, keys: Sequence[str], solve: Callable[[pa.Table, np.ndarray], pa.Table], schema: str,
               batch_rows: int = BATCH_ROWS) -> DataFrame:
    """``solve(table, starts)`` over tables of whole groups, whose first rows are ``starts``.

    Groups with null keys are groups like others.  A task holds about ``batch_rows`` rows or
    ``BATCH_BYTES``, or the largest group.
    """
    names = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, size, wait = [], 0, 0, 1
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            size += batch.nbytes
            if n < wait * batch_rows and size < wait * BATCH_BYTES:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            starts = group_starts(table, names)
            if len(starts) > 1:
                yield from solve(table.slice(0, starts[-1]), starts[:-1]).to_batches()
                held = table.slice(starts[-1]).to_batches()
                n, size, wait = sum(b.num_rows for b in held), sum(b.nbytes for b in held), 1
            else:  # one large group: not looked at again before it is twice as large
                wait = 2 * max(n / batch_rows, size / BATCH_BYTES)
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from solve(table, group_starts(table, names)).to_batches()

    return rows.repartition(*names).sortWithinPartitions(*names).mapInArrow(run, schema)
