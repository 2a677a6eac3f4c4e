"""Rows of sorted partitions as whole runs of one key, over Arrow batch borders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def same_as_before(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Whether each row has the keys of the row before it; nulls equal each other."""
    n = table.num_rows
    same = np.ones(n, dtype=bool)
    if n:
        same[0] = False
    for key in keys:
        codes = table[key].combine_chunks().dictionary_encode(null_encoding="encode")
        codes = codes.indices.to_numpy(zero_copy_only=False)
        same[1:] &= codes[1:] == codes[:-1]
    return same


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that end with a run, and the starts of their runs.

    Rows must be sorted by ``keys``. Only the last run of a batch waits for the next one.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held:
            edge = pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch])
            same = same_as_before(edge, keys)[1:]
        else:
            same = same_as_before(pa.Table.from_batches([batch]), keys)
        starts = np.flatnonzero(~same)
        if not len(starts):
            held.append(batch)
            continue
        last = int(starts[-1])
        if last or held:
            head = pa.Table.from_batches([*held, batch.slice(0, last)])
            if head.num_rows:
                yield head, np.flatnonzero(~same_as_before(head, keys))
        held = [batch.slice(last)]
    if held:
        rest = pa.Table.from_batches(held)
        yield rest, np.flatnonzero(~same_as_before(rest, keys))
