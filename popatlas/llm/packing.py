"""Packing: token windows of near-equal fill by Karmarkar-Karp differencing.

A document is its ids and an end id. Whole windows are cut off its front; of what remains,
the last ids beyond a multiple of ``TAIL`` are a piece of their own. These short tails let
the fills come out nearly equal, where long pieces alone would leave percents of padding.
Remaining pieces are dealt by a hash and packed in groups of ``GROUP``: each
piece starts as a partition with one filled window; the two partitions with the largest
difference between fullest and emptiest window are merged, the fuller windows of one with
the emptier ones of the other, until one is left. It starts with the fewest windows that
could hold the group, and takes one more as long as any is over capacity.

Checksums are taken where a text is read, so only a narrow row per piece is shuffled, or
also the ids of the piece where they are asked for. Null texts count as empty (a document
of the end id alone), repeated rows are packed once each, null ids like any other.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popatlas.llm.common import long_rows, whole_text
from popatlas.llm.tokens import END_ID, encoder

WINDOW = 2048
GROUP = 4096
TAIL = 128
ROWS = 250

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECE + ", sequence_id long, offset long"


def difference(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of each size, by multiway differencing into ``windows`` windows."""
    n = len(sizes)
    if windows == 1:
        return np.zeros(n, dtype=np.int64)
    fill: list[np.ndarray | None] = [None] * n  # ascending, above the emptiest window
    joins: list[tuple[int, int, np.ndarray]] = []
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)

    def taken(node: int) -> np.ndarray:
        out = fill[node]
        if out is None:
            out = np.zeros(windows, dtype=np.int64)
            out[-1] = sizes[node]
        fill[node] = None
        return out

    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        both = taken(a)[::-1] + taken(b)
        order = np.argsort(both, kind="stable")
        both = both[order] - both[order[0]]
        joins.append((a, b, order))
        fill.append(both)
        heapq.heappush(heap, (-int(both[-1]), n + len(joins) - 1))
    # From the last merge back: which window each slot of each merged partition became.
    slots: dict[int, np.ndarray] = {n + len(joins) - 1: np.arange(windows)}
    for node in range(n + len(joins) - 1, n - 1, -1):
        a, b, order = joins[node - n]
        of = slots.pop(node)
        slots[a], slots[b] = np.empty_like(of), np.empty_like(of)
        slots[a][windows - 1 - order] = of
        slots[b][order] = of
    return np.array([slots[i][-1] for i in range(n)])


def pack(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The window of each size and the number of windows, none over capacity."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        at = difference(sizes, windows)
        if np.bincount(at, weights=sizes, minlength=windows).max() <= capacity:
            return at, windows
        windows += 1


def cuts(n: int, window: int) -> list[int]:
    """Where the pieces of ``n`` ids start and end."""
    whole, rest = divmod(n, window)
    at = [window * i for i in range(whole + 1)]
    if rest > TAIL:
        at.append(n - rest % TAIL)
    return sorted({*at, n})


def _pieces(path: str, window: int, with_ids: bool):
    end = np.array([END_ID], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            rows = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids = memoryview(encode(text.as_py()) + end)
                n = len(ids) // 4
                at = cuts(n, window)
                for start, stop in zip(at, at[1:], strict=False):
                    part = ids[4 * start : 4 * stop]
                    row = (doc, start, stop - start, crc32(part), n)
                    rows.append((*row, bytes(part)) if with_ids else row)
            columns = list(zip(*rows, strict=True)) or [[]] * (6 if with_ids else 5)
            names = [f.split()[0] for f in PIECE.split(", ")]
            arrays = [pa.array(c, pa.int64()) for c in columns[:5]]
            if with_ids:
                names, arrays = [*names, "ids"], [*arrays, pa.array(columns[5], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def _windows(path: str, window: int, group: int):
    def placed(rows: pa.Table, sequence: np.ndarray, offset: np.ndarray) -> list[pa.RecordBatch]:
        rows = rows.append_column("sequence_id", pa.array(sequence, pa.int64()))
        return rows.append_column("offset", pa.array(offset, pa.int64())).to_batches()

    def packed(rows: pa.Table, first: int) -> tuple[list[pa.RecordBatch], int]:
        sizes = rows["length"].to_numpy()
        at, windows = pack(sizes, window)
        order = np.argsort(at, kind="stable")
        before = np.cumsum(sizes[order]) - sizes[order]
        starts = np.flatnonzero(np.append(True, np.diff(at[order]) != 0))
        offset = np.empty(len(sizes), dtype=np.int64)
        offset[order] = before - np.repeat(before[starts], np.diff(np.append(starts, len(order))))
        return placed(rows, first + at, offset), first + windows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder(path).release()  # the worker may have encoded before; here it needs no words
        pa.default_memory_pool().release_unused()
        first = TaskContext.get().partitionId() << 33
        held: list[pa.RecordBatch] = []
        waiting = 0
        for batch in batches:
            whole = pa.array(batch["length"].to_numpy() == window)
            full = pa.Table.from_batches([batch.filter(whole)])  # windows of their own
            yield from placed(full, first + np.arange(len(full)), np.zeros(len(full), dtype=np.int64))
            first += len(full)
            rest, at = batch.filter(pc.invert(whole)), 0
            while at < rest.num_rows:
                held.append(rest.slice(at, group - waiting))
                at, waiting = at + held[-1].num_rows, waiting + held[-1].num_rows
                if waiting == group:
                    out, first = packed(pa.Table.from_batches(held), first)
                    yield from out
                    held, waiting = [], 0
        if held:
            yield from packed(pa.Table.from_batches(held), first)[0]
        pa.default_memory_pool().release_unused()

    return run


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = True,
    group: int = GROUP,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset``, and ``ids`` (little-endian unsigned 32-bit) unless ``with_ids`` is off.

    A sequence is the pieces of one ``sequence_id`` by ``offset``, padded to ``window``.
    Ids of sequences are unique, not dense.
    """
    rows = long_rows(docs).select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    more = ", ids binary" if with_ids else ""
    pieces = rows.mapInArrow(_pieces(tokenizer, window, with_ids), PIECE + more)
    order = ["doc_id", "start", "length", "ids_crc32"]
    dealt = pieces.repartition(*order).sortWithinPartitions(*order)
    schema = PIECE + more + ", sequence_id long, offset long"
    return dealt.mapInArrow(_windows(tokenizer, window, group), schema)
