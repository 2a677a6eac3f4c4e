"""Sharding: a Feistel permutation of the global row numbers deals rows to shards.

Rows are numbered in ascending ``doc_id`` order. The permutation acts on pairs
``(left, right)`` of ``Z_a x Z_b`` with ``a * b`` at least the number of rows: each round
adds a keyed hash of one half to the other. Numbers that leave the range of rows are
permuted again (cycle walking). ``domain`` picks ``a`` and ``b`` so that at most ``SPARE``
numbers lie outside; a walk thus ends within ``SPARE`` further steps, always.

Position ``p`` of the shuffled order is slot ``p div shards`` of shard ``p mod shards``:
shards differ by at most one row, slots have no gaps, and both follow from the row number
alone (``place``), as does the row number from them (``row_at``). Rows are numbered by
``(doc_id, text_crc32, size)``, nulls first; equal rows may swap their numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popatlas.llm.common import number_rows, utf8, whole_text

ROUNDS = 8
SPARE = 64
ROW_OVERHEAD = 16


def domain(n: int) -> tuple[int, int]:
    """``a, b`` near the root of ``n`` with ``n <= a * b <= n + SPARE``."""
    a = max(1, math.isqrt(n))
    while a > 1 and -n % a > SPARE:
        a -= 1
    return a, max(1, -(-n // a))


def _div(x: Column, by: int) -> Column:
    """Integer quotient; the dividend is a multiple, so the division is exact to 2^53."""
    return ((x - x % by) / by).cast("long")


def _once(x: Column, a: int, b: int, seed: int, inverse: bool) -> Column:
    """One application: the halves take turns in getting a hash of the other added."""
    moduli = [a, b]
    first = F.struct(_div(x, b).alias("l"), (x % b).alias("r"))
    steps = range(ROUNDS)[::-1] if inverse else range(ROUNDS)
    rounds = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(moduli[i % 2]).cast("long").alias("m")) for i in steps])
    sign = -1 if inverse else 1

    def step(s: Column, k: Column) -> Column:
        left = k["i"] % 2 == 0
        other = F.when(left, s["r"]).otherwise(s["l"])
        own = F.when(left, s["l"]).otherwise(s["r"])
        moved = F.pmod(own + sign * F.pmod(F.xxhash64(other, F.lit(seed).cast("long"), k["i"]), k["m"]), k["m"])
        return F.struct(
            F.when(left, moved).otherwise(s["l"]).alias("l"),
            F.when(left, s["r"]).otherwise(moved).alias("r"),
        )

    return F.aggregate(rounds, first, step, lambda s: s["l"] * b + s["r"])


def permute(x: Column, n: int, seed: int, inverse: bool = False) -> Column:
    """The position of row number ``x`` of ``n``, or with ``inverse`` the row of a position."""
    a, b = domain(n)
    y = _once(x, a, b, seed, inverse)
    if a * b == n:
        return y

    def walk(y: Column, _: Column) -> Column:
        return F.when(y < n, y).otherwise(_once(y, a, b, seed, inverse))

    return F.aggregate(F.sequence(F.lit(1), F.lit(a * b - n)), y, walk)


def place(row: Column, n: int, shards: int, seed: int) -> tuple[Column, Column]:
    """Shard and slot of a row number."""
    at = permute(row, n, seed)
    return (at % shards).cast("int"), _div(at, shards)


def row_at(shard: Column, slot: Column, n: int, shards: int, seed: int) -> Column:
    """The row number that lies in a slot of a shard."""
    return permute(slot * shards + shard, n, seed, inverse=True)


def assign_shards(
    docs: DataFrame,
    shards: int,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, row_number, shard, slot``.

    Null texts have size ``ROW_OVERHEAD`` and the checksum of the empty text.
    """
    text = whole_text(text_col)
    rows = number_rows(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
            F.crc32(utf8(text)).alias("text_crc32"),
        ),
        ["doc_id", "text_crc32", "size"],
        "numbered",
        "row_number",
    )
    n = rows.count()
    shard, slot = place(F.col("row_number"), n, shards, seed)
    return rows.withColumns({"shard": shard, "slot": slot})


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write ``docs`` as a folder per shard, in slot order; ``doc_id`` must be unique."""
    where = assigned.select(F.col("doc_id").alias("_id"), "shard", "slot")
    (
        docs.drop("shard", "slot")
        .join(where, F.col(id_col) == F.col("_id"))
        .drop("_id")
        .repartitionByRange("shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(path)
    )
