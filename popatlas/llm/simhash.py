"""SimHash near-dedup over a Gray-order hierarchical index.

Fingerprint: of the XXH64 values (seed 42) of all word shingles, the bits set in over half.
Only distinct fingerprints are searched; each stands for its smallest ``doc_id``.

Two 64-bit fingerprints that differ in at most four bits agree in at least two of six
blocks. So each fingerprint goes to one bucket for every pair of blocks (15 buckets, keyed
by about 21 bits), and every link has both ends in some bucket. A bucket of over ``BUCKET``
fingerprints is split by two more of six blocks of its remaining bits, and so on down to
``DEPTH`` levels, by the same argument; so a group of near copies, however large, is spread
over many buckets. Within a bucket the fingerprints are sorted by Gray rank; ``FAN``
neighbours make a node of the index, ``FAN`` nodes one of the level above. A node holds the
bits that all below it share and that the node above does not hold yet. A search walks down
level by level and adds up the differences on these masks; once they exceed the limit, the
whole node is dropped.

Links of a bucket leave it as a spanning forest, at most one per fingerprint. Components
of all links give each document the smallest ``doc_id`` it can reach.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popatlas.llm.common import long_rows, whole_text
from popatlas.llm.components import LINKS, components, spanning_forest
from popatlas.llm.runs import whole_runs
from popatlas.plans.storage import stored

SHINGLE_WORDS = 5
MAX_BITS = 4
SEED = 42
BUCKET = 20_000
DEPTH = 3
FAN = 16
QUERIES = 2048
CHUNK = 1 << 16
ALL = (1 << 64) - 1

Forest = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def shingle_values(text: str, words: int) -> np.ndarray:
    """The XXH64 values of all word shingles, repeats included. Only A-Z are lower-cased; words
    are runs of bytes other than space and 0x09 to 0x0D. A text of fewer words is one shingle,
    none gives none."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    last = ends[min(words, len(parts)) - 1 :]
    first = np.concatenate([[0], ends[: len(last) - 1] + 1])
    digest, found = xxhash.xxh64_intdigest, []
    for at in range(0, len(last), CHUNK):
        spans = zip(first[at : at + CHUNK].tolist(), last[at : at + CHUNK].tolist(), strict=True)
        found.append(np.array([digest(joined[a:b], SEED) for a, b in spans], dtype=np.uint64))
    return np.concatenate(found)


def majority(values: np.ndarray) -> int:
    """The unsigned number of the bits that are set in over half of the values."""
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(values), CHUNK):
        part = values[at : at + CHUNK].astype(">u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(values)).tobytes(), "big")


def fingerprint(text: str, words: int) -> int:
    """The unsigned fingerprint of a text; one without a word has 0."""
    return majority(shingle_values(text, words))


def fingerprints(
    docs: DataFrame, words: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long). Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), words) for t in batch["text"]]
            signed = np.array(fps, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(signed)], ["doc_id", "fp"])

    rows = long_rows(docs).select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def block_masks(used: int, blocks: int, equal: int) -> list[int]:
    """``used`` together with ``equal`` of ``blocks`` even blocks of the other bits."""
    free = [i for i in range(64) if not used >> i & 1]
    cuts = [len(free) * k // blocks for k in range(blocks + 1)]
    parts = [sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    return sorted({used | sum(c) for c in combinations(parts, equal)})


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code in Gray order."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


class GrayIndex:
    """Hierarchical index over codes (uint64) in Gray order."""

    def __init__(self, codes: np.ndarray):
        self.order = np.argsort(gray_rank(codes), kind="stable")
        self.codes = codes[self.order]
        ones, zeros = self.codes, ~self.codes
        levels = [(self.codes, np.full(len(codes), ALL, dtype=np.uint64))]
        while len(ones) > FAN:
            starts = np.arange(0, len(ones), FAN)
            ones = np.bitwise_and.reduceat(ones, starts)
            zeros = np.bitwise_and.reduceat(zeros, starts)
            levels.append((ones, ones | zeros))
        # From the top: the pattern of a node and the bits it holds beyond the node above.
        self.levels = []
        above = None
        for bits, fixed in reversed(levels):
            own = fixed if above is None else fixed & ~np.repeat(above, FAN)[: len(fixed)]
            self.levels.append((bits, own))
            above = fixed

    def search(self, queries: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query number, place in ``codes``) that differ in at most ``limit`` bits."""
        top = len(self.levels[0][0])
        query = np.repeat(np.arange(len(queries)), top)
        node = np.tile(np.arange(top), len(queries))
        differ = np.zeros(len(node), dtype=np.uint8)
        for depth, (bits, own) in enumerate(self.levels):
            if depth:
                query = np.repeat(query, FAN)
                differ = np.repeat(differ, FAN)
                node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                real = node < len(bits)
                query, differ, node = query[real], differ[real], node[real]
            differ = differ + np.bitwise_count((queries[query] ^ bits[node]) & own[node])
            near = differ <= limit
            query, node, differ = query[near], node[near], differ[near]
        return query, node


def direct_links(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links of each node to smaller ones, that to the smallest."""
    low, high = np.minimum(u, v), np.maximum(u, v)
    order = np.lexsort((low, high))
    low, high = low[order], high[order]
    first = np.append(True, high[1:] != high[:-1])[: len(high)]
    return high[first], low[first]


def large_bucket(
    fps: np.ndarray, reps: np.ndarray, limit: int, forest: Forest = spanning_forest
) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between the fingerprints of one bucket."""
    index = GrayIndex(fps)
    ordered = reps[index.order]
    us, vs = [], []
    for start in range(0, len(fps), QUERIES):
        query, found = index.search(index.codes[start : start + QUERIES], limit)
        later = found > query + start
        u, v = forest(ordered[query[later] + start], ordered[found[later]])
        us.append(u)
        vs.append(v)
    return np.concatenate(us), np.concatenate(vs)


def small_buckets(
    fps: np.ndarray, reps: np.ndarray, sizes: np.ndarray, limit: int
) -> tuple[np.ndarray, np.ndarray]:
    """Links within all buckets of at most ``FAN`` fingerprints, a single node each."""
    bucket = np.repeat(np.where(sizes <= FAN, np.arange(len(sizes)), -1), sizes)
    us, vs = [reps[:0]], [reps[:0]]
    for ahead in range(1, min(FAN, int(sizes.max()))):
        near = (bucket[:-ahead] == bucket[ahead:]) & (bucket[ahead:] >= 0)
        near[near] = np.bitwise_count(fps[:-ahead][near] ^ fps[ahead:][near]) <= limit
        us.append(reps[:-ahead][near])
        vs.append(reps[ahead:][near])
    return np.concatenate(us), np.concatenate(vs)


def _link_buckets(limit: int, forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_runs(batches, ["mask", "key"]):
            fps = table["fp"].to_numpy().view(np.uint64)
            reps = table["rep"].to_numpy()
            sizes = np.diff(np.append(starts, len(fps)))
            found = [small_buckets(fps, reps, sizes, limit)]
            for at, n in zip(starts[sizes > FAN], sizes[sizes > FAN], strict=True):
                found.append(large_bucket(fps[at : at + n], reps[at : at + n], limit, forest))
            u, v = forest(*(np.concatenate(x) for x in zip(*found, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return run


def fingerprint_links(
    fps: DataFrame, limit: int = MAX_BITS, bucket: int = BUCKET, forest: Forest = spanning_forest
) -> DataFrame:
    """Links ``u, v`` between the ``rep`` values of distinct fingerprints (``fp, rep``) that
    differ in at most ``limit`` bits, enough of them to give all components; with
    :func:`direct_links` the pairs themselves, each fingerprint of a bucket with the smallest."""
    blocks, equal = limit + 2, 2
    todo, links = fps.withColumn("mask", F.lit(0).cast("long")), None
    masks = [0]
    for level in range(DEPTH):
        finer = {m: block_masks(m, blocks, equal) for m in masks}
        masks = sorted({s for found in finer.values() for s in found})
        table = F.create_map(
            *[
                x
                for m, found in finer.items()
                for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(s)) for s in found]))
            ]
        )
        rows = todo.select("fp", "rep", F.explode(table[F.col("mask")]).alias("mask"))
        if level:
            rows = rows.distinct()
        rows = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        last = level == DEPTH - 1
        if not last:
            big = stored(
                rows.groupBy("mask", "key").count().where(F.col("count") > bucket).drop("count"), "big"
            )
            again = not big.isEmpty()
            if again:
                todo = stored(rows.join(big, ["mask", "key"], "left_semi").drop("key"), "again")
                rows = rows.join(big, ["mask", "key"], "left_anti")
        found = (
            rows.repartition("mask", "key")
            .sortWithinPartitions("mask", "key")
            .mapInArrow(_link_buckets(limit, forest), LINKS)
        )
        links = found if links is None else links.unionByName(found)
        if last or not again:
            return links
    return links


def near_groups(
    docs: DataFrame,
    words: int = SHINGLE_WORDS,
    limit: int = MAX_BITS,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket: int = BUCKET,
) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id``.

    Empty texts have fingerprint 0 and link like all others. Repeated rows give repeated
    results. A null id is never the smallest of its component, unless all ids are null.
    """
    rows = stored(fingerprints(docs, words, id_col, text_col), "fingerprints")
    fps = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct-fingerprints")
    links = fingerprint_links(fps.where("rep is not null"), limit, bucket)
    found = components(links).withColumnRenamed("node", "rep")
    joined = fps.join(found, "rep", "left")
    named = joined.select("fp", F.coalesce("component", "rep").alias("component_id"))
    return rows.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_copies(
    docs: DataFrame,
    words: int = SHINGLE_WORDS,
    limit: int = MAX_BITS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with the smallest id of each group only, all columns kept; rows with a null
    id stay only when their whole group has null ids, and of repeated rows one."""
    groups = near_groups(docs, words, limit, id_col, text_col)
    gone = groups.where(~F.col("doc_id").eqNullSafe(F.col("component_id")))
    gone = stored(gone.select(F.col("doc_id").alias("_gone")).distinct(), "near-copies")
    kept = docs.join(gone, F.col(id_col).eqNullSafe(F.col("_gone")), "left_anti")
    twice = kept.groupBy(F.col(id_col).alias("_twice")).count().where("count > 1").drop("count")
    twice = stored(twice, "repeated-ids")
    if twice.isEmpty():
        return kept
    same = F.col(id_col).eqNullSafe(F.col("_twice"))
    once = kept.join(twice, same, "left_semi").dropDuplicates([id_col])
    return kept.join(twice, same, "left_anti").unionByName(once)
