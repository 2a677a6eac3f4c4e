"""Near-dedup by SimHash and similarity: texts whose sets of word shingles have a Jaccard similarity of
at least ``NUMERATOR / DENOMINATOR`` are linked.

Each distinct set is a node. ``BANDS`` independent fingerprints per set, each made of the
minima of ``ROWS`` permutations of its shingle hashes, name the buckets it goes to; two sets
at the threshold miss each other in all of them with a chance of 2.4e-9, closer ones with
less. Every link is confirmed on the whole sets.

First each node is paired with the smallest of those whose SimHash fingerprint differs from its
own in at most ``MAX_BITS`` bits, found by the Gray-order index of ``simhash``, and with the
smallest of the nodes that come first in its buckets, so that a large group of copies costs two
comparisons per member. Then come the other pairs of near fingerprints, and of the first node
of a bucket with its others, that are not in one component yet. SimHash alone would miss most
texts between 0.8 and 0.95; the buckets of minima hold those. Last, in the buckets whose
members are not all in one component yet, members of different components are compared within
the task that holds the bucket, and the sets of those in a likely pair are brought to it, the
likely pairs (``LIKELY`` bytes of their sketches agree) a round before the others, each pair in
the first bucket that both go to: 32 bits of every bucket key ride along, and other texts agree in
those of a band with a chance of 2e-10. Pairs whose sizes rule out the similarity are left out, and so are those whose sketches tell them apart. A sketch is one
byte of each of the ``BITS`` minima. Two at the threshold agree in the first bits of less than
``AGREE`` of them with a chance of 3e-12 (6.9 standard deviations) and in less than ``SAME``
whole bytes with 2e-5 (4.2); texts that share three words in four do so nearly always. Only
what is left, pairs close to the threshold or above it, goes on to be confirmed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popatlas.llm.common import fresh, long_rows, whole_text
from popatlas.llm.components import LINKS, components
from popatlas.llm.runs import whole_runs
from popatlas.llm.simhash import (
    MAX_BITS,
    SEED,
    SHINGLE_WORDS,
    direct_links,
    fingerprint_links,
    majority,
    shingle_values,
)
from popatlas.plans.storage import stored

NUMERATOR, DENOMINATOR = 4, 5
ROWS = 5
BANDS = 50
BITS = ROWS * BANDS
AGREE = 192
SAME = 174
LIKELY = 195
STEP = 512
BLOCK = 256
PAIRS = 1 << 16  # whose bytes are compared at once
OPEN_ROWS = 1000

_drawn = np.random.default_rng(SEED)
_TIMES = _drawn.integers(0, 1 << 31, (BITS, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _drawn.integers(0, 1 << 32, (BITS, 1), dtype=np.uint32)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str, words: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct values of ``simhash.shingle_values``, ascending."""
    return np.unique(shingle_values(text, words))


def minima(values: np.ndarray) -> np.ndarray:
    """The least value of a set (not empty) under each permutation."""
    short = (values >> np.uint64(32)).astype(np.uint32)
    least = np.full(BITS, np.iinfo(np.uint32).max, dtype=np.uint32)
    for at in range(0, len(short), STEP):
        moved = short[at : at + STEP] * _TIMES
        moved += _PLUS
        np.minimum(least, moved.min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """A bucket key (signed) per band."""
    rows = least.reshape(BANDS, ROWS).astype(np.uint64)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX
    for k in range(ROWS):
        keys = (keys ^ rows[:, k]) * _MIX
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def tag(keys: np.ndarray) -> np.ndarray:
    """The 32 low bits of bucket keys, less 2^31."""
    return ((keys & 0xFFFFFFFF) - (1 << 31)).astype(np.int32)


def sketch(least: np.ndarray) -> bytes:
    """One byte of each minimum."""
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


def first_bits(sketches: np.ndarray) -> np.ndarray:
    """The first bit of each byte of the sketches, in whole words of 64."""
    bits = np.packbits(sketches >> 7, axis=1)
    return np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8))).view(np.uint64)


def close(
    sketches: np.ndarray,
    bits: np.ndarray,
    u: np.ndarray,
    v: np.ndarray,
    same: int = SAME,
    below: int = BITS + 1,
) -> np.ndarray:
    """Which of the pairs of rows ``u``, ``v`` may be similar as far as sketches tell, that
    is, share ``same`` bytes, but less than ``below``."""
    near = np.bitwise_count(bits[u] ^ bits[v]).sum(axis=1) <= BITS - AGREE
    for at in range(0, len(u), PAIRS):
        left = at + np.flatnonzero(near[at : at + PAIRS])
        shared = (sketches[u[left]] == sketches[v[left]]).sum(axis=1)
        near[left] = (shared >= same) & (shared < below)
    return near


def shared_before(tags: np.ndarray, band: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Which of the pairs of rows ``u``, ``v`` also share a bucket of a band before ``band``."""
    return (tags[u, :band] == tags[v, :band]).any(axis=1)


def node_of(values: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(values.tobytes(), SEED) - (1 << 63)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets (ascending) reach the similarity."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * DENOMINATOR >= NUMERATOR * (len(a) + len(b) - both)


def _described(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, fps, sizes, keys, sketches = [], [], [], [], []
            for text in batch["text"]:
                repeated = shingle_values(text.as_py(), words)
                values = np.unique(repeated)
                fps.append(majority(repeated))
                # Smaller sets reach the similarity only if they are equal.
                least = minima(values) if len(values) >= NUMERATOR else None
                nodes.append(node_of(values))
                sizes.append(len(values))
                keys.append([] if least is None else band_keys(least))
                sketches.append(None if least is None else sketch(least))
            columns = [
                batch["doc_id"],
                batch["text_key"],
                pa.array(nodes, pa.int64()),
                pa.array(np.array(fps, dtype=np.uint64).view(np.int64)),
                pa.array(sizes, pa.int64()),
                pa.array(keys, pa.list_(pa.int64())),
                pa.array(sketches, pa.binary()),
            ]
            names = ["doc_id", "text_key", "node", "fp", "size", "keys", "sketch"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _whole_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [shingles(t.as_py(), words) for t in batch["text"]]
            nodes = pa.array([node_of(v) for v in values], pa.int64())
            sets = pa.array([v.tobytes() for v in values], pa.binary())
            yield pa.RecordBatch.from_arrays([nodes, sets], ["node", "values"])

    return run


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of buckets of at least two, each with the smallest of its bucket."""
    for table, starts in whole_runs(batches, ["key"]):
        sizes = np.diff(np.append(starts, table.num_rows))
        nodes = table["node"].to_numpy()
        centre = np.repeat(nodes[starts], sizes)
        keep = np.repeat(sizes, sizes) > 1
        columns = [pa.array(x[keep]) for x in (table["key"].to_numpy(), nodes, centre)]
        yield pa.RecordBatch.from_arrays(columns, ["key", "node", "centre"])


def _candidates(
    table: pa.Table, starts: np.ndarray, same: int, below: int, skip: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The run and row numbers of pairs of a bucket that lie in different components, share
    ``same`` bytes, but less than ``below``, and no bucket of a band before. The first ``skip``
    rows of a bucket are left out."""
    nodes, labels, sizes = (table[c].to_numpy() for c in ("node", "label", "size"))
    sketches = np.frombuffer(b"".join(table["sketch"].to_pylist()), dtype=np.uint8)
    sketches = sketches.reshape(len(nodes), BITS)
    bits = first_bits(sketches)
    tags = table["tags"].combine_chunks().flatten().to_numpy().reshape(len(nodes), BANDS)
    own = tag(table["key"].to_numpy())
    for run, (start, stop) in enumerate(zip(starts, [*starts[1:], len(nodes)], strict=True)):
        band = int((tags[start] == own[start]).argmax())
        for a in range(start + skip, stop, BLOCK):
            for b in range(a, stop, BLOCK):
                us, vs = slice(a, min(a + BLOCK, stop)), slice(b, min(b + BLOCK, stop))
                small = np.minimum(sizes[us, None], sizes[None, vs])
                large = np.maximum(sizes[us, None], sizes[None, vs])
                may = (labels[us, None] != labels[None, vs]) & (nodes[us, None] < nodes[None, vs])
                may &= small * DENOMINATOR >= large * NUMERATOR
                u, v = np.nonzero(may)
                near = np.flatnonzero(close(sketches, bits, a + u, b + v, same, below))
                near = near[~shared_before(tags, band, a + u[near], b + v[near])]
                yield run, a + u[near], b + v[near]


def _across(same: int, below: int):
    """The candidates of each bucket. Its first node has been compared with all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_runs(batches, ["key"]):
            nodes = table["node"].to_numpy()
            for _, u, v in _candidates(table, starts, same, below, 1):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[u]), pa.array(nodes[v])], ["u", "v"])

    return run


def _open_members(same: int, below: int):
    """The rows of each bucket that are in any pair of :func:`_across`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_runs(batches, ["key"]):
            paired = np.zeros(table.num_rows, dtype=bool)
            for _, u, v in _candidates(table, starts, same, below, 1):
                paired[u] = paired[v] = True
            yield from table.filter(pa.array(paired)).combine_chunks().to_batches(max_chunksize=OPEN_ROWS)

    return run


def _linked_across(same: int, below: int):
    """The pairs of :func:`_across` that are similar, from its :func:`_open_members` with their
    sets. What a bucket has joined already is not compared again, so no more links leave it than
    it has members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_runs(batches, ["key"]):
            nodes, labels = (table[c].to_numpy() for c in ("node", "label"))
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["values"].combine_chunks()]
            joined: dict[int, int] = {}
            at, us, vs = -1, [], []

            def top(label: int) -> int:
                while label in joined:
                    label = joined[label]
                return label

            for bucket, u, v in _candidates(table, starts, same, below, 0):
                if bucket != at:
                    joined.clear()
                    at = bucket
                for i, j in zip(u.tolist(), v.tolist(), strict=True):
                    a, b = top(int(labels[i])), top(int(labels[j]))
                    if a != b and similar(sets[i], sets[j]):
                        joined[max(a, b)] = min(a, b)
                        us.append(nodes[i])
                        vs.append(nodes[j])
            found = [pa.array(us, pa.int64()), pa.array(vs, pa.int64())]
            yield pa.RecordBatch.from_arrays(found, ["u", "v"])

    return run


def _may_be_similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs ``u, v`` with ``size_u, sketch_u, size_v, sketch_v`` that sizes and sketches
    leave over."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        joined = b"".join(batch["sketch_u"].to_pylist() + batch["sketch_v"].to_pylist())
        sketches = np.frombuffer(joined, dtype=np.uint8).reshape(2 * n, BITS)
        a, b = batch["size_u"].to_numpy(), batch["size_v"].to_numpy()
        near = close(sketches, first_bits(sketches), np.arange(n), np.arange(n, 2 * n))
        near &= np.minimum(a, b) * DENOMINATOR >= np.maximum(a, b) * NUMERATOR
        yield batch.select(["u", "v"]).filter(pa.array(near))


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(batch["a"], batch["b"], strict=True)
        good = [
            similar(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64))
            for a, b in pairs
        ]
        yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))


def _sets(asked: DataFrame, docs: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """``node, values`` of the nodes ``asked`` for; ``docs`` and ``rows`` hold the texts and what
    is known of them."""
    found = rows.join(asked, "node", "left_semi").groupBy("node").agg(
        F.min(F.struct(F.col("doc_id"), F.col("text_key"))).alias("first")
    )
    found = stored(found.select("first.doc_id", "first.text_key"), "asked-texts")
    same = docs["doc_id"].eqNullSafe(found["doc_id"]) & (docs["text_key"] == found["text_key"])
    texts = docs.join(found, same, "left_semi").select("text")
    sets = texts.mapInArrow(_whole_sets(words), "node long, values binary")
    return stored(sets.dropDuplicates(["node"]), "whole-sets")


def _confirm(pairs: DataFrame, docs: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """Those of the pairs ``u, v`` whose sets are similar."""
    asked = pairs.select(F.col("u").alias("node")).distinct()
    asked = asked.unionByName(pairs.select(F.col("v").alias("node")).distinct()).distinct()
    sets = _sets(asked, docs, rows, words)
    joined = (
        pairs.join(sets.select(F.col("node").alias("u"), F.col("values").alias("a")), "u")
        .join(sets.select(F.col("node").alias("v"), F.col("values").alias("b")), "v")
        .select("u", "v", "a", "b")
    )
    return stored(joined.mapInArrow(_confirmed, LINKS), "similar-pairs")


def _near_fingerprints(rows: DataFrame) -> DataFrame:
    """Pairs ``u, v`` of nodes, ``u`` the smaller, whose SimHash fingerprints are equal or found
    near by the Gray-order index: each fingerprint with the smallest of every bucket it shares."""
    named = rows.where("sketch is not null").select("fp", "node").distinct()
    fps = stored(named.groupBy("fp").agg(F.min("node").alias("rep")), "distinct-fingerprints")
    equal = named.join(fps, "fp").select(F.col("rep").alias("u"), F.col("node").alias("v"))
    found = fingerprint_links(fps, MAX_BITS, forest=direct_links).unionByName(equal).where("u <> v")
    return found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def similar_groups(
    docs: DataFrame, words: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: ``doc_id, text_key, component``; ``text_key`` is the XXH64 of the
    text, null texts counting as empty, and texts without a word are alike."""
    texts = long_rows(docs).select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(whole_text(text_col)).alias("text_key"),
        whole_text(text_col).alias("text"),
    )
    schema = "doc_id long, text_key long, node long, fp long, size long, keys array<long>, sketch binary"
    rows = stored(texts.mapInArrow(_described(words), schema), "shingle-sets")
    tags = F.transform("keys", lambda k: (k.bitwiseAND(F.lit(0xFFFFFFFF)) - F.lit(1 << 31)).cast("int"))
    nodes = rows.select("node", "size", "sketch", tags.alias("tags")).dropDuplicates(["node"])
    nodes = stored(nodes.where("sketch is not null"), "distinct-sets")
    members = (
        rows.select("node", "keys")
        .dropDuplicates(["node"])
        .select("node", F.explode("keys").alias("key"))
        .repartition("key")
        .sortWithinPartitions("key", "node")
        .mapInArrow(_stars, "key long, node long, centre long")
    )
    members = stored(members, "bucket-members")
    sides = [
        nodes.select(
            F.col("node").alias(side), F.col("size").alias(f"size_{side}"), F.col("sketch").alias(f"sketch_{side}")
        )
        for side in "uv"
    ]
    label = F.coalesce("component", "node")

    def linked(pairs: DataFrame) -> DataFrame:
        likely = pairs.join(sides[0], "u").join(sides[1], "v").mapInArrow(_may_be_similar, LINKS)
        return _confirm(stored(likely, "star-pairs"), texts, rows, words)

    def labelled(found: DataFrame) -> DataFrame:
        return members.join(found, "node", "left").withColumn("label", label).drop("component")

    stars = members.where("node <> centre").select(F.col("centre").alias("u"), F.col("node").alias("v"))
    near = stored(_near_fingerprints(rows), "near-fingerprints")
    first = [pairs.groupBy("v").agg(F.min("u").alias("u")).select("u", "v") for pairs in (near, stars)]
    links = linked(first[0].unionByName(first[1]).distinct())
    found = components(links)
    ends = [
        found.select(F.col("node").alias(side), F.col("component").alias(f"at_{side}")) for side in "uv"
    ]
    apart = (
        near.unionByName(stars)
        .join(ends[0], "u", "left")
        .join(ends[1], "v", "left")
        .where("coalesce(at_u, u) <> coalesce(at_v, v)")
        .select("u", "v")
        .distinct()
    )
    links = links.unionByName(linked(apart))
    # The likely pairs first: what they join needs no comparing after, and they are not compared again.
    for same, below in ((LIKELY, BITS + 1), (SAME, LIKELY)):
        known = stored(labelled(components(links)).drop("centre"), "labelled-members")
        mixed = known.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b")
        open_members = (
            known.join(mixed.select("key"), "key", "left_semi")
            .join(nodes, "node")
            .repartition("key")
            .sortWithinPartitions("key", "node")
        )
        schema = open_members.schema
        open_members = stored(open_members.mapInArrow(_open_members(same, below), schema), "open-members")
        sets = _sets(open_members.select("node").distinct(), texts, rows, words)
        more = (
            open_members.join(sets, "node")
            .repartition("key")
            .sortWithinPartitions("key", "node")
            .mapInArrow(_linked_across(same, below), LINKS)
        )
        more = stored(more, "similar-members")
        links = links.unionByName(more)
    named = rows.select("doc_id", "text_key", "node").join(components(links), "node", "left")
    return named.select("doc_id", "text_key", label.alias("component"))


def drop_similar(
    docs: DataFrame, words: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with the smallest id of each group only, all columns kept; a null id stays only
    when its whole group has null ids, and of repeated rows one."""
    groups = stored(similar_groups(docs, words, id_col, text_col), "similar-groups")
    name = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_key"))
    first = groups.groupBy("component").agg(F.min(name).alias("first"))
    key, gone_id, gone_key = fresh(docs, "_key", "_gone", "_gone_key")
    same = F.col(id_col).eqNullSafe(F.col(gone_id)) & (F.col(key) == F.col(gone_key))
    listed = [F.col("doc_id").alias(gone_id), F.col("text_key").alias(gone_key)]
    gone = groups.join(first, "component").where(name != F.col("first")).select(listed).distinct()
    kept = docs.withColumn(key, F.xxhash64(whole_text(text_col))).join(
        stored(gone, "similar-copies"), same, "left_anti"
    )
    twice = groups.groupBy(listed).count().where("count > 1").drop("count")
    twice = stored(twice, "repeated-rows")
    if twice.isEmpty():
        return kept.drop(key)
    once = kept.join(twice, same, "left_semi").dropDuplicates([id_col, key])
    return kept.join(twice, same, "left_anti").unionByName(once).drop(key)
