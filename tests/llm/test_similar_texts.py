"""The near-dedup stage of the pipeline against brute-force Jaccard."""

from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from popatlas.llm import simhash, similar_texts

SCHEMA = "doc_id long, text string, source string"


def brute_set(text):
    parts = (text or "").encode().lower().split()
    return {tuple(parts[i : i + 5]) for i in range(max(1, len(parts) - 4))} if parts else set()


def survivors(rows):
    """The smallest id of each group linked at a similarity of 0.8."""
    sets = [brute_set(t) for _, t, *_ in rows]
    label = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a == b or 5 * len(a & b) >= 4 * len(a | b):
            old, new = label[j], label[i]
            label = [new if x == old else x for x in label]
    groups = {}
    for (i, *_), k in zip(rows, label, strict=True):
        groups.setdefault(k, []).append(i)
    return sorted((min(g, key=lambda x: (x is None, x or 0)) for g in groups.values()), key=str)


def changed(rng, words, n):
    out = list(words)
    for at in rng.choice(len(out), n, replace=False):
        out[at] = f"x{rng.integers(1 << 30)}"
    return " ".join(out)


def test_stage_links_all_similar_texts(spark):
    rng, rows = np.random.default_rng(11), []
    for size, edits in ((100, 1), (100, 2), (300, 3), (300, 4), (300, 6), (300, 9), (1000, 9), (1000, 20), (1000, 25)):
        for _ in range(6):
            words = [f"w{x}" for x in rng.integers(0, 1 << 30, size)]
            rows += [(len(rows), " ".join(words), "s"), (len(rows) + 1, changed(rng, words, edits), "s")]
    # A large group whose members are not all similar to its smallest, and a common passage.
    words = [f"g{x}" for x in range(300)]
    rows += [(1000 + i, changed(rng, words, int(rng.integers(1, 6))), "s") for i in range(80)]
    rows += [(2000 + i, " ".join(words[:60] + [f"o{i}.{k}" for k in range(30)]), "s") for i in range(40)]
    rows += [(3000, None, "s"), (3001, " \t", "s"), (3002, "a b c", "s"), (3003, "A b  c", "s"), (3004, "a b d", "s")]
    rows += [(None, rows[0][1], "s"), (None, "lost id", "s"), (None, "another lost id", "s")]
    rows += [(5, "one id but another text", "s")]
    df = spark.createDataFrame(rows + rows[3:5], SCHEMA).repartition(5)
    got = corpus_pipeline.drop_near_copies(spark, df, "")
    assert got.columns == df.columns
    assert sorted((r.doc_id for r in got.collect()), key=str) == survivors(rows)
    assert corpus_pipeline.drop_near_copies(spark, df.limit(0), "").count() == 0


@pytest.mark.parametrize("size, edits", [(60, 1), (300, 6), (1000, 21)])
def test_bands_and_sketches_miss_no_similar_pair(size, edits):
    rng = np.random.default_rng(size)
    for _ in range(100):
        words = [f"w{x}" for x in rng.integers(0, 1 << 30, size)]
        a, b = (similar_texts.shingles(t) for t in (" ".join(words), changed(rng, words, edits)))
        if similar_texts.similar(a, b):
            x, y = similar_texts.minima(a), similar_texts.minima(b)
            assert (similar_texts.band_keys(x) == similar_texts.band_keys(y)).any()
            rows = np.frombuffer(similar_texts.sketch(x) + similar_texts.sketch(y), np.uint8)
            rows = rows.reshape(2, -1)
            bits = similar_texts.first_bits(rows)
            assert similar_texts.close(rows, bits, np.array([0]), np.array([1])).all()


def test_texts_that_share_three_words_in_four_make_no_candidates():
    """300 common words of 400, none similar: their number must not grow with the square."""
    rng = np.random.default_rng(3)
    common = [f"c{x}" for x in rng.integers(0, 1 << 30, 300)]
    texts = [" ".join(common + [f"o{i}.{k}" for k in range(100)]) for i in range(60)]
    least = [similar_texts.minima(similar_texts.shingles(t)) for t in texts]
    rows = np.array([np.frombuffer(similar_texts.sketch(x), np.uint8) for x in least])
    u, v = np.array(list(combinations(range(60), 2))).T
    assert similar_texts.close(rows, similar_texts.first_bits(rows), u, v).sum() <= 0.02 * len(u)


def test_pairs_leave_their_first_shared_bucket_only():
    """Members of one large group, in different components and close to the threshold."""
    rng = np.random.default_rng(5)
    words = [f"g{x}" for x in rng.integers(0, 1 << 30, 300)]
    texts = [changed(rng, words, 5) for _ in range(30)]
    least = [similar_texts.minima(similar_texts.shingles(t)) for t in texts]
    keys = np.array([similar_texts.band_keys(x) for x in least])
    assert all(((k & 0xFFFFFFFF) - (1 << 31) == similar_texts.tag(k)).all() for k in keys)
    rows = []  # key, node, label, size, sketch, tags as the stage joins them
    for i, (x, k) in enumerate(zip(least, keys, strict=True)):
        tags = similar_texts.tag(k).tolist()
        rows += [(int(key), i, i, 296, similar_texts.sketch(x), tags) for key in k]
    rows.sort(key=lambda r: r[:2])
    names = ["key", "node", "label", "size", "sketch", "tags"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32())]

    def pairs(same, below):
        arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        batch = pa.RecordBatch.from_arrays(arrays, names)
        cut = [batch.slice(at, 100) for at in range(0, batch.num_rows, 100)]
        found = similar_texts._across(same, below)(iter(cut))
        return [p for b in found for p in zip(b["u"].to_pylist(), b["v"].to_pylist(), strict=True)]

    sketches = np.array([np.frombuffer(similar_texts.sketch(x), np.uint8) for x in least])
    bits = similar_texts.first_bits(sketches)
    first = {}
    for band in range(similar_texts.BANDS):
        for key in np.unique(keys[:, band]):
            at = np.flatnonzero(keys[:, band] == key).tolist()
            for u, v in combinations(at, 2):  # the first of a bucket is left to the rounds before
                first.setdefault((u, v), u != at[0])
    u, v = np.array(sorted(first)).T
    likely = similar_texts.close(sketches, bits, u, v, similar_texts.LIKELY)
    near = similar_texts.close(sketches, bits, u, v)
    listed = list(zip(u.tolist(), v.tolist(), strict=True))
    one, two = pairs(similar_texts.LIKELY, similar_texts.BITS + 1), pairs(similar_texts.SAME, similar_texts.LIKELY)
    assert sorted(one) == [p for p, ok in zip(listed, likely, strict=True) if ok and first[p]]
    assert sorted(two) == [p for p, a, b in zip(listed, near, likely, strict=True) if a and not b and first[p]]
    assert len(one) > 20 and len(two) > 20


def test_stage_pairs_near_simhash_fingerprints(spark):
    rng = np.random.default_rng(7)
    words = rng.integers(0, 10**6, 2000).astype(str).tolist()
    other = rng.integers(0, 10**6, 2000).astype(str).tolist()
    texts = [" ".join(w) for w in (words, words[:-1] + ["x"], other)]
    prints = [simhash.fingerprint(t, 5) for t in texts]
    assert (prints[0] ^ prints[1]).bit_count() <= simhash.MAX_BITS < (prints[0] ^ prints[2]).bit_count()
    nodes = [similar_texts.node_of(similar_texts.shingles(t)) for t in texts]
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    rows = spark.createDataFrame(
        [(n, p, b"0") for n, p in zip(nodes, signed, strict=True)], "node long, fp long, sketch binary"
    )
    found = [tuple(r) for r in similar_texts._near_fingerprints(rows).collect()]
    assert found == [tuple(sorted(nodes[:2]))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = similar_texts.drop_similar(docs)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2]


def test_buckets_are_joined_by_no_more_links_than_members():
    rng = np.random.default_rng(11)
    words = rng.integers(0, 10**6, 400).astype(str).tolist()
    texts = [" ".join([*words[:-1], f"last{k}"]) for k in range(40)]
    sets = [similar_texts.shingles(t) for t in texts]
    least = [similar_texts.minima(s) for s in sets]
    keys = [similar_texts.band_keys(x) for x in least]
    key = int(next(k for k in keys[0] if sum(k in other for other in keys) > 20))
    members = [i for i, k in enumerate(keys) if key in k]
    # No bucket before is shared: each text has tags of its own but for that of the key.
    tags = np.array([np.arange(similar_texts.BANDS) + similar_texts.BANDS * (i + 1) for i in members])
    tags[:, int(np.flatnonzero(keys[members[0]] == key)[0])] = similar_texts.tag(np.array([key]))[0]
    rows = {
        "key": [key] * len(members),
        "node": members,
        "label": members,
        "size": [len(sets[i]) for i in members],
        "sketch": [similar_texts.sketch(least[i]) for i in members],
        "tags": tags.tolist(),
    }
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32())]
    columns = [pa.array(v, t) for v, t in zip(rows.values(), types, strict=True)]
    batch = pa.RecordBatch.from_arrays(columns, list(rows))
    limits = (similar_texts.SAME, similar_texts.BITS + 1)
    opened = pa.Table.from_batches(similar_texts._open_members(*limits)(iter([batch])))
    assert opened["node"].to_pylist() == members[1:]
    values = pa.array([sets[i].tobytes() for i in members[1:]], pa.binary())
    opened = opened.append_column("values", values).combine_chunks().to_batches()
    found = pa.Table.from_batches(similar_texts._linked_across(*limits)(iter(opened)))
    links = list(zip(found["u"].to_pylist(), found["v"].to_pylist(), strict=True))
    assert len(links) == len(members) - 2
    assert set(sum(links, ())) == set(members[1:])
