"""The training-data operators against brute force, on small tables with odd rows."""

import hashlib
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from popatlas.llm import (
    bpe,
    chat_format,
    embedding_dedup,
    exact_dedup,
    html_extract,
    packing,
    quality,
    sharding,
    simhash,
    token_coder,
    token_files,
    tokens,
)
from popatlas.llm.components import components
from popatlas.llm.tokens import Encoder
from popatlas.plans.storage import new_folder

WORD, BYTE = map(public_tokenizers.path, ("word_bpe_49k.json", "byte_bpe_50k.json"))
SCHEMA = "doc_id long, text string, source string, digest string, row string"
ROWS = [
    (1, "Alpha beta gamma delta epsilon", "s", "x", "y"),
    (2, "ALPHA beta gamma delta epsilon", "s", None, None),
    (3, "É é  alpha\tbeta\n\ngamma's <|endoftext|> 漢字 don't", None, "x", "y"),
    (4, None, "s", "x", "y"),
    (5, "", "s", "x", "y"),
    (6, "é é alpha", "s", "x", "y"),
    (None, "lost id", "s", "x", "y"),
    (8, "word " * 5000, "s", "x", "y"),
    (8, "word " * 5000, "s", "x", "y"),
]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_exact_groups(docs, none):
    got = exact_dedup.exact_groups(docs).collect()
    assert len(got) == len(ROWS)
    for r in got:
        texts = [t for i, t, *_ in ROWS if i == r.doc_id]
        same = [i for i, t, *_ in ROWS if lower(t) == lower(texts[0])]
        assert r.group_size == len(same)
        assert r.keep_id == max((i for i in same if i is not None), default=None)
        assert r.text_sha256 == hashlib.sha256(lower(texts[0]).encode()).hexdigest()
    kept = sorted((r.doc_id for r in got if r.kept), key=str)
    assert kept == sorted([2, 3, 5, 6, None, 8], key=str)
    dropped = exact_dedup.drop_exact_copies(docs)
    assert dropped.columns == docs.columns
    assert sorted((r.doc_id for r in dropped.collect()), key=str) == kept
    assert exact_dedup.exact_groups(none).count() == exact_dedup.drop_exact_copies(none).count() == 0


def test_exact_groups_do_not_depend_on_the_sketch(spark):
    rows = [(i, "hot" if i % 3 else f"text {i % 50}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    found = [
        sorted(map(tuple, exact_dedup.exact_groups(df, tracked=k).collect())) for k in (64, 4096)
    ]
    assert found[0] == found[1]


@pytest.mark.parametrize("n", [0, 1, 2, 7, 97, 1000])
def test_feistel_is_a_permutation(spark, n):
    rows = spark.range(n).select("id", sharding.permute(F.col("id"), max(n, 1), 5).alias("at"))
    back = rows.select("id", "at", sharding.permute(F.col("at"), max(n, 1), 5, True).alias("back"))
    got = back.collect()
    assert sorted(r["at"] for r in got) == list(range(n))
    assert all(r["back"] == r["id"] for r in got)
    a, b = sharding.domain(max(n, 1))
    assert n <= a * b <= max(n, 1) + sharding.SPARE


def test_shards(docs, none):
    got = sharding.assign_shards(docs, 4).collect()
    assert sorted((r.shard, r.slot) for r in got) == sorted((i % 4, i // 4) for i in range(9))
    assert sorted(r.row_number for r in got) == list(range(9))
    for r in got:
        text = next(t for i, t, *_ in ROWS if i == r.doc_id) or ""
        assert r["size"] == len(text.encode()) + 16 and r.text_crc32 == zlib.crc32(text.encode())
    again = sharding.assign_shards(docs.repartition(5), 4).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in got} == {(r.doc_id, r.shard, r.slot) for r in again}
    assert sharding.assign_shards(none, 4).count() == 0


def ids_of(text):
    found = Tokenizer.from_file(WORD).encode(text or "", add_special_tokens=False).ids
    return np.array([*found, 1], dtype="<u4")


def test_word_encoder_equals_the_library():
    encode, library = Encoder(WORD).encode, Tokenizer.from_file(WORD)
    rng = np.random.default_rng(2)
    letters = list("abXY'’s .,!*\n\t0é ΣİßµºªŉǺ̈ \x1c\x85漢🙂<|>") + ["<|endoftext|>", "<|ENDOFTEXT|>", "'LL"]
    for _ in range(3000):
        text = "".join(rng.choice(letters, rng.integers(0, 12)))
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encode(text), "<u4").tolist() == want


def test_token_blocks_round_trip():
    rng = np.random.default_rng(0)
    blocks = [rng.zipf(1.3, n) % 500 for n in (0, 1, 5000, token_coder.BLOCK)]
    codes = token_coder.encode_blocks(blocks, 500)
    for block, ids in zip(blocks, token_coder.decode_blocks(codes), strict=True):
        assert block.tolist() == ids.tolist()
    assert token_coder.encode_blocks(blocks[2:3], 500)[0] == codes[2]
    assert len(codes[3]) < 2 * len(blocks[3])
    for at in (0, 10, 40, len(codes[2]) - 1):
        damaged = bytearray(codes[2])
        damaged[at] ^= 1
        with pytest.raises(ValueError):
            token_coder.decode_blocks([bytes(damaged)])
    with pytest.raises(ValueError):
        token_coder.decode_blocks([codes[2][:-2]])


def test_token_blocks_learn_across_lanes():
    rng = np.random.default_rng(1)
    phrases = rng.integers(0, 40_000, (60, 5))
    ids = phrases[rng.integers(0, 60, 6_000)].ravel()
    (code,) = token_coder.encode_blocks([ids], 49_408)
    assert token_coder.decode_blocks([code])[0].tolist() == ids.tolist()
    assert len(code) < 0.35 * len(ids)


def test_token_blocks_of_odd_shapes():
    rng = np.random.default_rng(3)
    step = token_coder.STEPS
    blocks = [rng.integers(0, 50, n) for n in (step - 1, step, step + 1, 3 * step + 7)]
    blocks += [np.zeros(5000, dtype=int), np.full(3000, 99_999), np.arange(60_000), rng.integers(0, 100_000, 3000)]
    for ids, got in zip(blocks, token_coder.decode_blocks(token_coder.encode_blocks(blocks, 100_000)), strict=True):
        assert ids.tolist() == got.tolist()
    with pytest.raises(ValueError):
        token_coder.encode_blocks([blocks[0]], 1 << 23)


def test_words_share_the_ids_of_their_part():
    words = Encoder(WORD).words
    assert words["Élleque"] is words["élleque"] is words.pieces["élleque"]
    words.pieces.split = None  # a part the table lacks is not split anew
    assert words["Àÿß"] is words["àÿß"]


def test_token_blocks_code_thousands_of_ids_a_step(monkeypatch):
    steps = []
    predict = token_coder._Model.predict
    monkeypatch.setattr(token_coder._Model, "predict", lambda model: (steps.append(1), predict(model))[1])
    ids = (np.random.default_rng(4).zipf(1.2, 1 << 20) % 49_408).astype("<u4")
    codes = token_coder.encode_blocks(
        [ids[at : at + token_coder.BLOCK] for at in range(0, len(ids), token_coder.BLOCK)], 49_408
    )
    assert len(steps) <= len(ids) // 4_000
    assert np.array_equal(np.concatenate(token_coder.decode_blocks(codes)), ids)
    assert len(steps) <= len(ids) // 2_000


def test_a_full_word_table_keeps_what_came_first(monkeypatch):
    monkeypatch.setattr(tokens, "WORDS", 100)
    own, library = Encoder(WORD), Tokenizer.from_file(WORD)
    often = [f"{a}{b}" for a in "abcde" for b in "fghij"]
    own.encode(" ".join(often))
    for at in range(300):
        text = f"Élan{chr(97 + at % 26)}{chr(97 + at // 26)}, w{at}"
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == want
        assert len(own.words) <= 100 and all(word in own.words for word in often)


def test_token_files(spark, docs, none):
    path = new_folder(spark, "test-tokens")
    more = [(100 + i, "several words here " * 2000, None, None, None) for i in range(3)]
    token_files.write_tokens(docs.unionByName(spark.createDataFrame(more, SCHEMA)), WORD, path)
    got = sorted(token_files.token_index(spark, path).collect(), key=lambda r: r.start)
    rows = sorted([*ROWS, *more], key=lambda r: (r[0] is not None, r[0] or 0))
    at = 0
    for r, (doc, text, *_) in zip(got, rows, strict=True):
        ids = ids_of(text)
        assert (r.doc_id, r.start, r.n_tokens) == (doc, at, len(ids))
        assert r.ids_crc32 == zlib.crc32(ids.tobytes())
        at += len(ids)
    pieces = sorted(token_files.read_tokens(spark, path).where("doc_id = 101").collect(), key=lambda r: r.piece_start)
    assert sum((p.ids for p in pieces), []) == ids_of(more[1][1]).tolist()
    empty = new_folder(spark, "test-tokens")
    token_files.write_tokens(none, WORD, empty)
    assert token_files.token_index(spark, empty).count() == 0


def test_quality(spark, docs, none):
    good = [(i, f"the quiet river runs by number {i} and on", "a") for i in range(60)]
    bad = [(100 + i, f"BUY!!! $$$ NOW*** {i} %%% CHEAP!!!", "a") for i in range(60)]
    rows = spark.createDataFrame(good + bad, "doc_id long, text string, label string")
    marks = [(i, 1, 0) for i in range(60)] + [(100 + i, 0, 0) for i in range(60)]
    labels = spark.createDataFrame([*marks, (None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    votes = quality.fit(rows, labels)
    got = quality.score(rows, votes).collect()
    assert {r.held_out for r in got} == {True, False}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == (r.doc_id < 100) and 0 <= r.score <= 1
    kept = quality.keep_good(rows, votes)
    assert kept.columns == rows.columns and {r.doc_id for r in kept.collect()} == set(range(60))
    assert quality.score(docs, votes).count() == len(ROWS)
    assert quality.score(none, votes).count() == 0
    unlearned = quality.fit(none, labels)
    assert {r.score for r in quality.score(docs, unlearned).collect()} == {0.5}


def test_quality_scores_are_exact_votes():
    rng = np.random.default_rng(1)
    counts, labels = rng.poisson(0.05, (80, quality.TERMS)), rng.integers(0, 2, 80)
    votes = quality.Votes(counts, labels)
    asked = rng.poisson(0.05, (9, quality.TERMS))
    space = quality._unit(quality.weighted(asked, votes.weights) @ votes.axes)
    for vector, score in zip(space, votes.scores(asked), strict=True):
        near = sorted(zip(votes.vectors @ vector, labels, strict=True), reverse=True)[: quality.NEIGHBOURS]
        weights = [max(c, 0) ** quality.SHARPNESS for c, _ in near]
        want = sum(w * y for w, (_, y) in zip(weights, near, strict=True)) / sum(weights)
        assert score == pytest.approx(want, rel=1e-3, abs=1e-6)


def test_bpe_equals_the_library():
    own, library = bpe.Bpe(BYTE), Tokenizer.from_file(BYTE)
    rng = np.random.default_rng(3)
    letters = list("abXYth'’s .,!*\n\t0é ΣİßǺ̈ \x1c\x85\0漢🙂<|>") + ["<|endoftext|>", "'ll", "  ", "hello"]
    for _ in range(3000):
        text = "".join(rng.choice(letters, rng.integers(0, 14)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
        ids = rng.integers(0, 50257, 6).tolist()
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_automaton_states():
    merges = [(b"a", b"b"), (b"a", b"a"), (b"ab", b"c"), (b"aa", b"b"), (b"aa", b"aa"), (b"c", b"ab")]
    auto = bpe.Automaton(merges)
    for x in range(len(auto.tokens)):
        for y in range(len(auto.tokens)):
            assert auto.follows(x, y) == auto._arc(auto.target[x], y)

    def merged(word):  # by priority, leftmost first
        parts = [bytes([b]) for b in word]
        for u, v in merges:
            i = 0
            while i + 1 < len(parts):
                if (parts[i], parts[i + 1]) == (u, v):
                    parts[i : i + 2] = [u + v]
                i += 1
        return parts

    rng = np.random.default_rng(4)
    for _ in range(2000):
        word = bytes(rng.choice(list(b"abc"), rng.integers(1, 12)).tolist())
        assert [auto.tokens[t] for t in auto.encode(word)] == merged(word)


def test_bpe_words_together():
    own, library = bpe.Bpe(BYTE), Tokenizer.from_file(BYTE)
    auto, rng = own.automaton, np.random.default_rng(6)
    letters = list("aeioubcdthsn") + ["the", "ing", "ß", "漢", "'", "!!", "0"]
    words = {"".join(rng.choice(letters, rng.integers(1, 30))).encode() for _ in range(4000)}
    words = sorted(words | {b"ab" * bpe.LONG, b"a" * bpe.LONG, b"a" * (bpe.LONG + 1), b"x"})
    together = auto.encode_words(words)
    for word, tokens in zip(words, together, strict=True):
        assert tokens.tolist() == auto.encode(word)
        assert b"".join(auto.tokens[t] for t in tokens) == word
        assert all(auto.follows(a, b) for a, b in zip(tokens, tokens[1:]))
    assert auto.encode_words([]) == []
    # Arcs keep their answer however often others have taken their place in the table.
    before, token = rng.integers(0, auto.start + 1, 20_000), rng.integers(0, auto.start, 20_000)
    for _ in range(2):
        got = auto._arcs(before, token)
        assert got.tolist() == [auto.follows(a, b) for a, b in zip(before.tolist(), token.tolist())]
    texts = ["", "one two", "a<|endoftext|>b", " " * 5000 + "end", "\n\nab \n", "ab" * 5000, "one two"]
    ids = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(i, "<u4").tolist() for i in own.encode_all(texts)] == ids
    assert [t for run in bpe._runs(texts) for t in run] == texts and not list(bpe._runs([]))


def test_bpe_words_let_go(monkeypatch):
    monkeypatch.setattr(bpe, "WORDS", 3)
    own, library = bpe.Bpe(BYTE), Tokenizer.from_file(BYTE)
    for text in ("one two three four", "four five <|endoftext|> one", "", "one two three four"):
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids


def test_bpe_tables(docs, none):
    library = Tokenizer.from_file(BYTE)
    decoded = bpe.decode_ids(bpe.encode_texts(docs, BYTE), BYTE).collect()
    assert len(decoded) == len(ROWS)
    for r in decoded:
        text = next(t for i, t, *_ in ROWS if i == r.doc_id) or ""
        assert r.ids == library.encode(text, add_special_tokens=False).ids and r.text == text
    assert bpe.decode_ids(bpe.encode_texts(none, BYTE), BYTE).count() == 0


def test_packing(docs, none):
    got = packing.pack_documents(docs, WORD, window=256, group=8).collect()
    ids = [ids_of(t) for _, t, *_ in ROWS]
    assert sum(r.length for r in got) == sum(map(len, ids))
    assert all(r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length for r in got)
    three = b"".join(r.ids for r in sorted(got, key=lambda r: r.start) if r.doc_id == 3)
    assert three == ids[2].tobytes()
    by = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == by.get(r.sequence_id, 0)
        by[r.sequence_id] = r.offset + r.length
    assert max(by.values()) <= 256
    assert packing.pack_documents(none, WORD).count() == 0


def test_differencing():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 200, 300)
    fill = np.bincount(packing.difference(sizes, 20), weights=sizes, minlength=20)
    assert fill.sum() == sizes.sum() and fill.max() - fill.min() <= 20
    at, windows = packing.pack(np.array([60, 60, 60]), 100)  # two could hold them by size
    assert windows == 3 and sorted(at) == [0, 1, 2]


def vectors_by_brute_force(rows, threshold):
    unit = {}
    for k, (i, v, label) in enumerate(rows):
        ok = v and all(x is not None and np.isfinite(x) for x in v) and any(v) and label is not None
        if ok and i is not None:
            unit[k] = np.array(v, dtype=float) / np.linalg.norm(v)
    near = {k: {k} for k in range(len(rows))}
    for a, b in combinations(unit, 2):
        if rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
            near[a].add(b)
            near[b].add(a)
    out = []
    for k, (i, *_) in enumerate(rows):
        reach, todo = {k}, [k]
        while todo:
            new = near[todo.pop()] - reach
            reach |= new
            todo += new
        out.append((i, len(near[k]) - 1, min((rows[r][0] for r in reach), key=lambda x: (x is None, x))))
    return out


@pytest.mark.parametrize("chunk", [5, 4096])
def test_similar_vectors(spark, chunk):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((6, 16))
    rows = [
        (i, (base[i % 6] + 0.02 * rng.standard_normal(16)).astype(np.float32).tolist(), i % 2) for i in range(90)
    ]
    rows += [(90 + i, rows[0][1], 0) for i in range(5)] + [(200, [0.0] * 16, 0), (201, None, 0), (202, [], 1)]
    rows += [(203, [1.0, None], 0), (204, [float("nan")] * 16, 0), (205, rows[0][1], None), (206, [1.0, 2.0], 0), (207, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    got = embedding_dedup.similar_vectors(df, chunk=chunk).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted(vectors_by_brute_force(rows, 0.98))
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert embedding_dedup.similar_vectors(df.limit(0)).count() == 0


def test_chat(spark):
    turns = [
        (1, "chosen", 0, "user", "hi"), (1, "chosen", 1, "assistant", "yo"), (1, "chosen", 2, "user", "more <|im_end|>"),
        (1, "rejected", 0, "user", "hi"), (1, "rejected", 0, "user", "hi"), (1, "rejected", 1, "assistant", "no"),
        (2, "chosen", None, None, None), (2, "rejected", None, None, None),
        (3, "chosen", 0, "user", "alone"), (None, "chosen", 0, "user", "x"), (4, "other", 0, "user", "x"),
    ]
    df = spark.createDataFrame(turns, "pair_id long, side string, turn long, role string, text string")
    got = {r.pair_id: r for r in chat_format.preference_pairs(df).collect()}
    assert sorted(got) == [1, 2, 3]
    one = got[1]
    assert one.prompt == "<|im_start|>user\nhi<|im_end|>\n"
    assert one.rejected == "<|im_start|>assistant\nno<|im_end|>\n"
    assert one.chosen.endswith("<|im_start|>user\nmore <im_end><|im_end|>\n")
    for text, spans, want in ((one.chosen, one.chosen_spans, "yo"), (one.rejected, one.rejected_spans, "no")):
        a, b = map(int, spans.split("-"))
        assert text[a:b] == want
    assert got[2].prompt == "<|im_start|>unknown\n<|im_end|>\n" and got[2].chosen == got[2].rejected == ""
    assert got[3].prompt == "" and got[3].rejected == ""
    assert chat_format.preference_pairs(df.limit(0)).count() == 0
    long = [(9, s, t, "user", f"{t}") for t in range(7) for s in ("chosen", "rejected")]
    parts = chat_format.preference_pairs(spark.createDataFrame(long, df.schema), part=3).collect()
    assert sorted((r.part, r.n_prompt_turns) for r in parts) == [(0, 3), (1, 3), (2, 1)]


def brute_fingerprint(text, words):
    parts = (text or "").encode().lower().split()
    spans = [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))] if parts else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in spans]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, docs, none):
    got = simhash.near_groups(docs, words=4).collect()
    for r in got:
        text = next(t for i, t, *_ in ROWS if i == r.doc_id)
        assert r.fingerprint == f"{brute_fingerprint(text, 4):016x}"
    assert {r.doc_id: r.component_id for r in got}[5] == 4
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 3, 4, 6, 8, None], key=str)
    assert simhash.near_groups(none).count() == simhash.drop_near_copies(none).count() == 0


@pytest.mark.parametrize("bucket", [20, 20_000])
def test_fingerprint_links(spark, bucket):
    rng = np.random.default_rng(7)
    centres = [int(x) for x in rng.integers(0, 1 << 63, 4)]
    fps = set()
    for k in range(240):
        flips = rng.choice(64, rng.integers(0, 7), replace=False)
        fps.add(centres[k % 4] ^ sum(1 << int(b) for b in flips))
    fps = sorted(fps)
    rows = [(simhash._signed(f), i) for i, f in enumerate(fps)]
    links = simhash.fingerprint_links(spark.createDataFrame(rows, "fp long, rep long"), 4, bucket)
    got = {r.node: r.component for r in components(links).collect()}
    label = list(range(len(fps)))
    for a, b in combinations(range(len(fps)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 4 and label[a] != label[b]:
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = [new if x == old else x for x in label]
    assert [got.get(i, i) for i in range(len(fps))] == label


def test_gray_index():
    rng = np.random.default_rng(8)
    codes = np.unique(rng.integers(0, 1 << 12, 700).astype(np.uint64))
    index = simhash.GrayIndex(codes)
    query, found = index.search(codes[:40], 2)
    want = {(q, int(c)) for q in range(40) for c in codes if int(codes[q] ^ c).bit_count() <= 2}
    assert {(int(q), int(index.codes[f])) for q, f in zip(query, found, strict=True)} == want


def test_html(spark):
    def page(body, head="<title>t &am</title><script>var t='</p>';</script>"):
        return f"<!DOCTYPE html><head>{head}</head><body><nav><ul><li><a href='/'>menu</a></ul></nav>{body}<footer>foot</footer>"

    article = "<article><h1>A &amp; B</h1><div class='ad'>buy</div><p>one <b>two</b><br>three<p>four&nbsp; five</p><div id=comments>no</div></article>"
    rows = [(i, "http://a.example/x", page(article.replace("four", f"four{i}"))) for i in range(3)]
    rows += [(10, None, None), (11, "::bad", ""), (12, "http://b.example", "<p>plain text<form>f</form></p><aside>s</aside>")]
    rows += [(13, "http://c.example", "<div>" * 3000 + "deep" ), (14, "http://c.example", "<a title='x<y' <b>odd")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in html_extract.extract_text(df).collect()}
    assert len(got) == len(rows)
    for i in range(3):
        assert got[i].text == f"A & B one two three four{i} five" and got[i].n_chars == len(got[i].text)
    assert got[10].text == got[11].text == "" and got[12].text == "plain text" and got[13].text == "deep"
    assert html_extract.extract_text(df.limit(0)).count() == 0


def test_wrapper():
    def tree(html):
        return html_extract.parse(html, html_extract.LEFT_OUT_WORDS)

    pages = ["<div><p>a</p><p>b</p></div><i>x</i>", "<div><h1>t</h1><p>c</p></div><i>x</i>"]
    wrapper = html_extract.infer([tree(p) for p in pages])
    div = wrapper.kids[0]
    assert {k.key: (k.many, k.maybe) for k in div.kids} == {"h1": (False, True), "p": (True, False)}
    assert wrapper.kids[1].text == "x" and div.kids[-1].kids[0].text is None
    literal = [f"<main><p>Read more here</p><h2>{i}</h2></main>" for i in range(6)]
    assert html_extract.extract(literal) == [str(i) for i in range(6)]


def test_pipeline(spark, tmp_path):
    good = [(i, " ".join(f"w{(i * 7 + k * k) % 997}" for k in range(60)), "en", "s", 1) for i in range(40)]
    bad = [(100 + i, f"BUY!!! $$$ NOW*** {i} %%% CHEAP!!!", "en", "s", 1) for i in range(40)]
    copies = [(200, good[3][1].upper(), "en", "s", 1), (201, good[4][1] , "en", "s", 1)]
    docs = spark.createDataFrame(good + bad + copies, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    marks = [(i, 1, 0) for i in range(40)] + [(100 + i, 0, 0) for i in range(40)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    found = {r.doc_id for r in got}
    rejected = {r.doc_id for r in docs.collect()} - {
        r.doc_id for r in corpus_pipeline.drop_low_quality(spark, docs, str(tmp_path)).collect()
    }
    assert {*range(100, 140)} <= rejected <= {*range(100, 140), 200}  # 200 shouts a good text
    kept = {*range(40), 200, 201} - rejected
    last = {}  # of equal texts the largest id, then of near ones the smallest
    for r in sorted(docs.collect()):
        if r.doc_id in kept:
            last[lower(r.text)] = (r.doc_id, brute_fingerprint(r.text, simhash.SHINGLE_WORDS))
    label = {i: i for i, _ in last.values()}
    for (a, x), (b, y) in combinations(sorted(last.values()), 2):
        if (x ^ y).bit_count() <= simhash.MAX_BITS:
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = {i: new if v == old else v for i, v in label.items()}
    assert found == {i for i, v in label.items() if i == v}
