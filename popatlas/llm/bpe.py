"""BPE encoding by a tokenization automaton, and decoding by its arc labels.

The automaton runs over tokens and accepts exactly the token sequences that merging by
priority leaves. It starts as one state with an arc per byte. The merges are compiled one
after the other, each by a gadget: for the merge ``u v`` the state ``q`` that ``u`` leads to
gets a copy without its ``v`` arc, the ``u`` arcs lead to the copy from now on, and every
state with a ``u`` arc gets an arc ``uv`` to where the ``v`` arcs lead. All arcs of one
token lead to one state, so a merge adds one state at most. A copy shares the arcs of
its origin: a state is kept as its origin, the token it dropped and the merge that made it,
and ``_arc`` walks these. The states that lead back from a token fall into stretches: those
made by merges of the token itself, then those of its right part before the token came
about, and so on. One lookup tells whether a stretch dropped an arc, which makes
``follows`` fast; its answers are kept in a table.

A word has just one accepted token sequence, and each of its prefixes too: the sequence of
the prefix before its last token, then that token. So a word is read byte by byte, without
going back. A table of byte transitions (a row per beginning of a token, about 1 KB each)
gives the longest token that ends at a position; it is the last one there if the automaton
has its arc after the last token where it begins, else the next shorter one is asked. Arcs
that were asked for stay in a table of fixed size. New words are read together, sorted by
length, one position of all at a time; long ones each on their own. Time is linear in the
length of a word, memory four bytes a position. Decoding emits the bytes that the arcs stand for.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator, Sequence
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popatlas.llm.common import long_rows, whole_text

# Fixed value: the published pre-splitting pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# A line end, a run of ASCII and Latin-1 letters with its blank, signs but the apostrophe: a
# stretch that the pattern splits into just these.
_PLAIN = re.compile(
    r"(\n?)( ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-&(-/:-@\[-`{-~]*)"
).fullmatch
WORDS = 300_000
ROWS = 500
LETTERS = 1 << 20  # of the texts whose new words are read together
LONG = 64
TOGETHER = 1 << 13
ARC_BITS = 21
ARCS = 1 << 18
ROOT = 0
_MIX = np.uint64(0x9E3779B97F4A7C15)


def byte_letters() -> dict[str, int]:
    """The letter that vocabulary files write for each byte: printable Latin-1 characters
    stand for themselves, all others for the letters from code point 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


class Automaton:
    """The compiled merges; tokens are byte strings, ranked by when they come about."""

    def __init__(self, merges: Sequence[tuple[bytes, bytes]]):
        self.tokens = [bytes([b]) for b in range(256)]
        rank = {t: i for i, t in enumerate(self.tokens)}
        self.left, self.right = [-1] * 256, [-1] * 256
        self.state_of: dict[int, int] = {}  # the state that a merge made, by its two tokens
        self.target = [ROOT] * 256
        self.origin, self.dropped, self.made = [ROOT], [-1], [-1]
        for u, v in merges:
            a, b = rank.get(u), rank.get(v)
            if a is None or b is None or u + v in rank or not self._reads(a, b, len(self.tokens)):
                continue
            w = rank[u + v] = len(self.tokens)
            self.tokens.append(u + v)
            self.left.append(a)
            self.right.append(b)
            self.target.append(self.target[b])
            self.origin.append(self.target[a])
            self.dropped.append(b)
            self.made.append(w)
            self.state_of[a << 32 | b] = w
            self.target[a] = len(self.origin) - 1
        self.rank = rank
        self.start = len(self.tokens)  # stands for the start of a word, before any token
        self.target.append(ROOT)
        self.known: dict[int, bool] = {}
        self.lefts, self.rights = np.array(self.left), np.array(self.right)
        pairs = np.fromiter(self.state_of, np.int64, len(self.state_of))
        order = np.argsort(pairs)
        self.pairs = np.append(pairs[order], np.iinfo(np.int64).max)
        self.pair_made = np.append(np.fromiter(self.state_of.values(), np.int64, len(pairs))[order], -1)
        self.arcs = np.full(1 << ARC_BITS, -1)
        self._tabulate()

    def _tabulate(self) -> None:
        """The byte transitions: from each beginning of a token, a byte leads to the longest
        beginning of a token that what has been read ends with."""
        places: dict[int, int] = {}
        levels: list[list[tuple[int, int, int]]] = []
        ends = []
        for spelling in self.tokens:
            place = 0
            for depth, byte in enumerate(spelling):
                key = place << 8 | byte
                if key not in places:
                    places[key] = len(places) + 1
                    levels += [[]] * (depth == len(levels))
                    levels[depth].append((place, byte, places[key]))
                place = places[key]
            ends.append(place)
        steps = np.zeros((len(places) + 1, 256), dtype=np.int32)
        complete = np.full(len(places) + 1, -1, dtype=np.int32)
        complete[ends] = np.arange(len(ends))
        rest = np.zeros(len(places) + 1, dtype=np.int32)  # the longest other beginning it ends with
        before = None
        for level in levels:
            parent, byte, place = np.array(level).T
            if before is not None:
                rest[place] = steps[rest[parent], byte]
                steps[before] = steps[rest[before]]
                bare = place[complete[place] < 0]
                complete[bare] = complete[rest[bare]]
            steps[parent, byte] = place
            before = place
        steps[before] = steps[rest[before]]
        self.steps, self.longest = steps.ravel(), complete
        self.lengths = np.array([len(t) for t in self.tokens], dtype=np.int32)
        self.shorters = complete[rest[ends]]
        self.length, self.shorter = self.lengths.tolist(), self.shorters.tolist()

    def _reads(self, before: int, token: int, now: int) -> bool:
        """Whether the state that ``before`` leads to has the arc, as of the merge ``now``."""
        left, right, state_of = self.left, self.right, self.state_of
        while True:
            if state_of.get(before << 32 | token, now) < now:
                return False  # a state of this stretch dropped it
            if token > 255 and token >= before:
                token, now = left[token], token + 1
            elif before > 255:
                before, now = right[before], before
            else:
                return True

    def _arc(self, state: int, token: int) -> bool:
        while True:
            if token > 255 and token >= self.made[state]:
                # Came about after the state (or with it): there if its left part is.
                token = self.left[token]
            elif state == ROOT:
                return True
            elif token == self.dropped[state]:
                return False
            else:
                state = self.origin[state]

    def follows(self, before: int, token: int) -> bool:
        """Whether the automaton can read a token after another."""
        key = before << 32 | token
        found = self.known.get(key)
        if found is None:
            if len(self.known) >= ARCS:
                self.known.clear()
            found = self.known[key] = before == self.start or self._reads(before, token, self.start)
        return found

    def _read_arcs(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """``_reads`` for many at once."""
        found = np.ones(len(before), dtype=bool)
        left = np.flatnonzero(before != self.start)
        before, token = before[left], token[left]
        now = np.full(len(left), self.start)
        while len(left):
            pair = before << 32 | token
            at = np.searchsorted(self.pairs, pair)
            dropped = (self.pairs[at] == pair) & (self.pair_made[at] < now)
            found[left[dropped]] = False
            by_token = (token > 255) & (token >= before)
            on = ~dropped & (by_token | (before > 255))
            left, before, token, by_token = left[on], before[on], token[on], by_token[on]
            now = np.where(by_token, token + 1, before)
            token, before = np.where(by_token, self.lefts[token], token), np.where(
                by_token, before, self.rights[np.minimum(before, len(self.rights) - 1)]
            )
        return found

    def _arcs(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """``follows`` for many at once, by the table of arcs."""
        before, token = before.astype(np.int64), token.astype(np.int64)
        key = before << 32 | token
        slot = (key.view(np.uint64) * _MIX) >> np.uint64(64 - ARC_BITS)
        kept = self.arcs[slot]
        found = (kept & 1).astype(bool)
        new = np.flatnonzero(kept >> 1 != key)
        if len(new):
            found[new] = self._read_arcs(before[new], token[new])
            self.arcs[slot[new]] = key[new] << 1 | found[new]
        return found

    def encode(self, word: bytes) -> list[int]:
        """The ranks of the tokens of a word."""
        step, longest = memoryview(self.steps), memoryview(self.longest)
        known, length, shorter = self.known.get, self.length, self.shorter
        last, place = array("i", [self.start]), 0
        for end, byte in enumerate(word, 1):
            place = step[place << 8 | byte]
            token = longest[place]
            while True:
                before = last[end - length[token]]
                reads = known(before << 32 | token)
                if reads or (reads is None and self.follows(before, token)):
                    break
                token = shorter[token]
            last.append(token)
        out, end = [], len(word)
        while end:
            out.append(last[end])
            end -= length[last[end]]
        return out[::-1]

    def encode_words(self, words: Sequence[bytes]) -> list[np.ndarray]:
        """``encode`` for many words (none empty) at once."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        out: list[np.ndarray] = [np.empty(0, dtype=np.int64)] * len(words)
        order = np.argsort(-sizes, kind="stable")
        long = int(np.searchsorted(-sizes[order], -LONG))  # those of more bytes
        for k in order[:long].tolist():
            out[k] = np.array(self.encode(words[k]))
        for at in range(long, len(words), TOGETHER):
            part = order[at : at + TOGETHER]
            tokens, ends = self._encode_sorted([words[k] for k in part.tolist()], sizes[part])
            start = 0
            for k, end in zip(part.tolist(), ends.tolist(), strict=True):
                out[k] = tokens[start:end]
                start = end
        return out

    def _encode_sorted(self, words: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of words that come longest first, and where each word's end."""
        n, lengths = len(words), self.lengths
        text = np.frombuffer(b"".join(words), dtype=np.uint8)
        begin, column = np.cumsum(sizes) - sizes, np.arange(n)
        last = np.empty((int(sizes[0]) + 1) * n, dtype=np.int32)
        last[:n] = self.start
        place = np.zeros(n, dtype=np.int64)
        for end in range(1, int(sizes[0]) + 1):
            live = int(np.searchsorted(-sizes, -end, side="right"))
            place = self.steps[place[:live] << 8 | text[begin[:live] + (end - 1)]].astype(np.int64)
            token = self.longest[place]
            open_ = self._arcs(last[(end - lengths[token]) * n + column[:live]], token)
            bad = np.flatnonzero(~open_)
            while len(bad):
                token[bad] = less = self.shorters[token[bad]]
                bad = bad[~self._arcs(last[(end - lengths[less]) * n + bad], less)]
            last[end * n : end * n + live] = token
        end, count, taken = sizes.copy(), np.zeros(n, dtype=np.int64), []
        left = column
        while len(left):
            token = last[end[left] * n + left]
            taken.append((left, token))
            end[left] -= lengths[token]
            count[left] += 1
            left = left[end[left] > 0]
        ends = np.cumsum(count)
        out = np.empty(int(ends[-1]), dtype=np.int64)
        for back, (left, token) in enumerate(taken, 1):
            out[ends[left] - back] = token
        return out, ends


class Bpe:
    """A byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model, split = data["model"], data.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True)
        if data.get("normalizer") or not plain or split.get("add_prefix_space"):
            raise ValueError("not a plain byte-level BPE vocabulary")
        added = data.get("added_tokens") or []
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("added tokens with options are not supported")
        letters = byte_letters()

        def spelled(token: str) -> bytes:
            return bytes(letters[c] for c in token)

        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = [(spelled(u), spelled(v)) for u, v in pairs]
        self.special = {t["content"]: t["id"] for t in added}
        known = {spelled(t): i for t, i in model["vocab"].items() if t not in self.special}
        self.labels = {i: t for t, i in known.items()} | {i: t.encode() for t, i in self.special.items()}
        names = sorted(self.special, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.pieces = regex.compile(PATTERN).findall
        own = {name: np.array([i], dtype="<u4").tobytes() for name, i in self.special.items()}
        self.own = own | {"": b""}
        self.words: dict[str, bytes] = dict(self.own)
        self.known: dict[str, bytes] = {}

    @cached_property
    def automaton(self) -> Automaton:
        """Compiled when first asked for: decoding does without."""
        return Automaton(self.merges)

    @cached_property
    def ids(self) -> np.ndarray:
        """The id of each of the automaton's tokens, -1 for none."""
        known = {t: i for i, t in self.labels.items() if i not in self.special.values()}
        return np.array([known.get(t, -1) for t in self.automaton.tokens], dtype="<i4")

    def _learn(self, words: set[str]) -> None:
        """Takes up the ids of words, stretches of text between places where every split
        begins anew."""
        cut = []
        for word in words:
            plain = _PLAIN(word)
            cut.append([p for p in plain.groups() if p] if plain else self.pieces(word))
        if len(self.known) >= WORDS:
            self.known.clear()
        known = self.known
        new = list(set().union(*cut).difference(known))
        ids = self.ids
        for piece, tokens in zip(new, self.automaton.encode_words([p.encode() for p in new]), strict=True):
            known[piece] = ids[tokens].tobytes()
        for word, pieces in zip(words, cut, strict=True):
            self.words[word] = b"".join([known[p] for p in pieces])

    def _plain(self, text: str) -> list[str]:
        doubled = "  " in text or "\n\n" in text or " \n" in text or "\n " in text
        if doubled or not text.replace("\n", "").isprintable():
            return self.pieces(text)  # runs of white space, or kinds other than these two
        # A split begins at each blank or line end.
        return text.replace("\n", "\0\n").replace(" ", "\0 ").split("\0")

    def _words(self, text: str) -> list[str]:
        if self.marks is None or not self.marks.search(text):
            return self._plain(text)
        out = []
        for part in self.marks.split(text):
            out += [part] if part in self.special else self._plain(part)
        return out

    def encode_all(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.words) >= WORDS:
            self.words = dict(self.own)
        split = [self._words(t) for t in texts]
        new = set().union(*split).difference(self.words)
        if new:
            self._learn(new)
        words = self.words
        return [b"".join([words[w] for w in parts]) for parts in split]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: Sequence[int]) -> str:
        """The text of the arc labels; ids outside the vocabulary stand for nothing, and
        bytes that are no UTF-8 for replacement characters."""
        get = self.labels.get
        return b"".join([get(i, b"") for i in ids]).decode("utf-8", "replace")


def _runs(texts: Sequence[str]) -> Iterator[Sequence[str]]:
    """The texts in runs of about ``LETTERS`` letters."""
    at, letters = 0, 0
    for end, text in enumerate(texts, 1):
        letters += len(text)
        if letters >= LETTERS or end == len(texts):
            yield texts[at:end]
            at, letters = end, 0


@lru_cache(maxsize=1)
def bpe(path: str) -> Bpe:
    """One automaton for each vocabulary file and Python worker."""
    return Bpe(path)


def encode_texts(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, ids`` (array of ints) for every document. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = bpe(vocabulary).encode_all
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                runs = _runs(part["text"].to_pylist())
                ids = [np.frombuffer(i, dtype="<i4") for run in runs for i in encode(run)]
                ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(ends, np.concatenate(ids))
                yield pa.RecordBatch.from_arrays([part["doc_id"], lists], ["doc_id", "ids"])

    rows = long_rows(docs).select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, ids, text`` for rows of ``doc_id, ids``; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = bpe(vocabulary).decode
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = pa.array([decode(i.values.to_pylist() if i.is_valid else []) for i in part["ids"]], pa.string())
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["ids"], texts], ["doc_id", "ids", "text"])

    rows = long_rows(encoded).select("doc_id", "ids")
    return rows.mapInArrow(run, "doc_id long, ids array<int>, text string")
