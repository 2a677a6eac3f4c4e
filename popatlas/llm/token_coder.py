"""Blocks of token ids, range-coded under a mix of order-2, order-1 and order-0 predictions.

The order-2 and order-1 contexts (the last two ids, the last id) each predict one id: the
one that held last, with a confidence of 0 to 3 that counts how often it did. The order-0
prediction is the frequency of every id in the block so far. The three are mixed: for each
pair of confidences the coder keeps adaptive shares of the code range for "order 2 is
right", "order 1 is right" and "neither"; within "neither", ids share by frequency.

A block is cut into lanes of ``STEPS`` successive ids or fewer, coded side by side, one id of
each per step, to let numpy work on whole columns. All lanes of a block learn into the same
tables, so these are as small as one model and know what every lane has seen up to the step
before. Every ``MIX`` steps the shares are taken anew from how the step before came out,
frequencies whenever the ids seen have doubled; the decoder finds an id by its place in the
range in one table. Ranges are whole numbers below 2 ** 53 in doubles, whose products and
quotients numpy takes several at a time; all of these are exact.

Every block starts from the same empty state and has its own checksums, so blocks are read
independently of each other, and what a block becomes does not depend on its neighbours.

Layout of a block: magic ``PTB3``, then little-endian unsigned 32-bit integers: number of
ids, alphabet size, CRC-32 of the ids as little-endian unsigned 32-bit integers, number of
code words, CRC-32 of all before and of the code words; then the 16-bit code words,
little-endian: the first three of each lane, then each as the decoder asks for it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence

import numpy as np

BLOCK = 1 << 21
STEPS = 256
MIX = 8
MAGIC = b"PTB3"
HEADER = struct.Struct("<4sIIIII")

_SLOTS2 = 1 << 16
_CLASSES = 32
_BITS = 16
_FULL = 1 << _BITS
_LEAST = _FULL >> 6  # of "neither"
_PLACES = 19  # bits of the range that ids share by frequency, at least
_FORGET = 1 << 14
_WORD = float(1 << 16)
_SMALL = float(1 << 32)


class _Model:
    """What a block has seen, and the shares that follow from it."""

    def __init__(self, lanes: int, alphabet: int, find: bool):
        self.alphabet, self.find = alphabet, find
        self.places = max(_PLACES, alphabet.bit_length() + 2)
        if self.places > 24:
            raise ValueError("the alphabet is too large")
        self.seen = np.zeros(alphabet, dtype=np.int64)
        self.done, self.due, self.step = 0, 64, 0
        # A prediction is four times its id, plus its confidence.
        # Those of order 1 come first, at their last id, then those of order 2.
        self.table = np.zeros(alphabet + _SLOTS2, dtype=np.int32)
        self.slots = np.empty((2, lanes), dtype=np.intp)
        # Of each class: "neither", "order 1 is right", "order 2 is right", "both are".
        self.tally = np.zeros(4 * _CLASSES, dtype=np.int64)
        self.last = np.zeros(lanes, dtype=np.int32)
        self.before = np.zeros(lanes, dtype=np.int32)
        self.mix()
        self.count(np.empty(0, dtype=np.int32))

    def mix(self) -> None:
        """Take the outcomes so far into the shares of the three predictions."""
        neither, right1, right2, both = self.tally.reshape(_CLASSES, 4).T
        right2 = right2 + both
        total = neither + right1 + right2 + 4
        share2 = np.maximum((right2 * 2 + 1) * (_FULL - _LEAST - 2) // (2 * total), 1)
        share12 = share2 + np.maximum((right1 * 2 + 1) * (_FULL - _LEAST - 2) // (2 * total), 1)
        self.share2, self.share12 = share2.astype(float), share12.astype(float)
        none = np.zeros(_CLASSES)
        self.start = np.stack([self.share12, self.share2, none, none], 1).ravel()
        self.width = np.stack([_FULL - share12, share12 - share2, share2, share2], 1).astype(float).ravel()
        self.tally[np.repeat(total > _FORGET, 4)] >>= 1

    def count(self, ids: np.ndarray) -> None:
        """Take these ids into the frequencies."""
        self.seen += np.bincount(ids, minlength=self.alphabet)
        total, room = max(int(self.seen.sum()), 1), (1 << self.places) - self.alphabet
        freq = 1 + np.floor(self.seen * (room / total)).astype(np.int64)
        freq[np.argmax(self.seen)] += (1 << self.places) - int(freq.sum())
        self.freq, self.cum = freq.astype(float), (np.cumsum(freq) - freq).astype(float)
        if self.find:
            small = np.uint16 if self.alphabet <= 1 << 16 else np.int32
            self.holder = np.repeat(np.arange(self.alphabet, dtype=small), freq)

    def predict(self) -> None:
        slot2 = self.last * np.int32(10007)
        slot2 += self.before * np.int32(7501)
        slot2 >>= 3
        slot2 &= _SLOTS2 - 1
        slot2 += self.alphabet
        self.slots[0], self.slots[1] = self.last, slot2
        self.had = self.table.take(self.slots)
        self.sure = self.had & 3
        kind = self.sure[1] << 2
        kind |= self.sure[0]
        kind <<= 1
        kind |= (self.had[0] ^ self.had[1]) < 4
        self.kind = kind.astype(np.intp)

    def outcome(self, ids4: np.ndarray) -> np.ndarray:
        """Class and outcome of a step, from four times its ids."""
        self.hits = (self.had ^ ids4) < 4
        out = self.kind << 1
        out |= self.hits[1]
        out <<= 1
        out |= self.hits[0]
        return out

    def update(self, rows: np.ndarray, ids4: np.ndarray, outcome: np.ndarray) -> None:
        """Learn the ids of a step; ``rows`` holds those of all steps up to it."""
        wrong = np.where(self.sure != 0, self.had - 1, ids4)
        right = np.minimum(self.had + 1, ids4 | 3)
        self.table[self.slots] = np.where(self.hits, right, wrong)  # of equal places the last lane's
        self.before, self.last = self.last, rows[self.step]
        self.step += 1
        if self.step % MIX == 0 or self.step < MIX:
            self.tally += np.bincount(outcome, minlength=4 * _CLASSES)
            self.mix()
        seen = self.step * rows.shape[1]
        if seen >= self.due:
            self.count(rows[self.done : self.step].ravel())
            self.done, self.due = self.step, 2 * seen


def _shape(n: int) -> tuple[int, int]:
    """Steps and lanes of a block of ``n`` ids."""
    lanes = -(-n // STEPS)
    steps = -(-n // lanes) if lanes else 0
    return steps, -(-n // steps) if steps else 0


def encode_blocks(blocks: Sequence[np.ndarray], alphabet: int) -> list[bytes]:
    """Each block of ids (below ``alphabet``, at most ``BLOCK``) as bytes."""
    return [_encode(np.asarray(block), alphabet) for block in blocks]


def _encode(block: np.ndarray, alphabet: int) -> bytes:
    steps, lanes = _shape(len(block))
    ids = np.zeros(steps * lanes, dtype=np.int32)
    ids[: len(block)] = block
    ids = np.ascontiguousarray(ids.reshape(lanes, steps).T)
    body = _words(ids, alphabet).astype("<u2").tobytes() if steps else b""
    crc = zlib.crc32(np.ascontiguousarray(block, dtype="<u4").tobytes())
    head = HEADER.pack(MAGIC, len(block), alphabet, crc, len(body) // 2, 0)[:-4]
    return head + struct.pack("<I", zlib.crc32(body, zlib.crc32(head))) + body


def _words(ids: np.ndarray, alphabet: int) -> np.ndarray:
    """The code words of ids in rows of one step each."""
    steps, lanes = ids.shape
    model = _Model(lanes, alphabet, find=False)
    share = 0.5**model.places
    low, span = np.zeros(lanes), np.full(lanes, _SMALL * _WORD)
    words = np.zeros((3 * steps + 4, lanes), dtype=np.int32)  # a column for each lane
    flat, at = words.ravel(), np.arange(lanes)
    asked = [at[:, None] + np.arange(3) * lanes]  # places of words in the order of the decoder
    for t in range(steps):
        model.predict()
        s4 = ids[t] << 2
        s = ids[t].astype(np.intp)
        outcome = model.outcome(s4)
        neither = outcome & 3 == 0
        unit = np.floor(span * (1 / _WORD))
        low += unit * model.start.take(outcome)
        span = unit * model.width.take(outcome)
        part = np.floor(span * share)
        part *= neither
        low += part * model.cum.take(s)
        np.multiply(part, model.freq.take(s), out=span, where=neither)
        small = np.flatnonzero(span < _SMALL)
        while len(small):
            places, lo, spans = at[small], low[small], span[small] * _WORD
            top = np.floor(lo * (1 / _SMALL))
            flat[places] = top
            low[small] = (lo - top * _SMALL) * _WORD
            span[small] = spans
            asked.append(places + 3 * lanes)
            at[small] = places + lanes
            small = small[spans < _SMALL]
        model.update(ids, s4, outcome)
    for shift in (_SMALL, _WORD, 1.0):
        flat[at] = top = np.floor(low / shift)
        low -= top * shift
        at += lanes
    words = words[: at.max() // lanes]
    while (carry := words >> 16).any():  # additions that ran over into the word before
        words &= 0xFFFF
        words[:-1] += carry[1:]
    return flat[np.concatenate([a.ravel() for a in asked])]


def decode_blocks(codes: Sequence[bytes]) -> list[np.ndarray]:
    """The ids (``<u4``) of each block; raises ValueError where one is damaged."""
    return [_decode(code) for code in codes]


def _decode(code: bytes) -> np.ndarray:
    if len(code) < HEADER.size:
        raise ValueError("a token block is cut off")
    magic, n, alphabet, crc, count, code_crc = HEADER.unpack_from(code)
    if magic != MAGIC or len(code) != HEADER.size + 2 * count or n > BLOCK:
        raise ValueError("not a token block")
    if zlib.crc32(code[HEADER.size :], zlib.crc32(code[: HEADER.size - 4])) != code_crc:
        raise ValueError("a token block is damaged")
    steps, lanes = _shape(n)
    words = np.frombuffer(code, "<u2", offset=HEADER.size)
    if len(words) < 3 * lanes:
        raise ValueError("a token block is cut off")
    ids = np.ascontiguousarray(_ids(words, steps, lanes, alphabet).T).ravel()[:n].astype("<u4")
    if zlib.crc32(ids.tobytes()) != crc:
        raise ValueError("a token block fails its checksum")
    return ids


def _ids(words: np.ndarray, steps: int, lanes: int, alphabet: int) -> np.ndarray:
    """Ids in rows of one step each, from the code words."""
    ids = np.zeros((steps, lanes), dtype=np.int32)
    if not steps:
        return ids
    model = _Model(lanes, alphabet, find=True)
    share = 0.5**model.places
    first = words[: 3 * lanes].reshape(lanes, 3).astype(float)
    code, pos = first[:, 0] * _SMALL + first[:, 1] * _WORD + first[:, 2], 3 * lanes
    span = np.full(lanes, _SMALL * _WORD)
    for t in range(steps):
        model.predict()
        unit = np.floor(span * (1 / _WORD))
        to2, to1 = unit * model.share2.take(model.kind), unit * model.share12.take(model.kind)
        hit2, neither = code < to2, code >= to1
        part = np.floor((unit * _WORD - to1) * share)
        # Divisor times quotient stay below 2 ** 49, so doubles round none up to the next integer.
        place = ((code - to1) / part).astype(np.intp)
        found = model.holder.take(place, mode="clip").astype(np.intp)  # also of places that are not asked for
        known = np.where(hit2, model.had[1], model.had[0]) >> 2
        s = ids[t]
        s[:] = np.where(neither, found, known)
        code -= np.where(neither, to1 + part * model.cum.take(found), np.where(hit2, 0.0, to2))
        span = np.where(neither, part * model.freq.take(found), np.where(hit2, to2, to1 - to2))
        small = np.flatnonzero(span < _SMALL)
        while len(small):
            more = words[pos : pos + len(small)]
            if len(more) < len(small):
                raise ValueError("a token block is cut off")
            code[small] = code[small] * _WORD + more
            spans = span[small] * _WORD
            span[small] = spans
            pos += len(small)
            small = small[spans < _SMALL]
        s4 = s << 2
        model.update(ids, s4, model.outcome(s4))
    return ids
