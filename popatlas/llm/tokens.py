"""Ids of whole texts by the tokenizers library, with repeated words looked up.

Where a tokenizer drops white space, no token spans it, so a text is encoded word by word
and each distinct word only once per worker (at most ``WORDS`` are held; then the half that
came first stays, which has most of the frequent ones). Texts with white space other than blank, tab and line ends go through the
library as a whole, as do all texts of tokenizers that keep white space.
"""

from __future__ import annotations

import json
import re
import struct
from functools import lru_cache
from itertools import islice

import numpy as np
from tokenizers import Tokenizer

WORDS = 690_000
END_ID = 1
_ODD_SPACE = (
    *map(chr, (0xB, 0xC, *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E)),
    *map(chr, (*range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)),
)


# Letters of ASCII and Latin-1, then signs other than the apostrophe: a word that normalizing
# only lower-cases and splitting takes for these two parts.
_PLAIN = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-&(-/:-@\[-`{-~]*)").fullmatch


class _Words(dict):
    """Ids of a word, made when first asked for; words of one part share what the lower-case
    part has, which is held as a word of its own."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.tokenizer, self.pieces = tokenizer, self
        self.tokenize = tokenizer.model.tokenize
        split = tokenizer.pre_tokenizer.pre_tokenize_str
        latin = (chr(c) for c in range(0xC0, 0x100) if chr(c) not in "\xd7\xf7")
        self.shown = {ord(c): split(c)[0][0] for c in latin}  # letters as the model reads them

    def __missing__(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            letters, signs = word, ""
        elif plain := _PLAIN(word):
            letters, signs = plain.groups()
        else:
            letters = signs = ""
        lower = letters.lower()
        if not letters:
            out = _packed(self.tokenizer.encode(word, add_special_tokens=False).ids)
        elif lower == word:
            shown = word if word.isascii() else word.translate(self.shown)
            out = _packed([t.id for t in self.tokenize(shown)])
        else:
            out = self[lower]
            if signs:
                out += self[signs]
        if len(self) >= WORDS:
            held = list(islice(self.items(), WORDS // 2))
            self.clear()
            self.update(held)
        self[word] = out
        return out


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            split = (json.load(f).get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        drops_space = (
            split.get("type") == "Split"
            and split.get("behavior") == "Removed"
            and split.get("invert")
            and [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str("a. b")] == ["a", ".", "b"]
        )
        self.words = _Words(self.tokenizer) if drops_space else None

    def encode(self, text: str) -> bytes:
        if self.words is None or any(space in text for space in _ODD_SPACE):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return np.array(ids, dtype="<u4").tobytes()
        return b"".join(map(self.words.__getitem__, text.split()))

    def release(self) -> None:
        """Give back the memory of the words held."""
        if self.words is not None:
            self.words.clear()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each tokenizer file and Python worker."""
    return Encoder(path)
