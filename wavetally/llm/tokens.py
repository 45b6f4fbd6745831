"""Token ids of whole texts by the tokenizers library, with repeated words encoded once.

Encoding a word again and again is what tokenizing costs. Both vocabularies in
use split a text at blanks and line ends before anything else, so the ids of a
text are the ids of its words one after the other, and a bounded cache of words
serves nearly all of them. Where white space is anything but single blanks and
line ends, the byte-level vocabulary gets the text whole, so the ids never
depend on the cache.
"""

from __future__ import annotations

import functools
import re
import sys
from array import array

import numpy as np
from tokenizers import Tokenizer

CACHED_WORDS = 400_000  # at most, some 200 bytes each
_NATIVE = sys.byteorder == "little" and array("I").itemsize == 4

# A word of Latin letters with punctuation behind it: always two pre-tokens, whatever the vocabulary.
_PLAIN = re.compile(r"( ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([.,!?;:#$%&*|]*)")


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _as_bytes(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers; for few ids an array is quicker than numpy."""
    return array("I", ids).tobytes() if _NATIVE else np.array(ids, dtype="<u4").tobytes()


class _Cache(dict):
    """Word -> ids as little-endian unsigned 32-bit integers, asked of the library where missing.

    ``turn`` makes what is here the older half; a word asked for again comes back from it, the others go at the next turn."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.pop(word, None)
        if ids is None:
            ids = self.encode(word)
        self[word] = ids
        return ids

    def turn(self):
        self.older = dict(self)
        self.clear()


class WordEncoder:
    """``encode(text)``: ids as bytes of little-endian unsigned 32-bit integers, as the library gives them without
    special tokens of its own.

    ``path``: a tokenizers file of a byte-level BPE in which blanks lead words, or of one that lower-cases, drops white
    space and marks word ends."""

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.blanks_lead = self.tokenizer.normalizer is None
        self.cached = cached
        self.letters = _byte_letters()
        self.words = _Cache(self._word)

    def library(self, text: str) -> bytes:
        return _as_bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        body = word[word[:1] == " " :]
        if not (body.isascii() and body.isalpha()):
            plain = _PLAIN.fullmatch(word)
            if plain is None:
                return self.library(word)
            body, tail = plain.groups()
            if tail:
                return self.words[body] + self.words[tail]
        if not self.blanks_lead:
            word = word.lower()
        spelled = word.replace(" ", self.letters[32]) if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return _as_bytes([t.id for t in self.model.tokenize(spelled)])

    def encode(self, text: str) -> bytes:
        if len(self.words) > self.cached // 2:
            self.words.turn()
        if not self.blanks_lead:
            if text.isascii():
                text = text.lower()  # as the library does first: fewer different words
            return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))
        words, cuts = text.split(), text.count(" ") + text.count("\n")
        if len(words) != cuts + 1 or len("".join(words)) + cuts != len(text) or "\x00" in text:
            return self.library(text)  # other white space, or more than one in a row, may join into one pre-token
        # a word takes the blank before it along; a mark in front of every blank and around line ends is where to cut
        parts = text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00")
        return b"".join(map(self.words.__getitem__, parts))


@functools.lru_cache(maxsize=1)
def word_encoder(path: str, cached: int = CACHED_WORDS) -> WordEncoder:
    """The encoder of this Python worker: tasks that follow one another in it go on with the words of those before."""
    return WordEncoder(path, cached)
