"""Token ids of whole texts by the ``tokenizers`` library, through a cache of words.

The vocabulary's normaliser and splitter never join anything across ASCII white space, so the ids of a text are the ids of
its white-space separated words in order. Each worker keeps a cache from a word's bytes to its ids, so a text costs one
``bytes.split`` and one dictionary look-up a word; the library encodes each word that the cache doesn't hold. A cache has two
generations of at most CACHE_BYTES each, unless an operator names its own: what is asked for again moves to the young one, and the old one goes when that is full.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable
from functools import lru_cache

import regex

#: Bytes of one generation of a cache, ENTRY_BYTES of which an entry has at most on average; words over LONGEST are encoded each time.
CACHE_BYTES, ENTRY_BYTES, LONGEST = 24_000_000, 180, 64
VOCABULARY = "word_bpe_49k.json"

_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
_LATIN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class Recent(dict):
    """What ``make`` gives for a key, kept for the keys asked for of late."""

    def __init__(self, make: Callable, most: int):
        self.make, self.most, self.old = make, most // ENTRY_BYTES, {}

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
            if len(key) > LONGEST:
                return got
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = got
        return got


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class _Words(Recent):
    """word bytes -> its ids as little-endian uint32 bytes."""

    def __init__(self, path: str, cache_bytes: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.model = self.library.model
        self.letters = _byte_letters()
        self.pieces = Recent(self._piece, cache_bytes // 2)
        super().__init__(self._word, cache_bytes)

    def _piece(self, piece: str) -> bytes:
        if not (piece.isascii() and piece.isprintable()):
            piece = "".join(map(self.letters.__getitem__, piece.encode()))
        return _packed([t.id for t in self.model.tokenize(piece)])

    def _word(self, word: bytes) -> bytes:
        if word.isalpha():  # ASCII letters: a single piece
            return _packed([t.id for t in self.model.tokenize(word.lower().decode("ascii"))])
        text = word.decode("utf-8", "replace")
        if b"<|" in word or not (text.isascii() or ord(max(text)) < 256):  # special tokens, composed and unusual characters: all by the library
            return _packed(self.library.encode(text, add_special_tokens=False).ids)
        found = _ASCII.findall(text.lower()) if text.isascii() and text.isprintable() else _LATIN.findall(text.lower())
        return b"".join(map(self.pieces.__getitem__, found))


@lru_cache(maxsize=2)
def words(path: str, cache_bytes: int = CACHE_BYTES) -> _Words:
    return _Words(path, cache_bytes)


def encode(cache: _Words, text: bytes) -> bytes:
    """Ids of a whole UTF-8 text as little-endian uint32 bytes."""
    return b"".join(map(cache.__getitem__, text.split()))
