"""Token ids of whole texts, by the tokenizers library behind a cache of words.

The library's whole-text calls encode some 2 MB a second, most of it spent around
the model. Most words of a corpus repeat, so a worker keeps the ids of words it has
met, and gives new plain words straight to the library's BPE model. Cutting a text
into words must not change its ids, so each kind of vocabulary states where that
holds:

* "space", a byte-level vocabulary whose pattern starts a token at every single
  space between two other characters that are no white space. A text with other
  spaces is encoded whole; only words that are safe to cut at are remembered, so
  that such a text shows as a miss. A single line break between two such characters
  is a token of its own there, so what it parts is looked up by itself: the words on
  both sides of a line's end hardly ever meet again.
* "words", a BPE with word ends that drops white space, so that no token or
  normalisation reaches over it. Texts with the separators that only Python calls
  white space (U+001C to U+001F) are encoded whole.

Words of Latin letters alone are one token of the pattern and go to the model as
they are; all others go through the library's normaliser and pattern. Special
tokens' strings in a text are ordinary text.
"""

from __future__ import annotations

import sys
from array import array

import numpy as np

#: Words a worker remembers: two generations of so many.
CACHE = 500_000
LONGEST_WORD = 64
SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Letters of the Latin blocks; every version of Unicode agrees on them.
AFTER_LATIN = "ɐ"


def pack(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class _Unsafe(Exception):
    """A text must not be cut at all its spaces."""


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in kept)
    return {b: chr(b) for b in kept} | {b: chr(0x100 + i) for i, b in enumerate(others)}


class Encoder:
    def __init__(self, path: str, cut: str) -> None:
        from tokenizers import Tokenizer

        if cut not in ("space", "words"):
            raise ValueError(f"cut must be 'space' or 'words', not {cut!r}")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.space = self.letters[0x20]
        self.cut, self.new, self.old, self.bare = cut, {}, {}, {}
        self.newline = self._whole("\n")

    def _whole(self, text: str) -> bytes:
        return pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _plain(self, word: str, space: str = "") -> bytes:
        """A word of letters, perhaps behind a space: one token of the pattern, as bytes' letters."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        return pack([t.id for t in self.model.tokenize(space + word)])

    def _unspaced(self, word: str) -> bytes:
        """Ids of a word that no space goes before."""
        ids = self.bare.get(word)
        if ids is None:
            stem = word[:-1]
            if word.isalpha() and max(word) < AFTER_LATIN:
                ids = self._plain(word)
            elif word[-1:] in (",", ".") and stem.isascii() and stem.isalpha():
                ids = self._plain(stem) + self._plain(word[-1])
            else:
                ids = self._whole(word)
            if len(word) <= LONGEST_WORD:
                if len(self.bare) >= CACHE:
                    self.bare = {}
                self.bare[word] = ids
        return ids

    def _broken(self, word: str) -> bytes:
        """Ids of a word, with a space before it, that has line breaks inside."""
        first, *rest = word.split("\n")
        if any(not x or x[0].isspace() or x[-1].isspace() for x in (first, *rest)):
            return self._whole(" " + word)
        return (self.new.get(first) or self._miss(first)) + b"".join([self.newline + self._unspaced(x) for x in rest])

    def _encoded(self, word: str) -> bytes:
        if self.cut == "space":
            if not word or word[0].isspace() or word[-1].isspace():
                raise _Unsafe
            if "\n" in word:
                return self._broken(word)
            if word.isalpha() and max(word) < AFTER_LATIN:
                return self._plain(word, self.space)
            stem = word[:-1]
            if word[-1] in ",." and stem.isascii() and stem.isalpha():  # the pattern parts them
                return self._plain(stem, self.space) + self._plain(word[-1])
            return self._whole(" " + word)
        lower = word.lower()
        if lower.isascii() and lower.isalpha():
            return self._plain(lower)
        stem = lower[:-1]
        if lower[-1] in ",." and stem.isascii() and stem.isalpha():
            return self._plain(stem) + self._plain(lower[-1])
        # Composed Latin letters are their own normal form.
        if lower.isalpha() and max(word) < AFTER_LATIN and len(lower) == len(word):
            return self._plain(lower)
        return self._whole(word)

    def _miss(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self._encoded(word)
        if len(word) <= LONGEST_WORD and "\n" not in word:
            if len(self.new) >= CACHE:
                self.old, self.new = self.new, {}
            self.new[word] = ids
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a whole text; none for null."""
        if not text:
            return np.empty(0, dtype="<u4")
        get, miss, head = self.new.get, self._miss, b""
        if self.cut == "words":
            if any(x in text for x in SEPARATORS):
                return np.frombuffer(self._whole(text), dtype="<u4")
            words = text.split()
        else:
            first, *words = text.split(" ")
            if not first or first[-1].isspace():
                return np.frombuffer(self._whole(text), dtype="<u4")
            head = self._whole(first) if "\n" in first else self._unspaced(first)
        try:
            return np.frombuffer(head + b"".join([get(w) or miss(w) for w in words]), dtype="<u4")
        except _Unsafe:
            return np.frombuffer(self._whole(text), dtype="<u4")


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, cut: str) -> Encoder:
    """This worker's encoder for a vocabulary file; it lives as long as the worker."""
    if (path, cut) not in _encoders:
        _encoders[path, cut] = Encoder(path, cut)
    return _encoders[path, cut]


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
