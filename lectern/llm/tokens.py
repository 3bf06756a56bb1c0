"""Exact and fast tokenization of whole texts with public BPE vocabularies.

Text is cut into units that the tokenizer cannot join, each unit is encoded by
the ``tokenizers`` library once, and its ids are looked up from then on. The
cuts give the same ids as encoding the whole text:

* ``words`` (vocabularies that drop white space and case): at every blank and line end.
* ``bytes`` (byte-level vocabularies that keep it): at a single blank or line
  end between two characters that are not white space; a text with any other
  white space at a cut is encoded whole.

Units go to the library as they are, so normalizing and the strings of special
tokens, which hold no blank, come out as in the whole text: as the library has
it by default, or as ordinary text where ``plain_specials`` is set. Only short
units are looked up; what a worker keeps is bounded in bytes.
"""

from __future__ import annotations

import os
from array import array

import numpy as np

from lectern.llm.resident import resident

#: Units kept in a worker: one generation being filled and the one before; longer ones are never kept.
CACHED_UNITS, LONGEST_UNIT = 500_000, 32
#: Up to here letters are composed, and their lower case is one letter each.
LATIN = "\u017f"
DIGITS = frozenset("0123456789")


def _byte_level() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where it prints."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printed]
    return {b: chr(b) for b in printed} | {b: chr(256 + i) for i, b in enumerate(others)}


LEVEL = _byte_level()


class Units(dict):
    """Ids of units as bytes, made when first asked for; when full, the older half is forgotten."""

    def __init__(self, make, most: int = CACHED_UNITS):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, unit: str) -> bytes:
        known = self.old.get(unit)
        if known is None:
            known = self.make(unit)
        if len(unit) <= LONGEST_UNIT:
            self[unit] = known
        return known

    def age(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


class Uncut(Exception):
    """White space stands where the cuts don't cover it: the text must be encoded whole."""


def _plain(c: str) -> bool:
    """A letter or digit that stays one, after which punctuation is a pre-token of its own."""
    return c <= LATIN and c != "\u0130" and c.isalpha() or c in DIGITS


class Encoder:
    """Ids of texts as bytes of little-endian unsigned integers of ``dtype``."""

    def __init__(self, path: str, cut: str, plain_specials: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if plain_specials:
            self.tokenizer.encode_special_tokens = True
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.cut = cut
        self.model = self.tokenizer.model
        self.bare = Units(self._bare if cut == "words" else self._clean)
        self.spaced = Units(self._spaced)
        self.lead = LEVEL[ord(" ")]
        self.newline = self._bare("\n") if cut == "bytes" else b""

    def _whole(self, text: str) -> bytes:
        return array(self.dtype.char, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str, lead: str) -> bytes | None:
        """Ids of a plain Latin word: one pre-token, so it goes straight to the merges."""
        if self.cut == "words":
            word = word.lower()
        if not word.isascii():
            if max(word) > LATIN:
                return None
            word = word.encode().decode("latin-1").translate(LEVEL)
        return array(self.dtype.char, [t.id for t in self.model.tokenize(lead + word)]).tobytes()

    def _bare(self, unit: str) -> bytes:
        """Full stops and commas after a letter or digit are a pre-token of their own."""
        found = self._word(unit, "") if unit.isalpha() else None
        if found is None:
            head = unit.rstrip(".,")
            if 0 < len(head) < len(unit) and _plain(head[-1]):
                return self.bare[head] + self.bare[unit[len(head) :]]
            found = self._whole(unit)
        return found

    def _clean(self, unit: str) -> bytes:
        if not unit or unit[0].isspace() or unit[-1].isspace():
            raise Uncut
        return self._bare(unit)

    def _spaced(self, unit: str) -> bytes:
        """As ``_bare``, after a blank."""
        if not unit or unit[0].isspace() or unit[-1].isspace():
            raise Uncut
        found = self._word(unit, self.lead) if unit.isalpha() else None
        if found is None:
            head = unit.rstrip(".,")
            if 0 < len(head) < len(unit) and _plain(head[-1]):
                return self.spaced[head] + self.bare[unit[len(head) :]]
            found = self._whole(" " + unit)
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return self._by_words(texts) if self.cut == "words" else self._by_bytes(texts)

    def _by_words(self, texts: list[str | None]) -> list[bytes]:
        self.bare.age()
        get = self.bare.__getitem__
        return [b"".join(map(get, t.replace("\n", " ").split(" "))) if t else b"" for t in texts]

    def _by_bytes(self, texts: list[str | None]) -> list[bytes]:
        self.bare.age()
        self.spaced.age()
        first, rest = self.bare.__getitem__, self.spaced.__getitem__
        out = []
        for text in texts:
            try:
                lines = [line.split(" ") for line in text.split("\n")] if text else []
                out.append(self.newline.join([first(x[0]) + b"".join(map(rest, x[1:])) for x in lines]))
            except Uncut:
                out.append(self._whole(text))
        return out


def encoder(path: str, cut: str, plain_specials: bool = False):
    """One encoder, with its units, for each Python worker, to be used in a ``with``."""
    return resident((Encoder, path, cut, plain_specials), lambda: Encoder(path, cut, plain_specials))


def batches_of(texts: list[str | None], letters: int = 1_000_000):
    """(start, end) of runs of texts that together have about so many letters."""
    at = 0
    while at < len(texts):
        end, total = at, 0
        while end < len(texts) and (end == at or total < letters):
            total += len(texts[end] or "")
            end += 1
        yield at, end
        at = end
