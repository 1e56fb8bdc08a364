"""Words, shingles and n-grams of many texts at once, as numpy arrays.

Used inside tasks. Texts are laid end to end as code points and every step is one numpy call over that array;
``runs`` keeps the array to a bounded length, apart from a single text that is longer by itself.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from functools import cache, cached_property

import numpy as np

_RUN_CHARS = 250_000
_U64 = np.uint64
_GOLDEN = _U64(0x9E3779B97F4A7C15)
WORDS_PER_SHINGLE = 5


def mix(values: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit hashes of 64-bit integers (the finaliser of splitmix64)."""
    h = values + _GOLDEN
    h = (h ^ (h >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U64(27))) * _U64(0x94D049BB133111EB)
    return h ^ (h >> _U64(31))


def _salt(number: int) -> np.uint64:
    return _U64(number * int(_GOLDEN) & 0xFFFFFFFFFFFFFFFF)


def runs(texts: Sequence[str | None], limit: int = _RUN_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of about ``limit`` characters together, with the position of the first; null is empty."""
    first, run, size = 0, [], 0
    for at, text in enumerate(texts):
        text = text or ""
        if run and size + len(text) > limit:
            yield first, run
            first, run, size = at, [], 0
        run.append(text)
        size += len(text)
    if run:
        yield first, run


@cache
def _table(test: str) -> np.ndarray:
    return np.fromiter((getattr(chr(c), test)() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def code_points(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points, a line feed after each text, and the position at which each text ends."""
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    joined = "\n".join(texts) + "\n"
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), ends


def letters(codes: np.ndarray) -> np.ndarray:
    return _table("isalpha")[codes]


class Words:
    """The words of some texts: runs of letters and digits, compared without regard to case."""

    def __init__(self, texts: Sequence[str]):
        lowered = [t.lower() for t in texts]
        codes, ends = code_points(lowered)
        inside = _table("isalnum")[codes]
        edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
        self.starts = np.flatnonzero(edge == 1)
        self.lengths = np.flatnonzero(edge == -1) - self.starts
        #: Position of the text that each word belongs to.
        self.texts = np.searchsorted(ends, self.starts, side="right")
        #: Number of words of each text, and where its words begin.
        self.counts = np.bincount(self.texts, minlength=len(texts))
        self.firsts = np.concatenate(([0], np.cumsum(self.counts)))
        self.codes = codes
        self._at = np.flatnonzero(inside)
        self._begins = np.concatenate(([0], np.cumsum(self.lengths)))[:-1].astype(np.int64)

    @cached_property
    def _spread(self) -> np.ndarray:
        """One hash per character of a word, of the character and its place in the word."""
        place = np.arange(len(self._at)) - np.repeat(self._begins, self.lengths)
        return mix(self.codes[self._at].astype(_U64) | (place.astype(_U64) << _U64(32)))

    def hashes(self) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, _U64)
        return mix(np.add.reduceat(self._spread, self._begins))

    def prefix_hashes(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the first ``length`` characters, and which words have that many or more."""
        which = np.flatnonzero(self.lengths >= length)
        if not len(which):
            return np.zeros(0, _U64), which
        total = np.zeros(len(which), _U64)
        for place in range(length):
            total += self._spread[self._begins[which] + place]
        return mix(total + _salt(length)), which


def shingles(texts: Sequence[str], width: int = WORDS_PER_SHINGLE) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its word n-grams.

    A text of fewer words has one shingle made of all its words; one without words has none.
    """
    words = Words(texts)
    hashes = words.hashes()
    sets = []
    if len(hashes):
        rolled = np.zeros(max(0, len(hashes) - width + 1), _U64)
        for step in range(width):
            rolled = rolled * _U64(0xD6E8FEB86659FD93) + hashes[step:step + len(rolled)]
        rolled = mix(rolled)
    for first, count in zip(words.firsts, words.counts):
        if count >= width:
            sets.append(np.unique(rolled[first:first + count - width + 1]))
        elif count:
            whole = _U64(count)
            with np.errstate(over="ignore"):
                for value in hashes[first:first + count]:
                    whole = whole * _U64(0xD6E8FEB86659FD93) + value
            sets.append(mix(np.array([whole])))
        else:
            sets.append(np.zeros(0, _U64))
    return sets


def ngram_codes(texts: Sequence[str], sizes: Sequence[int], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed character n-grams inside words, each padded with one blank on either side.

    Returns ``(text, bucket)`` of every n-gram and, per text, whether it holds a letter. Digits and punctuation
    separate words, so they are no evidence.
    """
    codes, ends = code_points([t.lower() for t in texts])
    letter = letters(codes)
    has = np.zeros(len(texts), bool)
    codes = np.where(letter, codes, 32).astype(np.uint32)
    text = np.searchsorted(ends, np.arange(len(codes)), side="right") if len(texts) > 1 else np.zeros(len(codes), int)
    has[np.unique(text[letter])] = True
    # Blanks next to each other are one.
    keep = letter | np.concatenate(([True], letter[:-1]))
    codes, text, letter = codes[keep].astype(_U64), text[keep], letter[keep]
    owners, buckets = [], []
    for size in sizes:
        n = len(codes) - size + 1
        if n <= 0:
            continue
        rolled = np.zeros(n, _U64)
        good = np.zeros(n, bool)
        inner = np.ones(n, bool)
        for step in range(size):
            rolled = rolled * _U64(0x100000001B3) + codes[step:step + n]
            good |= letter[step:step + n]
            if 0 < step < size - 1:
                inner &= letter[step:step + n]
        good &= inner & (text[:n] == text[size - 1:])
        rolled = mix(rolled[good] + _salt(size))
        owners.append(text[:n][good])
        buckets.append((rolled >> _U64(64 - bits)).astype(np.int64))
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), has
    return np.concatenate(owners), np.concatenate(buckets), has
