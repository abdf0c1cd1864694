"""Words of a batch of texts as hashes, by array operations only.

Words are the maximal runs of Unicode letters and digits of the lower-cased text.
A word's hash is a polynomial over its code points, so no Python object is made per word.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

CHUNK = 1 << 20  # characters taken at once, if no single text is longer
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """True for the code points that belong to words: categories L* and N* that are digits."""
    keep = np.zeros(sys.maxunicode + 1, dtype=bool)
    keep[[i for i in range(0x33480) if (c := unicodedata.category(chr(i)))[0] == "L" or c == "Nd"]] = True  # no letters lie beyond
    return keep


_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _powers[:] = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)])) for b in (_BASE, inverse)]
    return _powers[0][:n], _powers[1][:n]


class Words:
    """hash, doc, start and end of each word; start and end are offsets into text, which joins the chunk's texts. first: the chunk's first row."""

    __slots__ = ("hash", "doc", "start", "end", "text", "offset", "first", "docs", "points")

    def __init__(self, texts: list[str], first: int):
        self.first, self.docs = first, len(texts)
        self.text = "\n".join(texts)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.offset = np.concatenate([[0], np.cumsum(lengths + 1)])
        points = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.points = points
        inside = np.zeros(len(points) + 2, np.int8)
        inside[1:-1] = _classes()[points]
        edge = np.diff(inside)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        forward, back = _power(len(points) + 1)
        sums = np.zeros(len(points) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((points.astype(np.uint64) + np.uint64(7)) * forward[:-1], out=sums[1:])
            self.hash = mix((sums[self.end] - sums[self.start]) * back[self.start])
        self.doc = np.searchsorted(self.offset, self.start, "right") - 1

    def word(self, i: int) -> str:
        return self.text[self.start[i] : self.end[i]]

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.docs)


def chunks(texts: list[str]) -> Iterator[Words]:
    """The texts, already lower-cased, in chunks of about CHUNK characters and at most 4,000 texts; a longer text is a chunk of its own."""
    at, held, size = 0, [], 0
    for i, t in enumerate(texts):
        if held and (size + len(t) > CHUNK or len(held) >= 4000):
            yield Words(held, at)
            at, held, size = i, [], 0
        held.append(t)
        size += len(t) + 1
    if held:
        yield Words(held, at)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """hash, doc and first word of each run of k consecutive words of one text."""
    n = len(words.hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = words.hash[:n].copy()
        for j in range(1, k):
            h = h * np.uint64(0xD6E8FEB86659FD93) + words.hash[j : j + n]
    at = np.flatnonzero(words.doc[:n] == words.doc[k - 1 :])
    return mix(h[at]), words.doc[at], at


def hash_word(word: str) -> int:
    """The hash that Words gives to this lower-cased word."""
    w = Words([word], 0)
    return int(w.hash[0]) if len(w.hash) else 0
