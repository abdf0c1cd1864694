"""Similarity of strings from 0 to 100: whole, partial and by sets of tokens.

ratio is 200 x LCS / (|a| + |b|), the insert-and-delete similarity. The longest common subsequence is found with one
integer as a bit row, so a comparison takes one step per character of the longer string.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _table(a: str) -> dict[str, int]:
    bits: dict[str, int] = {}
    for i, c in enumerate(a):
        bits[c] = bits.get(c, 0) | 1 << i
    return bits


def _common(bits: dict[str, int], n: int, b: str) -> int:
    full = (1 << n) - 1
    row = full
    for c in b:
        hit = row & bits.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return n - row.bit_count()


def ratio(a: str | None, b: str | None) -> float:
    """Null counts as empty; two empty strings are equal."""
    a, b = a or "", b or ""
    if a == b:
        return 100.0
    if not a or not b:
        return 0.0
    return 200.0 * _common(_table(a), len(a), b) / (len(a) + len(b))


def partial_ratio(a: str | None, b: str | None, least: float = 0.0) -> float:
    """The best ratio of the shorter string with any window of the longer; below least, any smaller value may come out."""
    a, b = a or "", b or ""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    if a in b:
        return 100.0
    # a window that moves by one place changes its common subsequence by one at most: it moves as far as the best, or least, allows
    n, bits = len(a), _table(a)
    first, last = _common(bits, n, b[:n]), _common(bits, n, b[-n:])
    most = max(first, last)
    goal = least * n / 100 if least > 0 else 0.0
    s, end = max(1, int(max(goal, most + 1) - first)), len(b) - n
    while s < end:
        common = _common(bits, n, b[s : s + n])
        most = max(most, common)
        s += max(1, int(max(goal, most + 1) - common))
    best = 100.0 * most / n
    for common, part in ((first, lambda m: b[:m]), (last, lambda m: b[-m:])):  # shorter windows at both ends share no more than the whole one
        for m in range(n - 1, 0, -1):
            reach = min(m, common)
            if 200.0 * reach / (n + reach) <= max(best, least - 1e-9):
                break
            if 200.0 * reach / (n + m) > best:
                best = max(best, 200.0 * _common(bits, n, part(m)) / (n + m))
    return best


def token_set_ratio(a: str | None, b: str | None) -> float:
    """The best ratio among the sorted common tokens and these with either side's other tokens."""
    x, y = set((a or "").split()), set((b or "").split())
    if not x or not y:
        return 0.0
    common = " ".join(sorted(x & y))
    left, right = (" ".join(filter(None, [common, " ".join(sorted(s))])) for s in (x - y, y - x))
    if common and (x <= y or y <= x):
        return 100.0
    return max(ratio(left, right), ratio(common, left) if common else 0.0, ratio(common, right) if common else 0.0)


class Tokens:
    """A text as token_set_ratio sees it: its distinct tokens, the length of these joined, and its characters by slot."""

    def __init__(self, text: str | None):
        self.tokens = frozenset((text or "").split())
        joined = " ".join(self.tokens)
        self.size = len(joined)
        self.slots = np.bincount(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32) % 64, minlength=64)


def set_ratio_above(x: Tokens, y: Tokens, most: float, best: float) -> float:
    """The greater of best and token_set_ratio(x, y); the subsequence is searched only if most allows more than best."""
    if not x.tokens or not y.tokens:
        return best
    common, n = x.tokens & y.tokens, 0
    if common:
        if len(common) in (len(x.tokens), len(y.tokens)):
            return 100.0
        n = sum(map(len, common)) + len(common)
        best = max(best, 200.0 * (n - 1) / (n - 1 + min(x.size, y.size)))
    if most <= best:
        return best
    a, b = " ".join(sorted(x.tokens - common)), " ".join(sorted(y.tokens - common))
    return max(best, 200.0 * (n + _common(_table(a), len(a), b)) / (x.size + y.size))


class TokenBlocks:
    """Texts to compare many others with by token_set_ratio. They lie side by side in bit rows, so that one step of the search goes
    through a block of them at once. Texts of similar length share a block, as bounds leave blocks out."""

    def __init__(self, texts: list[Tokens], per_block: int = 32):
        self.texts = texts
        self.slots, self.sizes = np.array([y.slots for y in texts]), np.array([y.size for y in texts])
        self.counts = np.array([len(y.tokens) for y in texts])
        held: dict[str, list[int]] = {}
        for i, y in enumerate(texts):
            for token in y.tokens:
                held.setdefault(token, []).append(i)
        self.held = {token: np.array(i) for token, i in held.items()}
        order = np.argsort(self.sizes, kind="stable")
        self.blocks = [_Block([texts[i] for i in rows.tolist()], rows) for rows in np.split(order, range(per_block, len(order), per_block))]

    def above(self, x: Tokens, best: np.ndarray) -> np.ndarray:
        """By text the greater of best and the ratio with x; the subsequences are searched only where more letters are shared than best needs."""
        if not x.tokens:
            return best
        n, common = np.zeros(len(self.texts)), np.zeros(len(self.texts), np.int64)
        for token in x.tokens:
            if (rows := self.held.get(token)) is not None:
                n[rows] += len(token) + 1
                common[rows] += 1
        within = (common > 0) & ((common == len(x.tokens)) | (common == self.counts))
        told = np.where(common > 0, 200.0 * (n - 1) / np.maximum(n - 1 + np.minimum(x.size, self.sizes), 1), 0.0)
        best = np.where(within, 100.0, np.maximum(best, told))
        most = 200.0 * np.minimum(x.slots, self.slots).sum(1) / np.maximum(x.size + self.sizes, 1)
        open_ = ~within & (self.counts > 0) & (most > best)
        for block in self.blocks:
            rows = block.rows[open_[block.rows]]
            if len(rows) > len(block.rows) / 8:
                whole = block.rows
                found = 200.0 * (n[whole] + block.common(x)) / np.maximum(x.size + self.sizes[whole], 1)
                best[rows] = np.maximum(best[whole], found)[open_[whole]]
            else:
                for i in rows.tolist():
                    best[i] = set_ratio_above(x, self.texts[i], most[i], best[i])
        return best


class _Block:
    """Bit rows of texts side by side, each with a blank before every token and a bit after it that ends carries."""

    def __init__(self, texts: list[Tokens], rows: np.ndarray):
        self.rows, self.full = rows, 0
        self.bits: dict[str, int] = {}
        self.places: dict[str, int] = {}
        self.holders: dict[str, int] = {}
        start, at = [], 0
        for y in texts:
            start.append(at)
            own = ((1 << y.size + 1) - 1) << at
            self.full |= own
            for token in sorted(y.tokens):
                self.places[token] = self.places.get(token, 0) | ((1 << len(token) + 1) - 1) << at
                self.holders[token] = self.holders.get(token, 0) | own
                for c in " " + token:
                    self.bits[c] = self.bits.get(c, 0) | 1 << at
                    at += 1
            at = start[-1] + y.size + 2
        self.start, self.length, self.bytes = np.array(start), np.array([y.size + 1 for y in texts]), at // 8 + 1

    def common(self, x: Tokens) -> np.ndarray:
        """By text the common subsequence of what x and it have besides their common tokens, without the blank both begin with.

        A common token's places never match, and its letters are no step for the texts that have it."""
        full, keep = self.full, self.full
        for token in x.tokens:
            keep &= ~self.places.get(token, 0)
        bits = {c: b & keep for c, b in self.bits.items()}
        row = full
        for token in sorted(x.tokens):
            holders = self.holders.get(token)
            for c in " " + token:
                if (step := bits.get(c)) is not None:
                    hit = row & step if holders is None else row & step & ~holders
                    row = ((row + hit) | (row ^ hit)) & full
        left = np.unpackbits(np.frombuffer(row.to_bytes(self.bytes, "little"), np.uint8), bitorder="little")
        return self.length - np.add.reduceat(left, self.start, dtype=np.int64) - 1


class Windows:
    """Tells which of some texts may have a partial_ratio of least or more with another: pieces that hold every window lie side by side
    in one bit row, and a text is left out if no piece has a common subsequence as long as the ratio needs."""

    STEP, WIDER = 8, 24  # lengths that share a row, and how much longer than these its pieces are

    def __init__(self, texts: list[str], least: float):
        self.texts, self.least, self.rows = texts, least, {}
        self.longest = max(map(len, texts), default=0)

    def near(self, x: str) -> list[int]:
        if not self.texts:
            return []
        n = min(-(-len(x) // self.STEP) * self.STEP, self.longest)
        if n not in self.rows:
            self.rows[n] = self._row(n)
        bits, full, start, length, text, inner = self.rows[n]
        row = full
        for c in x:
            if (step := bits.get(c)) is not None:
                hit = row & step
                row = ((row + hit) | (row ^ hit)) & full
        left = np.unpackbits(np.frombuffer(row.to_bytes((full.bit_length() + 7) // 8, "little"), np.uint8), bitorder="little")
        common = length - np.add.reduceat(left, start, dtype=np.int64)
        # inner windows are as long as the shorter text; those at the ends may be shorter, down to the subsequence itself
        short = np.where(inner, len(x), np.minimum(len(x), length))
        need = np.where(inner, self.least / 100, self.least / (200 - self.least)) * short
        return np.unique(text[common >= need - 1e-6]).tolist()

    def _row(self, n: int) -> tuple:
        """For strings of up to n characters: bits by character, the places of the pieces, their lengths and texts, and which are inner ones."""
        pieces = []
        for i, y in enumerate(self.texts):
            if len(y) <= n + self.WIDER:
                pieces.append((y, i, False))
                continue
            pieces += [(y[:n], i, False), (y[-n:], i, False)]
            pieces += [(y[at : at + n + self.WIDER], i, True) for at in range(0, len(y) - n + 1, self.WIDER + 1)]
        pieces = [p for p in pieces if p[0]]
        bits: dict[str, bytearray] = {}
        start = np.cumsum([0, *(len(p) + 1 for p, _, _ in pieces)])
        size = int(start[-1]) // 8 + 1
        whole = bytearray(size)
        for at, (p, _, _) in zip(start.tolist(), pieces, strict=False):
            for k, c in enumerate(p, at):
                bits.setdefault(c, bytearray(size))[k >> 3] |= 1 << (k & 7)
                whole[k >> 3] |= 1 << (k & 7)
        texts, inner = np.array([i for _, i, _ in pieces]), np.array([w for _, _, w in pieces])
        return {c: int.from_bytes(b, "little") for c, b in bits.items()}, int.from_bytes(whole, "little"), start[:-1], np.array([len(p) for p, _, _ in pieces]), texts, inner


@F.pandas_udf(T.DoubleType())
def ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def partial_ratio_80_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([partial_ratio(x, y, 80.0) for x, y in zip(a, b, strict=True)], dtype="float64")
