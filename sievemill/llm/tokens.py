"""Encoding with a public byte-level BPE vocabulary, exactly and in linear time.

A text is cut into words by the tokenizer's pattern. In a word, the longest token at each place comes from an Aho-Corasick
automaton over the reversed tokens; the encoder takes it, or the next shorter prefix token, if its pair with the token
before is compatible, and steps back where nothing fits. A sequence whose neighbours are all compatible is the one that the
merges give, so the result equals merging. Words are kept in a table of bounded size, for speed alone.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space whose cuts depend on more than one space and what follows it: three in a row, or two at the end.
_LONG_SPACE = re.compile(r"\s\s\s|\s\s\Z").search
#: Words whose encoding a task keeps at most; and the longest that is kept.
KEPT, KEPT_CHARS = 200_000, 64
#: Pairs of tokens whose compatibility is kept; when there are as many, all are forgotten.
PAIRS = 1 << 20


def default_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Vocabulary:
    """Token bytes by id, which is also the rank of their merge, and the two parts each token is merged from."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern = pattern
        self.bytes: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.parts: list[tuple[int, int] | None] = [self._parts(ranks, t, i) if len(t) > 1 else None for i, t in enumerate(self.bytes)]

    @staticmethod
    def _parts(ranks: dict[bytes, int], token: bytes, own: int) -> tuple[int, int] | None:
        if len(token) == 2:
            return ranks[token[:1]], ranks[token[1:]]
        pieces = [token[i : i + 1] for i in range(len(token))]
        while len(pieces) > 2:
            rank, at = min((ranks.get(pieces[i] + pieces[i + 1], own), i) for i in range(len(pieces) - 1))
            if rank >= own:
                return None
            pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
        return ranks[pieces[0]], ranks[pieces[1]]


class Encoder(dict):
    """Ids of a space and the run of characters after it; as a dict it holds the runs met so far.

    The pattern never joins a space to what stands before it, so a text is encoded run by run between its spaces; texts
    with long white space are cut by the pattern as a whole.
    """

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.tokens = vocabulary.bytes
        self.parts = vocabulary.parts
        self.size = [len(t) for t in self.tokens]
        self.ids = {t: i for i, t in enumerate(self.tokens) if t}
        self.merged = {p: i for i, p in enumerate(self.parts) if p}
        self.shorter: dict[int, int] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.reverse = ahocorasick.Automaton()
        for token, i in self.ids.items():
            self.reverse.add_word(token[::-1].decode("latin-1"), i)
        self.reverse.make_automaton()
        self.find = regex.compile(vocabulary.pattern).findall

    def prefix(self, token: int) -> int:
        """The longest token that is a proper prefix, or -1."""
        found = self.shorter.get(token)
        if found is None:
            text = self.tokens[token]
            found = next((self.ids[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.ids), -1)
            self.shorter[token] = found
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging keeps both tokens apart: no pair across their border merges before the merges that made them."""
        known = self.pairs.get((left, right))
        if known is not None:
            return known
        a, b, before, apart = left, right, len(self.tokens), True
        while True:
            across = self.merged.get((a, b))
            if across is not None and across < before:
                apart = False
                break
            # undo the later of the two merges at the border; at equal rank the left one came first
            undo_left = a > b
            if undo_left and self.parts[a] is None:
                undo_left = False
                if self.parts[b] is None:
                    break
            elif not undo_left and self.parts[b] is None:
                if self.parts[a] is None:
                    break
                undo_left = True
            if undo_left:
                before, a = a, self.parts[a][1]
            else:
                before, b = b + 1, self.parts[b][0]
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[left, right] = apart
        return apart

    def word(self, data: bytes) -> tuple[int, ...]:
        whole = self.ids.get(data)
        if whole is not None:
            return (whole,)
        n = len(data)
        longest = [-1] * n
        for end, token in self.reverse.iter(data[::-1].decode("latin-1")):
            at = n - 1 - end
            if longest[at] < 0 or self.size[token] > self.size[longest[at]]:
                longest[at] = token
        open_, out, at, token = bytearray(b"\1" * (n + 1)), [], 0, longest[0]
        while token >= 0:
            end = at + self.size[token]
            if open_[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            elif (shorter := self.prefix(token)) >= 0:
                token = shorter
            else:
                open_[at] = 0
                token = out.pop()
                at -= self.size[token]
        return tuple(out)

    def cut(self, text: str) -> tuple[int, ...]:
        """Ids of a text by the pattern alone."""
        return tuple(chain.from_iterable(self.word(w.encode("utf-8", "replace")) for w in self.find(text)))

    def __missing__(self, run: str) -> tuple[int, ...]:
        ids = self.cut(" " + run)
        if len(run) <= KEPT_CHARS:
            if len(self) >= KEPT:
                self.clear()
            self[run] = ids
        return ids

    def pieces(self, text: str) -> Iterator[tuple[int, ...]]:
        if _LONG_SPACE(text):
            return iter((self.cut(text),))
        first, *rest = text.split(" ")
        return chain((self.cut(first),), map(self.__getitem__, rest))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.pieces(text)))

    def count(self, text: str) -> int:
        return sum(map(len, self.pieces(text)))


class Decoder:
    """Bytes of ids by an offset table: token i is the bytes from offset[i] to offset[i + 1]."""

    def __init__(self, vocabulary: Vocabulary):
        self.joined = np.frombuffer(b"".join(vocabulary.bytes), np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(t) for t in vocabulary.bytes])]).astype(np.int64)

    def decode(self, ids: np.ndarray) -> str:
        ids = np.asarray(ids, np.int64)
        size = self.offset[ids + 1] - self.offset[ids]
        at = np.repeat(self.offset[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return self.joined[at].tobytes().decode("utf-8", "replace")


_encoders: dict[int, Encoder] = {}


def _encoder(vocabulary: Vocabulary) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    key = id(vocabulary)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]


def _vocabulary(df: DataFrame, path: str | None, pattern: str | None):
    """The vocabulary, made once and sent to the workers: its size is that of the file."""
    return df.sparkSession.sparkContext.broadcast(Vocabulary(path or default_path(), pattern or default_pattern()))


def encode(df: DataFrame, id_col: str, text_col: str, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """id and ids, the token ids of the text without special tokens, whose strings count as ordinary text.

    Null and empty text give an empty array; repeated rows give repeated rows. Other columns are not read.
    """
    shared = _vocabulary(df, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for at in range(0, len(texts), 500):
                ids = [encoder.encode(t) if t else [] for t in texts[at : at + 500]]
                offset = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.fromiter(chain.from_iterable(ids), np.int32, int(offset[-1]))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, 500), pa.ListArray.from_arrays(pa.array(offset), pa.array(flat))], names=["id", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def count_tokens(df: DataFrame, keep: list[str], text_col: str, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The kept columns and n_tokens, the number of token ids of the text: 0 for null and empty text."""
    shared = _vocabulary(df, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            n = np.array([encoder.count(t) if t else 0 for t in batch.column("__text").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(n)], names=[*keep, "n_tokens"])

    rows = df.select(*keep, F.col(text_col).cast("string").alias("__text"))
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{schema}, n_tokens long")


def decode(df: DataFrame, id_col: str, ids_col: str, path: str | None = None) -> DataFrame:
    """id and text of token ids; null ids give null."""
    shared = _vocabulary(df, path, "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            texts = [None if x is None else decoder.decode(np.array(x, np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
