"""Passages of evaluation items inside training text, by winnowed fingerprints.

Both sides keep the smaller hash of each two neighbouring runs of K words, so every shared run of K + 1 words shares a kept
one. A passage of 20 words or more of which at most one in five is changed leaves such a run (16 words in five pieces), as do a
passage of 12 words with a remark in it and a run of 12 unchanged words: no such case is lost. A passage with both changes and a
remark is found wherever it leaves such a run too. Hits are counted over all runs of K words, and what may still be a case is
aligned word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._words import Words, chunks, shingles

K = 3
#: Words of an unchanged passage; of one with changes; of it, one in so many may be changed; words of an inserted remark at most.
EXACT, LOOSE, ONE_IN, REMARK = 12, 20, 5, 14
#: Changed words at the ends of a passage that still count as part of it.
ENDS = 2
#: Hits on different runs of K words that any case has at least: EXACT - K + 1 of an exact passage, and of LOOSE words with
#: LOOSE / ONE_IN changes and a remark no fewer than this.
LEAST = 4
#: Words of evaluation items that are matched at once; more items are taken block by block.
BLOCK_WORDS = 500_000


@dataclass
class Items:
    """Evaluation items: words of each, and all their runs of K words sorted by hash, with item and position; kept: if winnowing keeps it."""

    ids: list[str]
    words: list[np.ndarray]
    run: np.ndarray
    item: np.ndarray
    at: np.ndarray
    kept: np.ndarray


def winnow(runs: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """True for each run that is the smaller one of it and a neighbour in the same text, or has no neighbour."""
    n = len(runs)
    if not n:
        return np.zeros(0, bool)
    same = doc[1:] == doc[:-1]
    lone = np.concatenate([[True], ~same]) & np.concatenate([~same, [True]])
    kept = lone.copy()
    kept[:-1] |= same & (runs[:-1] <= runs[1:])
    kept[1:] |= same & (runs[1:] < runs[:-1])
    return kept


def index(rows: list[tuple[str, str]]) -> Items:
    ids, words, runs, items, ats, kepts = [], [], [], [], [], []
    for ident, text in rows:
        w = Words([text.lower()], 0)
        if len(w.hash) < EXACT:
            continue
        run, doc, at = shingles(w, K)
        runs.append(run)
        items.append(np.full(len(run), len(ids)))
        ats.append(at)
        kepts.append(winnow(run, doc))
        ids.append(ident)
        words.append(w.hash)
    if not ids:
        none = np.zeros(0, np.int64)
        return Items([], [], none.astype(np.uint64), none, none, none.astype(bool))
    run = np.concatenate(runs)
    order = np.argsort(run, kind="stable")
    return Items(ids, words, run[order], np.concatenate(items)[order], np.concatenate(ats)[order], np.concatenate(kepts)[order])


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges first..last: the row of each element, and the elements."""
    n = last - first
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[row]


def _edits(a: np.ndarray, b: np.ndarray) -> int:
    """Words to change, drop or add to turn a into b."""
    if not len(a) or not len(b):
        return max(len(a), len(b))
    row = list(range(len(b) + 1))
    for i, x in enumerate(a.tolist(), 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b.tolist(), 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def is_case(item: np.ndarray, text: np.ndarray, at_item: np.ndarray, at_text: np.ndarray) -> bool:
    """Whether text holds a passage of item, given their common runs of K words."""
    # maximal runs of equal words: common runs of K words on one diagonal without a gap
    order = np.lexsort((at_item, at_text - at_item))
    q, t = at_item[order], at_text[order]
    fresh = np.concatenate([[True], (np.diff(q) != 1) | (np.diff(t) != 1)])
    start = np.flatnonzero(fresh)
    size = np.diff(np.append(start, len(q))) + K - 1
    if size.max() >= EXACT:
        return True
    runs = sorted(zip(t[start].tolist(), q[start].tolist(), size.tolist(), strict=True))
    longest = LOOSE // ONE_IN + len(item) // ONE_IN
    for i, (t0, q0, n0) in enumerate(runs):
        t_end, q_end, edits, remark = t0 + n0, q0 + n0, 0, False
        for t1, q1, n1 in [(t0, q0, n0), *runs[i + 1 :]]:
            if (t1, q1) != (t0, q0):
                shift = max(t_end - t1, q_end - q1, 0)  # runs may touch where a word is dropped or doubled
                t1, q1, n1 = t1 + shift, q1 + shift, n1 - shift
                gap_t, gap_q = t1 - t_end, q1 - q_end
                if n1 <= 0 or gap_q > longest or gap_t > longest + REMARK:
                    continue
                more = _edits(item[q_end:q1], text[t_end:t1])
                if not remark and gap_t - gap_q >= 2 and gap_t - gap_q <= REMARK and gap_q <= 1:
                    remark, more = True, gap_q
                if edits + more > longest:
                    continue
                edits += more
                t_end, q_end = t1 + n1, q1 + n1
            length = q_end - q0
            room = min(ENDS, q0 + len(item) - q_end)
            for extra in range(room + 1):
                if length + extra >= LOOSE and ONE_IN * (edits + extra) <= length + extra:
                    return True
    return False


def find_in(words: Words, items: Items) -> Iterator[tuple[int, int]]:
    """(text, item) of each case in a chunk of texts."""
    run, doc, at = shingles(words, K)
    if not len(run) or not len(items.ids):
        return
    first, last = np.searchsorted(items.run, run, "left"), np.searchsorted(items.run, run, "right")
    hit = np.flatnonzero(last > first)
    row, place = _spread(first[hit], last[hit])
    row = hit[row]
    pair = doc[row] * len(items.ids) + items.item[place]
    seeds = np.unique(pair[winnow(run, doc)[row] & items.kept[place]])
    keep = np.isin(pair, seeds)
    pair, q, t = pair[keep], items.at[place[keep]], at[row[keep]]
    order = np.lexsort((t, pair))
    pair, q, t = pair[order], q[order], t[order]
    start = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
    end = np.append(start[1:], len(pair))
    base = np.searchsorted(words.doc, np.arange(words.docs + 1))
    for a, b in zip(start[end - start >= LEAST].tolist(), end[end - start >= LEAST].tolist(), strict=True):
        if len(np.unique(q[a:b])) < LEAST:
            continue
        d, item = divmod(int(pair[a]), len(items.ids))
        if is_case(items.words[item], words.hash[base[d] : base[d + 1]], q[a:b], t[a:b] - base[d]):
            yield d, item


def leaks(train: DataFrame, id_col: str, text_cols: list[str], test: DataFrame, item_col: str, test_col: str, block_words: int = BLOCK_WORDS) -> DataFrame:
    """id and item, distinct: training rows of which one text column holds a passage of the item's text.

    Null or short texts, on either side, hold nothing. Items with the same words are matched once; an item may have several
    texts. The items are taken in blocks of bounded size, every block against all rows.
    """
    spark = train.sparkSession
    clean = F.trim(F.regexp_replace(F.lower(F.col(test_col)), r"[^\p{L}\p{Nd}]+", " "))
    tests = test.where(F.col(item_col).isNotNull() & F.col(test_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), clean.alias("text")).distinct()
    tests = tests.withColumn("words", F.size(F.split("text", " "))).where(F.col("words") >= EXACT).cache()
    total = tests.agg(F.sum("words")).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    texts = F.array(*[F.col(c).cast("string") for c in text_cols])
    rows = train.select(F.col(id_col).alias("id"), F.explode(texts).alias("text")).where(F.col("text").isNotNull())
    kind = train.schema[id_col].dataType.simpleString()
    found = None
    for block in range(blocks):
        part = tests if blocks == 1 else tests.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        shared = spark.sparkContext.broadcast(index([(r["item"], r["text"]) for r in part.sort("item", "text").toLocalIterator()]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                ids = batch.column("id")
                for words in chunks([t.lower() for t in batch.column("text").to_pylist()]):
                    got = list(find_in(words, items))
                    if got:
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array([words.first + d for d, _ in got])), pa.array([items.ids[i] for _, i in got])], names=["id", "item"])

        here = rows.mapInArrow(run, f"id {kind}, item string")
        found = here if found is None else found.unionByName(here)
    tests.unpersist()
    return found.distinct().select(F.col("id").alias(id_col), F.col("item").alias(item_col))
