"""Chunks, an index of them, nearest neighbours and the quality of what is retrieved."""

from __future__ import annotations

import re

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.words import let, words

# How a path names its source type and its document; the first match counts.
PATH_PATTERNS = [r"(PMC\d+)", r"(NCT\d{8})", r"(PMID_?\d+)", r"([a-z]+_\d+)"]
SOURCE_DIRS = ["pubmed_abstracts", "clinical_trials", "wikipedia", "patient_narratives", "fda_labels"]


def paragraphs(text: Column, separator: str = "\n\n") -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), separator), lambda p: F.trim(p)), lambda p: p != "")


def overlap_size(size: int) -> int:
    return max(10, int(0.1 * size))


def count_words(text: str) -> int:
    return len(text.split())


def pack_units(text: str, most: int, separator: str = "\n\n", count: Callable[[str], int] = count_words) -> list[str]:
    """Paragraphs packed greedily up to most tokens, separators included; a longer paragraph goes sentence by sentence, a longer
    sentence stays whole. count: tokens of a text, by default its words."""
    between, blank = count(separator), count(" ")

    out: list[str] = []
    held: list[str] = []
    n = 0

    def flush() -> None:
        nonlocal n
        if held:
            out.append(separator.join(held))
            held.clear()
            n = 0

    for paragraph in (p.strip() for p in text.split(separator)):
        if not paragraph:
            continue
        size = count(paragraph)
        if size > most:
            flush()
            group: list[str] = []
            m = 0
            for sentence in re.split(r"(?<=[.!?])\s+", paragraph):
                k = count(sentence)
                if group and m + blank + k > most:
                    out.append(" ".join(group))
                    group, m = [], 0
                m += k + (blank if group else 0)
                group.append(sentence)
            held.append(" ".join(group))  # the last group opens the next chunk
            n = m
            continue
        if held and n + between + size > most:
            flush()
        n += size + (between if held else 0)
        held.append(paragraph)
    flush()
    return out


def chunk(df: DataFrame, key: str, text: str, most: int = 200, separator: str = "\n\n", count: Callable[[str], int] = count_words) -> DataFrame:
    """key, chunk_index, total_chunks, chunk and n_tokens; null and blank texts have no chunks. count: a tokenizer's count."""
    if most <= 0:
        raise ValueError("most must be positive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, i, len(parts), p, count(p)) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for parts in [pack_units(t, most, separator, count)] for i, p in enumerate(parts)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), *(pa.array(c, t) for c, t in zip(columns[1:], (pa.int32(), pa.int32(), pa.string(), pa.int64()), strict=True))], names=[key, "chunk_index", "total_chunks", "chunk", "n_tokens"])

    return df.select(key, F.col(text).cast("string")).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, chunk_index int, total_chunks int, chunk string, n_tokens long")


def fixed_chunks(df: DataFrame, key: str, text: str, size: int = 100) -> DataFrame:
    """Chunks of size words."""
    w = words(text)
    n = F.ceil(F.size(w) / size).cast("int")
    cut = df.select(F.col(key), w.alias("w"), n.alias("total_chunks")).where("total_chunks > 0").select(key, "w", "total_chunks", F.explode(F.sequence(F.lit(0), F.col("total_chunks") - 1)).alias("chunk_index"))
    part = F.slice(F.col("w"), F.col("chunk_index") * size + 1, size)
    return cut.select(key, "chunk_index", "total_chunks", F.array_join(part, " ").alias("chunk"), F.size(part).cast("long").alias("n_tokens"))


def with_overlap(chunks: DataFrame, key: str, k: int) -> DataFrame:
    """The last k words of the previous, unextended chunk before each chunk; n_tokens counts again."""
    before = F.lag("chunk").over(Window.partitionBy(key).orderBy("chunk_index"))
    tail = let(words(before), lambda w: F.slice(w, F.greatest(F.size(w) - k + 1, F.lit(1)), k))
    text = F.when(before.isNotNull(), F.concat_ws(" ", F.array_join(tail, " "), F.col("chunk"))).otherwise(F.col("chunk"))
    return chunks.withColumn("__x", text).select(key, "chunk_index", "total_chunks", F.col("__x").alias("chunk"), F.size(words("__x")).cast("long").alias("n_tokens"))


def path_metadata(path: Column) -> tuple[Column, Column]:
    """(source type, document id) of a path."""
    stem = F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
    ident = F.coalesce(*[F.when(F.regexp_extract(path, p, 1) != "", F.regexp_extract(path, p, 1)) for p in PATH_PATTERNS], stem)
    kind = F.coalesce(*[F.when(F.contains(path, F.lit(f"/{d}/")), F.lit(d)) for d in SOURCE_DIRS], F.lit("unknown"))
    return kind, ident


def chunk_stats(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.avg("n_tokens").alias("mean_tokens"), F.min("n_tokens").alias("min_tokens"), F.max("n_tokens").alias("max_tokens"), F.median("n_tokens").alias("median_tokens"))


def partial_documents(chunks: DataFrame, key: str) -> DataFrame:
    """Documents of which chunks are missing."""
    return chunks.groupBy(key).agg(F.count_distinct("chunk_index").alias("n_found"), F.max("total_chunks").alias("total_chunks")).where("n_found < total_chunks")


def missing(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    return expected.join(found, key, "left_anti")


def _best(score: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest scores of each row, ties by own: only what reaches the k-th score is sorted."""
    low = np.round(score, 9)
    least = np.partition(low, -k, axis=1)[:, -k] if score.shape[1] > k else np.full(len(score), -np.inf)
    row, column = np.nonzero((low >= least[:, None]) & np.isfinite(low))
    order = np.lexsort((own[column], -low[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


def nearest(base: DataFrame, queries: DataFrame, key: str, vector: str, k: int, block: int = 2_000, metric: str = "cosine") -> DataFrame:
    """The k nearest of each query, exactly; a query is not its own neighbour; ties by key.

    metric: cosine (score is the similarity) or l2 (score is the distance, negative). Queries go to all rows in blocks of
    bounded size; each task keeps k per query of a batch, so only these are shuffled. Null vectors, and by cosine zero ones,
    have no neighbours.
    """
    if metric not in ("cosine", "l2"):
        raise ValueError(f"unknown metric {metric}")
    spark = base.sparkSession
    rows = base.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"))
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"))
    n = max(1, -(-asked.count() // block))
    out = None
    for i in range(n):
        part = (asked if n == 1 else asked.where(F.pmod(F.xxhash64("id"), F.lit(n)) == i)).toArrow()
        if not part.num_rows:
            continue
        shared = spark.sparkContext.broadcast((part.column("id").to_numpy(), np.stack([np.asarray(x, np.float64) for x in part.column("v").to_pylist()])))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            size = np.linalg.norm(q, axis=1)
            for batch in batches:
                own = batch.column("id").to_numpy()
                if not len(own):
                    continue
                v = np.stack([np.asarray(x, np.float64) for x in batch.column("v").to_pylist()])
                norm = np.linalg.norm(v, axis=1)
                score = q @ v.T
                if metric == "cosine":
                    score /= np.maximum(size, 1e-30)[:, None] * np.maximum(norm, 1e-30)[None, :]
                    score[:, norm == 0] = score[size == 0] = -np.inf
                else:
                    score = -np.sqrt(np.maximum(size[:, None] ** 2 + norm[None, :] ** 2 - 2 * score, 0.0))
                score[ids[:, None] == own[None, :]] = -np.inf
                row, column = _best(score, own, k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(own[column]), pa.array(score[row, column])], names=["query", "neighbour", "score"])

        here = rows.mapInArrow(run, "query long, neighbour long, score double")
        out = here if out is None else out.unionByName(here)
    if out is None:
        return spark.createDataFrame([], "query long, neighbour long, score double, rank int")
    w = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "neighbour")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cosine(a: Column, b: Column) -> Column:
    """In plain expressions, for few pairs."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    size = [F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x)) for v in (a, b)]
    return F.when((size[0] > 0) & (size[1] > 0), dot / (size[0] * size[1]))


def context_block(chunks: Column) -> Column:
    return F.array_join(F.transform(chunks, lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), c)), "\n\n")


# Prompts with retrieved passages.
TEMPLATES = {
    "context_only": 'Context:\n{context_block}\n\nUsing only the context above, answer the following question. If the answer is not found in the context, say "Not found in context."\nQuestion: {question}',
    "combined": "Context:\n{context_block}\n\nUsing the context above and your own knowledge, answer the following question.\nQuestion: {question}",
}


def context_prompt(block: Column, question: Column, template: str = "combined") -> Column:
    """The prompt of a template by name, or of one's own, which must hold both {context_block} and {question}; nulls are empty."""
    text = TEMPLATES.get(template, template)
    if "{context_block}" not in text or "{question}" not in text:
        raise ValueError("a template needs {context_block} and {question}")
    parts = re.split(r"(\{context_block\}|\{question\})", text)
    values = {"{context_block}": F.coalesce(block, F.lit("")), "{question}": F.coalesce(question, F.lit(""))}
    return F.concat(*[values[x] if x in values else F.lit(x) for x in parts if x])


def sweep(spark, sizes: list[int], tops: list[int], models: list[str]) -> DataFrame:
    """All settings of a configuration sweep: three short lists."""
    return spark.createDataFrame(list(product(sizes, tops, models)), "chunk_size int, top_k int, model string")


def hit_rate(matches: DataFrame, facts: DataFrame, item: str, fact: str) -> DataFrame:
    """Per item facts found in what was retrieved; facts of items without retrieval are misses."""
    seen = matches.groupBy(item, fact).agg(F.max(F.col("found").cast("int")).alias("f"))
    return facts.join(seen, [item, fact], "left").groupBy(item).agg(F.count("*").alias("n_facts"), F.sum(F.coalesce("f", F.lit(0))).cast("long").alias("n_found"))


def retrieval_pattern(hit: Column, accuracy: Column) -> Column:
    return (
        F.when((hit >= 0.5) & (accuracy < 0.3), "Generation failure").when((hit < 0.3) & (accuracy >= 0.5), "Parametric knowledge")
        .when((hit >= 0.5) & (accuracy >= 0.5), "Retrieval success").when((hit < 0.3) & (accuracy < 0.3), "Retrieval failure").otherwise("Mixed")
    )
