"""Comparison of tokenizers by what they make of terms and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def win_loss(counts: DataFrame, a: str, b: str) -> DataFrame:
    """Terms with who needs fewer tokens."""
    return counts.withColumn("winner", F.when(F.col(a) < F.col(b), "a").when(F.col(a) > F.col(b), "b").otherwise("tie"))


def largest_differences(counts: DataFrame, name: str, a: str, b: str, k: int = 10) -> DataFrame:
    """The k terms each side wins most tokens on: winner, term and how many it saves; ties by term."""
    saved = win_loss(counts, a, b).where("winner <> 'tie'").withColumn("saved", F.abs(F.col(a) - F.col(b)))
    parts = [saved.where(F.col("winner") == side).orderBy(F.desc("saved"), name).limit(k) for side in ("a", "b")]
    return parts[0].unionByName(parts[1]).select("winner", name, "saved")


def ratios(df: DataFrame, tokens: str, words: str, chars: str) -> DataFrame:
    return df.agg((F.sum(tokens) / F.sum(words)).alias("fertility"), (F.sum(chars) / F.sum(tokens)).alias("compression"))


def fragmentation(df: DataFrame, category: str, tokens: str, least: int = 3) -> DataFrame:
    return df.groupBy(category).agg(F.count("*").alias("n_terms"), F.sum((F.col(tokens) >= least).cast("long")).alias("n_fragmented"), F.sum((F.col(tokens) == 1).cast("long")).alias("n_single"))


def degraded(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.where(F.col(new) > F.col(old))


def winner(df: DataFrame, name: str, single: str, mean: str, terms: str | None = None, least: float = 0.5) -> DataFrame:
    """Most terms as single tokens, then the lowest mean. terms: a column with the number of all terms; is_enough then tells whether
    the winner has the least share of them as single tokens, or a larger vocabulary should be tried."""
    best = F.struct(F.col(single), -F.col(mean))
    enough = [(F.max_by(single, best) >= least * F.max_by(terms, best)).alias("is_enough")] if terms else []
    return df.agg(F.max_by(name, best).alias("winner"), *enough)


def min_max(column: str, low: float, high: float, higher_is_better: bool) -> Column:
    """Place in the range from 0 to 1; 1 where all are equal."""
    if low is None or high == low:
        return F.lit(1.0)
    at = (F.col(column) - F.lit(low)) / F.lit(high - low)
    return at if higher_is_better else 1.0 - at


def weighted_rank(df: DataFrame, name: str, weights: list[tuple[str, float, bool]]) -> DataFrame:
    """Candidates by the weighted sum of their places; weights are (column, weight, higher is better)."""
    ends = df.agg(*[f(c).alias(f"{n}{i}") for i, (c, _, _) in enumerate(weights) for n, f in (("low", F.min), ("high", F.max))]).first()
    score = sum((min_max(c, ends[f"low{i}"], ends[f"high{i}"], up) * w for i, (c, w, up) in enumerate(weights)), F.lit(0.0))
    scored = df.select(name, score.alias("score"))
    # a rank is the number of candidates in better cells of the score, of which there are at most 4,097, and those before it in its own
    cell = scored.withColumn("__c", F.floor(F.col("score") * 4096 / F.lit(sum(abs(w) for _, w, _ in weights) or 1.0)))
    sizes = cell.groupBy("__c").agg(F.count("*").alias("__n"))
    better = F.coalesce(F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("__c")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("__c").orderBy(F.desc("score"), name))
    placed = cell.withColumn("__r", inside).join(sizes.select("__c", better.alias("__b")), "__c")
    return placed.select(name, "score", (F.col("__b") + F.col("__r")).cast("int").alias("rank"))


def fits(df: DataFrame, tokens: str, limit: int = 1024) -> DataFrame:
    return df.agg(F.count("*").alias("n_docs"), F.sum(tokens).alias("n_tokens"), F.sum((F.col(tokens) <= limit).cast("long")).alias("n_fit"))


def vocabulary_difference(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Entries of one vocabulary that the other lacks."""
    return a.join(b, columns, "left_anti").withColumn("only_in", F.lit("a")).unionByName(b.join(a, columns, "left_anti").withColumn("only_in", F.lit("b")))


def file_digest(spark, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), "length")


def pair_counts(words: DataFrame, word: str, n: str) -> DataFrame:
    """Adjacent symbol pairs weighted by word counts: one counting step of a byte-pair learner, for inspection only."""
    chars = F.split(F.col(word), "")
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(chars) - 1, F.lit(1))), lambda i: F.array_join(F.slice(chars, i, 2), "")))
    return words.where(F.length(word) >= 2).select(pair.alias("pair"), F.col(n)).groupBy("pair").agg(F.sum(n).alias("n"))
