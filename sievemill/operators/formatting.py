"""Instruction pairs as prompts, chats and fixed blocks of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.words import words

# The two prompt templates.
WITH_INPUT = "Below is an instruction that describes a task, paired with an input that provides further context. Write a response that appropriately completes the request.\n\n### Instruction:\n%s\n\n### Input:\n%s\n\n### Response:\n"
WITHOUT_INPUT = "Below is an instruction that describes a task. Write a response that appropriately completes the request.\n\n### Instruction:\n%s\n\n### Response:\n"
IGNORED = -100


def prompt(instruction: Column, input_: Column) -> Column:
    """The template with input if there is one, else without; null counts as empty."""
    i, x = F.coalesce(instruction, F.lit("")), F.coalesce(input_, F.lit(""))
    return F.when(F.trim(x) != "", F.format_string(WITH_INPUT, i, x)).otherwise(F.format_string(WITHOUT_INPUT, i))


def chat(system: str, instruction: Column, input_: Column, output: Column) -> Column:
    user = F.when(F.trim(F.coalesce(input_, F.lit(""))) != "", F.concat(instruction, F.lit("\n\nContext: "), input_)).otherwise(instruction)
    return F.array(*[F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in (("system", F.lit(system)), ("user", user), ("assistant", output))])


def split_at_last(text: Column, tag: str) -> tuple[Column, Column]:
    """(up to and with the last tag, what follows it); without a tag, all is prompt."""
    after = F.length(F.substring_index(text, tag, -1))
    has = F.contains(text, F.lit(tag))
    return F.when(has, F.substring(text, F.lit(1), F.length(text) - after)).otherwise(text), F.when(has, F.substring_index(text, tag, -1)).otherwise(F.lit(""))


def masked(prompt_ids: Column, output_ids: Column, block: int, pad: int = 0) -> tuple[Column, Column]:
    """(ids, labels) of exactly block places, the prompt and the padding not counted as labels; null if too long."""
    n = F.size(prompt_ids) + F.size(output_ids)
    room = F.greatest(F.lit(block) - n, F.lit(0))
    ids = F.concat(prompt_ids, output_ids, F.array_repeat(F.lit(pad), room))
    labels = F.concat(F.array_repeat(F.lit(IGNORED), F.size(prompt_ids)), output_ids, F.array_repeat(F.lit(IGNORED), room))
    return F.when(n <= block, ids), F.when(n <= block, labels)


def word_ids(text: Column, size: int = 50_000) -> Column:
    """A stand-in tokenizer: words hashed to ids."""
    return F.transform(words(text), lambda w: (F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("long") % size).cast("int"))


def pack(df: DataFrame, order: str, ids: str, block: int) -> DataFrame:
    """Blocks of exactly block tokens of the whole sequence in order; the last, shorter one is left out.

    Where each record starts comes from sums over ranges of records, so no task holds the sequence.
    """
    sized = df.select(order, ids, F.size(ids).cast("long").alias("n")).withColumn("__g", F.floor(F.col(order) / 1000))
    sums = sized.groupBy("__g").agg(F.sum("n").alias("s"))
    starts = sums.withColumn("__start", F.coalesce(F.sum("s").over(Window.orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__g", "__start")
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("__g").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sized.withColumn("__in", inside).join(starts, "__g").select(F.posexplode(ids).alias("p", "id"), (F.col("__start") + F.col("__in")).alias("at"))
    token = placed.select(F.floor((F.col("at") + F.col("p")) / block).alias("block"), ((F.col("at") + F.col("p")) % block).alias("place"), "id")
    whole = token.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("ids"))  # a group has block rows
    return whole.where(F.size("ids") == block)


def percentiles(df: DataFrame, n: str, limit: int, accuracy: int | None = None) -> DataFrame:
    """Interpolated percentiles of a count, and how many exceed the limit; accuracy: of approximate ones, whose state does not grow with the data."""
    q = [(F.percentile(n, F.lit(p)) if accuracy is None else F.percentile_approx(n, p, accuracy)).cast("double").alias(f"p{int(p * 100)}") for p in (0.9, 0.95, 0.99)]
    return df.agg(F.min(n).alias("min_tokens"), F.avg(n).alias("avg_tokens"), F.max(n).alias("max_tokens"), *q, F.sum((F.col(n) > limit).cast("long")).alias("n_over"))
