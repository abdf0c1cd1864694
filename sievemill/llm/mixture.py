"""A mixture of sources at target weights, by weighted fair queueing.

Every document, and every allowed repeat of it after all first passes, stands in a random queue of its source; its virtual
finish time is the queue's tokens up to it, divided by the source's weight. Taken in the order of these times, every prefix
has the target shares as long as all queues last; the mixture is the prefix that fits the token budget.

Where that prefix ends is known but for the length of a few documents: up to a time t the queues hold, source by source, no more
than weight x t tokens and less than the longest document under it. What ends before the time at which that reaches the budget
is in the mixture; what ends after the time at which it exceeds the budget by all longest documents is not, and is never queued.
Only the documents between these times are sorted, and their tokens are at most twice the number of sources times the longest
document's, whatever the size of the corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from ._ranks import buckets_for, draw, running
from .sampling import normal
from .tokens import count_tokens

def _targets(targets: DataFrame) -> list[tuple[str, float, int]]:
    """One row per source: a documented, small table."""
    rows = targets.select(normal("source").alias("source"), "target_share", "max_repeats").where(F.col("source").isNotNull()).collect()
    return [(r["source"], float(r["target_share"] or 0), max(1, int(r["max_repeats"] or 1))) for r in rows]


_SCHEMA = "source string, target_share double, max_repeats int"


def queued(documents: DataFrame, targets: DataFrame, seed: int, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(documents with source and n_tokens, the table of targets); texts without tokens and sources without a target are left out."""
    goal = documents.sparkSession.createDataFrame(_targets(targets), _SCHEMA)
    named = documents.select(F.col(id_col).alias("doc_id"), normal(source_col).alias("source"), F.col(text_col).alias("text"))
    sized = materialize(count_tokens(named, ["doc_id", "source"], "text"), "mixture-sizes")
    once = sized.groupBy("doc_id").agg(F.min(F.struct("source", "n_tokens")).alias("d")).select("doc_id", "d.source", "d.n_tokens")
    return once.where((F.col("n_tokens") > 0) & F.col("source").isNotNull()).join(F.broadcast(goal), "source", "left_semi"), goal


def mix(documents: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 20, **columns: str) -> DataFrame:
    """doc_id, source, repeat_no, n_tokens and virtual_finish of the mixture.

    budget: tokens of the mixture; if not given, those of all documents of the target sources once. A document is repeated
    max_repeats times at most and never before every other of its source has been taken as often. A source that runs out
    leaves its share to the others. An empty table gives an empty mixture; a doc_id counts once.
    """
    sized, goal = queued(documents, targets, seed, **columns)
    held = sized.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"), F.max("n_tokens").alias("longest")).collect()  # a row per target source
    of = {r["source"]: r for r in goal.where("target_share > 0").collect()}
    queues = {r["source"]: (of[r["source"]]["target_share"], int(r["t"]), of[r["source"]]["max_repeats"]) for r in held if r["source"] in of}
    budget = budget if budget is not None else sum(int(r["t"]) for r in held)
    slack = len(queues) * max((int(r["longest"]) for r in held), default=0)
    surely, at_most = finish(queues, budget) * (1 - 1e-9), finish(queues, budget + slack) * (1 + 1e-9)
    # a source's passes as far as they can begin in time, with the tokens of its earlier passes: each pass holds all its documents
    rows = [(s, w, t, min(most, int(min(at_most * w / t, most)) + 1)) for s, (w, t, most) in queues.items()]
    plan = documents.sparkSession.createDataFrame(rows, "source string, target_share double, __all long, __passes int")
    passes = sized.join(F.broadcast(plan), "source").withColumn("repeat_no", F.explode(F.sequence(F.lit(1), "__passes")))
    passes = passes.withColumn("__u", draw(seed, "doc_id", "repeat_no"))
    inside = running(passes, ["source", "repeat_no"], "n_tokens", "__u", ["doc_id"], buckets_for(sum(r["n"] for r in held)), "__in_pass")
    queue = inside.withColumn("virtual_finish", ((F.col("repeat_no") - 1) * F.col("__all") + F.col("__in_pass")) / F.col("target_share"))
    columns_out = ["doc_id", "source", "repeat_no", "n_tokens", "virtual_finish"]
    queue = materialize(queue.where(F.col("virtual_finish") <= at_most).select(columns_out), "mixture-queue")
    whole = queue.where(F.col("virtual_finish") <= surely)
    left = budget - int(whole.agg(F.sum("n_tokens")).first()[0] or 0)
    # bounded: see above
    order = Window.partitionBy(F.lit(0)).orderBy("virtual_finish", "source", "doc_id", "repeat_no").rowsBetween(Window.unboundedPreceding, 0)
    edge = queue.where(F.col("virtual_finish") > surely).withColumn("__sum", F.sum("n_tokens").over(order)).where(F.col("__sum") <= left)
    return whole.unionByName(edge.select(columns_out))


def finish(queues: dict[str, tuple[float, int, int]], tokens: int) -> float:
    """The virtual time at which sources of (weight, tokens of a pass, passes) have given the tokens, or all they have."""
    ends = sorted((t * most / w, w, t * most) for w, t, most in queues.values())
    time, given, weight = 0.0, 0.0, sum(w for _, w, _ in ends)
    for end, w, _ in ends:
        if given + (end - time) * weight >= tokens:
            return time + (tokens - given) / weight
        given, time, weight = given + (end - time) * weight, end, weight - w
    return time


def report(documents: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 20, **columns: str) -> DataFrame:
    """Per source: its target and actual share of the tokens, rows, most repeats, and whether it came within a tenth of its target.

    exhausted: every document of the source is in the mixture as often as it may be, so that others take its share.
    """
    sized, goal = queued(documents, targets, seed, **columns)
    held = sized.groupBy("source").agg(F.count("*").alias("n_documents"))
    got = mix(documents, targets, budget, seed, **columns).groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_rows"), F.max("repeat_no").alias("most_repeats"))
    both = goal.join(got, "source", "left").join(held, "source", "left").na.fill(0, ["tokens", "n_rows", "most_repeats", "n_documents"])
    share = F.col("tokens") / F.greatest(F.sum("tokens").over(Window.partitionBy(F.lit(0))), F.lit(1))  # a row per target source
    met = F.abs(F.col("actual_share") - F.col("target_share")) <= 0.1 * F.col("target_share")
    told = both.withColumn("actual_share", share)
    return told.select("source", "target_share", "actual_share", "max_repeats", "most_repeats", "n_documents", "n_rows", "tokens", met.alias("met"), (F.col("n_rows") == F.col("n_documents") * F.col("max_repeats")).alias("exhausted"))
