"""Analysis of training logs: ordered events with a type, read tolerantly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def enriched(validation: DataFrame) -> DataFrame:
    """Perplexities capped at 100,000, the gap between losses and its ratio (0 where the training loss is 0)."""
    p = lambda c: F.least(F.exp(c), F.lit(1e5))
    gap = F.col("val_loss") - F.col("train_loss")
    return validation.withColumn("train_perplexity", p("train_loss")).withColumn("val_perplexity", p("val_loss")).withColumn("gap", gap).withColumn("gap_ratio", F.when(F.col("train_loss") != 0, gap / F.col("train_loss")).otherwise(0.0))


def overfit_class(gap_ratio: Column) -> Column:
    return F.when(gap_ratio < -0.02, "Underfitting").when(gap_ratio < 0.02, "Well-fit").when(gap_ratio < 0.10, "Mild overfitting").otherwise("Severe overfitting")


def divergence(validation: DataFrame, run: str, step: str) -> DataFrame:
    """Runs of at least two steps in which validation loss rises while training loss falls; start is the step before."""
    w = Window.partitionBy(run).orderBy(step)
    moved = validation.withColumn("__v", F.col("val_loss") > F.lag("val_loss").over(w)).withColumn("__t", F.col("train_loss") < F.lag("train_loss").over(w)).withColumn("__before", F.lag(step).over(w))
    bad = moved.withColumn("__bad", F.coalesce(F.col("__v") & F.col("__t"), F.lit(False)))
    island = F.row_number().over(w) - F.row_number().over(Window.partitionBy(run, "__bad").orderBy(step))
    return bad.withColumn("__i", island).where("__bad").groupBy(run, "__i").agg(F.min("__before").alias("start_step"), F.max(step).alias("end_step"), F.count("*").alias("n_steps")).where("n_steps >= 2").drop("__i")


def converging(validation: DataFrame, run: str, step: str, least: float = 0.05) -> DataFrame:
    """Whether the last two validation losses still drop by over least; not from a loss of 0."""
    w = Window.partitionBy(run).orderBy(F.desc(step))
    last = validation.withColumn("__r", F.row_number().over(w)).where("__r <= 2").groupBy(run).agg(F.max(F.when(F.col("__r") == 1, F.col("val_loss"))).alias("last"), F.max(F.when(F.col("__r") == 2, F.col("val_loss"))).alias("before"))
    return last.select(run, "before", "last", F.coalesce((F.col("before") - F.col("last")) / F.nullif("before", F.lit(0.0)) > least, F.lit(False)).alias("still_improving"))


def resources(df: DataFrame, columns: list[str]) -> DataFrame:
    """Peak, mean and least of each measure, one row per measure."""
    long = df.unpivot([], columns, "measure", "value")
    return long.groupBy("measure").agg(F.max("value").alias("peak"), F.avg("value").alias("mean"), F.min("value").alias("least"))


def run_summary(df: DataFrame, run: str, step: str, loss: str) -> DataFrame:
    """Last step, loss at it and best loss with its step."""
    return df.groupBy(run).agg(F.max(step).alias("last_step"), F.max_by(loss, step).alias("last_loss"), F.min(loss).alias("best_loss"), F.min_by(step, F.struct(F.col(loss), F.col(step))).alias("best_step"))


def distinct_losses(df: DataFrame, run: str, step: str, loss: str, apart: float = 1e-8) -> DataFrame:
    """run, step and loss of the rows whose loss differs by apart or more from that of the step before: repeated log lines count once."""
    before = F.lag(loss).over(Window.partitionBy(run).orderBy(step))
    return df.where(F.col(loss).isNotNull()).withColumn("__b", before).where(F.col("__b").isNull() | (F.abs(F.col(loss) - F.col("__b")) >= apart)).select(run, step, loss)


def continuity(df: DataFrame, order: str, step: str, rate: str, is_resume: Column, tolerance: float = 1e-5) -> DataFrame:
    """Steps logged before and again after a resume, and whether their rates agree. Segments come from sums over ranges of order."""
    g = F.floor(F.col(order) / 10_000)
    marked = df.withColumn("__m", is_resume.cast("int")).withColumn("__g", g)
    starts = marked.groupBy("__g").agg(F.sum("__m").alias("s")).withColumn("__start", F.coalesce(F.sum("s").over(Window.orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__g", "__start")
    inside = F.sum("__m").over(Window.partitionBy("__g").orderBy(order))
    seg = marked.withColumn("__in", inside).join(F.broadcast(starts), "__g").withColumn("segment", F.col("__start") + F.col("__in")).where("__m = 0")
    a = seg.groupBy("segment", step).agg(F.max_by(rate, order).alias("rate_before"))
    b = seg.groupBy("segment", step).agg(F.min_by(rate, order).alias("rate_after")).withColumn("segment", F.col("segment") - 1)
    off = F.abs(F.col("rate_after") - F.col("rate_before")) / F.greatest(F.abs("rate_before"), F.lit(1e-30))
    return a.join(b, ["segment", step]).withColumn("agrees", off <= tolerance)


def continuity_across(df: DataFrame, order: str, rate: str, is_resume: Column, tolerance: float = 0.10) -> DataFrame:
    """Each resume with the last rate before it and the first after it, and whether they agree within the wider tolerance, for logs
    that repeat no step. Rows are cut into ranges of order, so that no log is sorted in one task."""
    g = F.floor(F.col(order) / 10_000)
    rows = df.select(F.col(order).alias("o"), F.col(rate).alias("r"), is_resume.alias("m"), g.alias("g"))
    w = Window.partitionBy("g").orderBy("o")
    at = F.when(~F.col("m"), F.struct("o", "r"))
    near = rows.withColumn("before", F.last(at, True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("after", F.first(at, True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    # a range's own ends, for resumes at the edge of one: as many rows as there are ranges
    ends = rows.where("NOT m").groupBy("g").agg(F.max(F.struct("o", "r")).alias("last"), F.min(F.struct("o", "r")).alias("first"))
    v = Window.partitionBy(F.lit(0)).orderBy("g")
    beside = rows.select("g").distinct().join(ends, "g", "left").select("g", F.last("last", True).over(v.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"), F.first("first", True).over(v.rowsBetween(1, Window.unboundedFollowing)).alias("later"))
    told = near.where("m").join(beside, "g").select(F.col("o").alias(order), F.coalesce("before", "earlier")["r"].alias("rate_before"), F.coalesce("after", "later")["r"].alias("rate_after"))
    off = F.when(F.col("rate_before") == 0, F.abs("rate_after")).otherwise(F.abs(F.col("rate_after") - F.col("rate_before")) / F.abs("rate_before"))
    return told.withColumn("agrees", F.coalesce(off <= tolerance, F.lit(False)))


def coverage(df: DataFrame, columns: list[str], least: float = 0.9) -> DataFrame:
    """Share of rows in which each field is there."""
    one = df.agg(F.count("*").alias("n"), *[F.count(c).alias(c) for c in columns])
    return one.unpivot(["n"], columns, "field", "n_present").withColumn("is_covered", F.col("n_present") >= least * F.col("n"))


def completed(df: DataFrame, run: str, step: str, expected: Column, tolerance: int = 15) -> DataFrame:
    return df.groupBy(run).agg(F.max(step).alias("last_step"), F.max(expected).alias("expected")).withColumn("is_complete", F.col("expected") - F.col("last_step") <= tolerance)


def projection(df: DataFrame, tokens: str, rate: str, epochs: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """Hours for so many epochs at a rate of tokens a second."""
    return df.select("*", *[(F.col(tokens) * e / F.col(rate) / 3600.0).alias(f"hours_{e}") for e in epochs])


def epochs(df: DataFrame, step: str, per_epoch: int) -> DataFrame:
    return df.groupBy(F.floor(F.col(step) / per_epoch).alias("epoch")).agg(F.count("*").alias("n_steps"), F.min(step).alias("first_step"), F.max(step).alias("last_step"))
