"""Running sums over groups of any size, without bringing a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows a bucket is meant to have, and buckets a group has at most.
BUCKET_ROWS, BUCKETS = 20_000, 4_096


def buckets_for(rows: int) -> int:
    n = 1
    while n < BUCKETS and n * BUCKET_ROWS < rows:
        n *= 2
    return n


def draw(seed: int, *cols: str) -> Column:
    """A pseudo-random long from seed and columns, from 0 to 2^62 - 1."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[F.col(c).cast("string") for c in cols]), 2)


def running(df: DataFrame, group: list[str], amount: str, order: str, ties: list[str], buckets: int, name: str) -> DataFrame:
    """df with the running sum of amount in each group, by order (a draw) and ties.

    Each group is cut into buckets of the draw's range; the sums of the buckets, of which there are at most groups x buckets,
    give where each bucket starts, and only inside a bucket are rows ordered.
    """
    cut = df.withColumn("__bucket", F.floor(F.col(order) / F.lit((1 << 62) / buckets)).cast("int"))
    sums = cut.groupBy(*group, "__bucket").agg(F.sum(amount).alias("__sum"))
    before = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*group, "__bucket", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*group, "__bucket").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    own = cut.withColumn("__own", F.sum(amount).over(inside))
    return own.join(starts, [*group, "__bucket"]).withColumn(name, F.col("__start") + F.col("__own")).drop("__bucket", "__own", "__start")
