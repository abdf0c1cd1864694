"""Relational building blocks beyond single built-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the last right row at or before it: one sort of both sides together, no pairs."""
    r = right.select(*by, F.col(right_time).alias("__t"), F.struct(*values).alias("__v"), F.lit(0).alias("__side"))
    base = left.withColumn("__row", F.struct(*left.columns)).select(*by, F.col(left_time).alias("__t"), "__row", F.lit(1).alias("__side"))
    both = base.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("__last", F.last("__v", ignorenulls=True).over(w)).where("__side = 1")
    return filled.select("__row.*", *[F.col(f"__last.{v}").alias(v) for v in values])


def band_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """left rows whose point lies in [low, high] of right rows: an equi-join on cells of the width, then the exact test."""
    a = left.withColumn("__c", F.floor(F.col(point) / width))
    b = right.withColumn("__c", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return a.join(b, "__c").where(F.col(point).between(F.col(low), F.col(high))).drop("__c")


def salted_join(large: DataFrame, small: DataFrame, on: list[str], salts: int = 16, how: str = "inner") -> DataFrame:
    """A join whose hot keys are spread: every small row is there once per salt."""
    if how not in ("inner", "left"):
        raise ValueError("inner and left joins can be salted")
    a = large.withColumn("__s", F.pmod(F.xxhash64(*large.columns), F.lit(salts)).cast("int"))
    b = small.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, [*on, "__s"], how).drop("__s")


def sessions(df: DataFrame, user: str, time: str, gap_seconds: int) -> DataFrame:
    """Rows with the number of their session: a new one after a pause of more than gap_seconds."""
    w = Window.partitionBy(user).orderBy(time)
    at = F.unix_micros(F.col(time).cast("timestamp"))
    pause = at - F.lag(at).over(w)
    return df.withColumn("session_no", F.sum(F.coalesce(pause > gap_seconds * 1_000_000, F.lit(True)).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
