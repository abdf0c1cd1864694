"""Caps, splits and picks in a seeded md5 order: counts are exact, results do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.words import seeded

# Shares of the total that groups may have at most.
CAPS = {"patient_narratives": 0.10, "supplementary": 0.15}


def cap_category(category: Column) -> Column:
    c = F.lower(F.coalesce(category, F.lit("")))
    return F.when(F.contains(c, F.lit("patient")), "patient_narratives").when(c.isin("wikipedia", "supplementary"), "supplementary")


#: Hex digits of the draw by which groups are cut for ranking: 16 to this power parts of each group.
DIGITS = 3


def top_by_draw(df: DataFrame, group: list[str], key: str, seed: int, limit: Column) -> DataFrame:
    """Up to limit rows of each group in seeded order. The order is a sort on an md5; groups are cut by its first hex digits,
    so even a group of most rows is ranked in 4,096 parts whose sizes are added up."""
    cut = df.withColumn("__o", seeded(seed, key)).withColumn("__d", F.substring("__o", 1, DIGITS))
    sizes = cut.groupBy(*group, "__d").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*group).orderBy("__d").rowsBetween(Window.unboundedPreceding, -1)  # at most 4,096 rows a group
    starts = sizes.select(*group, "__d", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__s"))
    inside = Window.partitionBy(*group, "__d").orderBy("__o", key)
    ranked = cut.withColumn("__r", F.row_number().over(inside)).join(starts, [*group, "__d"])
    return ranked.where(F.col("__s") + F.col("__r") <= limit).drop("__o", "__d", "__n", "__s", "__r")


def cap(df: DataFrame, key: str, category: str, seed: int = 42, caps: dict[str, float] | None = None) -> DataFrame:
    """Rows that stay: of each capped group floor(share x rows before capping), the others untouched."""
    caps = caps or CAPS
    marked = df.withColumn("cap_category", cap_category(F.col(category)))
    total = marked.count()
    share = F.coalesce(*[F.when(F.col("cap_category") == k, F.lit(v)) for k, v in caps.items()])
    kept = top_by_draw(marked.where(F.col("cap_category").isNotNull()), ["cap_category"], key, seed, F.floor(F.lit(total) * share))
    return marked.where(F.col("cap_category").isNull()).unionByName(kept)


def split(df: DataFrame, key: str, stratum: str, val_share: float = 0.1, seed: int = 42) -> DataFrame:
    """df with split train or val: ceil(share x rows) val rows allotted to strata by largest remainder; single rows train."""
    rows = df.withColumn("__st", F.coalesce(stratum, F.lit("unknown")))
    sizes = rows.groupBy("__st").agg(F.count("*").alias("__n")).where("__n > 1")
    total = sizes.agg(F.sum("__n")).first()[0] or 0
    wanted = F.ceil(F.lit(total) * val_share)
    exact = wanted * F.col("__n") / F.lit(max(total, 1))
    quota = sizes.select("__st", F.floor(exact).alias("__q"), (exact - F.floor(exact)).alias("__rest"))
    left = quota.agg((F.first(wanted) - F.sum("__q")).cast("int")).first()[0] or 0  # at most one for each stratum
    more = quota.orderBy(F.desc("__rest"), "__st").limit(left).select("__st", F.lit(1).alias("__more"))
    quota = quota.join(more, "__st", "left").select("__st", (F.col("__q") + F.coalesce("__more", F.lit(0))).alias("__quota"))
    val = top_by_draw(rows.join(quota, "__st"), ["__st"], key, seed, F.col("__quota")).select(key, F.lit("val").alias("split"))
    return rows.drop("__st").join(val, key, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def head_split(df: DataFrame, key: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """The first share of the seeded order is train, the rest val."""
    order = seeded(seed, key)
    digits = df.groupBy(F.substring(order, 1, 4).alias("__d")).agg(F.count("*").alias("__n"))  # at most 65,536 rows
    run = Window.orderBy("__d").rowsBetween(Window.unboundedPreceding, 0)
    starts = digits.withColumn("__s", F.sum("__n").over(run) - F.col("__n")).withColumn("__all", F.sum("__n").over(Window.partitionBy()))
    ranked = df.withColumn("__o", order).withColumn("__d", F.substring("__o", 1, 4)).withColumn("__r", F.row_number().over(Window.partitionBy("__d").orderBy("__o", key)))
    placed = ranked.join(F.broadcast(starts), "__d")
    return placed.withColumn("split", F.when(F.col("__s") + F.col("__r") <= F.floor(F.col("__all") * share), "train").otherwise("val")).drop("__o", "__d", "__r", "__n", "__s", "__all")


def one_per_group(df: DataFrame, key: str, group: str, seed: int = 42) -> DataFrame:
    """One row per group, the first in seeded order."""
    first = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.min_by(F.col(key), F.struct(seeded(seed, key), F.col(key))).alias(key))
    return df.join(first, [group, key], "left_semi")
