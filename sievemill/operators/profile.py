"""Statistics of a corpus and the comparison of two versions of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.words import n_words, words

# Lower bounds of the length classes, in words.
CLASSES = [0, 100, 500, 1000, 5000]


def sized(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("n_words", n_words(text)).withColumn("n_chars", F.coalesce(F.length(text), F.lit(0)).cast("long"))


def by_group(df: DataFrame, group: str, text: str = "text") -> DataFrame:
    """Records, words, characters, estimated tokens (a quarter of the characters) and the group's share of words."""
    one = sized(df, text).groupBy(F.coalesce(F.col(group), F.lit("unknown")).alias(group)).agg(F.count("*").alias("n_docs"), F.sum("n_words").alias("n_words"), F.sum("n_chars").alias("n_chars"))
    total = F.greatest(F.sum("n_words").over(Window.partitionBy()), F.lit(1))
    return one.withColumn("est_tokens", F.floor(F.col("n_chars") / 4)).withColumn("pct_words", 100.0 * F.col("n_words") / total)


def lengths(df: DataFrame, text: str = "text", accuracy: int | None = None) -> DataFrame:
    """Mean, median, least and greatest number of words. accuracy: of an approximate median, whose state does not grow with the data."""
    middle = F.median("n_words") if accuracy is None else F.percentile_approx("n_words", 0.5, accuracy).cast("double")
    return sized(df, text).agg(F.avg("n_words").alias("mean_words"), middle.alias("median_words"), F.min("n_words").alias("min_words"), F.max("n_words").alias("max_words"))


def length_class(n: Column) -> Column:
    out = F.lit(1)
    for i, low in enumerate(CLASSES[1:], 2):
        out = F.when(n >= low, F.lit(i)).otherwise(out)
    return out


def histogram(df: DataFrame, text: str = "text") -> DataFrame:
    """Records per length class, empty classes included."""
    classes = df.sparkSession.range(1, len(CLASSES) + 1).select(F.col("id").cast("int").alias("bucket"))
    return classes.join(sized(df, text).groupBy(length_class(F.col("n_words")).alias("bucket")).agg(F.count("*").alias("n")), "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n_docs"))


def vocabulary(df: DataFrame, text: str = "text") -> DataFrame:
    return df.select(F.explode(words(F.lower(F.col(text)))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def top_words(df: DataFrame, k: int = 100, least_chars: int = 1, text: str = "text") -> DataFrame:
    """The k most frequent words; ties in alphabetical order."""
    return vocabulary(df, text).where(F.length("word") >= least_chars).orderBy(F.desc("n"), "word").limit(k)


def pivot_split(df: DataFrame, group: str) -> DataFrame:
    """Records per group and split, and the share of train."""
    train, val = (F.sum((F.col("split") == s).cast("long")) for s in ("train", "val"))
    return df.groupBy(F.coalesce(F.col(group), F.lit("unknown")).alias(group)).agg(train.alias("n_train"), val.alias("n_val")).withColumn("pct_train", 100.0 * F.col("n_train") / (F.col("n_train") + F.col("n_val")))


def counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(column), F.lit("unknown")).alias(column)).agg(F.count("*").alias("n"))


def compare(old: DataFrame, new: DataFrame, key: str, metric: str) -> DataFrame:
    """Full outer comparison: delta, change in percent, NEW, REMOVED or CHANGED, and a warning for a drop of over a tenth."""
    both = old.select(key, F.col(metric).alias("old")).join(new.select(key, F.col(metric).alias("new")), key, "full_outer")
    a, b = F.coalesce("old", F.lit(0)), F.coalesce("new", F.lit(0))
    status = F.when(F.col("old").isNull(), "NEW").when(F.col("new").isNull(), "REMOVED").otherwise("CHANGED")
    return both.select(key, a.alias("old_value"), b.alias("new_value"), (b - a).alias("delta"), F.when(a != 0, 100.0 * (b - a) / a).alias("pct_delta"), status.alias("status"), F.coalesce((a > 0) & ((a - b) > 0.1 * a), F.lit(False)).alias("regression"))


def delta_text(old: Column, new: Column) -> Column:
    """The change as a reader sees it: a dash for nothing, NEW, or the signed difference with its percentage."""
    diff = new - old
    sign = F.when(diff > 0, "+").otherwise("")
    return F.when((old == 0) & (new == 0), "—").when(old == 0, "NEW").otherwise(F.concat(sign, diff.cast("string"), F.lit(" ("), sign, F.format_number(100.0 * diff / old, 1), F.lit(" %)")))


def points_text(old: Column, new: Column) -> Column:
    """The change of a percentage, in points."""
    return F.concat(F.when(new > old, "+").otherwise(""), F.format_string("%.1f", (new - old).cast("double")), F.lit(" pp"))


def loss_rate(raw: DataFrame, final: DataFrame, group: str) -> DataFrame:
    both = raw.groupBy(group).agg(F.count("*").alias("n_raw")).join(final.groupBy(group).agg(F.count("*").alias("n_final")), group, "left").na.fill(0, ["n_final"])
    return both.withColumn("loss_pct", 100.0 * (F.col("n_raw") - F.col("n_final")) / F.col("n_raw"))


def near_dup_rate(n_near: Column, n_docs: Column, n_rejected: Column) -> Column:
    return F.when(n_docs + n_rejected > 0, n_near / (n_docs + n_rejected)).otherwise(F.lit(0.0))


def size_advice(megabytes: Column) -> Column:
    return F.when(megabytes >= 80, "large").when(megabytes > 32, "medium").otherwise("small")


def parse_number(text: Column) -> Column:
    """1,234 and ~1,234 as numbers; sizes with units in bytes."""
    value = F.replace(F.regexp_extract(text, r"([\d,]+(?:\.\d+)?)", 1), F.lit(","), F.lit(""))
    unit = F.upper(F.regexp_extract(text, r"([KMGT])i?B", 1))
    factor = F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "G", 1e9).when(unit == "T", 1e12).otherwise(1.0)
    return F.when(value != "", value.cast("double") * factor)
