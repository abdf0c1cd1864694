"""Column expressions for words, orders and shares that have the same meaning in other engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space between words: the ASCII kinds that every regex dialect agrees on.
BLANK = r"[ \t\n\r\f]+"


def words(text: Column | str) -> Column:
    """Words between white space; null text has none."""
    col = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(col, F.lit("")), BLANK), lambda w: w != "")


def n_words(text: Column | str) -> Column:
    return F.size(words(text)).cast("long")


def seeded(seed: int | str, *cols: Column | str) -> Column:
    """A pseudo-random but reproducible order: md5 of the seed and the key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]))


def uniform(seed: int | str, *cols: Column | str) -> Column:
    """A number in [0, 1) from the same order."""
    return F.conv(F.substring(seeded(seed, *cols), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def occurrences(text: Column, part: Column) -> Column:
    """How often part occurs in text, without overlaps."""
    return F.when(F.length(part) > 0, ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("long")).otherwise(F.lit(0))


def sentences(text: Column) -> Column:
    """Sentences: split after . ! or ? before white space."""
    return F.filter(F.split(F.regexp_replace(text, r"([.!?])[ \t\n\r\f]+", "$1\u0001"), "\u0001"), lambda s: F.trim(s) != "")


def let(value: Column, use) -> Column:
    """use(value) with the value computed once per row, also where it stands inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with the column computed once per row, however often later expressions name it: they are not merged into a generator."""
    return df.withColumn(name, F.explode(F.array(value)))


def runs(w: Column, k: int) -> Column:
    """Runs of k consecutive words, joined by blanks; none if there are fewer words."""
    return let(w, lambda x: F.when(F.size(x) >= k, F.transform(F.sequence(F.lit(1), F.greatest(F.size(x) - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(x, i, k), " "))).otherwise(F.array().cast("array<string>")))
