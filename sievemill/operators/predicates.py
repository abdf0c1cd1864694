"""Scalar checks of responses and pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.words import n_words, runs, words


def coherent(text: Column, least_chars: int = 10, at_least: bool = True) -> Column:
    """False for blank, short, stuttering, looping or mostly symbolic text. least_chars: >= if at_least, else > it."""
    plain = F.trim(F.coalesce(text, F.lit("")))
    long_enough = F.length(plain) >= least_chars if at_least else F.length(plain) > least_chars
    spread = F.regexp_replace(F.lower(plain), r"[,;\-]+", " ")
    stutter = F.lower(plain).rlike(r"\b(\w+)(?:\s+\1\b){5,}") | spread.rlike(r"\b(\w+)(?:\s+\1\b){5,}")
    return long_enough & ~stutter & ~plain.rlike(r"(\S{2,10})\1{4,}") & native_coherent(text)


def native_coherent(text: Column) -> Column:
    """The part of the check without back-references: no word trigram four times or more, letters and digits at least a fifth."""
    plain = F.trim(F.coalesce(text, F.lit("")))
    w = words(F.lower(plain))
    most = F.aggregate(F.array_sort(runs(w, 3)), F.struct(F.lit("").alias("g"), F.lit(0).alias("n"), F.lit(0).alias("m")), _longest_run, lambda s: s["m"])
    share = F.length(F.regexp_replace(plain, r"[^A-Za-z0-9]", "")) / F.greatest(F.length(plain), F.lit(1))
    return (F.length(plain) > 0) & ~((F.size(w) >= 6) & (most >= 4)) & (share >= 0.2)


def _longest_run(state: Column, gram: Column) -> Column:
    n = F.when(state["g"] == gram, state["n"] + 1).otherwise(F.lit(1))
    return F.struct(gram.alias("g"), n.alias("n"), F.greatest(state["m"], n).alias("m"))


def pair_format(instruction: Column, output: Column, least: int = 10, most: int = 200) -> Column:
    """Both present and not blank, the output of 10 to 200 words."""
    return F.coalesce((F.length(F.trim(instruction)) > 0) & n_words(output).between(least, most), F.lit(False))


def reference_heavy(text: Column) -> Column:
    return F.coalesce((F.regexp_count(text, F.lit(r"et al\.")) > 3) | (F.regexp_count(text, F.lit(r"\[\d+\]")) > 5), F.lit(False))


def topic(text: Column, keywords: list[str]) -> Column:
    """One of the keywords from a word start on; those of up to four letters as whole words."""
    parts = "|".join(k + (r"\b" if len(k) <= 4 else "") for k in keywords)
    return F.coalesce(text.rlike(rf"(?i)\b(?:{parts})"), F.lit(False))


def verdict(passed: Column, total: Column, least: float = 0.7) -> Column:
    return F.when((total > 0) & (passed / total >= least), "PASS").otherwise("FAIL")
