"""The corpus pipeline: clean, remove near duplicates and repeated paragraphs, cap, split, profile."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cleaning, dedup, profile, sampling
from ..session import materialize


@dataclass
class Result:
    kept: DataFrame
    rejected: DataFrame
    profile: DataFrame


def run(df: DataFrame, key: str = "doc_id", seed: int = 42, strict: bool = False, with_udfs: bool = True, separator: str = "\n\n", least_words: int = 50) -> Result:
    """kept has split train or val; rejected holds every lost record once with stage and reason. Keys must be unique and not null."""
    cleaned, rejects = cleaning.clean(df, key, strict, with_udfs)
    cleaned = materialize(cleaned, "cleaned")
    kept = dedup.near(cleaned, key, "text")
    unique = cleaned.join(kept, key, "left_semi")
    near = cleaning.reject(cleaned.join(kept, key, "left_anti"), key, "source", "dedup", F.lit("near_duplicate"))
    parts, lost = dedup.paragraphs(unique, key, "text", separator, least_words)
    rebuilt = materialize(unique.drop("text", "word_count").join(parts.select(key, "text", "word_count"), key), "unique")
    repeated = cleaning.reject(unique.join(lost, key, "left_semi"), key, "source", "dedup", F.lit("all_paragraphs_duplicate"))
    capped = sampling.cap(rebuilt, key, "source_category", seed).drop("cap_category")
    over = cleaning.reject(rebuilt.join(capped.select(key), key, "left_anti"), key, "source", "split", F.lit("source_cap"))
    divided = sampling.split(capped, key, "source_category", seed=seed)
    train, val = divided.where("split = 'train'"), divided.where("split = 'val'")
    leaks = dedup.cross_leaks(train, val, key, "text")
    leaked = cleaning.reject(val.join(leaks, key, "left_semi"), key, "source", "split", F.lit("leaks_into_train"))
    final = materialize(divided.join(leaks, key, "left_anti"), "final")
    rejected = rejects.unionByName(near).unionByName(repeated).unionByName(over).unionByName(leaked)
    return Result(final, rejected, profile.by_group(final, "source_category"))
