"""Passages for instruction data: scoring by keywords, sliding windows, drafts and their quality."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.words import n_words, occurrences, once, seeded, sentences, uniform
from .predicates import reference_heavy

# Keywords by topic.
KEYWORDS = {
    "diagnosis": ["diagnosis", "diagnosed", "diagnostic", "el escorial", "electromyography", "emg", "nerve conduction", "clinical criteria", "differential diagnosis", "biomarker", "mri", "lumbar puncture"],
    "symptoms": ["symptom", "weakness", "fasciculation", "dysarthria", "dysphagia", "spasticity", "muscle atrophy", "bulbar", "limb onset", "respiratory", "progression", "cramping", "hyperreflexia"],
    "genetics": ["gene", "mutation", "sod1", "c9orf72", "fus", "tardbp", "tdp-43", "familial", "hereditary", "genetic", "repeat expansion", "chromosome", "autosomal"],
    "treatment": ["treatment", "therapy", "riluzole", "edaravone", "drug", "clinical trial", "therapeutic", "neuroprotective", "antisense oligonucleotide", "tofersen", "pharmacological"],
    "clinical_trials": ["clinical trial", "randomized", "placebo", "phase ii", "phase iii", "endpoint", "alsfrs", "enrollment", "efficacy", "nct", "double-blind", "multicenter"],
    "epidemiology": ["incidence", "prevalence", "epidemiol", "risk factor", "mortality", "survival", "age of onset", "population", "male female ratio", "geographic", "demographic"],
    "pathophysiology": ["pathophysiol", "mechanism", "excitotoxicity", "glutamate", "oxidative stress", "protein aggregation", "motor neuron", "neurodegeneration", "mitochondr", "autophagy", "apoptosis"],
    "patient_care": ["care", "ventilation", "nutrition", "gastrostomy", "palliative", "multidisciplinary", "quality of life", "caregiver", "rehabilitation", "non-invasive ventilation", "hospice"],
}
TYPES = [("factual", 0.40), ("explanatory", 0.70), ("comparative", 0.85), ("clinical", 1.0)]


def keyword_scores(df: DataFrame, key: str, text: str) -> DataFrame:
    """Per record and topic the sum of keyword occurrences, where above zero; one pass per record over a fixed list."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    pairs = F.array(*[F.struct(F.lit(c).alias("category"), sum((occurrences(low, F.lit(k)) for k in ks), F.lit(0)).alias("score")) for c, ks in KEYWORDS.items()])
    return df.select(F.col(key), F.explode(pairs).alias("x")).select(key, "x.category", F.col("x.score").cast("long").alias("score")).where("score > 0")


def top_records(scores: DataFrame, key: str, k: int = 10) -> DataFrame:
    """The k best records of each topic: Spark keeps k per partition before the shuffle."""
    w = Window.partitionBy("category").orderBy(F.desc("score"), key)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def passages(df: DataFrame, key: str, text: str, size: int = 400, step: int = 300, least: int = 200, least_words: int = 50, keywords: list[str] | None = None) -> DataFrame:
    """Windows cut back to their last blank if that lies beyond half; texts of up to 500 characters as a whole.

    Passages must be long enough, not full of references, and hold a keyword: by default one of any topic.
    """
    keywords = keywords if keywords is not None else sorted({k for ks in KEYWORDS.values() for k in ks})
    t = F.coalesce(F.col(text), F.lit(""))
    starts = F.when(F.length(t) <= 500, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(F.length(t) - 1, F.lit(0)), F.lit(step)))
    cut = df.select(F.col(key), t.alias("t"), F.explode(starts).alias("start"))
    raw = F.when(F.length("t") <= 500, F.col("t")).otherwise(F.substring(F.col("t"), F.col("start") + 1, F.lit(size)))
    last = F.length(F.col("raw")) - F.instr(F.reverse("raw"), " ")
    open_end = (F.length("t") > 500) & (F.col("start") + size < F.length("t")) & (F.instr("raw", " ") > 0) & (last > size / 2)
    body = F.trim(F.when(open_end, F.substring(F.col("raw"), F.lit(1), last)).otherwise(F.col("raw")))
    out = once(once(cut, "raw", raw), "passage", body)
    on_topic = F.lower("passage").rlike("|".join(map(re.escape, keywords))) if keywords else F.lit(True)
    return out.where(on_topic & (F.length("passage") >= least) & (n_words("passage") >= least_words) & ~reference_heavy(F.col("passage"))).select(key, "start", "passage")


def question_type(seed: int, key: str) -> Column:
    """A draw of 40, 30, 15 and 15 in a hundred."""
    u = uniform(seed, key)
    out = F.lit(TYPES[-1][0])
    for name, end in reversed(TYPES[:-1]):
        out = F.when(u < end, name).otherwise(out)
    return out


def input_excerpt(text: Column, seed: int, key: str, share: float = 0.2, most: int = 150) -> Column:
    """For a share of the records the first sentence, at most 150 characters with a mark; else nothing."""
    first = F.coalesce(F.get(sentences(text), F.lit(0)), F.lit(""))
    return F.when(uniform(seed, key) < share, F.when(F.length(first) > most, F.concat(F.substring(first, 1, most - 3), F.lit("..."))).otherwise(first)).otherwise(F.lit(""))


def drafts(df: DataFrame, key: str, text: str, seed: int = 42, limit: int | None = None) -> DataFrame:
    """Prompts for passages in seeded order; limit, if given, is the number asked for."""
    out = df.withColumn("question_type", question_type(seed, key)).withColumn("input", input_excerpt(F.col(text), seed + 1, key))
    out = out.withColumn("prompt", F.format_string("Write one %s question and its answer from this passage only.\n\n%s", "question_type", text))
    return out.orderBy(seeded(seed, key), key).limit(limit) if limit is not None else out


# Abbreviations whose stop ends no sentence.
ABBREVIATIONS = ["Dr.", "Mr.", "Ms.", "Mrs.", "Prof.", "Jr.", "Sr.", "vs.", "et al.", "e.g.", "i.e.", "Fig.", "No.", "Vol."]


def n_sentences(text: Column) -> Column:
    """Sentences by stops before white space, those of abbreviations not counted; at least one."""
    safe = F.coalesce(text, F.lit(""))
    for x in ABBREVIATIONS:
        safe = F.replace(safe, F.lit(x), F.lit(x.replace(".", "\u0002")))
    return F.greatest(F.size(F.filter(F.split(F.regexp_replace(safe, r"[.][ \t\n\r\f]+", "\u0001"), "\u0001"), lambda s: F.trim(s) != "")), F.lit(1)).cast("long")


def quality(df: DataFrame, category: Column, output: Column, target: int = 250, thin: int = 50) -> DataFrame:
    """Per category: pairs, shortfall against the target, thinness, and words and sentences of the outputs."""
    rows = df.select(F.coalesce(category, F.lit("unknown")).alias("category"), n_words(output).alias("w"), n_sentences(output).alias("s"))
    return rows.groupBy("category").agg(
        F.count("*").alias("n_pairs"), F.greatest(F.lit(target) - F.count("*"), F.lit(0)).alias("shortfall"), (F.count("*") < thin).alias("is_thin"),
        F.sum("w").alias("n_words"), F.min("w").alias("min_words"), F.max("w").alias("max_words"), F.sum("s").alias("n_sentences"),
    )


def type_shares(df: DataFrame, kind: Column) -> DataFrame:
    """Pairs by question type, and their percentage with one decimal."""
    one = df.groupBy(F.coalesce(kind, F.lit("unknown")).alias("question_type")).agg(F.count("*").alias("n"))
    return one.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 1))  # a row per type
