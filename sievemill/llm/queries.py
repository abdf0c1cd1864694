"""The pN_ queries; each takes (spark, sf_dir) and reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import leakage, mixture, neardup, pairs, residue, sampling, tokens, truncated


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "synthetic_sft").select(F.lit("synthetic_sft").alias("table_name"), F.col("pair_id").alias("row_id"), F.col("instruction").alias("question"), F.col("output").alias("text"))
    b = table(spark, sf_dir, "verify_results").select(F.lit("verify_results").alias("table_name"), F.col("result_id").alias("row_id"), F.col("prompt").alias("question"), F.col("response").alias("text"))
    return a.unionByName(b)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.defects(_pairs(spark, sf_dir))


def p1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_found(spark, sf_dir).groupBy("table_name", "defect").agg(F.count("*").alias("n_pairs"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    sft = table(spark, sf_dir, "synthetic_sft")
    text = F.concat(F.coalesce("input", F.lit("")), F.lit(" "), F.coalesce("output", F.lit("")))
    links, members = neardup.similar_pairs(sft.select("pair_id", text.alias("whole")), "pair_id", "whole", similarity=0.6, k=3, least_words=30)
    return neardup.id_pairs(links, members).select(F.col("a").alias("pair_id_a"), F.col("b").alias("pair_id_b"))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    sft = table(spark, sf_dir, "synthetic_sft")
    text = F.concat(F.coalesce("input", F.lit("")), F.lit(" "), F.coalesce("output", F.lit("")))
    return neardup.duplicate_groups(sft.select("pair_id", text.alias("whole")), "pair_id", "whole", similarity=0.6, k=3, least_words=30).withColumnRenamed("id", "pair_id")


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers of problem 3, redelivered ones included; source: what the share of cut answers is given for."""
    report, results = table(spark, sf_dir, "model_comparison_report"), table(spark, sf_dir, "verify_results")
    a = report.select(F.lit("model_comparison_report").alias("table_name"), F.col("sample_id").alias("row_id"), F.col("quantization").alias("source"), F.col("scratch_1b_base_response").alias("text"))
    b = results.select(F.lit("verify_results").alias("table_name"), F.col("result_id").alias("row_id"), F.col("model_tag").alias("source"), F.col("response").alias("text"))
    return a.unionByName(b)


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each answer once: redelivered rows have the same text, and lose it before they are brought together."""
    return truncated.judge(_answers(spark, sf_dir), source=["table_name", "source"]).dropDuplicates(["table_name", "row_id"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).where("cut").select("table_name", "row_id")


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut answers by quantization (model_comparison_report) and model_tag (verify_results)."""
    return truncated.rates(_judged(spark, sf_dir), ["table_name", "source"])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    sft, asked = table(spark, sf_dir, "synthetic_sft"), table(spark, sf_dir, "verify_results")
    return leakage.leaks(sft, "pair_id", ["input", "output"], asked, "question_id", "question")


def p4_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which evaluation items leaked, and into how many pairs."""
    return p4_found(spark, sf_dir).groupBy("question_id").agg(F.count("*").alias("n_pairs"))


_SAMPLED = (("model_comparison_report", "sample_id"), ("verify_results", "result_id"))


def _both(spark: SparkSession, sf_dir: str, make) -> DataFrame:
    parts = [make(table(spark, sf_dir, name), key, "category", table(spark, sf_dir, "category_targets")).select(F.lit(name).alias("table_name"), "*") for name, key in _SAMPLED]
    return parts[0].unionByName(parts[1])


def p5_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(spark, sf_dir, sampling.sample)


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(spark, sf_dir, sampling.report)


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text").select("doc_id").distinct()


def p8_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents without residue."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return documents.join(p8_found(spark, sf_dir), "doc_id", "left_anti")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_counts": p1_counts,
    "p2_found": p2_found,
    "p2_groups": p2_groups,
    "p3_found": p3_found,
    "p3_rates": p3_rates,
    "p4_found": p4_found,
    "p4_items": p4_items,
    "p5_sample": p5_sample,
    "p5_report": p5_report,
    "p6_ids": p6_ids,
    "p7_mixture": p7_mixture,
    "p7_report": p7_report,
    "p8_found": p8_found,
    "p8_kept": p8_kept,
}
