"""The library's Python functions as SQL functions, and the place to add one's own."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators.cleaning import abbreviations, html_text, nfc
from .fuzzy import partial_ratio_80_udf, ratio_udf

#: Name in SQL and vectorised function; further ones may be added before register is called.
FUNCTIONS = {"fuzzy_ratio": ratio_udf, "fuzzy_partial_80": partial_ratio_80_udf, "nfc_text": nfc, "html_to_text": html_text, "expand_abbreviations": abbreviations}


def register(spark: SparkSession, more: dict | None = None) -> list[str]:
    """Register all functions with the session; returns their names. more: further pandas UDFs by name."""
    for name, function in (FUNCTIONS | (more or {})).items():
        spark.udf.register(name, function)
    return sorted(FUNCTIONS | (more or {}))
