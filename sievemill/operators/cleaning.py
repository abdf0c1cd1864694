"""Source-aware cleaning of documents as one chain of column expressions, with rejects on the side.

strict=True keeps two quirks of the original rules: the unanchored phone pattern, which eats trial ids and year ranges, and
abbreviation rules on texts of any language.
"""

from __future__ import annotations

import re
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.words import n_words, once, words

# Patterns of what is removed.
URL = r"https?://\S+|www\.\S+"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z|]{2,}\b"
PHONE_STRICT = r"(\+?\d{1,3}[-. \t\n\r\f]?)?(\(?\d{2,4}\)?[-. \t\n\r\f]?)?\d{3,4}[-. \t\n\r\f]?\d{3,4}"
PHONE = r"(?:\+\d{1,3}[-. ]?)?\(?\d{3}\)?[-. ]\d{3}[-. ]\d{4}\b"
TEMPORAL = (
    r"(?i)\bas\s+of\s+(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{4}\b"
    r"|\blast\s+updated:?\s*[A-Z][a-z]+\s+\d{1,2},?\s*\d{4}\b|\bupcoming\s+.+?\s+on\s+[A-Z][a-z]+\s+\d{1,2}\b"
)
CALL_TO_ACTION = (
    r"(?i)\b(?:donate\s+now|sign\s+up\s+for\s+our\s+newsletter|share\s+this\s+article|subscribe\s+to|click\s+here\s+to|join\s+our\s+mailing\s+list"
    r"|give\s+today|support\s+our\s+cause|make\s+a\s+gift|contribute\s+now)\b"
)
COPYRIGHT = r"(?im)copyright\s*[\x{a9}(c)]?\s*\d{4}.*?(?:\.|$)|all\s+rights\s+reserved\.?|\x{a9}\s*\d{4}.*?(?:\.|$)"
LICENCE = r"(?is)(?:This\s+article\s+is\s+licensed\s+under|Creative\s+Commons).*?(?:\n\n|\z)"
NUMBERED_CITATION = r"\[[\d, \t\n\r\f;\-]+\]"
AUTHOR_CITATION = r"\([A-Z][a-z]+(?:\s+(?:et\s+al\.?|and\s+[A-Z][a-z]+))?,?\s*\d{4}[a-z]?\)"
_HEADS = r"Abstract|Introduction|Methods|Materials\s+and\s+Methods|Results|Discussion|Conclusions?|References|Bibliography"
SECTIONS = (
    r"(?is)\n(?:References|Bibliography|Works\s+Cited|Literature\s+Cited)\s*\n.*",
    rf"(?is)\n(?:Acknowledgments?|Acknowledgements?)\s*\n.*?(?=\n(?:{_HEADS}|Funding|Financial\s+Support|Grant\s+Support)\s*\n|\z)",
    rf"(?is)\n(?:Funding|Financial\s+Support|Grant\s+Support)\s*\n.*?(?=\n(?:{_HEADS}|Acknowledgments?|Acknowledgements?)\s*\n|\z)",
    r"(?is)\nTable\s+\d+\..*?\n\n",
    r"(?ims)^(?:Figure|Fig\.?)\s+\d+.*?(?:\n\n|\n(?=[A-Z])|\z)",
    r"(?im)^(?:Department\s+of|Faculty\s+of|School\s+of|Institute\s+of|Center\s+for|Centre\s+for).*$",
)
TRIAL_STATUS = r"(?im)^(?:Status|Recruitment\s+Status|Overall\s+Status)\s*:.*$"
# Sources and categories the source-aware steps apply to.
SCIENTIFIC_CATEGORIES, SCIENTIFIC_SOURCES, TRIAL_SOURCES = ["research_papers", "biomedical_research"], ["pubmed", "pubmed_abstracts"], ["clinical_trials", "clinicaltrials"]
# Canonical forms of characters.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
HYPHENS, SPACES, ZERO_WIDTH = "‒−", "     　", "​‌‍﻿"
# Canonical form, first-use expansion (or none) and variants of the abbreviations.
ABBREVIATIONS = [
    ("ALS", "amyotrophic lateral sclerosis (ALS)", "ALS|als"),
    ("SOD1", None, r"SOD1|sod1|Cu/Zn\s+SOD"),
    ("FTD", "frontotemporal dementia (FTD)", "FTD|ftd"),
    ("TDP-43", None, "TDP-43|TDP43|tdp-43|tdp43"),
    ("FUS", None, "FUS|fus|FUS/TLS"),
    ("C9orf72", None, "C9orf72|C9ORF72|c9orf72"),
    ("EMG", "electromyography (EMG)", "EMG|emg"),
    ("MND", "motor neuron disease (MND)", "MND|mnd"),
    ("ALSFRS-R", "ALS Functional Rating Scale-Revised (ALSFRS-R)", "ALSFRS-R|ALSFRS|alsfrs-r|alsfrs"),
    ("PLS", "primary lateral sclerosis (PLS)", "PLS|pls"),
    ("UMN", "upper motor neuron (UMN)", "UMN|umn"),
    ("LMN", "lower motor neuron (LMN)", "LMN|lmn"),
]
MIN_WORDS, NEAR = 100, 200


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []

    def handle_data(self, data: str) -> None:
        self.parts.append(data)


def html_to_text(html: str | None) -> str | None:
    """Text nodes joined by line breaks."""
    if html is None or ("<" not in html and "&" not in html):
        return html
    parser = _Text()
    parser.feed(html)
    parser.close()
    return "\n".join(parser.parts)


@F.pandas_udf(T.StringType())
def html_text(html: pd.Series) -> pd.Series:
    return html.map(html_to_text, na_action="ignore")


def fix_unicode(text: str) -> str:
    """Undo UTF-8 read as Latin-1 where that is what the text is, then NFC (not NFKC: meaning stays)."""
    if not text.isascii() and re.search("[ÂÃâ][\u0080-¿]", text):
        try:
            text = text.encode("latin-1").decode("utf-8")
        except UnicodeError:
            pass
    return unicodedata.normalize("NFC", text)


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(fix_unicode, na_action="ignore")


_COMPILED = [(name, full, re.compile(rf"\b(?:{variants})\b", re.I), {re.split(r"[-\\/]", v)[0].lower() for v in variants.split("|")}) for name, full, variants in ABBREVIATIONS]


def expand(text: str) -> str:
    """Each abbreviation in its canonical form; the first use is spelt out unless that stands within the NEAR characters before."""
    low = text.lower()
    for name, full, pattern, starts in _COMPILED:
        if not any(s in low for s in starts):  # what no variant begins with needs no search
            continue
        used = full is None
        pieces, at = [], 0
        for m in pattern.finditer(text):
            pieces.append(text[at : m.start()])
            if used:
                pieces.append(name)
            else:
                before = text[max(0, m.start() - NEAR) : m.start()].lower()
                pieces.append(name if full[: full.rindex(" (")].lower() in before else full)
                used = True
            at = m.end()
        if at:
            text = "".join(pieces) + text[at:]
            low = text.lower()
    return text


@F.pandas_udf(T.StringType())
def abbreviations(text: pd.Series) -> pd.Series:
    return text.map(expand, na_action="ignore")


def strip_sections(text: Column) -> Column:
    for p in SECTIONS:
        text = F.regexp_replace(text, p, "")
    return text


def strip_citations(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, NUMBERED_CITATION, ""), AUTHOR_CITATION, "")


def strip_volatile(text: Column, strict: bool = False) -> Column:
    for p in (URL, EMAIL, PHONE_STRICT if strict else PHONE, TEMPORAL, CALL_TO_ACTION, COPYRIGHT, LICENCE):
        text = F.regexp_replace(text, p, "")
    return text


def strip_trial_status(text: Column) -> Column:
    return F.regexp_replace(text, TRIAL_STATUS, "")


def mask_pii(text: Column) -> Column:
    """Addresses and numbers of persons as marks."""
    text = F.regexp_replace(text, EMAIL, "[EMAIL]")
    text = F.regexp_replace(text, PHONE, "[PHONE]")
    return F.regexp_replace(text, r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "[IP]")


def mask_cards(text: Column) -> Column:
    """Card numbers as a mark: runs of 13 to 19 figures, with single blanks or hyphens between, whose check digit is right."""
    runs = F.regexp_extract_all(text, F.lit(r"[0-9](?:[ -]?[0-9]){12,18}"), F.lit(0))
    cards = F.filter(F.array_distinct(runs), lambda x: F.call_function("luhn_check", F.regexp_replace(x, "[ -]", "")))
    return F.when(text.isNotNull(), F.aggregate(F.coalesce(cards, F.array().cast("array<string>")), text, lambda t, card: F.replace(t, card, F.lit("[CARD]"))))


def canonical_punctuation(text: Column) -> Column:
    for a, b in LIGATURES.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.translate(text, HYPHENS + SPACES + ZERO_WIDTH, "-" * len(HYPHENS) + " " * len(SPACES))


def rejoin_breaks(text: Column) -> Column:
    """Words broken at a hyphen; the hyphen stays."""
    return F.regexp_replace(text, r"([a-z])-\n([a-z])", "$1-$2")


def normal_whitespace(text: Column) -> Column:
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r\f]+", " ")))
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def looks_english(text: Column) -> Column:
    """One of the commonest words among the first 200; a warning, never a reason to reject."""
    return F.arrays_overlap(F.transform(F.slice(words(text), 1, 200), F.lower), F.array(*map(F.lit, ("the", "and", "of", "in"))))


def embed_title(title: Column, text: Column) -> Column:
    return F.when(F.length(F.trim(F.coalesce(title, F.lit("")))) > 0, F.concat(title, F.lit("\n\n"), text)).otherwise(text)


def reject(df: DataFrame, key: str, source: str, stage: str, reason: Column, details: Column | None = None) -> DataFrame:
    """Rows in the shared reject form."""
    kind = T.MapType(T.StringType(), T.StringType())
    return df.select(F.col(key).cast("string").alias("id"), F.col(source).alias("source"), reason.alias("reason"), F.lit(stage).alias("stage"), (details if details is not None else F.create_map()).cast(kind).alias("details"))


def clean(df: DataFrame, key: str = "doc_id", strict: bool = False, with_udfs: bool = True, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): all steps in order over text, source, source_category, title and lang; other columns stay.

    Null and blank texts are rejected as empty_text, short ones as too_short with word_count and threshold. kept has text
    rewritten and word_count.
    """
    text, source = F.col("text"), F.lower(F.coalesce("source", F.lit("")))
    blank = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", "")) == 0
    full = df.where(~blank)
    if with_udfs:
        full = full.withColumn("text", html_text("text"))
    # branches over one text: each step is computed once, whatever its source
    scientific = F.coalesce(F.col("source_category").isin(SCIENTIFIC_CATEGORIES) | source.isin(SCIENTIFIC_SOURCES), F.lit(False))
    full = once(full, "text", strip_volatile(strip_citations(F.when(scientific, strip_sections(text)).otherwise(text)), strict))
    full = once(full, "text", F.when(source.isin(TRIAL_SOURCES), strip_trial_status(text)).when(source == "patient_narratives", mask_cards(mask_pii(text))).otherwise(text))
    full = full.withColumn("title", F.when(source == "patient_narratives", mask_cards(mask_pii(F.col("title")))).otherwise(F.col("title")))
    if with_udfs:
        full = full.withColumn("text", nfc("text"))
    full = once(full, "text", normal_whitespace(rejoin_breaks(canonical_punctuation(text))))
    if with_udfs:
        english = F.lit(True) if strict else F.coalesce(F.lower("lang") == "en", F.lit(False))
        full = once(full, "text", F.when(english, abbreviations("text")).otherwise(text))
    full = full.withColumn("is_english", looks_english(text)).withColumn("text", embed_title(F.col("title"), text))
    full = once(full, "word_count", n_words(text))
    short = F.col("word_count") < min_words
    rejected = reject(df.where(blank), key, "source", "clean", F.lit("empty_text")).unionByName(
        reject(full.where(short), key, "source", "clean", F.lit("too_short"), F.create_map(F.lit("word_count"), F.col("word_count").cast("string"), F.lit("threshold"), F.lit(str(min_words))))
    )
    return full.where(~short), rejected


def survival(before: DataFrame, after: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Per abbreviation: records that had a variant before cleaning, and those of them with the canonical form after it."""
    both = before.select(key, F.col(text).alias("raw")).join(after.select(key, F.col(text).alias("clean")), key)
    found = [F.when(F.col("raw").rlike(rf"(?i)\b(?:{v})\b"), F.struct(F.lit(n).alias("term"), F.contains("clean", F.lit(n)).alias("there"))) for n, _, v in ABBREVIATIONS]
    hits = both.select(F.explode(F.array_compact(F.array(*found))).alias("x"))
    return hits.groupBy("x.term").agg(F.count("*").alias("n_checked"), F.sum(F.col("x.there").cast("long")).alias("n_survived"))


def survival_verdict(survived: DataFrame) -> DataFrame:
    """verdict over the rows of survival: 0 if every term survived, 1 if one was lost, 2 if no record had any term to check."""
    lost, checked = F.sum(F.col("n_checked") - F.col("n_survived")), F.coalesce(F.sum("n_checked"), F.lit(0))
    return survived.agg(checked.alias("n_checked"), F.coalesce(lost, F.lit(0)).alias("n_lost"), F.when(checked == 0, 2).when(lost > 0, 1).otherwise(0).alias("verdict"))
