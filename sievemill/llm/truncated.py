"""Texts cut off by a field limit or in transfer.

One pass gathers what the corpus knows: the words that values hold before their last one, the items of lists before the last
one, and after which words sentences end on a whole number and after which ones decimals come. The words and items form prefix
tables, the distributed form of a vocabulary trie: a last word or a last item is broken off if it is unknown and a proper prefix
of something known. A second pass looks at how each value ends and how long it is; lengths at which the unfinished values of a
source pile up are its limits. Ending, trie and limit decide together:

* an open mark of a cut, such as an ellipsis or half a tag, is a cut;
* a value that stops without a full stop is cut, but a mere label of a few words only if its last word is broken or it stands at
  a limit;
* an item of a list is cut if it or its last word is broken, or if it is unknown and stands at a limit;
* a value that ends on a full stop is cut if its last word is broken and it stands at a limit, the stop having been appended.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Entries a task holds before it passes its counts on.
HELD = 200_000
#: Words a label has at most; letters of a last word that tell something before a full stop.
LABEL, LETTERS = 4, 3
#: A length is a limit of its source if so many unfinished values have it, and one in so many of them.
LIMIT, LIMIT_SHARE = 5, 20
#: Parts into which the values of one last word are dealt.
PARTS = 8

# Answers that stand for no answer, and lines of a test harness.
PLACEHOLDER = re.compile(
    r"^[\W_]*(?:n/?a|null|none|nil|nan|undefined|empty|blank|tbd|tba|todo|placeholder|unknown|no (?:answer|response|output|data|content)|not (?:available|applicable)"
    r"|(?:#+ *)?(?:response|answer|output|assistant|instruction|input)|(?:#+ *)?(?:instruction|input):?[\W_]*(?:#+ *)?response)?[\W_]*$",
    re.I,
)
HARNESS = re.compile(
    r"^[\W_]*(?:ollama|openai|vllm|llama|api|http|https|server|request|connection|runtime|value|timeout|cuda|generation|internal|traceback|harness|model)?[ _-]*(?:error|timeout|exception|failed|failure)\b"
    r"\s*(?:$|[:\]!.,(–—-]|\d|(?:code|after|while|in|at|from|to|with|occurred|because)\b)[^\n]*$", re.I
)
EMPTY_MARKUP = re.compile(r"<[^<>\n]{1,60}>|&(?:nbsp|#160|#8203|zwnj);|[​-‏⁠﻿­]")

# What a transfer may append where it cut, and what may follow a complete sentence.
CUT_MARK = re.compile(
    r"(?:…|\.{2,}|\[\s*(?:\.{2,}|…)\s*\]|<\s*(?:\.{2,}|…)\s*>|\(\s*(?:\.{2,}|…)\s*\)|[\[(<{](?:truncated|cut(?: off)?|more|continued|cont\.?|snip|output truncated|max(?:imum)? (?:tokens|length)[^\])>}]{0,20}|read more)[\])>}]|read more|-->)$", re.I
)
BROKEN = re.compile(r"(?:&#?\w{0,8}|<[/!]?[A-Za-z][^<>\s]{0,30}(?:\s[^<>]{0,80})?|\\u[0-9a-fA-F]{0,3}|\\|�+|%[0-9A-Fa-f]?)$")
END_MARK = re.compile(r"(?:</?(?:s|p|div|br|answer|response|end|eos)\s*/?>|<\|[^|<>]{1,30}\|>|\[(?:END|EOS|DONE|/INST)\]|###|---|\*\*\*)$", re.I)
QUOTES = "\"'”’»*_`"
STOP = ".!?。！？؟।"
ITEM = re.compile(r"^\s*(?:[-*•–·]|\(?\d{1,3}[.)]|\(?[a-z][.)])\s+(.*\S)\s*$")
# Abbreviations that never end a sentence.
ABBREVIATION = re.compile(r"(?:^|[\s(\[])(?:e\.g|i\.e|cf|vs|viz|approx|ca|fig|figs|no|nos|dr|prof|mr|mrs|ms|st|p|pp|vol|ed|eds|ref|eq|sec|resp|incl|bzw|z\.b|d\.h|p\.ej|ex|c)\.$", re.I)
#: A number after a word or sign that asks for more, or a lone zero: a decimal cut at its point.
_HALF = re.compile(r"(?:[<>=≤≥±~]|\b(?:from|between))\s*\d+\.$|(?<![\w.,])0\.$")


def is_blank(text: str | None) -> bool:
    """Null, blank, punctuation or empty markup only, a placeholder word or a harness error line."""
    if text is None:
        return True
    bare = (text if text.isascii() and "<" not in text and "&" not in text else EMPTY_MARKUP.sub(" ", text)).strip()
    return not any(c.isalnum() for c in bare) or bool(PLACEHOLDER.match(bare)) or bool(HARNESS.match(bare))


def _without_end_marks(s: str) -> str:
    s = s.rstrip()
    while s and s[-1] in ">]#-*" and (m := END_MARK.search(s[-40:])) is not None:
        s = s[: len(s) - len(m.group(0))].rstrip()
    return s


def _tail(s: str) -> tuple[str, bool]:
    """The text without marks that tell of a cut, and whether there were any."""
    marked = False
    while s and (s[-1] in "…)]>}" or s.endswith("..") or s[-4:].lower() == "more") and (m := CUT_MARK.search(s[-40:])) is not None:
        s, marked = s[: len(s) - len(m.group(0))].rstrip(), True
    return s, marked


def _without_closers(s: str) -> str:
    """The text without quotes, references and short remarks in brackets at its end."""
    while s:
        last = s[-1]
        if last in QUOTES:
            s = s[:-1].rstrip()
        elif last in ")]":
            at = s.rfind("(" if last == ")" else "[", max(0, len(s) - 62))
            if at < 0 or "\n" in s[at:]:
                return s
            s = s[:at].rstrip()
        else:
            return s
    return s


def _number_key(text: str) -> str:
    """The two tokens before the last one, without their figures."""
    return _masked(" ".join(text.split()[-3:-1]))


def _masked(tokens: str) -> str:
    return re.sub(r"\d+", "9", " ".join(tokens.lower().split()))


_LAST = re.compile(r"[^\W\d_]+$")
_LOOP = re.compile(r"(.{1,30}?)\1{3,}")


def _is_label(s: str) -> bool:
    """A few words without a sentence, a comma or a loop."""
    words = s.split(None, LABEL)
    return len(words) <= LABEL and not any(c in s for c in STOP + ",;:\n") and max(map(len, words)) <= 40 and len({*words}) * 2 > len(words) and _LOOP.search(s) is None


def ending(text: str | None) -> tuple[str, str]:
    """What the end of a value says: ('whole', last word before a full stop, if it tells something), ('cut', ''),
    ('item', item), ('number', key), ('word', last word) or ('label', last word).

    'item': it ends on a list item, whole if the item is; 'number': on a stop after a whole number or a letter, whole
    unless what stands before it takes decimals and never ends a sentence; 'word': without a stop; 'label': so, and it is but
    a few words.
    """
    if is_blank(text):
        return "whole", ""
    s = _without_end_marks(text)
    if not s:
        return "whole", ""
    s, marked = _tail(s)
    if not s:
        return "cut", ""
    line = s[s.rfind("\n") + 1 :]
    item = ITEM.match(line)
    last = s[-1]
    if last in STOP:
        if last == "." and ABBREVIATION.search(s[-14:]):
            return "cut", ""
        if last == "." and not marked and (last_token := s[-40:].split()[-1][:-1]):
            token = last_token.strip("([\"'")
            # an integer that may be half of a decimal, or a token too short for a word
            if _HALF.search(s[-60:]):
                return "cut", ""
            if token.isdigit() or (len(token) == 1 and token.isascii() and token.isalpha()):
                return "number", _number_key(s[-200:])
            inside = s[s.rfind("(") :] if "(" in s[-80:] else ""
            if inside and ")" not in inside and len(inside) < 80 and re.match(r"\((?:n|95|see|mean|fig|table|ref|p|range|median|about|age)", inside, re.I):
                return "cut", ""
        word = _LAST.search(s[-60:-1])
        return "whole", word.group(0).lower() if word is not None and len(word.group(0)) >= LETTERS and not marked else ""
    body = _without_closers(s)
    if body != s and body and body[-1] in STOP:
        return "whole", ""
    if marked or BROKEN.search(s[-40:]) is not None:
        return "cut", ""
    if item is not None:
        return "item", item.group(1).lower()
    word = _LAST.search(s[-60:])
    if word is None:
        return "cut", ""
    return "label" if _is_label(s) else "word", word.group(0).lower()


#: A whole number or a letter that ends a sentence, and a decimal, both after white space.
_ENDS_SO = re.compile(r"\s(?:\d+|[A-Za-z])\.(?=\s+[A-Z0-9\"(])")
_DECIMAL = re.compile(r"\s\d+\.\d")


def _before(text: str, at: int) -> str:
    """The two tokens before a place."""
    return _masked(" ".join(text[max(0, at - 80) : at].split()[-2:]))


def _knowledge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind, key and count: the words, items and number endings that values hold before their end."""
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        keys = list(held)
        batch = pa.RecordBatch.from_pydict({"kind": [k[0] for k in keys], "key": [k[1] for k in keys], "n": pa.array(held.values(), pa.int64())})
        held.clear()
        return batch

    words: Counter = Counter()
    for batch in batches:
        for text in batch.column("text").to_pylist():
            if is_blank(text):
                continue
            words.update(text.split()[:-1])
            for m in _DECIMAL.finditer(text):
                held["decimal", _before(text, m.start())] += 1
            for m in _ENDS_SO.finditer(text):
                held["number", _before(text, m.start())] += 1
            if "\n" in text:
                held.update(("item", m.group(1).lower()) for line in text.split("\n")[:-1] if (m := ITEM.match(line)) is not None)
            if len(words) > HELD:
                _fold(words, held)
            if len(held) > HELD:
                yield out()
    _fold(words, held)
    yield out()


def _fold(words: Counter, held: Counter) -> None:
    for token, n in words.items():
        for w in re.findall(r"[^\W\d_]{2,}", token.lower()):
            held["word", w] += n
    words.clear()


def _endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        got = [ending(t) for t in texts]
        new = [pa.array([g[0] for g in got]), pa.array([g[1] for g in got]), pa.array([None if t is None else len(t) for t in texts], pa.int32())]
        names = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *new], names=[*names, "__ends", "__key", "__length"])


def judge(rows: DataFrame, text_col: str = "text", corpus: DataFrame | None = None, source: list[str] | None = None) -> DataFrame:
    """rows without the text, and cut (boolean), broken (its last word or item is an unknown proper prefix of known ones) and
    at_limit (it is as long as many unfinished values of its source).

    rows: one value per row, with any further columns; source: those that name its source, none for a single one. corpus: the
    same values in a column text, where they are cheaper to read than rows. Null, blank and placeholder values are not cut. A
    loop of repeated words is cut unless it ends with a full stop. Repeated rows stay. Columns with the names of the results are
    replaced.
    """
    keep = [c for c in rows.columns if c not in (text_col, "cut", "broken", "at_limit")]
    texts = rows.select(*keep, F.col(text_col).cast("string").alias("text"))
    schema = ", ".join([*(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in keep), "__ends string, __key string, __length int"])
    ends = materialize(texts.mapInArrow(_endings, schema), "cut-endings")
    known = (texts if corpus is None else corpus).select("text").mapInArrow(_knowledge, "kind string, key string, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    known = materialize(known, "cut-known")

    # the limits: at most LIMIT_SHARE lengths per source
    by = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in source or []]
    place = F.concat_ws("\1", F.lit(""), *by)
    open_ = ends.where(F.col("__ends").isin("cut", "word", "item", "label")).groupBy(place.alias("__place"), "__length").agg(F.count("*").alias("same"))
    all_open = open_.groupBy("__place").agg(F.sum("same").alias("all"))
    limits = open_.join(all_open, "__place").where((F.col("same") >= LIMIT) & (F.col("same") * LIMIT_SHARE >= F.col("all"))).select("__place", "__length", F.lit(True).alias("__at"))
    limits = materialize(limits, "cut-limits")
    placed = ends.withColumn("__place", place).join(limits, ["__place", "__length"], "left").drop("__place", "__length").withColumn("__at", F.coalesce("__at", F.lit(False)))

    # what is asked: the distinct last words, items and number endings; then which of the unknown ones begin something known
    asks = F.col("__ends").isin("item", "number", "word", "label") | ((F.col("__ends") == "whole") & (F.col("__key") != "") & F.col("__at"))
    kind = F.when(F.col("__ends").isin("item", "number"), F.col("__ends")).otherwise("word")
    asking, rest = placed.where(asks).withColumn("__kind", kind), placed.where(~asks)
    word_of = F.lower(F.regexp_extract("key", r"(\p{L}+)$", 1))
    asked = asking.select(F.col("__kind").alias("kind"), F.col("__key").alias("key")).distinct()
    both = asked.unionByName(asked.where("kind = 'item'").select(F.lit("word").alias("kind"), word_of.alias("key"))).distinct()
    unknown = both.join(known.select("kind", "key").hint("merge"), ["kind", "key"], "left_anti").where(F.col("kind").isin("word", "item") & (F.length("key") > 0))
    lengths = F.sequence(F.lit(1), F.length("key") - 1)
    longer = known.where(F.col("kind").isin("word", "item") & (F.length("key") > 1)).select("kind", F.explode(F.transform(lengths, lambda n: F.substring("key", F.lit(1), n))).alias("key"))
    broken = materialize(unknown.join(longer.hint("merge"), ["kind", "key"], "left_semi"), "cut-broken")
    decimal = known.where("kind = 'decimal'").select(F.lit("number").alias("kind"), "key", F.lit(True).alias("is_decimal"))
    facts = (
        asked.withColumn("word", F.when(F.col("kind") == "item", word_of))
        .join(known.select("kind", "key", F.lit(True).alias("is_known")).hint("merge"), ["kind", "key"], "left")
        .join(broken.withColumn("is_broken", F.lit(True)), ["kind", "key"], "left")
        .join(broken.where("kind = 'word'").select(F.col("key").alias("word"), F.lit(True).alias("breaks")), "word", "left")
        .join(decimal, ["kind", "key"], "left")
        .select(F.col("kind").alias("__kind"), F.col("key").alias("__key"), *[F.coalesce(c, F.lit(False)).alias(f"__{c}") for c in ("is_known", "is_broken", "breaks", "is_decimal")])
    )
    # many values may end on one word: they are dealt to parts, and what is known of the word is sent to each
    dealt = asking.withColumn("__part", F.pmod(F.xxhash64(F.lit(0), *[c for c in keep if "map<" not in rows.schema[c].dataType.simpleString()]), F.lit(PARTS)))
    told = dealt.join(facts.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long")))).hint("merge"), ["__kind", "__key", "__part"], "left")
    is_known, at = F.col("__is_known"), F.col("__at")
    is_broken = F.col("__is_broken") | ((F.col("__kind") == "item") & F.col("__breaks") & ~is_known)
    cut = (
        F.when(F.col("__ends") == "word", True)
        .when(F.col("__ends") == "label", is_broken | at)
        .when(F.col("__ends") == "item", is_broken | (~is_known & at))
        .when(F.col("__ends") == "number", ~is_known & F.col("__is_decimal"))
        .otherwise(is_broken & at)
    )
    judged = told.select(*keep, cut.alias("cut"), (is_broken & (F.col("__ends") != "number")).alias("broken"), at.alias("at_limit"))
    return judged.unionByName(rest.select(*keep, (F.col("__ends") == "cut").alias("cut"), F.lit(False).alias("broken"), at.alias("at_limit")))


def rates(judged: DataFrame, group: list[str]) -> DataFrame:
    """Per group: values, cut values, their share, and of the cut ones how many are broken inside a word or item, and how many stand at a limit."""
    cut = F.col("cut")
    whole = judged.groupBy(*group).agg(F.count("*").alias("n_values"), F.count_if(cut).alias("n_cut"), F.count_if(cut & F.col("broken")).alias("n_broken"), F.count_if(cut & F.col("at_limit")).alias("n_at_limit"))
    return whole.select(*group, "n_values", "n_cut", (F.col("n_cut") / F.col("n_values")).alias("share_cut"), "n_broken", "n_at_limit")
