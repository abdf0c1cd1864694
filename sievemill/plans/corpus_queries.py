"""Queries over the corpus: profiles, cleaning, duplicates, splits, passages, formats, chunks and terms."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..catalog import query
from ..functions.words import n_words, words
from ..operators import cleaning as C
from ..operators import dedup as D
from ..operators import entities as E
from ..operators import formatting as FT
from ..operators import passages as P
from ..operators import predicates as PR
from ..operators import profile as ST
from ..operators import retrieval as RG
from ..operators import sampling as SP
from ..operators import tokens as TK
from ..session import materialize, table

BLANK = r"[ \t\n\r\f]+"


def w(x: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({x}, ''), '{BLANK}'), lambda w: w <> '')"


def docs(spark, d):
    return table(spark, d, "documents")


def digest(df, text):
    return df.select("doc_id", F.sha2(text, 256).alias("digest"), F.length(text).cast("long").alias("n"))


def digest_sql(x: str) -> str:
    return f"SELECT doc_id, sha256(t) AS digest, length(t)::BIGINT AS n FROM (SELECT doc_id, {x} AS t FROM documents)"


def rx(text: str, pattern: str, by: str = "", flags: str = "g") -> str:
    return f"regexp_replace({text}, '{pattern.replace(chr(39), chr(39) * 2)}', '{by}', '{flags}')"


_S = f"SELECT *, len({w('text')})::BIGINT AS n_words, coalesce(length(text), 0)::BIGINT AS n_chars FROM documents"


def _profile_sql(group: str) -> str:
    return f"""SELECT coalesce({group}, 'unknown') AS {group}, count(*)::BIGINT AS n_docs, sum(n_words)::BIGINT AS n_words, sum(n_chars)::BIGINT AS n_chars,
      floor(sum(n_chars) / 4)::BIGINT AS est_tokens, 100.0::DOUBLE * sum(n_words) / greatest(sum(sum(n_words)) OVER (), 1) AS pct_words FROM ({_S}) GROUP BY 1"""


@query("profile_by_lang", _profile_sql("lang"))
def profile_by_lang(spark, d):
    return ST.by_group(docs(spark, d), "lang")


@query("profile_by_source", _profile_sql("source"))
def profile_by_source(spark, d):
    return ST.by_group(docs(spark, d), "source")


@query("length_stats", f"SELECT avg(n_words)::DOUBLE AS mean_words, median(n_words)::DOUBLE AS median_words, min(n_words) AS min_words, max(n_words) AS max_words FROM ({_S})")
def length_stats(spark, d):
    return ST.lengths(docs(spark, d))


@query("length_histogram", f"""SELECT b.bucket::INT AS bucket, count(s.doc_id)::BIGINT AS n_docs FROM range(1, 6) b(bucket) LEFT JOIN
  (SELECT doc_id, CASE WHEN n_words >= 5000 THEN 5 WHEN n_words >= 1000 THEN 4 WHEN n_words >= 500 THEN 3 WHEN n_words >= 100 THEN 2 ELSE 1 END AS k FROM ({_S})) s ON s.k = b.bucket GROUP BY 1""")
def length_histogram(spark, d):
    return ST.histogram(docs(spark, d))


def _vocab_sql(k: int, least: int) -> str:
    return f"SELECT word, count(*)::BIGINT AS n FROM (SELECT unnest({w('lower(text)')}) AS word FROM documents) WHERE length(word) >= {least} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {k}"


@query("vocab_topk", _vocab_sql(100, 1))
def vocab_topk(spark, d):
    return ST.top_words(docs(spark, d), 100)


@query("vocab_topk_len3", _vocab_sql(50, 3))
def vocab_topk_len3(spark, d):
    return ST.top_words(docs(spark, d), 50, 3)


@query("content_tiers", "SELECT coalesce(content_tier, 'unknown') AS content_tier, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def content_tiers(spark, d):
    return ST.counts(docs(spark, d), "content_tier")


_SPLIT = """WITH r AS (SELECT *, coalesce(source_category, 'unknown') AS st FROM documents), s AS (SELECT st, count(*) AS n FROM r GROUP BY 1 HAVING count(*) > 1),
  a AS (SELECT *, sum(n) OVER () AS total FROM s), x AS (SELECT *, ceil(total * 0.1::DOUBLE) * n / total AS e FROM a), y AS (SELECT *, floor(e) AS q, e - floor(e) AS rest FROM x),
  z AS (SELECT st, q + (row_number() OVER (ORDER BY rest DESC, st) <= ceil(total * 0.1::DOUBLE) - sum(q) OVER ())::INT AS quota FROM y),
  v AS (SELECT r.doc_id, row_number() OVER (PARTITION BY r.st ORDER BY md5('42:' || r.doc_id), r.doc_id) <= coalesce(z.quota, 0) AS is_val, r.st, r.source_category FROM r LEFT JOIN z USING (st))"""


@query("stratified_split", _SPLIT + " SELECT doc_id, CASE WHEN is_val THEN 'val' ELSE 'train' END AS split FROM v")
def stratified_split(spark, d):
    return SP.split(docs(spark, d), "doc_id", "source_category").select("doc_id", "split")


@query("train_val_pivot", _SPLIT + """ SELECT st AS source_category, sum((NOT is_val)::INT)::BIGINT AS n_train, sum(is_val::INT)::BIGINT AS n_val, 100.0::DOUBLE * sum((NOT is_val)::INT) / count(*) AS pct_train FROM v GROUP BY 1""")
def train_val_pivot(spark, d):
    return ST.pivot_split(SP.split(docs(spark, d), "doc_id", "source_category"), "source_category")


@query("source_caps", """WITH m AS (SELECT doc_id, CASE WHEN lower(coalesce(source, '')) LIKE '%patient%' THEN 'patient_narratives' WHEN lower(coalesce(source, '')) IN ('wikipedia', 'supplementary') THEN 'supplementary' END AS c FROM documents),
  r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY md5('42:' || doc_id), doc_id) AS k, count(*) OVER () AS total FROM m)
  SELECT doc_id FROM r WHERE c IS NULL OR k <= floor(total * CASE c WHEN 'patient_narratives' THEN 0.1::DOUBLE ELSE 0.15::DOUBLE END)""")
def source_caps(spark, d):
    return SP.cap(docs(spark, d), "doc_id", "source").select("doc_id")


@query("head_split", "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) <= floor(count(*) OVER () * 0.8::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM documents")
def head_split(spark, d):
    return SP.head_split(docs(spark, d), "doc_id").select("doc_id", "split")


@query("one_per_group", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) AS k FROM documents WHERE source IS NOT NULL) WHERE k = 1")
def one_per_group(spark, d):
    return SP.one_per_group(docs(spark, d), "doc_id", "source").select("source", "doc_id")


_COUNT = "SELECT coalesce(category, 'unknown') AS category, count(*)::BIGINT AS n FROM {} GROUP BY 1"


@query("version_delta", f"""SELECT category, coalesce(a.n, 0)::BIGINT AS old_value, coalesce(b.n, 0)::BIGINT AS new_value, (coalesce(b.n, 0) - coalesce(a.n, 0))::BIGINT AS delta,
  CASE WHEN coalesce(a.n, 0) <> 0 THEN 100.0::DOUBLE * (coalesce(b.n, 0) - a.n) / a.n END AS pct_delta, CASE WHEN a.n IS NULL THEN 'NEW' WHEN b.n IS NULL THEN 'REMOVED' ELSE 'CHANGED' END AS status,
  coalesce(a.n > 0 AND a.n - coalesce(b.n, 0) > 0.1::DOUBLE * a.n, false) AS regression FROM ({_COUNT.format('verify_results')}) a FULL JOIN ({_COUNT.format('model_comparison_report')}) b USING (category)""")
def version_delta(spark, d):
    old, new = (ST.counts(table(spark, d, t), "category") for t in ("verify_results", "model_comparison_report"))
    return ST.compare(old, new, "category", "n")


@query("loss_rate", """WITH f AS (SELECT * FROM documents WHERE coalesce(length(text), 0) >= 500) SELECT source, n_raw, coalesce(n_final, 0)::BIGINT AS n_final, 100.0::DOUBLE * (n_raw - coalesce(n_final, 0)) / n_raw AS loss_pct
  FROM (SELECT source, count(*)::BIGINT AS n_raw FROM documents GROUP BY 1) LEFT JOIN (SELECT source AS s, count(*)::BIGINT AS n_final FROM f GROUP BY 1) ON source = s""")
def loss_rate(spark, d):
    raw = docs(spark, d)
    return ST.loss_rate(raw, raw.where(F.coalesce(F.length("text"), F.lit(0)) >= 500), "source")


@query("clean_citations", digest_sql(rx(rx("text", C.NUMBERED_CITATION), C.AUTHOR_CITATION)))
def clean_citations(spark, d):
    return digest(docs(spark, d), C.strip_citations(F.col("text")))


@query("clean_volatile", digest_sql(rx(rx(rx(rx(rx(rx(rx("text", C.URL), C.EMAIL), C.PHONE), C.TEMPORAL), C.CALL_TO_ACTION), C.COPYRIGHT), C.LICENCE)))
def clean_volatile(spark, d):
    return digest(docs(spark, d), C.strip_volatile(F.col("text")))


@query("clean_phone_strict", digest_sql(rx("text", C.PHONE_STRICT)))
def clean_phone_strict(spark, d):
    return digest(docs(spark, d), F.regexp_replace("text", C.PHONE_STRICT, ""))


@query("clean_trial_status", digest_sql(rx("text", C.TRIAL_STATUS)))
def clean_trial_status(spark, d):
    return digest(docs(spark, d), C.strip_trial_status(F.col("text")))


def _punct_sql() -> str:
    x = "text"
    for a, b in C.LIGATURES.items():
        x = f"replace({x}, '{a}', '{b}')"
    return f"translate({x}, '{C.HYPHENS + C.SPACES + C.ZERO_WIDTH}', '{'-' * len(C.HYPHENS) + ' ' * len(C.SPACES)}')"


@query("clean_punct", digest_sql(_punct_sql()))
def clean_punct(spark, d):
    return digest(docs(spark, d), C.canonical_punctuation(F.col("text")))


@query("clean_whitespace", digest_sql(rx(rx("array_to_string(list_transform(string_split(text, chr(10)), lambda l: trim(regexp_replace(l, '[ \\t\\r\\f]+', ' ', 'g'), ' ')), chr(10))", r"\n{3,}", "\n\n"), r"^\n+|\n+$")))
def clean_whitespace(spark, d):
    return digest(docs(spark, d), C.normal_whitespace(F.col("text")))


@query("rejoin_breaks", digest_sql(rx("text", r"([a-z])-\n([a-z])", r"\1-\2")))
def rejoin_breaks(spark, d):
    return digest(docs(spark, d), C.rejoin_breaks(F.col("text")))


@query("title_embed", digest_sql("CASE WHEN length(trim(coalesce(title, ''), ' ')) > 0 THEN title || chr(10) || chr(10) || text ELSE text END"))
def title_embed(spark, d):
    return digest(docs(spark, d), C.embed_title(F.col("title"), F.col("text")))


@query("pii_mask", digest_sql(rx(rx(rx("text", C.EMAIL, "[EMAIL]"), C.PHONE, "[PHONE]"), r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "[IP]")))
def pii_mask(spark, d):
    return digest(docs(spark, d), C.mask_pii(F.col("text")))


_DIGITS = "regexp_replace(x, '[ -]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN (length({_DIGITS}) - i) % 2 = 0 THEN substr({_DIGITS}, i, 1)::INT ELSE (2 * substr({_DIGITS}, i, 1)::INT) // 10 + (2 * substr({_DIGITS}, i, 1)::INT) % 10 END)) % 10 = 0"
_NUMBERS = "regexp_replace(md5(ext_id || title), '[^0-9]', '', 'g')"


@query("card_marks", f"SELECT doc_id, list_reduce(list_prepend(t, list_filter(list_distinct(regexp_extract_all(t, '[0-9](?:[ -]?[0-9]){{12,18}}')), lambda x: {_LUHN})), lambda a, card: replace(a, card, '[CARD]')) AS masked FROM (SELECT doc_id, 'no ' || {_NUMBERS} || ' or 4111 1111 1111 1111' AS t FROM documents)")
def card_marks(spark, d):
    """Card numbers masked in a text made of the figures of a digest and a valid number."""
    t = F.concat(F.lit("no "), F.regexp_replace(F.md5(F.concat("ext_id", "title")), "[^0-9]", ""), F.lit(" or 4111 1111 1111 1111"))
    return docs(spark, d).select("doc_id", C.mask_cards(t).alias("masked"))


@query("english_gate", f"SELECT doc_id, coalesce(list_has_any(list_transform({w('text')}[1:200], lambda x: lower(x)), ['the', 'and', 'of', 'in']), false) AS is_english FROM documents")
def english_gate(spark, d):
    return docs(spark, d).select("doc_id", C.looks_english(F.col("text")).alias("is_english"))


@query("min_length_reject", f"SELECT doc_id, n_words AS word_count FROM (SELECT doc_id, len({w('text')})::BIGINT AS n_words FROM documents) WHERE n_words < 100")
def min_length_reject(spark, d):
    return docs(spark, d).select("doc_id", n_words("text").alias("word_count")).where("word_count < 100")


@query("reject_summary")
def reject_summary(spark, d):
    _, rejected = C.clean(docs(spark, d))
    return rejected.groupBy("stage", "reason").agg(F.count("*").alias("n"))


@query("clean_documents")
def clean_documents(spark, d):
    kept, _ = C.clean(docs(spark, d))
    return kept.select("doc_id", "text", "word_count", "is_english")


@query("clean_strict")
def clean_strict(spark, d):
    kept, _ = C.clean(docs(spark, d), strict=True)
    return kept.select("doc_id", F.sha2("text", 256).alias("digest"), "word_count")


def _sections_sql() -> str:
    """What a pattern looks ahead to is matched, and put back."""
    x = "text"
    for p in C.SECTIONS:
        ahead = re.search(r"\(\?=(.*?)\)(?=\)$|$|\|\\z\)$)", p)
        x = rx(x, p.replace(ahead.group(0), f"({ahead.group(1)})"), "\\1") if ahead else rx(x, p)
    return x


@query("clean_sections", digest_sql(_sections_sql()))
def clean_sections(spark, d):
    return digest(docs(spark, d), C.strip_sections(F.col("text")))


@query("html_text")
def html_text(spark, d):
    return digest(docs(spark, d), C.html_text("text"))


@query("unicode_nfc", digest_sql("nfc_normalize(text)"))
def unicode_nfc(spark, d):
    return digest(docs(spark, d), C.nfc("text"))


@query("abbrev_normalize")
def abbrev_normalize(spark, d):
    return digest(docs(spark, d), C.abbreviations("text"))


@query("survival_verdict")
def survival_verdict(spark, d):
    return C.survival_verdict(term_survival(spark, d))


@query("term_survival")
def term_survival(spark, d):
    df = docs(spark, d)
    return C.survival(df, df.withColumn("text", C.abbreviations("text")), "doc_id")


@query("exact_doc_dedup", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def exact_doc_dedup(spark, d):
    return D.exact(docs(spark, d), "text", ["doc_id"]).select("doc_id")


@query("line_dedup", f"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS part, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
  q AS (SELECT *, len({w('part')}) >= 5 AS is_long, array_to_string({w('part')}, ' ') AS norm FROM p),
  r AS (SELECT *, NOT is_long OR row_number() OVER (PARTITION BY is_long, norm ORDER BY doc_id, pos) = 1 AS stays FROM q)
  SELECT doc_id, sum((NOT stays)::INT)::BIGINT AS n_removed FROM r GROUP BY 1 HAVING NOT (sum(is_long::INT) > 0 AND sum((is_long AND stays)::INT) = 0)""")
def line_dedup(spark, d):
    kept, _ = D.paragraphs(docs(spark, d), "doc_id", "text", "\n", 5)
    return kept.select("doc_id", "n_removed")


def _shingles_sql(k: int) -> str:
    t = w("lower(text)")
    return f"(SELECT doc_id, list_distinct(CASE WHEN len(t) >= {k} THEN list_transform(range(1, len(t) - {k} + 2), lambda i: array_to_string(t[i:i + {k - 1}], ' ')) ELSE t END) AS s FROM (SELECT doc_id, {t} AS t FROM documents))"


@query("shingle_counts", f"SELECT doc_id, len(s)::BIGINT AS n_shingles FROM {_shingles_sql(5)}")
def shingle_counts(spark, d):
    return docs(spark, d).select("doc_id", F.size(D.shingle_set(F.coalesce("text", F.lit("")))).cast("long").alias("n_shingles"))


@query("exact_jaccard_pairs", f"""WITH s AS (SELECT doc_id, unnest(s) AS g FROM {_shingles_sql(5)}), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_shared FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2)
  SELECT a, b, n_shared::BIGINT AS n_shared, (x.n + y.n - n_shared)::BIGINT AS n_union FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE n_shared >= 0.8::DOUBLE * (x.n + y.n - n_shared)""")
def exact_jaccard_pairs(spark, d):
    return D.jaccard_pairs(docs(spark, d), "doc_id", "text", 0.8)


@query("minhash_candidates")
def minhash_candidates(spark, d):
    return D.band_pairs(docs(spark, d), "doc_id", "text", 0.85)


_ONE = f"(SELECT doc_id, array_to_string({w('lower(text)')}, ' ') AS words, min(doc_id) OVER (PARTITION BY array_to_string({w('lower(text)')}, ' ')) AS leader FROM documents)"
_SURVIVORS = f"""WITH RECURSIVE s AS (SELECT doc_id, unnest(s) AS g FROM {_shingles_sql(5)} WHERE doc_id IN (SELECT doc_id FROM {_ONE} WHERE doc_id = leader AND words <> '')), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
  e AS (SELECT b, list(a) AS before, row_number() OVER (ORDER BY b) AS i FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k >= 0.8::DOUBLE * (x.n + y.n - k) GROUP BY 1),
  r AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS fallen UNION ALL SELECT e.i, CASE WHEN len(list_filter(e.before, lambda x: NOT list_contains(r.fallen, x))) > 0 THEN list_append(r.fallen, e.b) ELSE r.fallen END FROM r JOIN e ON e.i = r.i + 1),
  kept AS (SELECT doc_id FROM {_ONE} WHERE (doc_id = leader OR words = '') AND doc_id NOT IN (SELECT unnest(fallen) FROM (SELECT fallen FROM r ORDER BY i DESC LIMIT 1)))"""


@query("near_dup_survivors", _SURVIVORS + " SELECT doc_id FROM kept")
def near_dup_survivors(spark, d):
    return D.near(docs(spark, d), "doc_id", "text")


_LEAKS = f"""{_SPLIT}, sh AS (SELECT doc_id, unnest(s) AS g FROM {_shingles_sql(5)}), sn AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b USING (g) JOIN v x ON x.doc_id = a.doc_id AND NOT x.is_val JOIN v y ON y.doc_id = b.doc_id AND y.is_val GROUP BY 1, 2)
  SELECT DISTINCT b AS doc_id FROM p JOIN sn x ON x.doc_id = a JOIN sn y ON y.doc_id = b WHERE k >= 0.7::DOUBLE * (x.n + y.n - k)"""


@query("cross_set_leak", _LEAKS)
def cross_set_leak(spark, d):
    """Validation documents of the stratified split that are near a training document."""
    divided = materialize(SP.split(docs(spark, d), "doc_id", "source_category").select("doc_id", "text", "split"), "divided")
    return D.cross_leaks(divided.where("split = 'train'"), divided.where("split = 'val'"), "doc_id", "text")


@query("pipeline_profile")
def pipeline_profile(spark, d):
    from . import pipeline

    return pipeline.run(docs(spark, d)).profile


def _keyword_sql() -> str:
    t = "lower(coalesce(text, ''))"
    one = lambda k: f"((length({t}) - length(replace({t}, '{k}', ''))) // {len(k)})"
    return " UNION ALL ".join(f"SELECT doc_id, '{c}' AS category, ({' + '.join(one(k) for k in ks)})::BIGINT AS score FROM documents" for c, ks in P.KEYWORDS.items())


@query("keyword_scores", f"SELECT * FROM ({_keyword_sql()}) WHERE score > 0")
def keyword_scores(spark, d):
    return P.keyword_scores(docs(spark, d), "doc_id", "text")


@query("keyword_score_topk", f"SELECT doc_id, category, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, doc_id) AS rank FROM ({_keyword_sql()}) WHERE score > 0) WHERE rank <= 10")
def keyword_score_topk(spark, d):
    return P.top_records(P.keyword_scores(docs(spark, d), "doc_id", "text"), "doc_id")


_PASSAGES = f"""(SELECT doc_id, start, passage FROM (SELECT doc_id, start, trim(CASE WHEN n > 500 AND start + 400 < n AND strpos(raw, ' ') > 0 AND length(raw) - strpos(reverse(raw), ' ') > 200 THEN substr(raw, 1, length(raw) - strpos(reverse(raw), ' ')) ELSE raw END, ' ') AS passage
  FROM (SELECT doc_id, n, start, CASE WHEN n <= 500 THEN t ELSE substr(t, start + 1, 400) END AS raw FROM (SELECT doc_id, t, length(t) AS n, unnest(CASE WHEN length(t) <= 500 THEN [0] ELSE range(0, length(t), 300) END)::INT AS start FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))))
  WHERE length(passage) >= 200 AND len({w('passage')}) >= 50 AND NOT (len(regexp_extract_all(passage, 'et al\\.')) > 3 OR len(regexp_extract_all(passage, '\\[\\d+\\]')) > 5) AND len(list_filter({sorted({k for ks in P.KEYWORDS.values() for k in ks})}, lambda k: contains(lower(passage), k))) > 0)"""


@query("sliding_passages", f"SELECT * FROM {_PASSAGES}")
def sliding_passages(spark, d):
    return P.passages(docs(spark, d), "doc_id", "text")


_U = "(('0x' || substr(md5('{}:' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


@query("question_types", f"SELECT doc_id, CASE WHEN u < 0.4 THEN 'factual' WHEN u < 0.7 THEN 'explanatory' WHEN u < 0.85 THEN 'comparative' ELSE 'clinical' END AS question_type FROM (SELECT doc_id, {_U.format(42)} AS u FROM documents)")
def question_types(spark, d):
    return docs(spark, d).select("doc_id", P.question_type(42, "doc_id").alias("question_type"))


_EXCERPT = f"coalesce(list_filter(string_split(regexp_replace(passage, '([.!?]){BLANK}', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, chr(32)) <> '')[1], '')"


@query("passage_drafts", f"""SELECT doc_id, start, question_type, CASE WHEN {_U.format(43)} < 0.2 THEN CASE WHEN length(f) > 150 THEN substr(f, 1, 147) || '...' ELSE f END ELSE '' END AS input,
  sha256('Write one ' || question_type || ' question and its answer from this passage only.' || chr(10) || chr(10) || passage) AS digest FROM (SELECT *, {_EXCERPT} AS f, CASE WHEN {_U.format(42)} < 0.4 THEN 'factual' WHEN {_U.format(42)} < 0.7 THEN 'explanatory' WHEN {_U.format(42)} < 0.85 THEN 'comparative' ELSE 'clinical' END AS question_type FROM {_PASSAGES})""")
def passage_drafts(spark, d):
    return P.drafts(P.passages(docs(spark, d), "doc_id", "text"), "doc_id", "passage").select("doc_id", "start", "question_type", "input", F.sha2("prompt", 256).alias("digest"))


def sft(spark, d):
    return table(spark, d, "synthetic_sft")


@query("pair_format", f"SELECT pair_id, coalesce(length(trim(instruction, ' ')) > 0 AND len({w('output')}) BETWEEN 10 AND 200, false) AS is_valid FROM synthetic_sft")
def pair_format(spark, d):
    return sft(spark, d).select("pair_id", PR.pair_format(F.col("instruction"), F.col("output")).alias("is_valid"))


def _safe(x: str) -> str:
    x = f"coalesce({x}, '')"
    for a in P.ABBREVIATIONS:
        x = f"replace({x}, '{a}', '{a.replace('.', chr(2))}')"
    return x


@query("type_shares", "SELECT coalesce(metadata.question_type, 'unknown') AS question_type, count(*)::BIGINT AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 1) AS pct FROM synthetic_sft GROUP BY 1")
def type_shares(spark, d):
    return P.type_shares(sft(spark, d), F.col("metadata.question_type"))


@query("quality_report", f"""SELECT coalesce(metadata.category, 'unknown') AS category, count(*)::BIGINT AS n_pairs, greatest(250 - count(*), 0)::BIGINT AS shortfall, count(*) < 50 AS is_thin,
  sum(len({w('output')}))::BIGINT AS n_words, min(len({w('output')}))::BIGINT AS min_words, max(len({w('output')}))::BIGINT AS max_words,
  sum(greatest(len(list_filter(string_split(regexp_replace({_safe('output')}, '[.]{BLANK}', chr(1), 'g'), chr(1)), lambda s: trim(s, ' ') <> '')), 1))::BIGINT AS n_sentences FROM synthetic_sft GROUP BY 1""")
def quality_report(spark, d):
    return P.quality(sft(spark, d), F.col("metadata.category"), F.col("output"))


@query("reference_heavy", r"SELECT doc_id, coalesce(len(regexp_extract_all(text, 'et al\.')) > 3 OR len(regexp_extract_all(text, '\[\d+\]')) > 5, false) AS is_heavy FROM documents")
def reference_heavy(spark, d):
    return docs(spark, d).select("doc_id", PR.reference_heavy(F.col("text")).alias("is_heavy"))


@query("topic_gate", r"SELECT doc_id, coalesce(regexp_matches(text, '(?i)\b(?:als\b|sod1\b|riluzole|motor neuron|tdp-43)'), false) AS on_topic FROM documents")
def topic_gate(spark, d):
    return docs(spark, d).select("doc_id", PR.topic(F.col("text"), ["als", "sod1", "riluzole", "motor neuron", "tdp-43"]).alias("on_topic"))


_FORMAT = f"CASE WHEN trim(coalesce(input, ''), ' ') <> '' THEN format('{FT.WITH_INPUT.replace('%s', '{}')}', coalesce(instruction, ''), coalesce(input, '')) ELSE format('{FT.WITHOUT_INPUT.replace('%s', '{}')}', coalesce(instruction, '')) END"


@query("alpaca_format", f"SELECT pair_id, sha256({_FORMAT}) AS digest FROM synthetic_sft")
def alpaca_format(spark, d):
    return sft(spark, d).select("pair_id", F.sha2(FT.prompt(F.col("instruction"), F.col("input")), 256).alias("digest"))


@query("chat_messages", "SELECT pair_id, unnest(['system', 'user', 'assistant']) AS role, unnest(['Answer.', CASE WHEN trim(coalesce(input, ''), ' ') <> '' THEN instruction || chr(10) || chr(10) || 'Context: ' || input ELSE instruction END, output]) AS content FROM synthetic_sft")
def chat_messages(spark, d):
    m = FT.chat("Answer.", F.col("instruction"), F.col("input"), F.col("output"))
    return sft(spark, d).select("pair_id", F.explode(m).alias("m")).select("pair_id", "m.role", "m.content")


_TAG = "### Response:" + chr(10)


@query("prompt_completion_split", """SELECT result_id, length(coalesce(p, t))::BIGINT AS n_prompt, length(t) - length(coalesce(p, t)) AS n_rest FROM (SELECT result_id, t, CASE WHEN contains(t, tag) THEN substr(t, 1, length(t) - strpos(reverse(t), reverse(tag)) + 1) END AS p
  FROM (SELECT result_id, prompt || coalesce(response, '') AS t, '### Response:' || chr(10) AS tag FROM verify_results WHERE prompt IS NOT NULL))""")
def prompt_completion_split(spark, d):
    """Prompts with their answers, taken apart again at the last tag; where there is no tag all is prompt."""
    whole = F.concat("prompt", F.coalesce("response", F.lit("")))
    p, rest = FT.split_at_last(whole, _TAG)
    return table(spark, d, "verify_results").where(F.col("prompt").isNotNull()).select("result_id", F.length(p).cast("long").alias("n_prompt"), F.length(rest).cast("long").alias("n_rest"))


_TOK = "list_transform({}, lambda x: (('0x' || substr(md5(x), 1, 7))::BIGINT % 50000)::INT)"


@query("mask_labels", f"""WITH t AS (SELECT pair_id, {_TOK.format(w('instruction'))} AS p, {_TOK.format(w('output'))} AS o FROM synthetic_sft)
  SELECT pair_id, len(p)::BIGINT AS n_prompt, len(o)::BIGINT AS n_output, (len(p) + len(o)) <= 128 AS fits, CASE WHEN len(p) + len(o) <= 128 THEN coalesce(list_sum(o), 0)::BIGINT - 100 * (128 - len(o)) END AS label_sum FROM t""")
def mask_labels(spark, d):
    p, o = FT.word_ids(F.col("instruction")), FT.word_ids(F.col("output"))
    ids, labels = FT.masked(p, o, 128)
    return sft(spark, d).select("pair_id", F.size(p).cast("long").alias("n_prompt"), F.size(o).cast("long").alias("n_output"), labels.isNotNull().alias("fits"), F.aggregate(labels, F.lit(0).cast("long"), lambda s, x: s + x).alias("label_sum"))


@query("pack_blocks", f"""WITH t AS (SELECT doc_id, {_TOK.format(w('text'))} AS ids FROM documents), u AS (SELECT doc_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS p FROM t),
  n AS (SELECT id, row_number() OVER (ORDER BY doc_id, p) - 1 AS pos FROM u) SELECT (pos // 512)::BIGINT AS block, count(*)::BIGINT AS n, sum(id * (pos % 512 + 1))::BIGINT AS checksum FROM n GROUP BY 1 HAVING count(*) = 512""")
def pack_blocks(spark, d):
    rows = FT.pack(docs(spark, d).select("doc_id", FT.word_ids(F.col("text")).alias("ids")), "doc_id", "ids", 512)
    return rows.select("block", F.size("ids").cast("long").alias("n"), F.aggregate(F.transform("ids", lambda x, i: x.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda s, x: s + x).alias("checksum"))


@query("token_percentiles", f"""SELECT min(n) AS min_tokens, avg(n)::DOUBLE AS avg_tokens, max(n) AS max_tokens, quantile_cont(n, 0.9)::DOUBLE AS p90, quantile_cont(n, 0.95)::DOUBLE AS p95, quantile_cont(n, 0.99)::DOUBLE AS p99, sum((n > 100)::INT)::BIGINT AS n_over
  FROM (SELECT len({w('output')})::BIGINT AS n FROM synthetic_sft)""")
def token_percentiles(spark, d):
    return FT.percentiles(sft(spark, d).select(n_words("output").alias("n")), "n", 100)


_CHUNKS = f"""(SELECT doc_id, c::INT AS chunk_index, ceil(len(t) / 100.0)::INT AS total_chunks, t[c * 100 + 1:c * 100 + 100] AS part FROM (SELECT doc_id, {w('text')} AS t FROM documents), unnest(range(0, ceil(len(t) / 100.0)::BIGINT)) u(c))"""


@query("fixed_chunks", f"SELECT doc_id, chunk_index, total_chunks, sha256(array_to_string(part, ' ')) AS digest, len(part)::BIGINT AS n_tokens FROM {_CHUNKS}")
def fixed_chunks(spark, d):
    return RG.fixed_chunks(docs(spark, d), "doc_id", "text").select("doc_id", "chunk_index", "total_chunks", F.sha2("chunk", 256).alias("digest"), "n_tokens")


@query("chunk_overlap", f"SELECT doc_id, chunk_index, (len(part) + CASE WHEN chunk_index > 0 THEN least(len(lag(part) OVER (PARTITION BY doc_id ORDER BY chunk_index)), 10) ELSE 0 END)::BIGINT AS n_tokens FROM {_CHUNKS}")
def chunk_overlap(spark, d):
    return RG.with_overlap(RG.fixed_chunks(docs(spark, d), "doc_id", "text"), "doc_id", RG.overlap_size(100)).select("doc_id", "chunk_index", "n_tokens")


@query("chunk_stats", f"SELECT avg(n)::DOUBLE AS mean_tokens, min(n) AS min_tokens, max(n) AS max_tokens, median(n)::DOUBLE AS median_tokens FROM (SELECT len(part)::BIGINT AS n FROM {_CHUNKS})")
def chunk_stats(spark, d):
    return RG.chunk_stats(RG.fixed_chunks(docs(spark, d), "doc_id", "text"))


@query("greedy_chunks")
def greedy_chunks(spark, d):
    return RG.chunk(docs(spark, d), "doc_id", "text", 120, "\n")


@query("partial_docs", f"SELECT doc_id, count(DISTINCT chunk_index)::BIGINT AS n_found, max(total_chunks) AS total_chunks FROM {_CHUNKS} WHERE len(part) = 100 GROUP BY 1 HAVING count(DISTINCT chunk_index) < max(total_chunks)")
def partial_docs(spark, d):
    return RG.partial_documents(RG.fixed_chunks(docs(spark, d), "doc_id", "text").where("n_tokens = 100"), "doc_id")


@query("resume_anti_join", f"SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM {_CHUNKS})")
def resume_anti_join(spark, d):
    df = docs(spark, d)
    return RG.missing(df.select("doc_id"), RG.fixed_chunks(df, "doc_id", "text").select("doc_id"), "doc_id")


@query("context_block", f"SELECT doc_id, sha256(string_agg('[' || (chunk_index + 1) || '] ' || array_to_string(part, ' '), chr(10) || chr(10) ORDER BY chunk_index)) AS digest FROM {_CHUNKS} GROUP BY 1")
def context_block(spark, d):
    chunks = RG.fixed_chunks(docs(spark, d), "doc_id", "text")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk"))), lambda x: x["chunk"])  # a document's chunks
    return chunks.groupBy("doc_id").agg(F.sha2(RG.context_block(ordered), 256).alias("digest"))


def _prompt_sql(name: str) -> str:
    a, b, c = re.split(r"\{context_block\}|\{question\}", RG.TEMPLATES[name].replace("'", "''"))
    return f"'{a}' || coalesce(text, '') || '{b}' || coalesce(title, '') || '{c}'"


@query("context_prompts", f"SELECT doc_id, sha256({_prompt_sql('context_only')}) AS strict_prompt, sha256({_prompt_sql('combined')}) AS free_prompt FROM documents")
def context_prompts(spark, d):
    """The two prompts with a document as context and its title as question."""
    made = [F.sha2(RG.context_prompt(F.col("text"), F.col("title"), t), 256) for t in ("context_only", "combined")]
    return docs(spark, d).select("doc_id", made[0].alias("strict_prompt"), made[1].alias("free_prompt"))


@query("paragraph_counts", "SELECT doc_id, len(list_filter(string_split(coalesce(text, ''), chr(10) || chr(10)), lambda p: trim(p, ' ') <> ''))::BIGINT AS n_paragraphs FROM documents")
def paragraph_counts(spark, d):
    return docs(spark, d).select("doc_id", F.size(RG.paragraphs(F.col("text"))).cast("long").alias("n_paragraphs"))


@query("path_metadata", r"""SELECT ext_id, CASE WHEN nullif(regexp_extract(p, '(PMC\d+)', 1), '') IS NOT NULL THEN regexp_extract(p, '(PMC\d+)', 1) WHEN regexp_extract(p, '(NCT\d{8})', 1) <> '' THEN regexp_extract(p, '(NCT\d{8})', 1)
  WHEN regexp_extract(p, '(PMID_?\d+)', 1) <> '' THEN regexp_extract(p, '(PMID_?\d+)', 1) WHEN regexp_extract(p, '([a-z]+_\d+)', 1) <> '' THEN regexp_extract(p, '([a-z]+_\d+)', 1) ELSE regexp_extract(p, '([^/]+?)(?:\.[^./]*)?$', 1) END AS document,
  coalesce(CASE WHEN contains(p, '/pubmed_abstracts/') THEN 'pubmed_abstracts' WHEN contains(p, '/clinical_trials/') THEN 'clinical_trials' WHEN contains(p, '/wikipedia/') THEN 'wikipedia' WHEN contains(p, '/patient_narratives/') THEN 'patient_narratives' WHEN contains(p, '/fda_labels/') THEN 'fda_labels' END, 'unknown') AS kind
  FROM (SELECT ext_id, '/data/' || coalesce(source, 'none') || '/' || coalesce(ext_id, 'none') || '.txt' AS p FROM documents)""")
def path_metadata(spark, d):
    path = F.concat(F.lit("/data/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce("ext_id", F.lit("none")), F.lit(".txt"))
    kind, ident = RG.path_metadata(F.col("p"))
    return docs(spark, d).withColumn("p", path).select("ext_id", ident.alias("document"), kind.alias("kind"))


@query("safe_ids", "SELECT doc_id, regexp_replace(ext_id, '[^a-zA-Z0-9_\\-.]', '_', 'g') AS safe_id FROM documents")
def safe_ids(spark, d):
    from ..sources.io import safe_id

    return docs(spark, d).select("doc_id", safe_id(F.col("ext_id")).alias("safe_id"))


@query("config_sweep", "SELECT a::INT AS chunk_size, b::INT AS top_k, c AS model FROM unnest([256, 512]) x(a), unnest([3, 5, 10]) y(b), unnest(['small', 'large']) z(c)")
def config_sweep(spark, d):
    return RG.sweep(spark, [256, 512], [3, 5, 10], ["small", "large"])


_KNN = """WITH p AS (SELECT q.vec_id AS query, b.vec_id AS neighbour, b.label, list_cosine_similarity(q.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings q, embeddings b WHERE q.vec_id % 100 = 0 AND q.vec_id <> b.vec_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(s, 9) DESC, neighbour) AS rank FROM p)"""


@query("knn_cosine", _KNN + " SELECT query, neighbour, round(s, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 10")
def knn_cosine(spark, d):
    e = table(spark, d, "embeddings")
    return RG.nearest(e, e.where(F.col("vec_id") % 100 == 0), "vec_id", "embedding", 10).select("query", "neighbour", F.round("score", 6).alias("score"), "rank")


@query("knn_l2", """WITH p AS (SELECT q.vec_id AS query, b.vec_id AS neighbour, list_distance(q.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings q, embeddings b WHERE q.vec_id % 100 = 0 AND q.vec_id <> b.vec_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(s, 9), neighbour) AS rank FROM p) SELECT query, neighbour, round(s, 5) AS distance, rank::INT AS rank FROM r WHERE rank <= 10""")
def knn_l2(spark, d):
    e = table(spark, d, "embeddings")
    return RG.nearest(e, e.where(F.col("vec_id") % 100 == 0), "vec_id", "embedding", 10, metric="l2").select("query", "neighbour", F.round(-F.col("score"), 5).alias("distance"), "rank")


@query("knn_label_vote", _KNN + " , v AS (SELECT query, label, count(*) AS n FROM r WHERE rank <= 10 GROUP BY 1, 2) SELECT query, label, n::BIGINT AS n FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY n DESC, label) AS k FROM v) WHERE k = 1")
def knn_label_vote(spark, d):
    e = table(spark, d, "embeddings")
    near = RG.nearest(e, e.where(F.col("vec_id") % 100 == 0), "vec_id", "embedding", 10)
    votes = near.join(e.select(F.col("vec_id").alias("neighbour"), "label"), "neighbour").groupBy("query", "label").agg(F.count("*").alias("n"))
    return votes.groupBy("query").agg(F.min_by(F.struct("label", "n"), F.struct(-F.col("n"), "label")).alias("b")).select("query", "b.label", "b.n")


_WORDS = f"(SELECT word, count(*)::BIGINT AS n FROM (SELECT trim(unnest({w('text')}), '{E.PUNCTUATION.replace(chr(39), chr(39) * 2)}') AS word FROM documents) WHERE length(word) >= 2 GROUP BY 1)"


@query("word_frequencies", f"SELECT * FROM {_WORDS}")
def word_frequencies(spark, d):
    return E.word_counts(docs(spark, d), "text")


@query("case_fold_merge", f"SELECT folded, form, n FROM (SELECT lower(word) AS folded, word AS form, sum(n) OVER (PARTITION BY lower(word))::BIGINT AS n, row_number() OVER (PARTITION BY lower(word) ORDER BY n DESC, word) AS k FROM {_WORDS}) WHERE k = 1")
def case_fold_merge(spark, d):
    return E.folded(E.word_counts(docs(spark, d), "text"))


@query("trial_ids", r"SELECT canonical, count(*)::BIGINT AS frequency FROM (SELECT unnest(regexp_extract_all(text, 'NCT\d{8}')) AS canonical FROM documents) GROUP BY 1")
def trial_ids(spark, d):
    return E.trials(docs(spark, d), "text")


@query("term_classes", f"""SELECT word, n, CASE WHEN regexp_full_match(word, '[A-Z][A-Z0-9]*[0-9][A-Z0-9]*') THEN 'gene' WHEN regexp_full_match(word, '[A-Z]{{2,6}}') THEN 'abbreviation' WHEN regexp_full_match(lower(word), '[a-z]{{3,}}(?:{'|'.join(E.DRUG_ENDINGS)})') THEN 'drug'
  WHEN contains(word, ' ') THEN 'phrase' WHEN regexp_matches(lower(word), '(?:itis|osis|pathy|trophy|plegia|phagia|arthria)$') THEN 'clinical' ELSE 'other' END AS category FROM {_WORDS}""")
def term_classes(spark, d):
    return E.word_counts(docs(spark, d), "text").withColumn("category", E.term_class(F.col("word")))


@query("term_win_loss", f"SELECT word, a, b, CASE WHEN a < b THEN 'a' WHEN a > b THEN 'b' ELSE 'tie' END AS winner FROM (SELECT word, ceil(length(word) / 4.0)::BIGINT AS a, (1 + length(word) // 5)::BIGINT AS b FROM {_WORDS})")
def term_win_loss(spark, d):
    t = E.word_counts(docs(spark, d), "text").select("word", F.ceil(F.length("word") / 4).alias("a"), (1 + F.floor(F.length("word") / 5)).cast("long").alias("b"))
    return TK.win_loss(t, "a", "b")


@query("token_ratios", f"SELECT sum(c // 4)::DOUBLE / sum(w) AS fertility, sum(c)::DOUBLE / sum(c // 4) AS compression FROM (SELECT coalesce(length(text), 0) AS c, len({w('text')}) AS w FROM documents)")
def token_ratios(spark, d):
    s = ST.sized(docs(spark, d)).withColumn("t", F.floor(F.col("n_chars") / 4))
    return TK.ratios(s, "t", "n_words", "n_chars")


@query("fragmentation", f"SELECT length(word)::INT AS size, count(*)::BIGINT AS n_terms, sum((t >= 3)::INT)::BIGINT AS n_fragmented, sum((t = 1)::INT)::BIGINT AS n_single FROM (SELECT word, ceil(length(word) / 4.0) AS t FROM {_WORDS}) GROUP BY 1")
def fragmentation(spark, d):
    t = E.word_counts(docs(spark, d), "text").select(F.length("word").alias("size"), F.ceil(F.length("word") / 4).alias("t"))
    return TK.fragmentation(t, "size", "t")


@query("docs_that_fit", f"SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_tokens, sum((n <= 200)::INT)::BIGINT AS n_fit FROM (SELECT len({w('text')}) AS n FROM documents)")
def docs_that_fit(spark, d):
    return TK.fits(docs(spark, d).select(n_words("text").alias("n")), "n", 200)


@query("minmax_rank", """WITH r AS (SELECT max(p_retailprice) AS hp, min(p_retailprice) AS lp, max(p_size) AS hs, min(p_size) AS ls FROM part), s AS (SELECT p_partkey, (p_retailprice - lp) / (hp - lp) * 0.6::DOUBLE + (1 - (p_size - ls)::DOUBLE / (hs - ls)) * 0.4::DOUBLE AS x FROM part, r)
  SELECT p_partkey, round(x, 6) AS score FROM s""")
def minmax_rank(spark, d):
    return TK.weighted_rank(table(spark, d, "part"), "p_partkey", [("p_retailprice", 0.6, True), ("p_size", 0.4, False)]).select("p_partkey", F.round("score", 6).alias("score"))


@query("vocabulary_difference", f"""WITH a AS (SELECT DISTINCT unnest({w('lower(instruction)')}) AS word FROM synthetic_sft), b AS (SELECT DISTINCT unnest({w('lower(question)')}) AS word FROM eval_questions)
  SELECT word, 'a' AS only_in FROM a WHERE word NOT IN (SELECT word FROM b) UNION ALL SELECT word, 'b' FROM b WHERE word NOT IN (SELECT word FROM a)""")
def vocabulary_difference(spark, d):
    a, b = (table(spark, d, t).select(F.explode(words(F.lower(c))).alias("word")).distinct() for t, c in (("synthetic_sft", "instruction"), ("eval_questions", "question")))
    return TK.vocabulary_difference(a, b, ["word"])


_FIRST = f"coalesce(list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?]){BLANK}', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, chr(32)) <> '')[1], '')"


@query("input_excerpts", f"SELECT doc_id, CASE WHEN {_U.format(43)} < 0.2 THEN CASE WHEN length(f) > 150 THEN substr(f, 1, 147) || '...' ELSE f END ELSE '' END AS input FROM (SELECT doc_id, {_FIRST} AS f FROM documents)")
def input_excerpts(spark, d):
    return docs(spark, d).select("doc_id", P.input_excerpt(F.coalesce("text", F.lit("")), 43, "doc_id").alias("input"))


@query("size_advice", "SELECT source, CASE WHEN n >= 80 THEN 'large' WHEN n > 32 THEN 'medium' ELSE 'small' END AS advice FROM (SELECT source, sum(coalesce(n_chars, 0)) / 1000.0::DOUBLE AS n FROM documents GROUP BY 1)")
def size_advice(spark, d):
    n = docs(spark, d).groupBy("source").agg((F.sum(F.coalesce("n_chars", F.lit(0))) / 1000.0).alias("n"))
    return n.select("source", ST.size_advice(F.col("n")).alias("advice"))


@query("parsed_numbers", r"SELECT DISTINCT t, replace(regexp_extract(t, '([\d,]+(?:\.\d+)?)', 1), ',', '')::DOUBLE * CASE upper(regexp_extract(t, '([KMGT])i?B', 1)) WHEN 'K' THEN 1e3 WHEN 'M' THEN 1e6 WHEN 'G' THEN 1e9 WHEN 'T' THEN 1e12 ELSE 1.0 END AS value FROM (SELECT unnest(regexp_extract_all(text, '~?[0-9][0-9,]*(?:\.[0-9]+)?(?: ?[A-Za-z]+)?')) AS t FROM documents)")
def parsed_numbers(spark, d):
    """Every number of the corpus with the word after it."""
    t = docs(spark, d).select(F.explode(F.regexp_extract_all("text", F.lit(r"~?[0-9][0-9,]*(?:\.[0-9]+)?(?: ?[A-Za-z]+)?"), F.lit(0))).alias("t")).distinct()
    return t.withColumn("value", ST.parse_number(F.col("t")))


@query("near_dup_rate", _SURVIVORS + " SELECT n - k AS n_near, (n - k)::DOUBLE / n AS rate FROM (SELECT (SELECT count(*) FROM documents)::BIGINT AS n, (SELECT count(*) FROM kept)::BIGINT AS k)")
def near_dup_rate(spark, d):
    df = docs(spark, d)
    kept = D.near(df, "doc_id", "text").withColumn("kept", F.lit(1))
    both = df.select("doc_id").join(kept, "doc_id", "left").agg(F.count("*").alias("n"), F.count("kept").alias("k"))
    return both.select((F.col("n") - F.col("k")).alias("n_near"), ST.near_dup_rate(F.col("n") - F.col("k"), F.col("k"), F.col("n") - F.col("k")).alias("rate"))


@query("delta_texts", f"""SELECT category, CASE WHEN o = 0 AND n = 0 THEN '—' WHEN o = 0 THEN 'NEW' ELSE CASE WHEN n > o THEN '+' ELSE '' END || (n - o) || ' (' || CASE WHEN n > o THEN '+' ELSE '' END || format('{{:,.1f}}', 100.0::DOUBLE * (n - o) / o) || ' %)' END AS change,
  CASE WHEN n > o THEN '+' ELSE '' END || format('{{:.1f}}', (n - o)::DOUBLE) || ' pp' AS points FROM (SELECT category, coalesce(a.n, 0)::BIGINT AS o, coalesce(b.n, 0)::BIGINT AS n FROM ({_COUNT.format('verify_results')}) a FULL JOIN ({_COUNT.format('model_comparison_report')}) b USING (category))""")
def delta_texts(spark, d):
    old, new = (ST.counts(table(spark, d, t), "category") for t in ("verify_results", "model_comparison_report"))
    return ST.compare(old, new, "category", "n").select("category", ST.delta_text(F.col("old_value"), F.col("new_value")).alias("change"), ST.points_text(F.col("old_value"), F.col("new_value")).alias("points"))


@query("split_token_stats", f"""WITH s AS (SELECT pair_id, len({w('instruction')})::BIGINT AS p, len({w('output')})::BIGINT AS r FROM (SELECT DISTINCT pair_id, instruction, output FROM synthetic_sft)),
  t AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY md5('42:' || pair_id), pair_id) <= floor(count(*) OVER () * 0.8::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM s)
  SELECT split, count(*)::BIGINT AS n, avg(p)::DOUBLE AS avg_prompt, min(p) AS min_prompt, max(p) AS max_prompt, avg(r)::DOUBLE AS avg_response, min(r) AS min_response, max(r) AS max_response FROM t GROUP BY 1""")
def split_token_stats(spark, d):
    one = SP.head_split(sft(spark, d).dropDuplicates(["pair_id"]), "pair_id").select("split", n_words("instruction").alias("p"), n_words("output").alias("r"))
    return one.groupBy("split").agg(F.count("*").alias("n"), F.avg("p").alias("avg_prompt"), F.min("p").alias("min_prompt"), F.max("p").alias("max_prompt"), F.avg("r").alias("avg_response"), F.min("r").alias("min_response"), F.max("r").alias("max_response"))


@query("symbol_pairs", f"SELECT pair, sum(n)::BIGINT AS n FROM (SELECT unnest(list_transform(range(1, length(word)::BIGINT), lambda i: substr(word, i, 2))) AS pair, n FROM {_WORDS}) GROUP BY 1")
def symbol_pairs(spark, d):
    return TK.pair_counts(E.word_counts(docs(spark, d), "text"), "word", "n")


@query("degraded_terms", f"SELECT word, a, b FROM (SELECT word, ceil(length(word) / 4.0)::BIGINT AS a, (1 + length(word) // 3)::BIGINT AS b FROM {_WORDS}) WHERE b > a")
def degraded_terms(spark, d):
    t = E.word_counts(docs(spark, d), "text").select("word", F.ceil(F.length("word") / 4).alias("a"), (1 + F.floor(F.length("word") / 3)).cast("long").alias("b"))
    return TK.degraded(t, "a", "b")


@query("best_tokenizer", f"""WITH t AS (SELECT ceil(length(word) / 4.0) AS a, 1 + length(word) // 5 AS b FROM {_WORDS}), c AS (SELECT 'a' AS name, sum((a = 1)::INT) AS s, avg(a) AS m, count(*) AS n FROM t UNION ALL SELECT 'b', sum((b = 1)::INT), avg(b), count(*) FROM t)
  SELECT name AS winner, s >= 0.5::DOUBLE * n AS is_enough FROM c ORDER BY s DESC, m LIMIT 1""")
def best_tokenizer(spark, d):
    t = E.word_counts(docs(spark, d), "text").select(F.ceil(F.length("word") / 4).alias("a"), (1 + F.floor(F.length("word") / 5)).cast("long").alias("b"))
    each = t.unpivot([], ["a", "b"], "name", "n").groupBy("name").agg(F.sum((F.col("n") == 1).cast("long")).alias("s"), F.avg("n").alias("m"), F.count("*").alias("terms"))
    return TK.winner(each, "name", "s", "m", "terms")


@query("largest_differences", f"""WITH t AS (SELECT word, ceil(length(word) / 4.0)::BIGINT AS a, (1 + length(word) // 5)::BIGINT AS b FROM {_WORDS}) (SELECT 'a' AS winner, word, b - a AS saved FROM t WHERE a < b ORDER BY saved DESC, word LIMIT 10)
  UNION ALL (SELECT 'b', word, a - b FROM t WHERE b < a ORDER BY a - b DESC, word LIMIT 10)""")
def largest_differences(spark, d):
    t = E.word_counts(docs(spark, d), "text").select("word", F.ceil(F.length("word") / 4).alias("a"), (1 + F.floor(F.length("word") / 5)).cast("long").alias("b"))
    return TK.largest_differences(t, "word", "a", "b")


@query("file_digests")
def file_digests(spark, d):
    """The digest of every table's files."""
    return TK.file_digest(spark, f"{d}/*.parquet").select(F.element_at(F.split("path", "/"), -1).alias("file"), "sha256", "length")