"""Queries over entities: registries of a corpus, candidates in answers, and what the corpus does not know."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions.words import words
from ..operators import entities as E
from ..operators import grounding as VA
from ..operators import scoring as SC
from ..session import materialize, table
from .corpus_queries import _WORDS, docs, w
from .evaluation_queries import _R, results

#: Kinds of places and groups that this corpus names besides institutions.
PATTERNS = [*E.INSTITUTIONS, r"\b[A-Z][\w\-]+ (?:register|registry|survey|panel|site|clinic|choir)\b"]


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(xs) -> str:
    return "[" + ", ".join(map(_text, xs)) + "]::VARCHAR[]"


def _in(xs) -> str:
    return "(" + ", ".join(map(_text, xs)) + ")"


def _seeded_sql(seeds: dict, parts: bool) -> str:
    values = ", ".join(f"({_text(c)}, {_list(a)}, {p}, {_text(x)})" for c, a, p, x in E.seed_rows(seeds, parts))
    return f"""SELECT canonical, aliases, max(m)::BIGINT AS frequency FROM (SELECT canonical, aliases, place, min(coalesce(n, 0)) AS m FROM (VALUES {values}) s(canonical, aliases, place, word)
      LEFT JOIN (SELECT lower(word) AS folded, sum(n) AS n FROM {_WORDS} GROUP BY 1) ON s.word = folded GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING max(m) >= 1"""


def _seed_names(seeds: dict) -> str:
    return _in(sorted({c.lower() for c in seeds} | {a.lower() for v in seeds.values() for a in v}))


_DRUGS = f"""({_seeded_sql(E.DRUG_SEEDS, True)} UNION ALL SELECT lower(word), []::VARCHAR[], max(n)::BIGINT FROM {_WORDS} WHERE length(word) >= 6 AND NOT regexp_matches(word, '[0-9]') AND upper(word) <> word
  AND regexp_matches(lower(word), '(?:{'|'.join(E.DRUG_ENDINGS)})$') AND lower(word) NOT IN {_in(E.NOT_DRUGS)} AND NOT regexp_matches(lower(word), '(?:{'|'.join(E.NOT_DRUGS_BY)})$') AND n >= 2 AND lower(word) NOT IN {_seed_names(E.DRUG_SEEDS)} GROUP BY 1)"""
_GENES = f"""(SELECT canonical, []::VARCHAR[] AS aliases, coalesce(sum(n) FILTER (word = canonical), sum(n))::BIGINT AS frequency FROM (SELECT unnest({_list(E.GENE_SEEDS)}) AS canonical) JOIN {_WORDS} ON lower(word) = lower(canonical) GROUP BY 1
  UNION ALL SELECT word, []::VARCHAR[], n FROM (SELECT word, n, row_number() OVER (PARTITION BY lower(word) ORDER BY n DESC, word) AS k FROM {_WORDS} WHERE regexp_matches(word, '^[A-Z][A-Z0-9]+(?:orf[0-9]+)?(?:-[A-Z0-9]+)?$')
    AND regexp_matches(word, '[0-9]') AND length(word) BETWEEN 2 AND 10 AND NOT regexp_matches(word, '^[A-Z][0-9]{{1,2}}$') AND word NOT IN {_in(E.NOT_GENES)} AND n >= 3 AND lower(word) NOT IN {_in([g.lower() for g in E.GENE_SEEDS])}) WHERE k = 1)"""
_PROTEINS = f"""({_seeded_sql(E.PROTEIN_SEEDS, False)} UNION ALL SELECT lower(word), []::VARCHAR[], max(n)::BIGINT FROM {_WORDS} WHERE length(word) >= 4 AND regexp_matches(lower(word), '^[a-z-]*(?:ase|{'|'.join(E.PROTEIN_ENDINGS)})$')
  AND lower(word) NOT IN {_in(E.NOT_DRUGS)} AND lower(word) NOT IN {_seed_names(E.PROTEIN_SEEDS)} GROUP BY 1)"""
_TRIALS = r"(SELECT canonical, []::VARCHAR[] AS aliases, count(*)::BIGINT AS frequency FROM (SELECT unnest(regexp_extract_all(text, 'NCT\d{8}')) AS canonical FROM documents) GROUP BY 1)"
_FOUND = " UNION ALL ".join(f"SELECT unnest(regexp_extract_all(text, '{p}')) AS m FROM documents WHERE text IS NOT NULL" for p in PATTERNS)
_INSTITUTIONS = rf"""(SELECT form AS canonical, []::VARCHAR[] AS aliases, n::BIGINT AS frequency FROM (SELECT form, sum(n) OVER (PARTITION BY lower(form)) AS n, row_number() OVER (PARTITION BY lower(form) ORDER BY n DESC, form) AS k
  FROM (SELECT trim(regexp_replace(m, '[ \t]+', ' ', 'g'), ' ') AS form, count(*) AS n FROM ({_FOUND}) GROUP BY 1) WHERE length(form) >= 10 AND lower(form) NOT IN {_in(E.NOT_INSTITUTIONS)}) WHERE k = 1)"""
_REGISTRY = " UNION ALL ".join(f"SELECT '{n}' AS etype, * FROM {t}" for n, t in (("drugs", _DRUGS), ("genes", _GENES), ("proteins", _PROTEINS), ("trials", _TRIALS), ("institutions", _INSTITUTIONS)))
_NAMES = f"(SELECT DISTINCT etype, lower(unnest(list_prepend(canonical, aliases))) AS name FROM ({_REGISTRY}))"


def counts(spark, d):
    return E.word_counts(docs(spark, d), "text")


@query("drug_registry", f"SELECT * FROM {_DRUGS}")
def drug_registry(spark, d):
    return E.drugs(counts(spark, d))


@query("gene_registry", f"SELECT * FROM {_GENES}")
def gene_registry(spark, d):
    return E.genes(counts(spark, d))


@query("protein_registry", f"SELECT * FROM {_PROTEINS}")
def protein_registry(spark, d):
    return E.proteins(counts(spark, d))


@query("institution_registry", f"SELECT canonical, frequency FROM {_INSTITUTIONS}")
def institution_registry(spark, d):
    return E.institutions(docs(spark, d), "text", PATTERNS)


@query("entity_registry", _REGISTRY)
def entity_registry(spark, d):
    return E.registry(docs(spark, d), "text", patterns=PATTERNS)


def names(spark, d):
    """Lower-cased names and aliases of the corpus, by type."""
    return materialize(E.known_names(E.registry(docs(spark, d), "text", patterns=PATTERNS)), "names")


_CLASS = f"""CASE WHEN regexp_full_match(word, '[A-Z][A-Z0-9]*[0-9][A-Z0-9]*') THEN 'gene' WHEN regexp_full_match(word, '[A-Z]{{2,6}}') THEN 'abbreviation' WHEN regexp_full_match(lower(word), '[a-z]{{3,}}(?:{'|'.join(E.DRUG_ENDINGS)})') THEN 'drug'
  WHEN contains(word, ' ') THEN 'phrase' WHEN regexp_matches(lower(word), '(?:itis|osis|pathy|trophy|plegia|phagia|arthria)$') THEN 'clinical' ELSE 'other' END"""
_CURATED = {g: "gene" for g in E.GENE_SEEDS} | {s: "drug" for s in E.DRUG_SEEDS}
_TERMS = f"""(SELECT term, category, frequency, CASE p WHEN 0 THEN 'curated' ELSE 'auto' END AS source FROM (SELECT *, row_number() OVER (PARTITION BY lower(term) ORDER BY p, frequency DESC, term) AS r FROM (
  SELECT term, category, min(coalesce(n, 0))::BIGINT AS frequency, 0 AS p FROM (SELECT term, category, unnest(string_split(lower(term), ' ')) AS part FROM (VALUES {', '.join(f'({_text(t)}, {_text(c)})' for t, c in _CURATED.items())}) v(term, category))
    LEFT JOIN (SELECT lower(word) AS folded, sum(n) AS n FROM {_WORDS} GROUP BY 1) ON part = folded GROUP BY 1, 2
  UNION ALL SELECT word, {_CLASS}, n, 1 FROM {_WORDS})) WHERE r = 1)"""


def terms(spark, d):
    auto = counts(spark, d).select(F.col("word").alias("term"), E.term_class(F.col("word")).alias("category"), F.col("n").alias("frequency"))
    curated = E.term_frequency(spark.createDataFrame(list(_CURATED.items()), "term string, category string"), counts(spark, d))
    return E.merged_terms(curated, auto)


@query("merged_terms", f"SELECT * FROM {_TERMS}")
def merged_terms(spark, d):
    return terms(spark, d)


@query("specific_terms", f"SELECT term, category, frequency, source FROM {_TERMS} WHERE lower(term) NOT IN (SELECT DISTINCT lower(unnest({w('instruction')})) FROM synthetic_sft) ORDER BY frequency DESC, term LIMIT 100")
def specific_terms(spark, d):
    """The commonest terms of the corpus that no instruction uses as a word."""
    general = table(spark, d, "synthetic_sft").select(F.explode(words("instruction")).alias("word"))
    return E.top_terms(terms(spark, d), general, 100)


_NOT = _in(E.NOT_CANDIDATES)
_T = f"(SELECT result_id, coalesce(response, '') AS t FROM {_R})"
_FOUND_IN = f"""(SELECT result_id, 'drugs' AS etype, unnest(list_distinct(list_concat(
    list_filter(regexp_extract_all(t, '{E.TOKEN}'), lambda x: length(x) BETWEEN 3 AND 30 AND upper(x) NOT IN {_NOT} AND (regexp_matches(x, '{E.CAPITALISED}') OR regexp_matches(x, '{E.ENDING}'))),
    list_filter(regexp_extract_all(t, '{E.PHRASE}', 1), lambda p: length(p) > 5)))) AS entity FROM {_T}
  UNION ALL SELECT result_id, 'genes', unnest(list_distinct(list_concat(list_filter(regexp_extract_all(t, '{E.PART}'), lambda g: regexp_matches(g, '{E.GENE_PART}') AND upper(g) NOT IN {_NOT} AND (regexp_matches(g, '[0-9]') OR upper(g) = g)),
    list_filter(regexp_extract_all(t, '{E.TOKEN}'), lambda g: regexp_matches(g, '{E.GENE_NUMBERED}'))))) FROM {_T}
  UNION ALL SELECT result_id, 'trials', unnest(list_distinct(list_transform(list_filter(regexp_extract_all(t, '{E.TRIAL}([A-Za-z0-9_]?)'), lambda m: regexp_matches(m, '[0-9]{{8}}$') AND NOT regexp_matches(m, '[0-9]{{9}}$')), lambda m: regexp_extract(m, 'NCT[0-9]{{8}}')))) FROM {_T})"""
_CANDIDATES = f"""(SELECT c.* FROM {_FOUND_IN} c WHERE NOT EXISTS (SELECT 1 FROM {_NAMES} k WHERE k.name = lower(c.entity) AND k.etype = CASE c.etype WHEN 'drugs' THEN 'genes' WHEN 'genes' THEN 'drugs' END))"""


@query("entity_candidates", f"SELECT * FROM {_CANDIDATES}")
def entity_candidates(spark, d):
    return E.candidates(results(spark, d), "result_id", "response", names(spark, d))


@query("registry_exact", f"SELECT c.*, k.name IS NOT NULL AS is_known FROM {_CANDIDATES} c LEFT JOIN {_NAMES} k ON k.etype = c.etype AND k.name = lower(c.entity)")
def registry_exact(spark, d):
    """Candidates and whether the registry has them, in any case."""
    known = names(spark, d)
    found = E.candidates(results(spark, d), "result_id", "response", known).withColumn("name", F.lower("entity"))
    return found.join(known.withColumn("k", F.lit(True)), ["etype", "name"], "left").select("result_id", "etype", "entity", F.coalesce("k", F.lit(False)).alias("is_known"))


def looked(spark, d):
    known = names(spark, d)
    return E.lookup(E.candidates(results(spark, d), "result_id", "response", known), known)


@query("fabrication_rollup")
def fabrication_rollup(spark, d):
    return E.flag_rates(looked(spark, d))


@query("flagged_entities")
def flagged_entities(spark, d):
    """Every flagged candidate with the sentence that names it."""
    flagged = looked(spark, d).where("flagged").select("result_id", "etype", "entity")
    texts = results(spark, d).select("result_id", "response")
    return flagged.join(texts, "result_id").select("result_id", "etype", "entity", E.context(F.col("response"), F.col("entity")).alias("context"))


@query("entity_contexts", f"""SELECT result_id, etype, entity, trim(coalesce(list_filter(string_split(regexp_replace(response, '([.!?])[ \\t\\n\\r\\f]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: contains(lower(s), lower(entity)))[1],
  CASE WHEN strpos(lower(response), lower(entity)) > 0 THEN substr(response, greatest(strpos(lower(response), lower(entity)) - 50, 1), length(entity) + 50 + least(strpos(lower(response), lower(entity)) - 1, 50)) END, substr(response, 1, 200)), ' ') AS context
  FROM {_CANDIDATES} JOIN (SELECT result_id, response FROM {_R}) USING (result_id)""")
def entity_contexts(spark, d):
    r = results(spark, d).select("result_id", "response")
    found = E.candidates(r, "result_id", "response", names(spark, d))
    return found.join(r, "result_id").select("result_id", "etype", "entity", E.context(F.col("response"), F.col("entity")).alias("context"))


@query("entity_grounding")
def entity_grounding(spark, d):
    """Per pair: candidates of its output, those the corpus does not know, and whether it knows them all."""
    return VA.entity_verdicts(pairs(spark, d), "pair_id", "output", names(spark, d))


def pairs(spark, d):
    return table(spark, d, "synthetic_sft").dropDuplicates(["pair_id"])


@query("top_flagged")
def top_flagged(spark, d):
    return SC.top_k(looked(spark, d).where("flagged"), "entity")


@query("coherent_fabrication")
def coherent_fabrication(spark, d):
    rows = results(spark, d).withColumnRenamed("coherent", "is_coherent")
    return SC.fabrication_of_coherent(rows, looked(spark, d), "result_id")


@query("registry_rules", """SELECT etype, canonical, error FROM (SELECT content_tier AS etype, title AS canonical, unnest(list_filter([CASE WHEN coalesce(content_tier NOT IN ('drugs', 'genes', 'proteins', 'trials', 'institutions'), true) THEN 'bad_type' END,
  CASE WHEN trim(coalesce(title, ''), ' ') = '' THEN 'missing_canonical' END, CASE WHEN coalesce(n_chars, 0) < 1 THEN 'bad_frequency' END], lambda e: e IS NOT NULL)) AS error FROM documents)
  UNION ALL SELECT content_tier, min(title), 'duplicate' FROM documents GROUP BY content_tier, lower(title) HAVING count(*) > 1""")
def registry_rules(spark, d):
    """The rules over a registry that breaks them: documents read as entities, with tier, title and length as type, name and frequency."""
    return SC.registry_errors(docs(spark, d).select(F.col("content_tier").alias("etype"), F.col("title").alias("canonical"), F.col("n_chars").alias("frequency")))


@query("validation_cascade")
def validation_cascade(spark, d):
    """Pairs that are rejected, and why: entities the corpus does not know, no support in the corpus, wording of the benchmark."""
    questions = table(spark, d, "eval_questions")
    support = VA.corpus_support(pairs(spark, d), "pair_id", "output", docs(spark, d), "doc_id", "text")
    leaked = VA.question_leaks(pairs(spark, d), "pair_id", "instruction", "output", questions, "question_id", "question", "prompt_template", "verified_answer")
    return VA.validated(pairs(spark, d), "pair_id", entity_grounding(spark, d), support, leaked, "question_id")[1].select("pair_id", "reason", "n_unknown", "support", "question_id")


@query("partial_leaks")
def partial_leaks(spark, d):
    """Every match of an instruction with a question or prompt, and of an output with a long key fact, by partial ratio."""
    return VA.partial_leaks(pairs(spark, d), "pair_id", "instruction", "output", table(spark, d, "eval_questions"), "question_id", "question", "prompt_template", "key_facts")
