"""Queries over answers, questions and reports: grounding, scores, taxonomies, comparisons, logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import entities as E
from ..operators import grounding as VA
from ..operators import logs as TL
from ..operators import predicates as PR
from ..operators import retrieval as RG
from ..operators import scoring as SC
from ..session import table

W = r"[^a-z0-9]+"


def results(spark, d):
    return table(spark, d, "verify_results").dropDuplicates(["result_id"])


def questions(spark, d):
    return table(spark, d, "eval_questions")


def facts(spark, d):
    return questions(spark, d).select("question_id", F.explode("key_facts").alias("fact"))


_R = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY loaded_at) AS rn FROM verify_results) WHERE rn = 1)"


@query("coherence_native", """WITH r AS (SELECT result_id, trim(coalesce(response, ''), chr(32)) AS t FROM """ + _R + r"""), g AS (SELECT result_id, t, list_filter(regexp_split_to_array(lower(t), '[ \t\n\r\f]+'), lambda w: w <> '') AS w FROM r),
  h AS (SELECT result_id, max(n) AS m FROM (SELECT result_id, g, count(*) AS n FROM (SELECT result_id, unnest(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: array_to_string(w[i:i + 2], ' '))) AS g FROM g) GROUP BY 1, 2) GROUP BY 1)
  SELECT result_id, length(t) > 0 AND NOT (len(w) >= 6 AND coalesce(m, 0) >= 4) AND length(regexp_replace(t, '[^A-Za-z0-9]', '', 'g')) / greatest(length(t), 1) >= 0.2 AS is_coherent FROM g LEFT JOIN h USING (result_id)""")
def coherence_native(spark, d):
    return results(spark, d).select("result_id", PR.native_coherent(F.col("response")).alias("is_coherent"))


@query("coherence_full")
def coherence_full(spark, d):
    return results(spark, d).select("result_id", PR.coherent(F.col("response")).alias("is_coherent"), PR.coherent(F.col("response"), 20, False).alias("is_coherent_sft"))


@query("coherence_verdict", f"SELECT model_tag, sum(coherent::INT)::BIGINT AS n_passed, count(*)::BIGINT AS n, CASE WHEN count(*) > 0 AND sum(coherent::INT)::DOUBLE / count(*) >= 0.7 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM {_R} WHERE coherent IS NOT NULL GROUP BY 1")
def coherence_verdict(spark, d):
    g = results(spark, d).where(F.col("coherent").isNotNull()).groupBy("model_tag").agg(F.sum(F.col("coherent").cast("long")).alias("n_passed"), F.count("*").alias("n"))
    return g.withColumn("verdict", PR.verdict(F.col("n_passed"), F.col("n")))


def _ws(x: str) -> str:
    return f"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce({x}, '')), '{W}', ' ', 'g'), '[ ]+'), lambda w: w <> '')"


def _grams(t: str, key: str, x: str) -> str:
    return f"SELECT DISTINCT {key}, unnest(CASE WHEN len(w) >= 8 THEN list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' ')) ELSE [] END) AS g FROM (SELECT {key}, {_ws(x)} AS w FROM {t})"


@query("ngram_overlap", f"SELECT pair_id, question_id, count(*)::BIGINT AS n_shared FROM ({_grams('synthetic_sft', 'pair_id', 'output')}) JOIN ({_grams('eval_questions', 'question_id', 'question')}) USING (g) GROUP BY 1, 2")
def ngram_overlap(spark, d):
    sft = table(spark, d, "synthetic_sft").dropDuplicates(["pair_id"])
    return VA.passage_hits(sft, "pair_id", "output", questions(spark, d), "question_id", "question")


@query("token_jaccard", f"""WITH a AS (SELECT DISTINCT pair_id, unnest({_ws('instruction')}) AS t FROM synthetic_sft), b AS (SELECT DISTINCT question_id, unnest({_ws('question')}) AS t FROM eval_questions),
  na AS (SELECT pair_id, count(*) AS n FROM a GROUP BY 1), nb AS (SELECT question_id, count(*) AS n FROM b GROUP BY 1), s AS (SELECT pair_id, question_id, count(*) AS k FROM a JOIN b USING (t) GROUP BY 1, 2)
  SELECT pair_id AS a, question_id AS b, k::BIGINT AS n_shared, (na.n + nb.n - k)::BIGINT AS n_union FROM s JOIN na USING (pair_id) JOIN nb USING (question_id) WHERE k >= 0.2::DOUBLE * (na.n + nb.n - k)""")
def token_jaccard(spark, d):
    sft = table(spark, d, "synthetic_sft").dropDuplicates(["pair_id"])
    return VA.token_jaccard(sft, questions(spark, d), "pair_id", "question_id", "instruction", "question", 0.2)


@query("question_leaks")
def question_leaks(spark, d):
    sft = table(spark, d, "synthetic_sft").dropDuplicates(["pair_id"])
    return VA.question_leaks(sft, "pair_id", "instruction", "output", questions(spark, d), "question_id", "question", "prompt_template", "verified_answer")


def _trials_sql(x: str) -> str:
    return f"list_distinct(list_transform(list_filter(regexp_extract_all(coalesce({x}, ''), '{E.TRIAL}([A-Za-z0-9_]?)'), lambda m: regexp_matches(m, '[0-9]{{8}}$') AND NOT regexp_matches(m, '[0-9]{{9}}$')), lambda m: regexp_extract(m, 'NCT[0-9]{{8}}')))"


@query("trial_candidates", rf"SELECT result_id, unnest({_trials_sql('response')}) AS entity FROM {_R} WHERE response IS NOT NULL")
def trial_candidates(spark, d):
    return results(spark, d).select("result_id", F.explode(E.trial_candidates(F.col("response"))).alias("entity"))


@query("score_windows", f"SELECT result_id, CASE WHEN n <= 100 THEN 1 ELSE ceil((n - 100) / 50.0)::BIGINT + 1 END AS n_windows FROM (SELECT result_id, length(trim(coalesce(response, ''), chr(32)))::BIGINT AS n FROM {_R})")
def score_windows(spark, d):
    return results(spark, d).select("result_id", F.size(SC.windows(F.col("response"))).cast("long").alias("n_windows"))


def _hedge_sql(x: str) -> str:
    t = f"lower(coalesce({x}, ''))"
    words = "|".join(SC.HEDGES)
    phrases = " + ".join(f"(length({t}) - length(replace({t}, '{p}', ''))) // {len(p)}" for p in SC.HEDGE_PHRASES)
    return rf"(len(regexp_extract_all({t}, '\b(?:{words})\b')) + {phrases})::BIGINT"


@query("hedging_counts", f"SELECT result_id, {_hedge_sql('response')} AS n_hedges FROM {_R}")
def hedging_counts(spark, d):
    return results(spark, d).select("result_id", SC.hedges(F.col("response")).alias("n_hedges"))


_FACTS = f"""(SELECT r.result_id, r.question_id, r.category, r.tokens_generated, r.coherent, r.model_tag, r.response, q.difficulty, q.is_trap, len(q.key_facts)::BIGINT AS n_facts,
  len(list_filter(q.key_facts, lambda f: contains(lower(coalesce(r.response, '')), lower(f))))::BIGINT AS n_found FROM {_R} r JOIN eval_questions q USING (question_id))"""


def exact_scores(spark, d):
    """Answers with the share of key facts that stand in them word for word: facts are joined as an array, one row per answer."""
    q = questions(spark, d).select("question_id", "difficulty", "is_trap", "key_facts")
    low = F.lower(F.coalesce("response", F.lit("")))
    r = results(spark, d).join(q, "question_id").withColumn("n_facts", F.size("key_facts").cast("long")).withColumn("n_found", F.size(F.filter("key_facts", lambda f: F.contains(low, F.lower(f)))).cast("long"))
    return r.withColumn("accuracy", F.col("n_found") / F.col("n_facts")).withColumn("is_correct", (F.col("accuracy") >= 0.5).cast("int"))


@query("exact_fact_scores", f"SELECT result_id, n_facts, n_found FROM {_FACTS}")
def exact_fact_scores(spark, d):
    return exact_scores(spark, d).select("result_id", "n_facts", "n_found")


@query("fuzzy_fact_scores")
def fuzzy_fact_scores(spark, d):
    return SC.question_scores(results(spark, d).select("result_id", "question_id", "response"), "result_id", "response", facts(spark, d), "question_id", "fact").select("result_id", "n_facts", "n_found", "accuracy", "is_correct")


@query("fuzzy_window_scores")
def fuzzy_window_scores(spark, d):
    """Key facts by windows of the answers, as the original rule has it."""
    told = VA.fact_matches(results(spark, d).select("result_id", "question_id", "response"), "result_id", "response", facts(spark, d), "fact", "question_id", strict=True)
    return told.groupBy("result_id").agg(F.count("*").alias("n_facts"), F.count_if("found").alias("n_found"))


@query("score_grouping_sets", f"""SELECT category, difficulty, is_trap, grouping(category, difficulty, is_trap)::BIGINT AS level, count(*)::BIGINT AS n, avg(a) AS mean_accuracy, median(a) AS median_accuracy, sum((a >= 0.5)::INT)::BIGINT AS n_correct
  FROM (SELECT *, n_found::DOUBLE / n_facts AS a FROM {_FACTS}) GROUP BY GROUPING SETS ((), (category), (difficulty), (is_trap))""")
def score_grouping_sets(spark, d):
    return SC.score_sets(exact_scores(spark, d), ["category", "difficulty", "is_trap"])


_RULES = """list_filter([CASE WHEN f > 0 AND h <= 1 THEN {'m': 'confident_fabrication', 's': 'high'} END, CASE WHEN category IN ('temporal_accuracy', 'clinical_trials') AND a < 0.5 THEN {'m': 'outdated_information', 's': 'medium'} END,
  CASE WHEN a >= 0.2 AND a < 0.5 AND f = 0 THEN {'m': 'plausible_blending', 's': CASE WHEN h = 0 THEN 'high' ELSE 'medium' END} END, CASE WHEN a < 0.3 AND h >= 2 AND f = 0 THEN {'m': 'boundary_confusion', 's': CASE WHEN h >= 3 THEN 'low' ELSE 'medium' END} END,
  CASE WHEN a >= 0.5 AND h = 0 AND difficulty IN ('hard', 'medium') THEN {'m': 'accurate_but_misleading', 's': CASE WHEN difficulty = 'hard' THEN 'medium' ELSE 'low' END} END], lambda x: x IS NOT NULL)"""
_TAX = f"""(SELECT *, CASE WHEN NOT coalesce(coherent, true) THEN 'degenerate' WHEN f > 0 AND h <= 1 THEN 'confident_fabrication' WHEN category IN ('temporal_accuracy', 'clinical_trials') AND a < 0.5 THEN 'outdated_information'
  WHEN a >= 0.2 AND a < 0.5 AND f = 0 THEN 'plausible_blending' WHEN a < 0.3 AND h >= 2 AND f = 0 THEN 'boundary_confusion' WHEN a >= 0.5 AND h = 0 AND difficulty IN ('hard', 'medium') THEN 'accurate_but_misleading'
  WHEN a >= 0.5 THEN 'accurate' WHEN a < 0.2 AND tokens_generated < 10 THEN 'degenerate' ELSE 'plausible_blending' END AS primary_mode
  FROM (SELECT *, {_RULES} AS rules FROM (SELECT *, n_found::DOUBLE / n_facts AS a, {_hedge_sql('response')} AS h, len(list_distinct(regexp_extract_all(coalesce(response, ''), 'NCT[0-9]{{8}}')))::BIGINT AS f FROM {_FACTS})))"""
_SEVERITY = "CASE WHEN NOT coalesce(coherent, true) THEN 'low' ELSE coalesce(rules[1].s, CASE WHEN a >= 0.5 THEN 'none' WHEN a < 0.2 AND tokens_generated < 10 THEN 'low' ELSE 'medium' END) END"


def modes(spark, d):
    s = exact_scores(spark, d).withColumn("h", SC.hedges(F.col("response"))).withColumn("f", F.size(F.array_distinct(F.regexp_extract_all(F.coalesce("response", F.lit("")), F.lit("NCT[0-9]{8}"), F.lit(0)))).cast("long"))
    return SC.taxonomy(s, "accuracy", "h", "f", "category", "difficulty", "tokens_generated", "coherent")


@query("taxonomy_case", f"SELECT result_id, primary_mode FROM {_TAX}")
def taxonomy_case(spark, d):
    return modes(spark, d).select("result_id", "primary_mode")


@query("taxonomy_severity", f"SELECT result_id, CASE WHEN coalesce(coherent, true) THEN rules[2].m END AS secondary_mode, {_SEVERITY} AS severity FROM {_TAX}")
def taxonomy_severity(spark, d):
    return modes(spark, d).select("result_id", "secondary_mode", "severity")


@query("taxonomy_distribution", f"SELECT m AS primary_mode, count(t.result_id)::BIGINT AS n FROM unnest({SC.MODES}) u(m) LEFT JOIN {_TAX} t ON t.primary_mode = m GROUP BY 1")
def taxonomy_distribution(spark, d):
    return SC.mode_distribution(modes(spark, d))


@query("taxonomy_override", f"SELECT result_id, CASE WHEN question_id = 'DRUG-001' THEN 'accurate' ELSE primary_mode END AS primary_mode, question_id = 'DRUG-001' AS override FROM {_TAX}")
def taxonomy_override(spark, d):
    m = modes(spark, d)
    manual = m.where("question_id = 'DRUG-001'").select("result_id", F.lit("accurate").alias("primary_mode"))
    return SC.overridden(m, manual, "result_id").select("result_id", "primary_mode", "override")


_X = f"(SELECT *, n_found::DOUBLE / n_facts AS a FROM {_FACTS})"


@query("best_worst_edge", f"""(SELECT 'best' AS kind, result_id FROM {_X} WHERE a >= 0.5 ORDER BY a DESC, result_id LIMIT 5) UNION ALL (SELECT 'worst', result_id FROM {_X} WHERE tokens_generated >= 10 ORDER BY a, result_id LIMIT 5)
  UNION ALL (SELECT 'edge', result_id FROM {_X} ORDER BY abs(a - 0.5), result_id LIMIT 5)""")
def best_worst_edge(spark, d):
    return SC.extremes(exact_scores(spark, d), "result_id").select("kind", "result_id")


@query("capability_gap", f"SELECT model_tag, 100.0::DOUBLE * avg(coalesce(coherent, true)::INT) AS coherence_pct, 100.0::DOUBLE * avg(a) AS accuracy_pct, 100.0::DOUBLE * avg(coalesce(coherent, true)::INT) - 100.0::DOUBLE * avg(a) AS gap FROM {_X} GROUP BY 1")
def capability_gap(spark, d):
    return SC.capability_gap(exact_scores(spark, d).withColumnRenamed("coherent", "is_coherent"), "model_tag")


_TRIALS = f"""(SELECT result_id, count(*)::BIGINT AS n_trials, count(*) FILTER (t NOT IN (SELECT unnest(regexp_extract_all(text, 'NCT[0-9]{{8}}')) FROM documents WHERE text IS NOT NULL))::BIGINT AS n_unknown
  FROM (SELECT result_id, unnest({_trials_sql('response')}) AS t FROM {_R}) GROUP BY 1)"""


def trial_flags(spark, d):
    """Answers with their trial ids, and how many of these the corpus does not hold."""
    found = results(spark, d).select("result_id", F.explode(E.trial_candidates(F.coalesce("response", F.lit("")))).alias("canonical"))
    known = E.trials(table(spark, d, "documents"), "text").select("canonical", F.lit(1).alias("known"))
    return found.join(known, "canonical", "left").groupBy("result_id").agg(F.count("*").alias("n_trials"), F.count_if(F.col("known").isNull()).alias("n_unknown"))


@query("ablation_delta", f"""WITH m AS (SELECT model_tag, avg(a) AS a, coalesce(sum(n_unknown)::DOUBLE / nullif(sum(n_trials), 0), 0) AS f, 100.0::DOUBLE * avg(coalesce(coherent, true)::INT) AS c FROM {_X} LEFT JOIN {_TRIALS} USING (result_id) GROUP BY 1)
  SELECT m.model_tag, m.a - b.a AS delta_accuracy, m.f - b.f AS delta_fabrication, m.c - b.c AS delta_coherence FROM m, (SELECT * FROM m WHERE model_tag = (SELECT min(model_tag) FROM m)) b""")
def ablation_delta(spark, d):
    rows = exact_scores(spark, d).join(trial_flags(spark, d), "result_id", "left")
    fabrication = F.coalesce(F.sum("n_unknown") / F.nullif(F.sum("n_trials"), F.lit(0)), F.lit(0.0))
    return SC.ablation(rows, "model_tag", {"accuracy": F.avg("accuracy"), "fabrication": fabrication, "coherence": 100.0 * F.avg(F.coalesce("coherent", F.lit(True)).cast("double"))})


@query("metric_pivot", f"SELECT * FROM (PIVOT (SELECT difficulty, model_tag, a FROM {_X}) ON model_tag USING avg(a) GROUP BY difficulty)")
def metric_pivot(spark, d):
    return SC.metric_pivot(exact_scores(spark, d), "difficulty", "model_tag", "accuracy")


@query("spread_judgement", f"""WITH m AS (SELECT model_tag, difficulty, avg(a) AS a FROM {_X} GROUP BY 1, 2) SELECT difficulty, max(a) - min(a) AS spread, CASE WHEN max(a) - min(a) > 0.1 THEN 'large' WHEN max(a) - min(a) > 0.05 THEN 'notable' ELSE 'small' END AS judgement FROM m GROUP BY 1""")
def spread_judgement(spark, d):
    one = exact_scores(spark, d).groupBy("model_tag", "difficulty").agg(F.avg("accuracy").alias("accuracy"))
    return SC.spread_judgement(one, "difficulty", "accuracy")


MODELS = ["scratch_500m", "gpt2_large_finetune", "scratch_1b_base", "scratch_1b_instruct"]
_LONG = " UNION ALL ".join(f"SELECT sample_id, question_id, category, '{m}' AS model, {m}_taxonomy AS mode, {m}_label AS label FROM model_comparison_report" for m in MODELS)


def long_report(spark, d):
    one = F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"{m}_taxonomy").alias("mode"), F.col(f"{m}_label").alias("label")) for m in MODELS])
    return table(spark, d, "model_comparison_report").dropDuplicates(["sample_id"]).select("sample_id", "question_id", "category", F.explode(one).alias("x")).select("sample_id", "question_id", "category", "x.*")


@query("disagreement", f"SELECT sample_id, count(DISTINCT model)::BIGINT AS n_models, array_to_string(list_sort(list_distinct(list(mode))), ',') AS modes FROM ({_LONG}) WHERE mode IS NOT NULL GROUP BY 1 HAVING count(DISTINCT model) = 4 AND count(DISTINCT mode) > 1")
def disagreement(spark, d):
    return SC.disagreement(long_report(spark, d).where(F.col("mode").isNotNull()), "sample_id", "model", "mode", 4).withColumn("modes", F.array_join("modes", ","))


@query("label_distribution", f"SELECT model, label, count(*)::BIGINT AS n FROM (SELECT DISTINCT * FROM ({_LONG})) GROUP BY 1, 2")
def label_distribution(spark, d):
    return long_report(spark, d).groupBy("model", "label").agg(F.count("*").alias("n"))


_C = f"(SELECT sample_id, category, count(DISTINCT mode)::BIGINT AS n_modes, count(DISTINCT label)::BIGINT AS spread FROM ({_LONG}) GROUP BY 1, 2)"


@query("contrast_quota", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n_modes DESC, spread DESC, sample_id) AS k FROM {_C}), s AS (SELECT sample_id, category, n_modes, spread FROM r WHERE k <= 3 ORDER BY n_modes DESC, spread DESC, sample_id LIMIT 14)
  SELECT sample_id, n_modes FROM s UNION ALL (SELECT sample_id, n_modes FROM {_C} WHERE sample_id NOT IN (SELECT sample_id FROM s) ORDER BY n_modes DESC, spread DESC, sample_id LIMIT 2)""")
def contrast_quota(spark, d):
    items = long_report(spark, d).groupBy("sample_id", "category").agg(F.count_distinct("mode").alias("n_modes"), F.count_distinct("label").alias("spread"))
    return SC.contrast(items, "sample_id", "category", 16).select("sample_id", "n_modes")


@query("pattern_exemplars", f"SELECT 'all_agree' AS pattern, min(sample_id) AS sample_id FROM {_C} WHERE n_modes = 1 HAVING count(*) > 0 UNION ALL SELECT 'all_differ', min(sample_id) FROM {_C} WHERE n_modes >= 3 HAVING count(*) > 0")
def pattern_exemplars(spark, d):
    items = long_report(spark, d).groupBy("sample_id", "category").agg(F.count_distinct("mode").alias("n_modes"))
    return SC.exemplars(items, "sample_id", ["sample_id"], {"all_agree": F.col("n_modes") == 1, "all_differ": F.col("n_modes") >= 3})


_KIND = "CASE WHEN n_found > 0 THEN 'generation_failure' ELSE 'retrieval_failure' END"


@query("pattern_rows", f"""WITH p AS (SELECT 'all_agree' AS pattern, 0 AS o, min(sample_id) AS sample_id FROM {_C} WHERE n_modes = 1 HAVING count(*) > 0 UNION ALL SELECT 'all_differ', 1, min(sample_id) FROM {_C} WHERE n_modes >= 3 HAVING count(*) > 0 UNION ALL SELECT 'any', 2, min(sample_id) FROM {_C} HAVING count(*) > 0),
  c AS (SELECT sample_id, arg_min(pattern, o) AS pattern, min(o) AS o FROM p GROUP BY 1), r AS (SELECT sample_id, NULL::VARCHAR AS pattern, 3 AS o FROM (SELECT DISTINCT sample_id FROM {_C}) WHERE sample_id NOT IN (SELECT sample_id FROM c)) SELECT sample_id, pattern FROM (SELECT * FROM c UNION ALL SELECT * FROM r) ORDER BY o, sample_id LIMIT 5""")
def pattern_rows(spark, d):
    items = long_report(spark, d).groupBy("sample_id", "category").agg(F.count_distinct("mode").alias("n_modes"))
    return SC.exemplar_rows(items, "sample_id", ["sample_id"], {"all_agree": F.col("n_modes") == 1, "all_differ": F.col("n_modes") >= 3, "any": F.lit(True)}, 5)


@query("failure_decomposition", f"SELECT CASE WHEN grouping(c) = 1 THEN '(all)' ELSE c END AS category, CASE WHEN grouping(k) = 1 THEN '(all)' ELSE k END AS failure, count(*)::BIGINT AS n FROM (SELECT coalesce(category, 'unknown') AS c, {_KIND} AS k FROM {_FACTS} WHERE n_found::DOUBLE / n_facts < 0.5) GROUP BY ROLLUP (c, k)")
def failure_decomposition(spark, d):
    wrong = exact_scores(spark, d).where("is_correct = 0").select(F.coalesce("category", F.lit("unknown")).alias("category"), "n_found")
    return SC.decomposition(wrong, "category").select(F.coalesce("category", F.lit("(all)")).alias("category"), F.coalesce("failure", F.lit("(all)")).alias("failure"), "n")


@query("sample_rows", f"SELECT q.question_id, r.n::BIGINT AS n_results, m.n::BIGINT AS n_samples FROM eval_questions q LEFT JOIN (SELECT question_id, count(*) AS n FROM {_R} GROUP BY 1) r USING (question_id) LEFT JOIN (SELECT question_id, count(DISTINCT sample_id) AS n FROM model_comparison_report GROUP BY 1) m USING (question_id)")
def sample_rows(spark, d):
    r = results(spark, d).groupBy("question_id").agg(F.count("*").alias("n_results"))
    m = table(spark, d, "model_comparison_report").groupBy("question_id").agg(F.count_distinct("sample_id").alias("n_samples"))
    return SC.sample_rows(questions(spark, d).select("question_id"), [r, m], "question_id")


def _benchmark_sql() -> str:
    fields = ("question_id", "category", "difficulty", "question", "prompt_template", "verified_answer")
    expected = "CASE category " + " ".join(f"WHEN '{c}' THEN '{p}'" for c, p in SC.PREFIXES.items()) + " END"
    checks = [f"CASE WHEN trim(coalesce({c}::VARCHAR, ''), ' ') = '' THEN 'missing_{c}' END" for c in fields] + [
        "CASE WHEN x = '' THEN 'bad_id' END", f"CASE WHEN x <> '' AND {expected} IS NOT NULL AND x <> {expected} THEN 'prefix_category_mismatch' END", f"CASE WHEN difficulty NOT IN {tuple(SC.DIFFICULTIES)} THEN 'bad_difficulty' END",
        "CASE WHEN NOT len(key_facts) BETWEEN 3 AND 5 THEN 'key_fact_count' END", f"CASE WHEN source.source_type NOT IN {tuple(SC.SOURCE_TYPES)} THEN 'bad_source_type' END", "CASE WHEN NOT is_trap AND source.corpus_ref IS NULL THEN 'no_corpus_ref' END",
    ]
    return f"""SELECT item, error FROM (SELECT question_id AS item, unnest(list_filter([{', '.join(checks)}], lambda e: e IS NOT NULL)) AS error FROM (SELECT *, coalesce(regexp_extract(question_id, '^([A-Z]+)-\\d{{3}}$', 1), '') AS x FROM eval_questions))
      UNION ALL SELECT question_id, 'duplicate_id' FROM eval_questions GROUP BY 1 HAVING count(*) > 1
      UNION ALL SELECT min(question_id), 'duplicate_question' FROM eval_questions GROUP BY trim(regexp_replace(lower(question), '[^a-z0-9]+', ' ', 'g'), ' ') HAVING count(*) > 1
      UNION ALL SELECT NULL, 'trap_share' FROM eval_questions HAVING NOT avg(is_trap::INT) BETWEEN 0.1 AND 0.15"""


@query("benchmark_rules", _benchmark_sql())
def benchmark_rules(spark, d):
    return SC.benchmark_errors(questions(spark, d))


@query("hit_rate", f"SELECT question_id, len(key_facts)::BIGINT AS n_facts, len(list_filter(key_facts, lambda f: contains(c, lower(f))))::BIGINT AS n_found FROM (SELECT q.question_id, q.key_facts, coalesce(r.c, '') AS c FROM eval_questions q LEFT JOIN (SELECT question_id, string_agg(lower(coalesce(response, '')), chr(1)) AS c FROM {_R} GROUP BY 1) r USING (question_id))")
def hit_rate(spark, d):
    f = questions(spark, d).select("question_id", F.explode(F.array_distinct("key_facts")).alias("fact"))
    low = F.lower(F.coalesce("response", F.lit("")))
    per = results(spark, d).join(questions(spark, d).select("question_id", "key_facts"), "question_id").select("question_id", F.explode(F.filter("key_facts", lambda x: F.contains(low, F.lower(x)))).alias("fact"), F.lit(True).alias("found")).distinct()
    return RG.hit_rate(per, f, "question_id", "fact")


@query("retrieval_pattern", f"""SELECT category, h, a, CASE WHEN h >= 0.5 AND a < 0.3 THEN 'Generation failure' WHEN h < 0.3 AND a >= 0.5 THEN 'Parametric knowledge' WHEN h >= 0.5 AND a >= 0.5 THEN 'Retrieval success' WHEN h < 0.3 AND a < 0.3 THEN 'Retrieval failure' ELSE 'Mixed' END AS pattern
  FROM (SELECT category, sum(n_found)::DOUBLE / sum(n_facts) AS h, avg((n_found::DOUBLE / n_facts >= 0.5)::INT)::DOUBLE AS a FROM {_FACTS} GROUP BY 1)""")
def retrieval_pattern(spark, d):
    g = exact_scores(spark, d).groupBy("category").agg((F.sum("n_found") / F.sum("n_facts")).alias("h"), F.avg("is_correct").alias("a"))
    return g.withColumn("pattern", RG.retrieval_pattern(F.col("h"), F.col("a")))


_EV = "(SELECT user_id AS run, event_id AS step, value AS train_loss, value * (1 + ((event_id % 40) - 10) / 200.0::DOUBLE) AS val_loss FROM events)"


def validation(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), F.col("value").alias("train_loss"), (F.col("value") * (1 + ((F.col("event_id") % 40) - 10) / F.lit(200.0))).alias("val_loss"))


@query("overfit_class", f"""SELECT c AS class, count(*)::BIGINT AS n FROM (SELECT CASE WHEN g < -0.02 THEN 'Underfitting' WHEN g < 0.02 THEN 'Well-fit' WHEN g < 0.1 THEN 'Mild overfitting' ELSE 'Severe overfitting' END AS c FROM (SELECT CASE WHEN train_loss <> 0 THEN round((val_loss - train_loss) / train_loss, 9) ELSE 0 END AS g FROM {_EV})) GROUP BY 1""")
def overfit_class(spark, d):
    e = TL.enriched(validation(spark, d))
    return e.groupBy(TL.overfit_class(F.round("gap_ratio", 9)).alias("class")).agg(F.count("*").alias("n"))


_DV = "(SELECT user_id AS run, event_id AS step, value AS train_loss, 1000 - value AS val_loss FROM events)"


@query("log_perplexities", f"SELECT step, run, least(exp(train_loss), 1e5::DOUBLE) AS train_perplexity, least(exp(val_loss), 1e5::DOUBLE) AS val_perplexity, val_loss - train_loss AS gap FROM {_EV}")
def log_perplexities(spark, d):
    return TL.enriched(validation(spark, d)).select("step", "run", "train_perplexity", "val_perplexity", "gap")


@query("loss_changes", "SELECT user_id, count(*)::BIGINT AS n FROM (SELECT user_id, round(value) AS v, lag(round(value)) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events WHERE value IS NOT NULL) WHERE b IS NULL OR abs(v - b) >= 1e-8 GROUP BY 1")
def loss_changes(spark, d):
    rounded = table(spark, d, "events").select("user_id", "event_id", F.round("value").alias("loss"))
    return TL.distinct_losses(rounded, "user_id", "event_id", "loss").groupBy("user_id").agg(F.count("*").alias("n"))


@query("divergence_runs", f"""WITH m AS (SELECT *, coalesce(val_loss > lag(val_loss) OVER w AND train_loss < lag(train_loss) OVER w, false) AS bad, lag(step) OVER w AS before, row_number() OVER w AS r FROM {_DV} WINDOW w AS (PARTITION BY run ORDER BY step)),
  i AS (SELECT *, r - row_number() OVER (PARTITION BY run, bad ORDER BY step) AS g FROM m) SELECT run, min(before) AS start_step, max(step) AS end_step, count(*)::BIGINT AS n_steps FROM i WHERE bad GROUP BY run, g HAVING count(*) >= 2""")
def divergence_runs(spark, d):
    return TL.divergence(validation(spark, d).withColumn("val_loss", 1000 - F.col("train_loss")), "run", "step")


@query("convergence", f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS k FROM {_EV}), p AS (SELECT run, max(val_loss) FILTER (k = 2) AS before, max(val_loss) FILTER (k = 1) AS last FROM r GROUP BY 1) SELECT run, before, last, coalesce((before - last) / nullif(before, 0) > 0.05, false) AS still_improving FROM p")
def convergence(spark, d):
    return TL.converging(validation(spark, d), "run", "step")


@query("resource_summary", "SELECT 'value' AS measure, max(value) AS peak, avg(value) AS mean, min(value) AS least FROM events UNION ALL SELECT 'k', max(k), avg(k), min(k) FROM (SELECT (props::JSON ->> '$.k')::DOUBLE AS k FROM events)")
def resource_summary(spark, d):
    e = table(spark, d, "events").select("value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    return TL.resources(e, ["value", "k"])


@query("run_summary", "SELECT user_id, max(event_id) AS last_step, arg_max(value, event_id) AS last_loss, min(value) AS best_loss, arg_min(event_id, (value, event_id)) AS best_step FROM events GROUP BY 1")
def run_summary(spark, d):
    return TL.run_summary(table(spark, d, "events"), "user_id", "event_id", "value")


@query("resume_continuity", """WITH m AS (SELECT *, sum((event_type = 'purchase')::INT) OVER (ORDER BY event_id) AS segment, (event_id // 20)::BIGINT AS step FROM events), r AS (SELECT segment, step, arg_max(value, event_id) AS x, arg_min(value, event_id) AS y FROM m WHERE event_type <> 'purchase' GROUP BY 1, 2)
  SELECT a.segment::BIGINT AS segment, a.step, a.x AS rate_before, b.y AS rate_after, abs(b.y - a.x) / greatest(abs(a.x), 1e-30::DOUBLE) <= 1e-5::DOUBLE AS agrees FROM r a JOIN r b ON b.segment = a.segment + 1 AND b.step = a.step""")
def resume_continuity(spark, d):
    e = table(spark, d, "events").withColumn("step", F.floor(F.col("event_id") / 20))
    return TL.continuity(e, "event_id", "step", "value", F.col("event_type") == "purchase")


@query("resume_rates", """WITH m AS (SELECT *, event_type = 'purchase' AS m FROM events), n AS (SELECT event_id, m, last_value(CASE WHEN NOT m THEN value END IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, first_value(CASE WHEN NOT m THEN value END IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM m)
  SELECT event_id, b AS rate_before, a AS rate_after, coalesce(CASE WHEN b = 0 THEN abs(a) ELSE abs(a - b) / abs(b) END <= 0.1::DOUBLE, false) AS agrees FROM n WHERE m""")
def resume_rates(spark, d):
    return TL.continuity_across(table(spark, d, "events"), "event_id", "value", F.col("event_type") == "purchase")


@query("field_coverage", "SELECT * FROM (SELECT n, unnest(['text', 'lang', 'source', 'published_at']) AS field, unnest([a, b, c, e]) AS n_present FROM (SELECT count(*)::BIGINT AS n, count(text)::BIGINT AS a, count(lang)::BIGINT AS b, count(source)::BIGINT AS c, count(published_at)::BIGINT AS e FROM documents)), LATERAL (SELECT n_present >= 0.9::DOUBLE * n AS is_covered)")
def field_coverage(spark, d):
    return TL.coverage(table(spark, d, "documents"), ["text", "lang", "source", "published_at"])


@query("epoch_tracker", "SELECT event_id // 1000 AS epoch, count(*)::BIGINT AS n_steps, min(event_id) AS first_step, max(event_id) AS last_step FROM events GROUP BY 1")
def epoch_tracker(spark, d):
    return TL.epochs(table(spark, d, "events"), "event_id", 1000)


@query("completion", "SELECT user_id, max(event_id) AS last_step, 100::INT AS expected, 100 - max(event_id) <= 15 AS is_complete FROM events GROUP BY 1")
def completion(spark, d):
    return TL.completed(table(spark, d, "events"), "user_id", "event_id", F.lit(100))


@query("duration_projection", "SELECT lang, n, n * 3 / 1000.0::DOUBLE / 3600 AS hours_3, n * 5 / 1000.0::DOUBLE / 3600 AS hours_5, n * 10 / 1000.0::DOUBLE / 3600 AS hours_10 FROM (SELECT lang, sum(n_chars)::BIGINT AS n FROM documents GROUP BY 1)")
def duration_projection(spark, d):
    n = table(spark, d, "documents").groupBy("lang").agg(F.sum("n_chars").alias("n")).withColumn("rate", F.lit(1000.0))
    return TL.projection(n, "n", "rate").drop("rate")


_LINES = "(SELECT event_id, CASE WHEN props IS NULL THEN '' WHEN event_type = 'purchase' THEN substr(props, 1, length(props) - 1) ELSE props END AS line FROM events)"


@query("log_parse", f"SELECT event_id, CASE WHEN json_valid(line) THEN (line::JSON ->> '$.k')::BIGINT END AS k, json_valid(line) AS ok FROM {_LINES} WHERE line <> ''")
def log_parse(spark, d):
    """Log lines, those of one type cut in transfer: blank lines are skipped, malformed ones are told."""
    from ..sources.io import parse_lines

    line = F.when(F.col("props").isNull(), "").when(F.col("event_type") == "purchase", F.substring("props", F.lit(1), F.length("props") - 1)).otherwise(F.col("props"))
    lines = table(spark, d, "events").select("event_id", line.alias("line")).where("line <> ''")
    return parse_lines(lines, "line", "k long").select("event_id", "k", F.col("_ok").alias("ok"))


@query("complete_models", "WITH q AS (SELECT question_id FROM eval_questions) SELECT model_tag, count(DISTINCT question_id)::BIGINT AS n_files FROM verify_results WHERE question_id IN (FROM q) GROUP BY 1 HAVING count(DISTINCT question_id) >= 0.1::DOUBLE * (SELECT count(*) FROM q)")
def complete_models(spark, d):
    """Models that answered at least a tenth of all questions, with how many."""
    asked = questions(spark, d).select("question_id").distinct()
    n = asked.count()
    answered = table(spark, d, "verify_results").join(asked, "question_id", "left_semi")
    return answered.groupBy("model_tag").agg(F.count_distinct("question_id").alias("n_files")).where(F.col("n_files") >= 0.1 * n)


@query("corpus_grounding", f"SELECT pair_id, count(DISTINCT g)::BIGINT AS n_grounded FROM ({_grams('synthetic_sft', 'pair_id', 'output')}) WHERE g IN (SELECT g FROM ({_grams('documents', 'doc_id', 'text')})) GROUP BY 1")
def corpus_grounding(spark, d):
    """Runs of eight words of each answer that the corpus holds, by a semi-join: no corpus is too large for it."""
    pairs = table(spark, d, "synthetic_sft").dropDuplicates(["pair_id"])
    return VA.corpus_support(pairs, "pair_id", "output", table(spark, d, "documents"), "doc_id", "text").where("support > 0").withColumnRenamed("support", "n_grounded")


@query("independence_report")
def independence_report(spark, d):
    sft = table(spark, d, "synthetic_sft").dropDuplicates(["pair_id"])
    scored = VA.similarities(sft, "pair_id", "instruction", "output", questions(spark, d), "question_id", "question", "prompt_template", "verified_answer")
    return VA.independence(scored, "score", "total", "n_items")


@query("context_stats", f"SELECT avg(n)::DOUBLE AS mean_tokens, max(n) AS max_tokens, count(*)::BIGINT AS n FROM (SELECT tokens_generated::BIGINT AS n FROM {_R}) WHERE n > 0")
def context_stats(spark, d):
    return results(spark, d).where("tokens_generated > 0").agg(F.avg("tokens_generated").alias("mean_tokens"), F.max(F.col("tokens_generated").cast("long")).alias("max_tokens"), F.count("*").alias("n"))


@query("annotations", f"SELECT result_id, concat_ws('; ', primary_mode || ' (' || {_SEVERITY} || ')', printf('accuracy %.2f', a), CASE WHEN f > 0 THEN f || ' flagged' END) AS note FROM {_TAX}")
def annotations(spark, d):
    m = modes(spark, d)
    return m.select("result_id", SC.annotation(F.col("primary_mode"), F.col("severity"), F.col("accuracy"), F.col("f")).alias("note"))
