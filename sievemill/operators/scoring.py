"""Scores of answers, failure taxonomies, comparisons of models and checks of benchmarks and registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grounding import fact_matches

# Hedging expressions; single words count as whole words only.
HEDGES = ["may", "might", "could", "possibly", "perhaps", "potentially", "likely", "unlikely", "uncertain", "unclear"]
HEDGE_PHRASES = [
    "it is thought that", "it is believed that", "some studies suggest", "it has been suggested", "it is possible that", "there is evidence that",
    "appears to", "seems to", "is thought to", "is believed to", "in some cases", "in certain cases",
]
# Failure modes, and categories whose answers age.
MODES = ["confident_fabrication", "outdated_information", "plausible_blending", "boundary_confusion", "accurate_but_misleading", "accurate", "degenerate"]
TEMPORAL = ["temporal_accuracy", "clinical_trials"]
# Identifiers, difficulties and sources a benchmark may have.
PREFIXES = {"drug_treatment": "DRUG", "gene_mutation": "GENE", "diagnostic_criteria": "DIAG", "clinical_trials": "TRIAL", "disease_mechanisms": "MECH", "temporal_accuracy": "TEMP", "epidemiology": "EPI", "patient_care": "CARE"}
DIFFICULTIES, SOURCE_TYPES = ["easy", "medium", "hard"], ["pubmed", "nct", "guideline", "textbook", "trap", "review"]


def windows(text: Column, size: int = 100, step: int = 50) -> Column:
    """Overlapping windows of the lower-cased text until its end is covered; a short text is one."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    last = F.greatest(F.ceil((F.length(t) - size) / step), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(t, i * step + 1, F.lit(size)))


def hedges(text: Column) -> Column:
    """Hedging expressions in the text."""
    t = F.lower(F.coalesce(text, F.lit("")))
    words = F.regexp_count(t, F.lit(r"\b(?:" + "|".join(HEDGES) + r")\b"))
    return (words + sum((F.floor((F.length(t) - F.length(F.replace(t, F.lit(p), F.lit("")))) / len(p)) for p in HEDGE_PHRASES), F.lit(0))).cast("long")


def question_scores(responses: DataFrame, key: str, text: str, facts: DataFrame, item: str, fact: str) -> DataFrame:
    """Per response facts found and in all, their share (0 without facts) and whether it is at least a half."""
    found = fact_matches(responses, key, text, facts, fact, item).groupBy(key).agg(F.count("*").alias("n_facts"), F.sum(F.col("found").cast("long")).alias("n_found"))
    out = responses.join(found, key, "left").na.fill(0, ["n_facts", "n_found"])
    share = F.when(F.col("n_facts") > 0, F.col("n_found") / F.col("n_facts")).otherwise(0.0)
    return out.withColumn("accuracy", share).withColumn("is_correct", (F.col("accuracy") >= 0.5).cast("int"))


def score_sets(scores: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, median and pass rate over all and by each column, as grouping sets."""
    names = ", ".join(columns)
    sets = ", ".join(["()", *(f"({c})" for c in columns)])
    scores.createOrReplaceTempView("__scores")
    return scores.sparkSession.sql(f"SELECT {names}, grouping_id({names}) AS level, count(*) AS n, avg(accuracy) AS mean_accuracy, median(accuracy) AS median_accuracy, sum(is_correct) AS n_correct FROM __scores GROUP BY GROUPING SETS ({sets})")


def taxonomy(df: DataFrame, accuracy: str, hedging: str, flagged: str, category: str, difficulty: str, tokens: str, is_coherent: str) -> DataFrame:
    """primary_mode, secondary_mode and severity by the first and second rule that hold; null coherence counts as coherent."""
    a, h, f = F.col(accuracy), F.col(hedging), F.col(flagged)

    def rule(condition: Column, mode: str, severity: Column) -> Column:
        return F.when(F.coalesce(condition, F.lit(False)), F.struct(F.lit(mode).alias("mode"), severity.alias("severity")))

    rules = F.array_compact(F.array(
        rule((f > 0) & (h <= 1), "confident_fabrication", F.lit("high")),
        rule(F.col(category).isin(TEMPORAL) & (a < 0.5), "outdated_information", F.lit("medium")),
        rule((a >= 0.2) & (a < 0.5) & (f == 0), "plausible_blending", F.when(h == 0, "high").otherwise("medium")),
        rule((a < 0.3) & (h >= 2) & (f == 0), "boundary_confusion", F.when(h >= 3, "low").otherwise("medium")),
        rule((a >= 0.5) & (h == 0) & F.col(difficulty).isin("hard", "medium"), "accurate_but_misleading", F.when(F.col(difficulty) == "hard", "medium").otherwise("low")),
    ))
    fallback = F.when(a >= 0.5, F.struct(F.lit("accurate").alias("mode"), F.lit("none").alias("severity"))).when((a < 0.2) & (F.col(tokens) < 10), F.struct(F.lit("degenerate").alias("mode"), F.lit("low").alias("severity"))).otherwise(F.struct(F.lit("plausible_blending").alias("mode"), F.lit("medium").alias("severity")))
    broken = ~F.coalesce(F.col(is_coherent), F.lit(True))
    first = F.coalesce(F.get(F.col("__r"), F.lit(0)), fallback)
    out = df.withColumn("__r", rules).withColumn("__f", first)
    return out.select(
        *df.columns, F.when(broken, "degenerate").otherwise(F.col("__f.mode")).alias("primary_mode"),
        F.when(~broken, F.get(F.col("__r"), F.lit(1))["mode"]).alias("secondary_mode"), F.when(broken, "low").otherwise(F.col("__f.severity")).alias("severity"),
    )


def overridden(rows: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """Manual labels win; override tells where."""
    o = overrides.select(key, F.col("primary_mode").alias("__mode"))
    return rows.join(o, key, "left").withColumn("override", F.col("__mode").isNotNull()).withColumn("primary_mode", F.coalesce("__mode", "primary_mode")).drop("__mode")


def mode_distribution(rows: DataFrame) -> DataFrame:
    """Rows per mode, modes without rows included."""
    modes = rows.sparkSession.createDataFrame([(m,) for m in MODES], "primary_mode string")
    return modes.join(rows.groupBy("primary_mode").agg(F.count("*").alias("n")), "primary_mode", "left").select("primary_mode", F.coalesce("n", F.lit(0)).alias("n"))


def extremes(scores: DataFrame, key: str, k: int = 5) -> DataFrame:
    """The best, the worst with ten tokens at least, and the k nearest to one half; ties by key."""
    best = scores.where("is_correct = 1").orderBy(F.desc("accuracy"), key).limit(k).withColumn("kind", F.lit("best"))
    worst = scores.where("tokens_generated >= 10").orderBy("accuracy", key).limit(k).withColumn("kind", F.lit("worst"))
    edge = scores.orderBy(F.abs(F.col("accuracy") - 0.5), key).limit(k).withColumn("kind", F.lit("edge"))
    return best.unionByName(worst).unionByName(edge)


def annotation(mode: Column, severity: Column, accuracy: Column, flagged: Column) -> Column:
    return F.concat_ws("; ", F.concat(mode, F.lit(" ("), severity, F.lit(")")), F.format_string("accuracy %.2f", accuracy.cast("double")), F.when(flagged > 0, F.format_string("%d flagged", flagged)))


def sample_rows(questions: DataFrame, parts: list[DataFrame], item: str) -> DataFrame:
    """Left joins of what is known per item."""
    for part in parts:
        questions = questions.join(part, item, "left")
    return questions


def metric_pivot(df: DataFrame, row: str, model: str, metric: str) -> DataFrame:
    """Mean of the metric by row, one column per model that the data holds; models are few, their names come to the driver."""
    return df.groupBy(row).pivot(model).agg(F.avg(metric))


def disagreement(df: DataFrame, item: str, model: str, mode: str, n_models: int) -> DataFrame:
    """Items that every model answered, in more than one mode."""
    return df.groupBy(item).agg(F.count_distinct(model).alias("n_models"), F.array_sort(F.collect_set(mode)).alias("modes")).where((F.col("n_models") == n_models) & (F.size("modes") > 1))


def spread_judgement(df: DataFrame, row: str, metric: str, least: float = 0.05, much: float = 0.10) -> DataFrame:
    d = F.max(metric) - F.min(metric)
    return df.groupBy(row).agg(d.alias("spread"), F.when(d > much, "large").when(d > least, "notable").otherwise("small").alias("judgement"))


def decomposition(wrong: DataFrame, category: str) -> DataFrame:
    """Wrong answers by whether a fact had been retrieved (column n_found), per category, with subtotals (null failure) and the total (null category)."""
    kind = F.when(F.coalesce("n_found", F.lit(0)) > 0, "generation_failure").otherwise("retrieval_failure")
    return wrong.withColumn("failure", kind).rollup(category, "failure").agg(F.count("*").alias("n"))


def contrast(items: DataFrame, item: str, category: str, n: int) -> DataFrame:
    """n items by distinct modes, then spread of scores, with at most max(2, n/8 + 1) of a category; the last two places go to the best left."""
    quota = max(2, n // 8 + 1)
    w = Window.partitionBy(category).orderBy(F.desc("n_modes"), F.desc("spread"), item)
    ranked = items.withColumn("__r", F.row_number().over(w))
    strict = ranked.where(F.col("__r") <= quota).orderBy(F.desc("n_modes"), F.desc("spread"), item).limit(max(n - 2, 0))
    rest = items.join(strict.select(item), item, "left_anti").orderBy(F.desc("n_modes"), F.desc("spread"), item).limit(2)
    return strict.drop("__r").unionByName(rest)


def exemplars(df: DataFrame, key: str, order: list[str], predicates: dict[str, Column]) -> DataFrame:
    """The first row that fits each pattern; one row can stand for several."""
    marks = F.array_compact(F.array(*[F.when(p, F.lit(n)) for n, p in predicates.items()]))
    return df.select(key, *[c for c in order if c != key], F.explode(marks).alias("pattern")).groupBy("pattern").agg(F.min_by(key, F.struct(*order)).alias(key))


def exemplar_rows(df: DataFrame, key: str, order: list[str], predicates: dict[str, Column], n: int) -> DataFrame:
    """n rows (key and pattern): the first that fits each pattern, in the patterns' order and no row twice, then the first others with no pattern."""
    place = {name: i for i, name in enumerate(predicates)}
    rank = F.coalesce(*[F.when(F.col("pattern") == name, i) for name, i in place.items()])
    once = exemplars(df, key, order, predicates).groupBy(key).agg(F.min_by("pattern", rank).alias("pattern"))  # a row per pattern at most
    chosen = once.withColumn("__p", rank).orderBy("__p").limit(n)
    rest = df.select(key, *[c for c in order if c != key]).join(chosen.select(key), key, "left_anti").orderBy(*order).limit(n).select(key, F.lit(None).cast("string").alias("pattern"), F.lit(len(place)).alias("__p"))
    return chosen.unionByName(rest).orderBy("__p", key).limit(n).drop("__p")


def fabrication_of_coherent(rows: DataFrame, looked: DataFrame, key: str) -> DataFrame:
    """Fabrication rate over coherent responses; unknown coherence counts as coherent."""
    ok = rows.where(F.coalesce("is_coherent", F.lit(True))).select(key)
    return looked.join(ok, key, "left_semi").agg(F.count("*").alias("n_entities"), F.sum(F.col("flagged").cast("long")).alias("n_flagged"))


def capability_gap(rows: DataFrame, model: str) -> DataFrame:
    """Coherence less accuracy, in percent."""
    c, a = 100.0 * F.avg(F.coalesce(F.col("is_coherent"), F.lit(True)).cast("double")), 100.0 * F.avg("accuracy")
    return rows.groupBy(model).agg(c.alias("coherence_pct"), a.alias("accuracy_pct"), (c - a).alias("gap"))


def ablation(rows: DataFrame, model: str, metrics: dict[str, Column], base: str | None = None) -> DataFrame:
    """Each metric (an aggregate) per model less that of the base model, by default the first by name."""
    one = rows.groupBy(model).agg(*[m.alias(n) for n, m in metrics.items()])  # one row per model
    order = F.struct(F.col(model) != base, model) if base else F.col(model)
    own = {n: F.min_by(n, order).over(Window.partitionBy()) for n in metrics}
    return one.select(model, *[(F.col(n) - b).alias(f"delta_{n}") for n, b in own.items()])


def benchmark_errors(q: DataFrame, trap_low: float = 0.10, trap_high: float = 0.15) -> DataFrame:
    """item and error of every broken rule; error rows for the whole benchmark have no item."""
    prefix = F.regexp_extract("question_id", r"^([A-Z]+)-\d{3}$", 1)
    expected = F.create_map(*[F.lit(x) for kv in PREFIXES.items() for x in kv])[F.col("category")]
    blank = [F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", F.lit(f"missing_{c}")) for c in ("question_id", "category", "difficulty", "question", "prompt_template", "verified_answer")]
    checks = [
        *blank, F.when(prefix == "", "bad_id"), F.when((prefix != "") & expected.isNotNull() & (prefix != expected), "prefix_category_mismatch"),
        F.when(~F.col("difficulty").isin(DIFFICULTIES), "bad_difficulty"), F.when(~F.size("key_facts").between(3, 5), "key_fact_count"),
        F.when(~F.col("source.source_type").isin(SOURCE_TYPES), "bad_source_type"), F.when(~F.col("is_trap") & F.col("source.corpus_ref").isNull(), "no_corpus_ref"),
    ]
    rows = q.select(F.col("question_id").alias("item"), F.explode(F.array_compact(F.array(*checks))).alias("error"))
    same = F.trim(F.regexp_replace(F.lower("question"), "[^a-z0-9]+", " "))
    duplicates = q.groupBy("question_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("question_id").alias("item"), F.lit("duplicate_id").alias("error"))
    questions = q.groupBy(same.alias("s")).agg(F.count("*").alias("n"), F.min("question_id").alias("item")).where("n > 1").select("item", F.lit("duplicate_question").alias("error"))
    share = q.agg(F.avg(F.col("is_trap").cast("double")).alias("s")).where(~F.col("s").between(trap_low, trap_high)).select(F.lit(None).cast("string").alias("item"), F.lit("trap_share").alias("error"))
    return rows.unionByName(duplicates).unionByName(questions).unionByName(share)


def registry_errors(r: DataFrame) -> DataFrame:
    checks = [F.when(~F.coalesce(F.col("etype").isin("drugs", "genes", "proteins", "trials", "institutions"), F.lit(False)), "bad_type"), F.when(F.trim(F.coalesce("canonical", F.lit(""))) == "", "missing_canonical"), F.when(F.coalesce("frequency", F.lit(0)) < 1, "bad_frequency")]
    rows = r.select("etype", "canonical", F.explode(F.array_compact(F.array(*checks))).alias("error"))
    twice = r.groupBy("etype", F.lower("canonical").alias("c")).agg(F.count("*").alias("n"), F.min("canonical").alias("canonical")).where("n > 1").select("etype", "canonical", F.lit("duplicate").alias("error"))
    return rows.unionByName(twice)


def top_k(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)
