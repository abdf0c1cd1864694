"""Whether pairs are grounded in the corpus and free of benchmark wording.

Fuzzy comparisons of entities and facts run on candidates: an exact hit is found by a join first, and the costly similarity
sees only what the join leaves open. Pairs meet every benchmark item; bounds skip searches that cannot change a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fuzzy import TokenBlocks, Tokens, Windows, partial_ratio, partial_ratio_80_udf
from ..functions.words import runs, words
from .dedup import hashed
from .entities import candidates, lookup


def token_sets(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key), F.explode(F.array_distinct(words(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^a-z0-9]+", " ")))).alias("token"))


def token_jaccard(left: DataFrame, right: DataFrame, lkey: str, rkey: str, ltext: str, rtext: str, least: float) -> DataFrame:
    """Pairs of texts by shared words, exactly. A pair is opened by one of the rarest words of either side only, as many as any
    pair at least must share; all words count in it. The sets travel with the pairs, so no common word is joined on."""
    sides = []
    both = token_sets(left, lkey, ltext).select("token").unionByName(token_sets(right, rkey, rtext).select("token"))
    often = both.groupBy("token").agg(F.count("*").alias("f"))
    for df, key, text, name in ((left, lkey, ltext, "a"), (right, rkey, rtext, "b")):
        ranked = token_sets(df, key, text).withColumnRenamed(key, name).join(often, "token").groupBy(name).agg(F.array_sort(F.collect_list(F.struct("f", "token"))).alias("s"))  # one text's words
        own = ranked.select(name, F.transform("s", lambda x: x["token"]).alias(f"set_{name}"))
        first = F.slice(f"set_{name}", 1, (F.size(f"set_{name}") - F.ceil(F.size(f"set_{name}") * least - 1e-9) + 1).cast("int"))
        sides.append((own, own.select(name, F.explode(first).alias("token"))))
    (own_a, open_a), (own_b, open_b) = sides
    pairs = open_a.join(open_b, "token").select("a", "b").distinct().join(own_a, "a").join(own_b, "b")
    n_shared = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    counted = pairs.select("a", "b", n_shared.alias("n_shared"), (F.size("set_a") + F.size("set_b")).cast("long").alias("n"))
    return counted.withColumn("n_union", F.col("n") - F.col("n_shared")).where(F.col("n_shared") >= least * F.col("n_union")).select("a", "b", "n_shared", "n_union")


def grounded(entities: DataFrame, registry: DataFrame, key: str, entity: str, name: str, least: float = 85.0) -> DataFrame:
    """entities with best and grounded: equal to a name of the registry in lower case, or of that ratio; best is 0 where no name reaches it."""
    known = registry.select(F.lit("any").alias("etype"), F.lower(F.col(name)).alias("name")).distinct()
    asked = entities.select(F.lit("any").alias("etype"), F.col(entity).alias("entity")).distinct()
    told = lookup(asked, known, least).select(F.col("entity").alias(entity), F.coalesce("best_score", F.lit(0.0)).alias("best"), (~F.col("flagged")).alias("grounded"))
    return entities.join(told, entity, "left").withColumn("grounded", F.coalesce("grounded", F.lit(False)))


def entity_verdicts(pairs: DataFrame, key: str, text: str, names: DataFrame, least: float = 85.0) -> DataFrame:
    """key, n_entities, n_unknown and grounded: whether the names of the corpus hold every entity of the text, exactly or by ratio.

    A text without entities, or null, is grounded. names: etype and name, see entities.known_names.
    """
    looked = lookup(candidates(pairs, key, text, names), names, least)
    per = looked.groupBy(key).agg(F.count("*").alias("n_entities"), F.count_if("flagged").alias("n_unknown"))
    told = pairs.select(key).join(per.hint("merge"), key, "left").na.fill(0, ["n_entities", "n_unknown"])
    return told.withColumn("grounded", F.col("n_unknown") == 0)


def corpus_support(pairs: DataFrame, key: str, text: str, corpus: DataFrame, doc: str, doc_text: str, k: int = 8) -> DataFrame:
    """key and support: how many distinct runs of k words of the text the corpus holds. An equi-join of hashes: no corpus is too large.

    Spark takes exploded texts for as small as the columns they come from, so the joins say that nothing is broadcast.
    """
    held = _grams(corpus, doc, doc_text, k).select("g").distinct()
    found = _grams(pairs, key, text, k).join(held.hint("merge"), "g", "left_semi").groupBy(key).agg(F.count("*").alias("support"))
    return pairs.select(key).hint("merge").join(found.hint("merge"), key, "left").na.fill(0, ["support"])


def validated(pairs: DataFrame, key: str, entities: DataFrame, support: DataFrame, leaks: DataFrame, item: str, least_support: int = 1) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected with reason): unknown entities, then no support in the corpus, then wording of the benchmark; the first failure counts.

    entities: of entity_verdicts; support: of corpus_support; leaks: key and item of question_leaks. All have as many rows as the
    pairs may have; none is broadcast.
    """
    told = pairs.join(entities.select(key, "n_unknown", "grounded").hint("merge"), key).join(support.hint("merge"), key).join(leaks.select(key, item).hint("merge"), key, "left")
    checks = told.withColumns({"__e": F.col("grounded"), "__s": F.col("support") >= least_support, "__l": F.col(item).isNull()})
    kept, rejected = cascade(checks, [("__e", "unknown_entities"), ("__s", "no_corpus_support"), ("__l", "benchmark_leakage")])
    return kept.drop("__e", "__s", "__l"), rejected.drop("__e", "__s", "__l")


def partial_leaks(pairs: DataFrame, key: str, instruction: str, output: str, items: DataFrame, item: str, question: str, prompt: str, facts: str, least: float = 80.0, least_fact: int = 40) -> DataFrame:
    """key, item, match_type and score of every match with a partial ratio of least or more, repeated facts once.

    Compared are instruction and question, instruction and prompt, output and each key fact of least_fact characters. Null texts
    are empty and match nothing. The items are few and go to all tasks; a text is compared once per task.
    """
    rows = items.select(item, question, prompt, facts).sort(item).collect()
    asked = [(r[item], kind, (r[c] or "").lower()) for r in rows for kind, c in (("instruction_vs_question", question), ("instruction_vs_prompt", prompt))]
    told = [(r[item], "output_vs_key_fact", f.lower()) for r in rows for f in dict.fromkeys(r[facts] or []) if f is not None and len(f) >= least_fact]

    asked = [x for x in asked if x[2]]

    def matched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        windows = [Windows([other for _, _, other in side], least) for side in (asked, told)]
        seen: dict[tuple[int, str], list[tuple]] = {}

        def of(side: int, text: str) -> list[tuple]:
            if (side, text) not in seen:
                if len(seen) >= 10_000:
                    seen.clear()
                near = [(asked, told)[side][i] for i in windows[side].near(text)] if text else []
                scored = ((i, kind, partial_ratio(text, other, least)) for i, kind, other in near)
                seen[side, text] = [x for x in scored if x[2] >= least]
            return seen[side, text]

        for batch in batches:
            got = [(k, *m) for k, x, o in zip(batch[key], batch["x"], batch["o"], strict=True) for m in (*of(0, x), *of(1, o))]
            yield pd.DataFrame(got, columns=[key, item, "match_type", "score"])

    types = f"{key} {pairs.schema[key].dataType.simpleString()}, {item} {items.schema[item].dataType.simpleString()}, match_type string, score double"
    texts = pairs.select(key, *[F.lower(F.coalesce(F.col(c), F.lit(""))).alias(n) for c, n in ((instruction, "x"), (output, "o"))])
    return texts.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), key).mapInPandas(matched, types)


def _grams(frame: DataFrame, ident: str, col: str, k: int) -> DataFrame:
    w = words(F.regexp_replace(F.lower(F.coalesce(F.col(col), F.lit(""))), "[^a-z0-9]+", " "))
    return frame.select(F.col(ident), F.explode(F.array_distinct(runs(w, k))).alias("g")).select(ident, hashed(F.col("g")).alias("g"))


def passage_hits(df: DataFrame, key: str, text: str, items: DataFrame, item: str, item_text: str, k: int = 8) -> DataFrame:
    """Per record and item the shared distinct runs of k words, by an equi-join of their hashes."""
    return _grams(df, key, text, k).join(_grams(items, item, item_text, k), "g").groupBy(key, item).agg(F.count("*").alias("n_shared"))


def similarities(pairs: DataFrame, key: str, instruction: str, output: str, items: DataFrame, item: str, question: str, prompt: str, answer: str, least: float = 0.0) -> DataFrame:
    """key, score, total and n_items: the highest, the sum and the number of a pair's similarities, one with each item; first and
    first_score: the first item, in item order, at least or more. Below least, similarities count as just under it, which is cheaper.

    The similarity is the greatest token-set ratio of instruction and question, instruction and prompt, output and answer. Every
    pair meets every item: the items are few and go to all tasks. Instructions are compared once per task.
    """
    rows = items.select(item, question, prompt, answer).sort(item).collect()
    floor = np.full(len(rows), np.nextafter(least, 0.0))
    columns = [TokenBlocks([Tokens((r[c] or "").lower()) for r in rows]) for c in (question, prompt, answer)] if rows else []

    def compared(text: str, sides: list[int], best: np.ndarray) -> np.ndarray:
        x = Tokens(text)
        for side in sides:
            best = columns[side].above(x, best)
        return best

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            best = []
            for x, o in zip(batch["x"], batch["o"], strict=True):
                if x not in seen:
                    if len(seen) >= 10_000:
                        seen.clear()
                    seen[x] = compared(x, [1, 0], floor)
                best.append(compared(o, [2], seen[x]).tolist())
            hits = [next((i for i, score in enumerate(b) if score >= least), None) for b in best]
            first = pd.Series([None if i is None else rows[i][item] for i in hits], dtype="object")
            at = [None if i is None else b[i] for i, b in zip(hits, best, strict=True)]
            yield pd.DataFrame({key: batch[key], "score": [max(b) for b in best], "total": [sum(b) for b in best], "n_items": len(rows), "first": first, "first_score": pd.Series(at, dtype="float64")})

    types = f"{key} {pairs.schema[key].dataType.simpleString()}, score double, total double, n_items long, first {items.schema[item].dataType.simpleString()}, first_score double"
    if not rows:
        return pairs.select(key, F.lit(0.0).alias("score"), F.lit(0.0).alias("total"), F.lit(0).cast("long").alias("n_items"), F.lit(None).cast(items.schema[item].dataType).alias("first"), F.lit(None).cast("double").alias("first_score"))
    texts = pairs.select(key, *[F.lower(F.coalesce(F.col(c), F.lit(""))).alias(n) for c, n in ((instruction, "x"), (output, "o"))])
    spread = texts.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)  # long computation on few bytes
    return spread.mapInPandas(scored, types)


def question_leaks(pairs: DataFrame, key: str, instruction: str, output: str, items: DataFrame, item: str, question: str, prompt: str, answer: str, least: float = 75.0) -> DataFrame:
    """The first item, in item order, whose similarity with the pair reaches least; see similarities."""
    found = similarities(pairs, key, instruction, output, items, item, question, prompt, answer, least)
    return found.where(F.col("first").isNotNull()).select(key, F.col("first").alias(item), F.col("first_score").alias("score"))


def fact_matches(texts: DataFrame, key: str, text: str, facts: DataFrame, fact: str, on: str, least: float = 80.0, strict: bool = False) -> DataFrame:
    """texts x facts of the same item, with score: 100 where the fact stands in the text, else the partial ratio.

    strict: the best over windows of 100 characters, 50 apart, as the original rule has it; a fact that lies across windows is
    then missed in part.
    """
    both = texts.select(F.col(key), F.col(on), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("__t")).join(facts.select(F.col(on), F.col(fact), F.lower(F.col(fact)).alias("__f")), on)
    if strict:
        t = F.trim("__t")
        last = F.greatest(F.ceil((F.length(t) - 100) / 50), F.lit(0)).cast("int")
        both = both.withColumn("__t", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(t, i * 50 + 1, F.lit(100)))))
    inside = both.withColumn("__in", F.contains("__t", "__f"))
    hit = inside.where("__in").withColumn("score", F.lit(100.0))
    rest = inside.where("NOT __in").withColumn("score", partial_ratio_80_udf(F.col("__f"), F.col("__t")))
    scored = hit.unionByName(rest).select(key, on, fact, "score")
    if strict:
        scored = scored.groupBy(key, on, fact).agg(F.max("score").alias("score"))
    return scored.withColumn("found", F.col("score") >= least)


def independence(pairs: DataFrame, score: str, total: str, n_items: str) -> DataFrame:
    """Over rows of similarities: the highest of all, the mean over all comparisons, the pairs at 75 or more, and the verdict."""
    mean = F.sum(total) / F.nullif(F.sum(n_items), F.lit(0))
    return pairs.agg(F.max(score).alias("max_score"), mean.alias("mean_score"), F.sum((F.col(score) >= 75).cast("long")).alias("n_flagged"), F.when(F.max(score) >= 75, "FAIL").otherwise("PASS").alias("verdict"))


def cascade(df: DataFrame, checks: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected with reason): the first failing check names the reason; checks are (boolean column, reason)."""
    reason = F.coalesce(*[F.when(~F.coalesce(F.col(c), F.lit(False)), F.lit(r)) for c, r in checks])
    marked = df.withColumn("reason", reason)
    return marked.where(F.col("reason").isNull()).drop("reason"), marked.where(F.col("reason").isNotNull())


def first_per(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where("__r = 1").drop("__r")
