"""Registries, candidates, look-ups and leaks against models in plain Python."""

import collections
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from sievemill import catalog
from sievemill.functions import fuzzy
from sievemill.operators import dedup as D
from sievemill.operators import entities as E
from sievemill.operators import grounding as VA
from sievemill.operators import sampling as SP
from sievemill.operators import tokens as TK

TEXTS = [
    "Riluzole and rilutek were compared with sodium phenylbutyrate; Riluzole won.",
    "sodium channels and phenylbutyrate salts, Edaravone, edaravone EDARAVONE",
    "The SOD1 and sod1 variants, TP53 TP53 TP53 tp53, IL6 IL6, BRCA1 (BRCA1) [BRCA1], IC50 IC50 IC50, S12 S12 S12",
    "A kinase, a novel-ase, myglobin myglobin disease disease Fakezole fakezole fakezole",
    "University of Northfield Medical School met the Wexford General Hospital.\nthe hospital\nA\nTrial NCT01234567 and NCT01234567x and NCT0123456",
    "Mobile WEXFORD GENERAL HOSPITAL, TDP43 and TDP-43, p62, NfL nfl",
    None,
    "",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(-1))


def counted():
    c = collections.Counter()
    for t in TEXTS:
        c.update(w for w in (x.strip(E.PUNCTUATION) for x in (t or "").split()) if len(w) >= 2)
    return c


def test_registries(spark, docs):
    c = counted()
    low = collections.Counter()
    for w, n in c.items():
        low[w.lower()] += n
    counts = E.word_counts(docs, "text")
    drugs = {r["canonical"]: (r["aliases"], r["frequency"]) for r in E.drugs(counts).collect()}
    assert drugs["riluzole"] == (["rilutek"], max(low["riluzole"], low["rilutek"])) and drugs["sodium phenylbutyrate"][1] == min(low["sodium"], low["phenylbutyrate"])
    assert drugs["edaravone"][1] == low["edaravone"] and drugs["fakezole"][1] == c["fakezole"] and not {"disease", "kinase", "rilutek", "tofersen"} & set(drugs)
    genes = {r["canonical"]: r["frequency"] for r in E.genes(counts).collect()}
    assert genes == {"SOD1": c["SOD1"], "TP53": c["TP53"]}
    proteins = {r["canonical"]: r["frequency"] for r in E.proteins(counts).collect()}
    assert proteins["TDP-43"] == max(low["tdp-43"], low["tdp43"]) and proteins["p62"] == 1 and proteins["neurofilament"] == low["nfl"] and proteins["myglobin"] == 2 and "novel-ase" in proteins and "disease" not in proteins
    assert {r["canonical"]: r["frequency"] for r in E.trials(docs, "text").collect()} == {"NCT01234567": 2}
    names = {r["canonical"]: r["frequency"] for r in E.institutions(docs, "text").collect()}
    assert any(n.startswith("University of Northfield") for n in names) and any("Wexford General Hospital" in n for n in names) and "the hospital" not in names
    every = E.registry(docs, "text")
    assert every.columns == ["etype", "canonical", "aliases", "frequency"] and every.where("etype = 'drugs' AND canonical = 'riluzole'").count() == 1
    assert E.registry(docs.limit(0), "text").count() == 0


def test_institutions_add_up_forms_that_differ_in_case(spark):
    df = spark.createDataFrame([("The Wexford Hospital",), ("The Wexford Hospital",), ("THE WEXFORD Hospital",)], "text string")
    assert [(r["canonical"], r["frequency"]) for r in E.institutions(df, "text").collect()] == [("The Wexford Hospital", 3)]


def plain_drugs(text):
    found = set()
    for x in re.findall(r"\b([A-Za-z0-9_-]+)\b", text):
        if 3 <= len(x) <= 30 and x.upper() not in E.NOT_CANDIDATES:
            if x[0].isupper() and x[1:].islower():
                found.add(x)
            if any(x.lower().endswith(s) and len(x) > len(s) for s in E.CANDIDATE_ENDINGS):
                found.add(x)
    return found | {p for p in re.findall(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2})\b", text) if len(p) > 5}


def test_candidates(spark):
    texts = ["We gave Galpavone and New Drug Name to him; WHO said tofersen, mab and anti-mab.", "SOD1 TARDBP C9orf72 FDA NCT12345678 A1", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string").withColumn("entity", F.lit(0))
    got = collections.defaultdict(set)
    for r in E.candidates(df, "k", "text").collect():
        got[r["k"], r["etype"]].add(r["entity"])
    for i, t in enumerate(texts):
        assert got[i, "drugs"] == plain_drugs(t or "")
    assert got[1, "genes"] >= {"SOD1", "TARDBP"} and "FDA" not in got[1, "genes"] and got[1, "trials"] == {"NCT12345678"}
    names = spark.createDataFrame([("genes", "galpavone"), ("drugs", "sod1")], "etype string, name string")
    kept = {(r["etype"], r["entity"]) for r in E.candidates(df, "k", "text", names).collect()}
    assert ("drugs", "Galpavone") not in kept and ("genes", "SOD1") not in kept and ("genes", "TARDBP") in kept


def test_lookup_equals_brute_force(spark):
    rng = random.Random(5)
    known = ["".join(rng.choices("abcdeinorst", k=rng.randint(3, 12))) for _ in range(60)]
    asked = known[:10] + ["".join([*k[:2], rng.choice("xyz"), *k[3:]]) for k in known[10:40]] + [k + "ne" for k in known[40:]] + ["", "q"]
    for k in known:  # letters dropped and added anywhere
        w = list(k)
        for _ in range(rng.randint(1, 3)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randint(0, 1)] = rng.choice(["", "x", k[0]])
        asked.append("".join(w))
    known += ["a", "ab", "x" * 40]
    asked += ["x" * 33, "x" * 30, "ab", "ba", "b"]
    names = spark.createDataFrame([("drugs", k) for k in known] + [("trials", "nct1")], "etype string, name string")
    found = spark.createDataFrame([(i, "drugs", a.upper()) for i, a in enumerate(asked)] + [(900, "trials", "NCT2"), (901, "genes", asked[0])], "k long, etype string, entity string")
    got = {r["k"]: (r["best_score"], r["flagged"]) for r in E.lookup(found, names).collect()}
    for i, a in enumerate(asked):
        best = max(fuzzy.ratio(a, k) for k in known)
        assert got[i] == ((pytest.approx(best), False) if best >= 85 else (None, True))
    assert got[900][1] and got[901][1]


def test_contexts(spark):
    rows = [("First one. Then Riluzole came! Last.", "riluzole"), ("x" * 80 + "abcde. " + "y" * 80, "abcde. y"), ("z" * 300, "q"), ("abc", "a")]
    got = [r["c"] for r in spark.createDataFrame(rows, "t string, e string").select(E.context(F.col("t"), F.col("e")).alias("c")).collect()]
    assert got == ["Then Riluzole came!", "x" * 50 + "abcde. y" + "y" * 50, "z" * 200, "abc"]


def brute_partial(a, b):
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    windows = {b[max(0, s) : max(0, s) + len(a) + min(0, s)] for s in range(-len(a) + 1, len(b))}
    return max((fuzzy.ratio(a, w) for w in windows if w), default=0.0)


def test_partial_ratio_equals_all_windows():
    rng = random.Random(8)
    for _ in range(400):
        a, b = ("".join(rng.choices("ab c", k=rng.randint(1, 14))) for _ in range(2))
        exact = brute_partial(a, b)
        assert fuzzy.partial_ratio(a, b) == pytest.approx(exact)
        if exact >= 80:
            assert fuzzy.partial_ratio(a, b, 80.0) == pytest.approx(exact)
        else:
            assert fuzzy.partial_ratio(a, b, 80.0) < 80


def test_partial_leaks_and_cascade(spark):
    fact = "the drug slows the loss of motor neurons in most cases"
    pairs = spark.createDataFrame([(1, "what does it do in mice?", f"We know that {fact} ."), (2, "How is it given to people with als today?", "By mouth."), (3, None, None), (4, "", "")], "pair_id long, instruction string, output string").withColumn("score", F.lit(1))
    items = spark.createDataFrame([("Q1", "How is it given to people with ALS today", "Explain: how is it given to people with ALS today?", [fact, "short", fact, None]), ("Q2", None, None, None)], "question_id string, question string, prompt string, facts array<string>")
    got = sorted((r["pair_id"], r["question_id"], r["match_type"]) for r in VA.partial_leaks(pairs, "pair_id", "instruction", "output", items, "question_id", "question", "prompt", "facts").collect())
    assert got == [(1, "Q1", "output_vs_key_fact"), (2, "Q1", "instruction_vs_prompt"), (2, "Q1", "instruction_vs_question")]
    assert VA.partial_leaks(pairs, "pair_id", "instruction", "output", items.limit(0), "question_id", "question", "prompt", "facts").count() == 0

    names = spark.createDataFrame([("drugs", "riluzole")], "etype string, name string")
    rows = [(1, "riluzole helps a b c d e f g"), (2, "Unknownvone a b c d e f g h"), (3, "one two three four five six seven eight"), (4, "riluzole helps a b c d e f g"), (5, None)]
    outputs = spark.createDataFrame(rows, "pair_id long, output string")
    verdicts = VA.entity_verdicts(outputs, "pair_id", "output", names)
    assert {r["pair_id"]: r["grounded"] for r in verdicts.collect()} == {1: True, 2: False, 3: True, 4: True, 5: True}
    corpus = spark.createDataFrame([(1, "so riluzole helps a b c d e f g and more")], "doc_id long, text string")
    support = VA.corpus_support(outputs, "pair_id", "output", corpus, "doc_id", "text")
    leaks = spark.createDataFrame([(4, "Q9")], "pair_id long, item string")
    kept, rejected = VA.validated(outputs, "pair_id", verdicts, support, leaks, "item")
    assert [r["pair_id"] for r in kept.collect()] == [1]
    assert {r["pair_id"]: r["reason"] for r in rejected.collect()} == {2: "unknown_entities", 3: "no_corpus_support", 4: "benchmark_leakage", 5: "no_corpus_support"}


def test_token_jaccard_equals_brute_force(spark):
    rng = random.Random(2)
    left, right = ([(i, " ".join(rng.choices(["the", "of", *map(str, range(12))], k=rng.randint(0, 9)))) for i in range(40)] + [(99, None)] for _ in range(2))
    a, b = spark.createDataFrame(left, "p long, x string"), spark.createDataFrame(right, "q long, y string")
    for least in (0.2, 0.5, 1.0):
        got = {(r["a"], r["b"]): (r["n_shared"], r["n_union"]) for r in VA.token_jaccard(a, b, "p", "q", "x", "y", least).collect()}
        sets = [{i: {*(t or "").split()} for i, t in rows} for rows in (left, right)]
        expected = {(i, j): (len(s & t), len(s | t)) for (i, s), (j, t) in itertools.product(sets[0].items(), sets[1].items()) if s and t and len(s & t) >= least * len(s | t)}
        assert got == expected


def test_rows_that_fall_by_bands_equal_the_greedy_scan(spark):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen".split()
    texts = [" ".join(base), " ".join(base[:-1] + ["x"]), " ".join(base[:-2] + ["x", "y"]), "quite another text of some words here and there", " ".join(reversed(base))] * 2
    df = spark.createDataFrame([(i, t + (" z" if i > 4 else "")) for i, t in enumerate(texts)], "k long, t string")
    bands = collections.defaultdict(set)
    for r in D.banded(df, "k", "t").collect():
        bands[r["k"]].add(r["band"])
    kept = []
    for k in sorted(bands):
        if not any(bands[k] & bands[x] for x in kept):
            kept.append(k)
    assert {r["n"] for r in D.first_of_bands(df).collect()} == set(bands) - set(kept)
    assert D.first_of_bands(df.limit(0)).count() == 0


def test_splits_and_ranks_by_parts(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else f"s{i % 7}") for i in range(300)] + [(900, None), (901, "single")], "k long, g string")
    got = SP.split(df, "k", "g").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"train": 272, "val": 30}
    assert SP.split(df.limit(0), "k", "g").count() == 0
    ranked = TK.weighted_rank(df.select(F.col("k").alias("name"), (F.col("k") % 17).alias("x"), (F.col("k") * 7 % 31).alias("y")), "name", [("x", 0.6, True), ("y", 0.4, False)]).collect()
    order = sorted(ranked, key=lambda r: (-r["score"], r["name"]))
    assert [r["rank"] for r in order] == list(range(1, 303))


def test_runs_of_the_corpus_are_not_broadcast(spark, data):
    """Spark takes exploded texts for small: with its own threshold it would send the corpus to the driver."""
    plan = catalog.QUERIES["corpus_grounding"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_verdicts_of_the_cascade_are_not_broadcast(spark, data):
    """Support by the corpus and the verdicts grow with the tables: the driver takes none of them."""
    pairs, corpus = (spark.read.parquet(f"{data}/{n}.parquet") for n in ("synthetic_sft", "documents"))
    verdicts = pairs.select("pair_id", F.lit(0).alias("n_unknown"), F.lit(True).alias("grounded"))
    support = VA.corpus_support(pairs, "pair_id", "output", corpus, "doc_id", "text")
    for part in VA.validated(pairs, "pair_id", verdicts, support, pairs.select("pair_id", F.lit("Q").alias("item")), "item"):
        assert "Broadcast" not in part._jdf.queryExecution().executedPlan().toString()
