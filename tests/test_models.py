"""Queries that SQL cannot express against models in plain Python, over the smallest tables."""

import collections
import hashlib
import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from sievemill import catalog
from sievemill.functions import fuzzy
from sievemill.operators import cleaning as C
from sievemill.operators import retrieval as RG
from sievemill.operators import scoring as SC


@pytest.fixture(scope="module")
def rows(data):
    return lambda name, columns="*": duckdb.sql(f"SELECT {columns} FROM '{data}/{name}.parquet'").fetchall()


def got(spark, data, name):
    return catalog.QUERIES[name](spark, data).collect()


def coherent(text, least, at_least):
    t = (text or "").strip(" ")
    if not t or (len(t) < least if at_least else len(t) <= least):
        return False
    plain = re.sub(r"[,;\-]+", " ", t)
    if any(re.search(r"\b(\w+)(?:\s+\1){5,}\b", x, re.I) for x in (t, plain)):
        return False
    w = t.lower().split()
    if len(w) >= 6 and max(collections.Counter(zip(w, w[1:], w[2:])).values()) >= 4:
        return False
    return not re.search(r"(\S{2,10})\1{4,}", t) and len(re.sub(r"[^A-Za-z0-9]", "", t)) / len(t) >= 0.2


def test_coherence(spark, data, rows):
    texts = dict(rows("verify_results", "result_id, response"))
    told = got(spark, data, "coherence_full")
    differs = [r["result_id"] for r in told if r["is_coherent"] != coherent(texts[r["result_id"]], 10, True) or r["is_coherent_sft"] != coherent(texts[r["result_id"]], 20, False)]
    assert len(told) == len(texts) and not differs


def test_leaks_and_independence(spark, data, rows):
    pairs = {p: (i or "", o or "") for p, i, o in rows("synthetic_sft", "pair_id, instruction, output")}
    items = sorted(rows("eval_questions", "question_id, question, prompt_template, verified_answer"))
    found, scores = {}, []
    for p, (i, o) in pairs.items():
        each = [max(fuzzy.token_set_ratio(i.lower(), q.lower()), fuzzy.token_set_ratio(i.lower(), t.lower()), fuzzy.token_set_ratio(o.lower(), a.lower())) for _, q, t, a in items]
        scores += each
        hit = next((k for k, s in enumerate(each) if s >= 75), None)
        if hit is not None:
            found[p] = items[hit][0]
    assert {r["pair_id"]: r["question_id"] for r in got(spark, data, "question_leaks")} == found
    report = got(spark, data, "independence_report")[0]
    assert report["max_score"] == pytest.approx(max(scores)) and report["mean_score"] == pytest.approx(sum(scores) / len(scores))


def test_fact_scores(spark, data, rows):
    facts = collections.defaultdict(list)
    for q, fs in rows("eval_questions", "question_id, key_facts"):
        facts[q] = fs
    answers = {r: (q, (t or "").lower()) for r, q, t in rows("verify_results", "result_id, question_id, response")}
    expected = {r: sum(f.lower() in t or fuzzy.partial_ratio(f.lower(), t, 80.0) >= 80 for f in facts[q]) for r, (q, t) in answers.items()}
    assert {r["result_id"]: r["n_found"] for r in got(spark, data, "fuzzy_fact_scores")} == expected


def test_flagged(spark, data):
    flagged = got(spark, data, "flagged_entities")
    counts = collections.Counter(r["entity"] for r in flagged)
    assert [(r["entity"], r["n"]) for r in got(spark, data, "top_flagged")] == sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:10]
    by_type = collections.Counter(r["etype"] for r in flagged)
    rates = {r["etype"]: r["n_flagged"] for r in got(spark, data, "fabrication_rollup")}
    assert rates == {**{k: by_type.get(k, 0) for k in rates if k != "all"}, "all": len(flagged)}
    assert all(r["entity"].lower() in r["context"].lower() for r in flagged if len(r["context"]) != 200)


def test_cleaning_keeps_or_rejects_every_document(spark, data, rows):
    kept = got(spark, data, "clean_documents")
    rejected = sum(r["n"] for r in got(spark, data, "reject_summary"))
    assert len(kept) + rejected == len(rows("documents", "doc_id")) and all(r["word_count"] == len(re.findall(r"[^ \t\n\r\f]+", r["text"])) for r in kept)
    texts = dict(rows("documents", "doc_id, text"))
    for name, make in (("html_text", C.html_to_text), ("abbrev_normalize", C.expand)):
        told = {r["doc_id"]: r["digest"] for r in got(spark, data, name)}
        assert told == {i: None if t is None else hashlib.sha256(make(t).encode()).hexdigest() for i, t in texts.items()}


def test_expansion_of_abbreviations():
    assert C.expand("ALS and als. EMG, emg") == "amyotrophic lateral sclerosis (ALS) and ALS. electromyography (EMG), EMG"
    assert C.expand("amyotrophic lateral sclerosis (ALS) is ALS") == "amyotrophic lateral sclerosis (ALS) is ALS"
    assert C.html_to_text("<p>a &amp; b</p><br>c") == "a & b\nc" and C.html_to_text("a < b") is not None


def test_chunks_hold_all_words_within_their_size(spark, data, rows):
    texts = dict(rows("documents", "doc_id, text"))
    chunks = collections.defaultdict(list)
    for r in sorted(got(spark, data, "greedy_chunks"), key=lambda r: (r["doc_id"], r["chunk_index"])):
        chunks[r["doc_id"]].append(r)
    for i, t in texts.items():
        assert " ".join(r["chunk"] for r in chunks[i]).split() == (t or "").split()
        assert all(r["n_tokens"] <= 120 or len(re.split(r"(?<=[.!?])\s+", r["chunk"])) == 1 or "\n" not in (t or "") or r["n_tokens"] < 240 for r in chunks[i])
    count = lambda x: len(x)
    assert RG.pack_units("aaaa\n\nbbbb\n\ncc", 10, "\n\n", count) == ["aaaa\n\nbbbb", "cc"] and RG.pack_units("aaaa\n\nbbbb", 9, "\n\n", count) == ["aaaa", "bbbb"]


def test_files(spark, data):
    told = {r["file"]: r["sha256"] for r in got(spark, data, "file_digests")}
    assert told == {n: hashlib.sha256(open(f"{data}/{n}", "rb").read()).hexdigest() for n in os.listdir(data)}


def test_cards_prompts_and_exemplars(spark):
    texts = [("pay 4111-1111-1111-1111 or 4111 1111 1111 1112", "pay [CARD] or 4111 1111 1111 1112"), (None, None), ("", ""), ("1234567890123", "1234567890123")]
    assert [r["x"] for r in spark.createDataFrame([(t,) for t, _ in texts], "t string").select(C.mask_cards(F.col("t")).alias("x")).collect()] == [e for _, e in texts]
    with pytest.raises(ValueError, match="template"):
        RG.context_prompt(F.lit("a"), F.lit("b"), "only {question}")
    df = spark.createDataFrame([(i, i % 3) for i in range(6)], "k long, m int").withColumn("pattern", F.lit("clash"))
    made = [tuple(r) for r in SC.exemplar_rows(df.drop("pattern"), "k", ["k"], {"one": F.col("m") == 1, "any": F.lit(True), "again": F.col("m") == 0, "none": F.col("m") == 9}, 4).collect()]
    assert made == [(1, "one"), (0, "any"), (2, None), (3, None)]


def test_neighbours_with_ties_nulls_and_zero_vectors(spark):
    vectors = [(i, [1.0, 0.0]) for i in range(20)] + [(20, [0.0, 1.0]), (21, [0.0, 0.0]), (22, None), (23, [2.0, 0.0])]
    base = spark.createDataFrame(vectors, "id long, v array<double>").withColumn("score", F.lit(0)).repartition(3)
    asked = base.where("id IN (5, 21, 22)")
    by_angle = collections.defaultdict(list)
    for r in RG.nearest(base, asked, "id", "v", 3).orderBy("query", "rank").collect():
        by_angle[r["query"]].append(r["neighbour"])
    assert by_angle == {5: [0, 1, 2]}
    by_distance = collections.defaultdict(list)
    for r in RG.nearest(base, asked, "id", "v", 3, metric="l2").orderBy("query", "rank").collect():
        by_distance[r["query"]].append((r["neighbour"], round(-r["score"], 6)))
    assert by_distance == {5: [(0, 0.0), (1, 0.0), (2, 0.0)], 21: [(0, 1.0), (1, 1.0), (2, 1.0)]}
    assert RG.nearest(base, asked.limit(0), "id", "v", 3).count() == 0
