"""Boundary cases and models of the core operators."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemill.functions import fuzzy
from sievemill.operators import cleaning as C
from sievemill.operators import dedup as D
from sievemill.operators import entities as E
from sievemill.operators import formatting as FT
from sievemill.operators import grounding as VA
from sievemill.operators import logs as TL
from sievemill.operators import predicates as PR
from sievemill.operators import profile as ST
from sievemill.operators import relational as R
from sievemill.operators import retrieval as RG
from sievemill.operators import sampling as SP
from sievemill.operators import scoring as SC
from sievemill.sources import io
from sievemill.streaming import events as S


def one(spark, expression, text):
    return spark.createDataFrame([(text,)], "t string").select(expression(F.col("t")).alias("x")).first()["x"]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_ratio_against_plain_lcs():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choices("abcd ", k=rng.randint(0, 14))) for _ in range(2))
        expected = 100.0 if a == b else 200 * lcs(a, b) / (len(a) + len(b))
        assert fuzzy.ratio(a, b) == pytest.approx(expected)


def test_partial_ratio_filter_loses_nothing():
    rng = random.Random(2)
    for _ in range(300):
        a, b = "".join(rng.choices("abc", k=rng.randint(1, 9))), "".join(rng.choices("abc", k=rng.randint(9, 40)))
        full = fuzzy.partial_ratio(a, b)
        if full >= 80:
            assert fuzzy.partial_ratio(a, b, 80.0) == pytest.approx(full)
    assert fuzzy.partial_ratio(None, None) == 100.0
    assert fuzzy.token_set_ratio("a b", "b a c") == 100.0


@pytest.mark.parametrize(("text", "expected"), [("TDP‒43", "TDP-43"), ("em—dash", "em—dash"), ("e n", "e n"), ("zero​width", "zerowidth"), ("ﬁ", "fi"), (None, None), ("", "")])
def test_punctuation(spark, text, expected):
    assert one(spark, C.canonical_punctuation, text) == expected


@pytest.mark.parametrize(("text", "expected"), [("neuro-\ndegenerative", "neuro-degenerative"), ("SOD1-\nmutant", "SOD1-\nmutant"), ("FUS-\nrelated", "FUS-\nrelated")])
def test_rejoin(spark, text, expected):
    assert one(spark, C.rejoin_breaks, text) == expected


def test_phone_modes(spark):
    strict = lambda c: F.regexp_replace(c, C.PHONE_STRICT, "")
    fixed = lambda c: F.regexp_replace(c, C.PHONE, "")
    assert [one(spark, strict, t) for t in ("NCT01234567", "2010-2015", "n=12345")] == ["NCT", "", "n=12345"]
    assert [one(spark, fixed, t) for t in ("NCT01234567", "2010-2015", "n=12345")] == ["NCT01234567", "2010-2015", "n=12345"]


def test_abbreviations():
    assert C.expand("ALS and als") == "amyotrophic lateral sclerosis (ALS) and ALS"
    assert C.expand("amyotrophic lateral sclerosis, or ALS") == "amyotrophic lateral sclerosis, or ALS"
    assert C.expand("tdp43") == "TDP-43"
    assert C.html_to_text("<p>a</p><p>b &amp; c</p>") == "a\nb & c"


def test_clean_rejects_and_idempotence(spark):
    long_text = " ".join(["word"] * 120)
    rows = [(1, None, "s", None, None, "en"), (2, "   ", "s", None, None, "en"), (3, "short", "s", None, None, "en"), (4, long_text, None, None, "T", None), (5, " ".join(["w"] * 99), "s", None, "T", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, source_category string, title string, lang string")
    kept, rejected = C.clean(df)
    assert {r["id"]: r["reason"] for r in rejected.collect()} == {"1": "empty_text", "2": "empty_text", "3": "too_short"}
    assert {r["doc_id"]: r["word_count"] for r in kept.collect()} == {4: 121, 5: 100}
    once = one(spark, C.normal_whitespace, " a  b \n\n\n\n c ")
    assert once == "a b\n\nc" == one(spark, C.normal_whitespace, once)


def test_coherence(spark):
    loop = "the cat sat " * 5
    assert [one(spark, PR.coherent, t) for t in ("123456789", "well, ten c", loop, "a a a a a a words here", "%%%% ^^^^ &&&& ((((", None, "")] == [False, True, False, False, False, False, False]
    sft = lambda c: PR.coherent(c, 20, False)
    assert [one(spark, sft, t) for t in ("x" * 9 + "y" * 3 + " abcdefg", "one two three four five")] == [False, True]


def test_greedy_keeps_ends_of_a_chain(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (4, 6), (5, 6)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in range(1, 8)], "k long")
    assert sorted(r["k"] for r in D.first_kept(pairs, nodes, "k").collect()) == [1, 3, 4, 7]
    empty = spark.createDataFrame([], "a long, b long")
    assert D.first_kept(empty, nodes, "k").count() == 7


def test_near_and_exact_pairs(spark):
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base), " ".join(base), " ".join(base[:-1] + ["x"]), " ".join(reversed(base)), None, "", "a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in D.near(df, "doc_id", "text").collect()) in ([0, 3, 4, 5, 6], [0, 2, 3, 4, 5, 6])
    pairs = {(r["a"], r["b"]) for r in D.jaccard_pairs(df, "doc_id", "text", 0.8).collect()}
    sets = [None if not t or len(t.split()) < 5 else {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    expected = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert pairs == expected


def test_copies_fall_with_their_leader(spark):
    base = [f"w{i}" for i in range(400)]
    near = " ".join(base[:-1] + ["x"])
    df = spark.createDataFrame([(1, " ".join(base)), (2, near), (3, near), (4, near.upper()), (5, "other words stay here too"), (6, None)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in D.near(df, "doc_id", "text").collect()) == [1, 5, 6]


def test_no_link_is_lost(spark):
    rows = []
    for i in range(30):  # 92 of 100 shingles are shared, J = 92 / 108; below, 84 are, J = 84 / 116
        base = [f"w{i}x{j}" for j in range(104)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base[:96] + [f"y{i}x{j}" for j in range(8)]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in D.near(df, "doc_id", "text").collect()) == [2 * i for i in range(30)]
    cut = [(2 * i, " ".join([f"w{i}x{j}" for j in range(88)] + [f"z{i}x{j}" for j in range(16)])) for i in range(30)]
    val = spark.createDataFrame(cut + [(1000, cut[0][1]), (1001, "none of these words is there")], "doc_id long, text string")
    train = df.where("doc_id % 2 = 0")
    assert sorted(r["doc_id"] for r in D.cross_leaks(train, val, "doc_id", "text").collect()) == [2 * i for i in range(30)] + [1000]


def test_paragraphs(spark):
    p50, p49 = " ".join(["a"] * 50), " ".join(["b"] * 49)
    df = spark.createDataFrame([(1, f"{p50}\n\n{p49}"), (2, f"{p49}\n\n{p50}\n\n{p50}"), (3, p50), (4, None)], "doc_id long, text string")
    kept, lost = D.paragraphs(df, "doc_id", "text")
    assert [r["doc_id"] for r in lost.collect()] == [2, 3] or sorted(r["doc_id"] for r in lost.collect()) == [2, 3]
    assert {r["doc_id"]: r["text"] for r in kept.collect()} == {1: f"{p50}\n\n{p49}"}


def test_caps_and_split_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i, "patient_x" if i < 5 else "other") for i in range(25)], "doc_id long, source_category string")
    kept = [sorted(r["doc_id"] for r in SP.cap(df.repartition(n), "doc_id", "source_category").collect()) for n in (1, 7)]
    assert kept[0] == kept[1] and sum(i < 5 for i in kept[0]) == 2
    single = spark.createDataFrame([(1, "a")], "doc_id long, source_category string")
    assert [r["split"] for r in SP.split(single, "doc_id", "source_category").collect()] == ["train"]
    assert SP.split(single.limit(0), "doc_id", "source_category").count() == 0
    halves = SP.head_split(df, "doc_id").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in halves} == {"train": 20, "val": 5}


def test_profile_edges(spark):
    df = spark.createDataFrame([(n,) for n in (0, 99, 100, 4999, 5000)], "n long")
    assert [r["b"] for r in df.select(ST.length_class(F.col("n")).alias("b")).collect()] == [1, 1, 2, 4, 5]
    d = spark.createDataFrame([(0, 0), (0, 5), (100, 90)], "a int, b int").select(ST.delta_text(F.col("a"), F.col("b")).alias("x"))
    assert [r["x"] for r in d.collect()] == ["—", "NEW", "-10 (-10.0 %)"]
    assert one(spark, ST.parse_number, "~1,234") == 1234.0 and one(spark, ST.parse_number, "1.2 GB") == 1.2e9
    assert ST.by_group(df.selectExpr("cast(null as string) lang", "cast(null as string) text").limit(0), "lang").count() == 0


def test_windows_hedges_taxonomy(spark):
    assert [one(spark, lambda c: F.size(SC.windows(c)), "x" * n) for n in (100, 101, 150, 151)] == [1, 2, 2, 3]
    assert one(spark, SC.hedges, "It may be unlikely; it is thought that mayonnaise helps.") == 3
    rows = [(0.5, 0, 0, "x", "easy", 50, True), (0.1, 1, 1, "x", "easy", 50, True), (0.1, 3, 0, "x", "easy", 50, None), (0.9, 0, 0, "x", "hard", 5, True), (0.0, 0, 0, "x", "easy", 5, True), (0.3, 0, 0, "temporal_accuracy", "easy", 5, True), (1.0, 0, 0, "x", "easy", 5, False)]
    df = spark.createDataFrame(rows, "a double, h int, f int, c string, d string, t int, k boolean")
    got = [tuple(r)[-3:] for r in SC.taxonomy(df, "a", "h", "f", "c", "d", "t", "k").collect()]
    assert got == [("accurate", None, "none"), ("confident_fabrication", None, "high"), ("boundary_confusion", None, "low"), ("accurate_but_misleading", None, "medium"), ("degenerate", None, "low"), ("outdated_information", "plausible_blending", "medium"), ("degenerate", None, "low")]


def test_grounding_and_facts(spark):
    entities = spark.createDataFrame([(1, "Riluzole"), (2, "riluzol"), (3, "nothing")], "k long, entity string")
    registry = spark.createDataFrame([("riluzole",), ("edaravone",)], "canonical string")
    assert {r["k"]: r["grounded"] for r in VA.grounded(entities, registry, "k", "entity", "canonical").collect()} == {1: True, 2: True, 3: False}
    texts = spark.createDataFrame([(1, "q", "the bulbar subscore fell"), (2, "q", None)], "k long, q string, text string")
    facts = spark.createDataFrame([("q", "bulbar subscore")], "q string, fact string")
    assert {r["k"]: r["found"] for r in VA.fact_matches(texts, "k", "text", facts, "fact", "q").collect()} == {1: True, 2: False}
    ok, bad = VA.cascade(spark.createDataFrame([(1, True, False), (2, True, True), (3, None, True)], "k long, a boolean, b boolean"), [("a", "no_a"), ("b", "no_b")])
    assert [r["k"] for r in ok.collect()] == [2] and {r["k"]: r["reason"] for r in bad.collect()} == {1: "no_b", 3: "no_a"}


def test_independence_takes_the_best_of_all(spark):
    draw = random.Random(5)
    some = lambda n: " ".join(draw.choice("What is the role of Riluzole riluzole in ALS care and trials ñ 5".split()) for _ in range(n))
    items = [(f"Q{i}", some(8), some(5), some(12)) for i in range(6)] + [("Q9", "what is edaravone for in adults", "", None)]
    pairs = [(i, some(draw.randrange(6)), some(draw.randrange(14))) for i in range(40)] + [(40, None, None), (41, "What is edaravone for in adults", "x")]
    best = [[max(fuzzy.token_set_ratio((a or "").lower(), (b or "").lower()) for a, b in ((x, q), (x, p), (o, v))) for _, q, p, v in items] for _, x, o in pairs]
    df, few = spark.createDataFrame(pairs, "k long, x string, o string"), spark.createDataFrame(items, "item string, q string, p string, v string")
    scored = VA.similarities(df, "k", "x", "o", few, "item", "q", "p", "v")
    assert {r["k"]: r["score"] for r in scored.collect()} == pytest.approx({k: max(b) for (k, *_), b in zip(pairs, best, strict=True)})
    report = VA.independence(scored, "score", "total", "n_items").first()
    assert (report["max_score"], report["n_flagged"], report["verdict"]) == (100.0, sum(max(b) >= 75 for b in best), "FAIL")
    assert report["mean_score"] == pytest.approx(sum(map(sum, best)) / (len(pairs) * len(items)))


def test_leaks_of_short_instructions_prompts_and_answers(spark):
    items = spark.createDataFrame([("A", "so what is riluzole?", "name the drug in two words", "it slows the loss of motor neurons"), ("B", "what is riluzole? say", "x", "y")], "item string, q string, p string, v string")
    pairs = [(1, "What is riluzole?", "z"), (2, "Name the drug in two words", "z"), (3, "other", "It slows the loss of motor neurons"), (4, "other", "z"), (5, None, None)]
    found = VA.question_leaks(spark.createDataFrame(pairs, "k long, x string, o string"), "k", "x", "o", items, "item", "q", "p", "v")
    assert {(r["k"], r["item"], r["score"]) for r in found.collect()} == {(1, "A", 100.0), (2, "A", 100.0), (3, "A", 100.0)}


def test_chunks_and_neighbours(spark):
    assert RG.pack_units("a b c\n\nd e\n\nf g h i", 5) == ["a b c\n\nd e", "f g h i"]
    assert RG.pack_units("One two three. Four five six. Seven.\n\nnext", 3) == ["One two three.", "Four five six.", "Seven.\n\nnext"]
    with pytest.raises(ValueError):
        RG.chunk(spark.createDataFrame([(1, "x")], "k long, t string"), "k", "t", 0)
    rng = random.Random(3)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(30)] + [(30, None), (31, [0.0] * 4)]
    df = spark.createDataFrame(vectors, "id long, v array<float>")
    got = {(r["query"], r["rank"]): r["neighbour"] for r in RG.nearest(df, df.where("id % 10 = 0"), "id", "v", 3, block=2).collect()}

    def cos(a, b):
        dot = sum(x * y for x, y in zip(a, b, strict=True))
        return dot / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5

    for q in (0, 10, 20):
        best = sorted((i for i in range(30) if i != q), key=lambda i: -cos(vectors[q][1], vectors[i][1]))[:3]
        assert [got[q, r] for r in (1, 2, 3)] == best


def test_formatting(spark):
    df = spark.createDataFrame([(0, [1, 2, 3]), (1, []), (2, [4, 5])], "k long, ids array<int>")
    assert [r["ids"] for r in FT.pack(df, "k", "ids", 2).orderBy("block").collect()] == [[1, 2], [3, 4]]
    prompt, rest = FT.split_at_last(F.col("t"), "<a>")
    row = spark.createDataFrame([("x<a>y<a>z",), ("none",)], "t string").select(prompt.alias("p"), rest.alias("r")).collect()
    assert [tuple(r) for r in row] == [("x<a>y<a>", "z"), ("none", "")]
    ids, labels = FT.masked(F.array(F.lit(7), F.lit(8)), F.array(F.lit(9)), 4)
    assert tuple(spark.range(1).select(ids.alias("i"), labels.alias("l")).first()) == ([7, 8, 9, 0], [-100, -100, 9, -100])


def test_converging_from_a_loss_of_zero(spark):
    v = spark.createDataFrame([(1, 1, 0.0), (1, 2, 0.5), (2, 1, 1.0), (2, 2, 0.9), (3, 1, 1.0)], "run int, step int, val_loss double")
    assert sorted(tuple(r) for r in TL.converging(v, "run", "step").collect()) == [(1, 0.0, 0.5, False), (2, 1.0, 0.9, True), (3, None, 1.0, False)]


def test_token_blocks_compare_a_text_with_all_at_once(monkeypatch):
    rng, some = random.Random(3), ["a", "ab", "be", "é", "x1", "the", "of", "dose"]
    for _ in range(200):
        texts = [" ".join(rng.choices(some, k=rng.randrange(6))) for _ in range(7)]
        blocks, x = fuzzy.TokenBlocks([fuzzy.Tokens(t) for t in texts], 3), " ".join(rng.choices(some, k=rng.randrange(6)))
        assert blocks.above(fuzzy.Tokens(x), np.zeros(7)).tolist() == [fuzzy.token_set_ratio(x, t) for t in texts]
    texts = [" ".join("".join(rng.choices("abcdefg", k=5)) for _ in range(20)) for _ in range(40)]
    one_by_one = [fuzzy.token_set_ratio(texts[0][::-1], t) for t in texts]
    monkeypatch.setattr(fuzzy, "_common", None)  # no search of single pairs
    assert fuzzy.TokenBlocks([fuzzy.Tokens(t) for t in texts]).above(fuzzy.Tokens(texts[0][::-1]), np.zeros(40)).tolist() == one_by_one


def test_windows_leave_out_only_texts_below_the_ratio():
    rng = random.Random(5)
    for least in (60.0, 80.0, 95.0):
        texts = ["".join(rng.choices("abcde ", k=rng.choice((1, 7, 40, 90, 150)))) for _ in range(60)]
        windows = fuzzy.Windows(texts, least)
        for i in range(120):
            y = rng.choice(texts)
            at = rng.randrange(len(y))
            x = "".join(c for c in y[at : at + rng.randrange(1, 70)] if rng.random() > 0.15) + rng.choice(("", "e", "abc")) if i % 4 else "".join(rng.choices("abcde ", k=rng.randrange(1, 200)))
            if x:
                near = windows.near(x)
                assert {k for k, t in enumerate(texts) if fuzzy.partial_ratio(x, t) >= least} <= set(near)
    texts = ["".join(rng.choices("abcdefghijklmnopqrst", k=300)) for _ in range(50)]
    assert fuzzy.Windows(texts, 80.0).near(texts[7][100:170]) == [7]  # the others are not searched


def test_logs(spark):
    v = spark.createDataFrame([(1, s, t, x) for s, t, x in [(1, 3.0, 3.0), (2, 2.5, 3.1), (3, 2.0, 3.2), (4, 1.9, 3.0), (5, 0.0, 3.0)]], "run int, step int, train_loss double, val_loss double")
    assert [tuple(r) for r in TL.divergence(v, "run", "step").collect()] == [(1, 1, 3, 2)]
    classes = spark.createDataFrame([(x,) for x in (-0.03, 0.01, 0.05, 0.15)], "g double").select(TL.overfit_class(F.col("g")).alias("c"))
    assert [r["c"] for r in classes.collect()] == ["Underfitting", "Well-fit", "Mild overfitting", "Severe overfitting"]
    assert TL.enriched(v).where("step = 5").first()["gap_ratio"] == 0.0
    log = spark.createDataFrame([(1, 10, 1.0, False), (2, 11, 2.0, False), (3, 0, 0.0, True), (4, 11, 2.0, False)], "ord long, step int, lr double, resume boolean")
    assert [r["agrees"] for r in TL.continuity(log, "ord", "step", "lr", F.col("resume")).collect()] == [True]


def test_entities(spark):
    df = spark.createDataFrame([(1, "Riluzole, riluzole and SOD1 (NCT01234567). FDA approved testamab."), (2, None)], "k long, t string")
    got = {(r["etype"], r["entity"]) for r in E.candidates(df, "k", "t").collect()}
    assert ("trials", "NCT01234567") in got and ("drugs", "testamab") in got and ("genes", "SOD1") in got and ("genes", "FDA") not in got
    assert {r["folded"]: r["n"] for r in E.folded(E.word_counts(df, "t")).collect()}["riluzole"] == 2


def test_relational(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "u int, t int")
    right = spark.createDataFrame([(1, 2, "a"), (1, 5, "b"), (1, 7, "c")], "u int, t int, v string")
    assert {(r["u"], r["t"]): r["v"] for r in R.asof(left, right, ["u"], "t", "t", ["v"]).collect()} == {(1, 5): "b", (1, 1): None, (2, 9): None}
    assert R.salted_join(left, right.select("u", "v"), ["u"], 4).count() == 6


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "1", "text": "x"}')
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "d.json").write_text('{\n  "id": "2",\n  "text": "x\\ny"\n}\n')
    good, bad = io.read_documents(spark, str(tmp_path))
    assert sorted(r["id"] for r in good.collect()) == ["1", "2"] and bad.count() == 1
    (tmp_path / "e.txt").write_text("two\nlines")
    assert [r["text"] for r in io.read_texts(spark, [str(tmp_path)], []).collect()] == ["two\nlines"]
    assert io.read_texts(spark, [str(tmp_path)], ["e.txt"]).count() == 0
    (tmp_path / "c.txt").write_text("one\n<|endoftext|>\n two <|endoftext|>\n<|endoftext|>")
    assert [r["text"] for r in io.read_delimited(spark, str(tmp_path / "c.txt")).collect()] == ["one", "two"]
    (tmp_path / "log.jsonl").write_text('{"type": "step", "step": 1}\n\nnot json\n')
    events, malformed = io.read_log(spark, str(tmp_path / "log.jsonl"), "type string, step int")
    assert events.count() == 1 and malformed.first()["n_malformed"] == 1
    table = "# A\n| x | y |\n|---|---|\n| 1 | 2 |\n\n# B\n| z |\n"
    assert io.read_markdown_table(table, "a") == [{"x": "1", "y": "2"}] and io.read_markdown_table(table, "c") == []
    chunks = spark.createDataFrame([(1, "a")], "doc_id long, chunk string")
    io.write_chunks(chunks, str(tmp_path / "t"), "doc_id")
    assert io.write_chunks(chunks, str(tmp_path / "t"), "doc_id").count() == 0
    io.snapshot(chunks, str(tmp_path / "s"), "1")
    io.snapshot(chunks.limit(0), str(tmp_path / "s"), "1")
    assert spark.read.parquet(str(tmp_path / "s")).count() == 1


def test_stream_equals_batch(spark, data, tmp_path):
    path = f"{data}/events.parquet"
    batch = {(r["start"], r["event_type"]): r["n"] for r in S.tumbling(spark.read.parquet(path)).collect()}
    rows = {}
    S.run_available(S.tumbling(S.read_events(spark, path)), str(tmp_path / "w"), "update", lambda df, _: rows.update({(r["start"], r["event_type"]): r["n"] for r in df.collect()}))
    assert rows == batch
    out = str(tmp_path / "d")
    S.run_available(S.first_seen(S.read_events(spark, path).where("ts IS NOT NULL"), ["event_id"]), out)
    assert spark.read.parquet(out).count() == spark.read.parquet(path).where("ts IS NOT NULL").select("event_id").distinct().count()


def test_pipeline_loses_nothing(spark, data):
    from sievemill.plans import pipeline

    df = spark.read.parquet(f"{data}/documents.parquet")
    result = pipeline.run(df, separator="\n", least_words=5)
    assert result.kept.count() + result.rejected.count() == df.count()
    assert {r["split"] for r in result.kept.collect()} <= {"train", "val"}
