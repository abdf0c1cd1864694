"""The pN_ operators against brute force, exact round trips and defined edge cases."""

import base64
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemill.llm import _ranks, _words, leakage, mixture, neardup, pairs, residue, sampling, tokens, truncated

WORD = re.compile(r"[^\W_]+")


def brute(texts, k, least, similarity):
    sets = {}
    for i, t in texts:
        w = WORD.findall((t or "").lower())
        if len(w) >= max(least, k):
            sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])}


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        i = rng.randrange(len(out))
        out[i : i + 1] = rng.choice([[], [out[i], "neu"], ["ander" + str(rng.randrange(9))]])
    return out


def corpus(rng, n=60):
    vocabulary = [f"w{i}" for i in range(40)] + ["Größe", "naïve", "ЖУК", "é"]
    texts = []
    for i in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 60))]
        texts.append((10 * i, " ".join(base)))
        texts.append((10 * i + 1, ", ".join(edited(rng, base, rng.randint(0, 8)))))
    return texts + [(9001, None), (9002, ""), (9003, texts[0][1]), (9003, texts[0][1]), (9004, "w1 " * 400)]


def test_words_are_runs_of_letters_and_digits():
    texts = ["a_b c-d  e1", "", "ä漢字x 5.3\n\nz", "‍", "O'Brien"]
    got = [[] for _ in texts]
    for words in _words.chunks([t.lower() for t in texts]):
        for i, d in enumerate(words.doc):
            got[words.first + d].append(words.word(i))
    assert got == [WORD.findall(t.lower()) for t in texts]


@pytest.mark.parametrize("region", [600, 1])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, region):
    monkeypatch.setattr(neardup, "REGION", region)  # 1: every region is split again
    texts = corpus(random.Random(7), 60 if region > 1 else 25)
    df = spark.createDataFrame(texts, "id long, text string").withColumn("cid", F.lit("clash")).repartition(3)
    links, members = neardup.similar_pairs(df, "id", "text", similarity=0.6, k=3, least_words=10)
    got = {(r["a"], r["b"]) for r in neardup.id_pairs(links, members).collect()}
    assert got == brute(dict(texts).items(), 3, 10, 0.6)


@pytest.mark.parametrize(("similarity", "levels"), [(0.6, 0), (0.6, 1), (0.6, 2), (0.6, 8), (0.5, 1), (0.5, 3), (0.8, 2)])
def test_small_sets_lose_no_link_however_regions_are_split(similarity, levels):
    """All sets of one to six of a few shingles: any linked pair meets in a region, whichever regions are split."""
    rng = random.Random(levels)
    sets = {tuple(sorted(rng.sample(range(1, 9), rng.randint(1, 6)))) for _ in range(60)} | {(1,), (1, 2), (1, 2, 3), (2, 3)}
    sets = sorted(sets)
    s, size = np.array([x for t in sets for x in t], np.uint64), np.array([len(t) for t in sets])
    start = np.cumsum(size) - size
    for draw in range(6):
        hot = [np.array([rng.random() < 0.6 for _ in range(1024)] * (neardup.SLOTS // 1024)) | (draw == 0) for _ in range(levels)]
        job = neardup.Join(1, 1, similarity, np.zeros(neardup.SLOTS, np.uint8), hot)
        met = {}
        for key, row, at, level, _ in neardup._regions(s, start, size, job):
            for k, r, a in zip(key.tolist(), row.tolist(), at.tolist(), strict=True):
                met.setdefault(k, []).append((r, len(sets[r]) - a + level - 1))
        pairs = {(x, y) for rows in met.values() for (x, i), (y, j) in itertools.product(rows, rows) if x < y and min(i, j) >= similarity / (1 + similarity) * (len(sets[x]) + len(sets[y])) - 1e-6}
        linked = {(x, y) for x, y in itertools.combinations(range(len(sets)), 2) if len({*sets[x]} & {*sets[y]}) >= similarity * len({*sets[x]} | {*sets[y]})}
        assert linked <= pairs


def test_replicas_stay_few_however_many_regions_are_large():
    """With all regions split, as over millions of records, a set has some replicas for each of its first pivots and no more."""
    sets = [np.sort(np.random.default_rng(i).choice(200, 40, replace=False)) for i in range(20)]
    s, size = np.concatenate(sets).astype(np.uint64), np.full(20, 40)
    job = neardup.Join(3, 1, 0.6, np.zeros(neardup.SLOTS, np.uint8), [np.ones(neardup.SLOTS, bool)] * 4)
    assert sum(len(key) for key, *_ in neardup._regions(s, np.cumsum(size) - size, size, job)) <= 20 * 17 * 5


@pytest.mark.parametrize("region", [0, 3_000])
def test_links_of_sets_of_unequal_sizes(spark, monkeypatch, region):
    """Texts and their own beginnings, repeated: the smaller and the larger set of a pair stand on different sides."""
    monkeypatch.setattr(neardup, "REGION", region)
    rng = random.Random(11)
    texts = []
    for i in range(12):
        base = [f"w{rng.randrange(60)}" for _ in range(60)]
        texts += [(100 * i + j, " ".join(base[:n])) for j, n in enumerate((60, 60, 55, 48, 40, 37, 30))]
    copies = [(10_000 * c + i, t) for c in range(3) for i, t in texts]
    df = spark.createDataFrame(copies, "id long, text string").repartition(4)
    got = {(r["a"], r["b"]) for r in neardup.id_pairs(*neardup.similar_pairs(df, "id", "text", similarity=0.6, k=3, least_words=10)).collect()}
    assert got == brute(copies, 3, 10, 0.6)


def test_looping_texts_and_large_classes(spark, monkeypatch):
    monkeypatch.setattr(neardup, "REGION", 1)
    monkeypatch.setattr(neardup, "MEMBERS", 3)
    texts = [(i, t) for i, t in enumerate(["a " * 40, "a " * 39 + "b", "a b " * 20, "a b " * 20 + "c", "b a " * 20, "a b c " * 12, "a b c " * 12 + "d"])]
    texts += [(100 + i, "a b c " * 12) for i in range(10)] + [(200 + i, "a b c " * 12 + "d") for i in range(4)]
    df = spark.createDataFrame(texts, "id long, text string").repartition(3)
    for similarity in (0.5, 0.6):
        got = {(r["a"], r["b"]) for r in neardup.id_pairs(*neardup.similar_pairs(df, "id", "text", similarity=similarity, k=3, least_words=10)).collect()}
        assert got == brute(texts, 3, 10, similarity)


def test_short_records_have_a_class(spark):
    df = spark.createDataFrame([(1, "x y"), (2, "X  y."), (3, "y x"), (4, None), (5, ""), (6, "one two three four five")], "id long, text string")
    got = {r["id"]: (r["class_id"], r["n_links"]) for r in neardup.duplicate_groups(df, "id", "text").collect()}
    assert len(got) == 6 and got[1] == got[2] != got[3] and got[4] == got[5] and all(v[1] == 0 for v in got.values())


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], "id long, text string")
    assert neardup.duplicate_groups(df, "id", "text").count() == 0
    same = spark.createDataFrame([(i, "one two three four five six") for i in range(50)], "id long, text string")
    groups = neardup.duplicate_groups(same, "id", "text").collect()
    assert len(groups) == 50 and len({r["class_id"] for r in groups}) == 1


QUESTION = "Two cousins of a bookbinder in Wexdastead carry TUBA4A and one of them with wasting at 55 while the total has dropped by three points since 2009 and therapy was postponed; who should first discuss a device?"


def test_leaks(spark):
    w = QUESTION.split()
    changed = w[:24]
    for i in (4, 9, 14, 19):
        changed[i] = "anders"
    rows = [
        (1, "intro " + " ".join(w[3:16]).upper() + " outro", None), (2, " ".join(w[3:13]), ""), (3, None, "x\n" + " ".join(changed).replace(" ", "\n ")),
        (4, "nothing here at all", "of a in the"), (5, " ".join(w[:10] + ["(a", "short", "remark)"] + w[10:24]), None), (6, None, None), (7, " ".join(random.Random(1).sample(w, len(w))), ""),
    ]
    train = spark.createDataFrame(rows, "pair_id long, input string, output string").withColumn("text", F.lit(1))
    test = spark.createDataFrame([("Q1", QUESTION), ("Q1", QUESTION.replace(" ", "  ")), ("Q2", None), (None, QUESTION), ("Q3", "too short")], "question_id string, question string")
    for block in (leakage.BLOCK_WORDS, 10):
        got = sorted(tuple(r) for r in leakage.leaks(train, "pair_id", ["input", "output"], test, "question_id", "question", block).collect())
        assert got == [(1, "Q1"), (3, "Q1"), (5, "Q1")]


def test_winnowing_keeps_one_of_each_two_neighbours():
    rng = np.random.default_rng(1)
    runs, doc = rng.integers(0, 50, 500).astype(np.uint64), np.sort(rng.integers(0, 20, 500))
    kept = leakage.winnow(runs, doc)
    assert all(kept[i] or kept[i + 1] for i in range(499) if doc[i] == doc[i + 1])


@pytest.fixture(scope="module")
def vocabulary():
    pytest.importorskip("public_tokenizers")
    return tokens.Vocabulary(tokens.default_path(), tokens.default_pattern())


def test_encoder_equals_the_reference_library(vocabulary, data):
    tiktoken = pytest.importorskip("tiktoken")
    import duckdb

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokens.default_path(), "rb"))}
    theirs = tiktoken.Encoding("own", pat_str=vocabulary.pattern, mergeable_ranks=ranks, special_tokens={})
    ours, decoder, rng = tokens.Encoder(vocabulary), tokens.Decoder(vocabulary), random.Random(5)
    texts = [r[0] for r in duckdb.sql(f"SELECT text FROM '{data}/documents.parquet' WHERE text IS NOT NULL").fetchall()]
    texts += ["".join(rng.choices("abcdeT her inging0123 \n\t\x1c é漢🙂-='<|>", k=rng.randint(0, 50))) for _ in range(3000)]
    texts += ["a" * 5000, " ", "  ", "\n \n", "x  ", "  x", "<|endoftext|>"]
    for t in texts:
        ids = ours.encode(t)
        assert ids == theirs.encode_ordinary(t) and decoder.decode(np.array(ids, np.int64)) == t and ours.count(t) == len(ids)


def test_encode_edges(spark):
    pytest.importorskip("public_tokenizers")
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "hello world", 0), (3, "hello world", 0)], "doc_id long, text string, ids int")
    got = sorted((r["doc_id"], r["ids"]) for r in tokens.encode(df, "doc_id", "text").collect())
    assert got[:2] == [(1, []), (2, [])] and got[2] == got[3] and len(got[2][1]) == 2
    back = tokens.decode(tokens.encode(df, "doc_id", "text"), "doc_id", "ids").collect()
    assert sorted((r["doc_id"], r["text"]) for r in back) == [(1, ""), (2, ""), (3, "hello world"), (3, "hello world")]


@pytest.mark.parametrize(
    ("text", "ends"),
    [(None, "whole"), ("", "whole"), ("n/a", "whole"), ("[ollama error: HTTP 503 - upstream closed]", "whole"), ("All done here.", "whole"), ("All done here. [12]", "whole"), ("All done here. (low certainty)", "whole"), ('He said: "We kept it close by."', "whole"),
     ("All done here.</s>", "whole"), ("It stops in the mid", "word"), ("It stops in the mid…", "cut"), ("It stops in the mid [...]", "cut"), ("It stops in the [truncated]", "cut"), ("It stops <str", "cut"), ("It stops &#82", "cut"), ("Doses were compared, e.g.", "cut"),
     ("The gap was wide (p < 0.", "cut"), ("- one thing\n- another", "item"), ("by the group et al.", "whole"), ("This ends here。", "whole"), ("ALS and ALS and ALS and ALS and", "word"), ("ALS and ALS and ALS and ALS.", "whole"), ("counted,", "cut"), ("see the appendix, item 12.", "number")],
)
def test_endings(text, ends):
    assert truncated.ending(text)[0] == ends


def test_cut_items_and_rates(spark):
    items = "\n".join(f"- {x}" for x in ("Speech therapy", "Home nursing", "A neck collar"))
    rows = [(1, items + "\n- Voice banking\n- Speech therapy", "m"), (2, items + "\n- Voice ban", "m"), (3, items + "\n- Voice banking\n- Home nurs", None), (4, None, "m"), (5, "The slope fell to 1.5 points and fell to 2.5 again. It fell to 3.", "m"), (6, items + "\n- Speech", "m")]
    df = spark.createDataFrame(rows, "row_id long, text string, source string").withColumn("n_chars", F.length("text"))
    judged = truncated.judge(df)
    assert sorted(r["row_id"] for r in judged.where("cut").collect()) == [2, 3, 5, 6]
    assert {r["source"]: (r["n_values"], r["n_cut"]) for r in truncated.rates(judged, ["source"]).collect()} == {"m": (5, 3), None: (1, 1)}
    assert truncated.judge(df.limit(0)).count() == 0
    assert truncated.judge(df.select("text").union(df.select("text"))).where("cut").count() == 8
    assert truncated.judge(df.withColumn("m", F.create_map(F.lit(1), F.lit(2)))).where("cut").count() == 4
    clash = df.withColumns({c: F.lit(7) for c in ("kind", "key", "word", "cut", "broken", "at_limit", "n", "is_known", "same", "part", "__x")})
    again = truncated.judge(clash)
    assert sorted(r["row_id"] for r in again.where("cut").collect()) == [2, 3, 5, 6] and {r["kind"] for r in again.collect()} == {7}


@pytest.mark.parametrize(
    ("question", "answer", "name"),
    [("What is it?", None, "empty_answer"), ("What is it?", "​", "empty_answer"), ("What is it?", "<p></p>", "empty_answer"), ("What is it?", "--", "empty_answer"), ("What was found in the trial?", "You asked: what was found in the trial", "copied_question"),
     ("### Instruction:\nWhat was found in the trial of ninozole?\n\n### Response:\n", "### Instruction:\nWhat was found in the trial of ninozole?", "copied_question"), ("What is it?", "I'm sorry, but I can't help with that.", "refusal"), ("What is it?", "My guidelines don't allow me to discuss this.", "refusal"),
     ("What is it?", "The panel was unable to recommend it in 1990, but it now supports 5 mg.", ""), ("What is it?", "I am sorry to hear about that; in most cases a collar helps within five weeks.", ""), ("What does it show in a patient?", "La variante del gen se asocia con un inicio temprano según el registro de los años.", "other_language"),
     ("¿Cómo se ajusta la dosis en los pacientes?", "La variante del gen se asocia con un inicio temprano según el registro de los años.", ""), ("What does it show?", "肺活量が低下した場合は、再検査を行う。", "other_language"), ("What was found in the trial?", "What was found in the trial was a slow gain of five points over ten months in men under fifty and nothing more than this.", "")],
)
def test_defects(question, answer, name):
    assert pairs.defect(question, answer) == name


@pytest.mark.parametrize(
    ("question", "answer", "name"),
    [("What is it?", "<p></p>" * 70, "empty_answer"), ("What is it?", "[ollama error: " + "upstream closed " * 60 + "]", "empty_answer"), ("What is it?", "Error rates fell by 3% in the register.", ""),
     ("What is it?", "I'm sorry, but I can't help with that. " + "Please consult your care team about it. " * 12, "refusal"),
     ("What was found in the trial of ninozole in men?", "What was found in the trial of ninozole in women?", "copied_question"), ("What was found in the trial of ninozole?", ("What was found in the trial of ninozole? " * 40).strip(), "copied_question"),
     ("Why?", "Why", "copied_question"), ("", "Fine.", ""), (None, "Fine.", "")],
)
def test_defects_have_no_length_limits(question, answer, name):
    assert pairs.defect(question, answer) == name


def test_trie_and_limits_decide(spark):
    """Labels are whole unless their word is broken or they stand at a limit; a broken word before a stop is cut at a limit only."""
    long = "The neurologist measured the spirometry of each participant over the whole registry period and noted"
    rows = [(1, "Motor neurons", "a"), (2, "Motor neuro", "a"), (3, "The neurons of participants and spirometry are in the registry.", "a"), (4, "Upper limb", "b"), (5, "A sentence that ends in registr.", "a")]
    rows += [(100 + i, f"{i:02d} " + long[: 57 - i % 2] + "x" * (i % 2), "c") for i in range(40)]
    at_limit = "participants noted the registry and the " + "a" * 10 + " spiromet."
    rows += [(200, at_limit, "c"), (201, at_limit.replace("aaa", "a"), "c"), (202, at_limit.replace("a spiromet", "spirometry"), "c")]
    assert len(at_limit) == len(rows[5][1])
    rows += [(300 + i, "one two three four five", "b") for i in range(3)]
    df = spark.createDataFrame([(i, t, s) for i, t, s in rows], "row_id long, text string, source string")
    got = {r["row_id"]: (r["cut"], r["broken"], r["at_limit"]) for r in truncated.judge(df, source=["source"]).collect()}
    assert got[1] == (False, False, False) and got[2] == (True, True, False) and got[3][0] is False and got[4][0] is False
    assert got[5] == (False, False, False)  # broken, but no limit: a rare word may look so
    assert all(got[100 + i][0] and got[100 + i][2] for i in range(40)) and got[300] == (True, False, False)
    assert got[200] == (True, True, True) and got[201][0] is False and got[202][0] is False


def test_defect_rows(spark):
    rows = [("t", 1, None, "It stops in the mid"), ("t", 1, None, "It stops in the mid"), ("t", 2, "q", "Fine."), ("t", 3, "What is it?", None)]
    df = spark.createDataFrame(rows, "table_name string, row_id long, question string, text string")
    assert sorted(tuple(r) for r in pairs.defects(df).collect()) == [("t", 1, "truncated_answer"), ("t", 3, "empty_answer")]


def test_repair_never_raises_the_deviation():
    rng = random.Random(9)
    for seed in range(40):
        names = "abcdef"
        available = {k: rng.randint(0, 300) for k in names}
        floors = {k: rng.randint(0, 20) for k in names}
        shares = {k: rng.random() for k in names[:5]}
        shares = {k: v / sum(shares.values()) for k, v in shares.items()}
        size = rng.randint(0, sum(available.values()))
        start = sampling.start_counts(available, floors, size, seed)
        end = sampling.repair(start, available, floors, shares)
        off = lambda c: sum((c[k] - shares.get(k, 0) * size) ** 2 / max(shares.get(k, 0) * size, 1) for k in names)
        assert sum(start.values()) == sum(end.values()) == size and off(end) <= off(start) + 1e-6
        assert all(0 <= end[k] <= available[k] for k in names) and all(end[k] >= min(floors[k], available[k], start[k]) for k in names)


def test_draws_from_populations_of_any_size():
    rng = np.random.default_rng(3)
    for good, bad, n in ((3_000_000_000, 1_000_000_000, 10_000), (10, 5_000_000_000, 1_000_000_000), (2_000_000_000, 3, 1_000_000_000)):
        got = np.array([sampling.hypergeometric(rng, good, bad, n) for _ in range(300)])
        mean = n * good / (good + bad)
        spread = (mean * bad / (good + bad) * (good + bad - n) / (good + bad - 1)) ** 0.5
        assert got.min() >= max(0, n - bad) and got.max() <= min(n, good)
        assert abs(got.mean() - mean) < 5 * spread / 300**0.5 + 1e-6 and abs(got.std() / spread - 1) < 0.25
    available = {"a": 4_000_000_000, "b": 2_000_000_000, "c": 7}
    assert sum(sampling.start_counts(available, {"c": 7}, 3_000_000_000, 1).values()) == 3_000_000_000


def test_sample(spark):
    rows = [(i, ["A b", "a-b ", "A_B", "c", None][i % 5], 0) for i in range(500)] + [(None, "c", 0), (1, "a b", 0)]
    df = spark.createDataFrame(rows, "id long, category string, row_id int")
    targets = spark.createDataFrame([("a_b", 0.5, 10), ("c", 0.4, 5), ("absent", 0.1, 3)], "category string, target_share double, min_rows int")
    got = sampling.sample(df, "id", "category", targets).collect()
    ids = [r["row_id"] for r in got]
    assert len(ids) == len(set(ids)) == 250
    told = {r["category"]: r for r in sampling.report(df, "id", "category", targets).collect()}
    assert {k: v["sampled"] for k, v in told.items()} == {k: sum(r["category"] == k for r in got) for k in told}
    assert not told["absent"]["floor_met"] and told["absent"]["available"] == 0
    assert sampling.sample(df.limit(0), "id", "category", targets).count() == 0


def test_mixture(spark):
    pytest.importorskip("public_tokenizers")
    rows = [(i, "word " * (1 + i % 7), ["Big", "small ", None][0 if i % 10 else 1]) for i in range(600)] + [(601, None, "big"), (602, "", "big"), (603, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_tokens", F.lit(1))
    targets = spark.createDataFrame([("big", 0.7, 1), ("small", 0.3, 2), ("none", 0.0, 4)], "source string, target_share double, max_repeats int")
    budget = 900
    got = mixture.mix(docs, targets, budget).collect()
    assert budget - 20 <= sum(r["n_tokens"] for r in got) <= budget
    share = sum(r["n_tokens"] for r in got if r["source"] == "big") / sum(r["n_tokens"] for r in got)
    assert abs(share - 0.7) < 0.03
    assert len({(r["doc_id"], r["repeat_no"]) for r in got}) == len(got) and max(r["repeat_no"] for r in got) <= 2
    order = sorted(got, key=lambda r: r["virtual_finish"])
    for part in (300, 600):  # every prefix has the shares
        head, n = [], 0
        for r in order:
            if n < part:
                head.append(r)
                n += r["n_tokens"]
        assert abs(sum(r["n_tokens"] for r in head if r["source"] == "big") / n - 0.7) < 0.06
    assert mixture.mix(docs.limit(0), targets).count() == 0
    assert {r["source"]: r["met"] for r in mixture.report(docs, targets, budget).collect()}["big"]


def test_mixture_is_the_prefix_of_the_whole_queue(spark):
    """Against the queue in plain Python: documents of very different length, sources that run out, budgets below and above all tokens."""
    pytest.importorskip("public_tokenizers")
    rng = random.Random(4)
    rows = [(i, "word " * rng.choice([1, 2, 3, 40, 200]), rng.choice("aaaabbc")) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.5, 3), ("c", 0.2, 2)], "source string, target_share double, max_repeats int")
    share, most = {"a": 0.3, "b": 0.5, "c": 0.2}, {"a": 1, "b": 3, "c": 2}
    sizes = {r["doc_id"]: (r["source"], r["n_tokens"]) for r in mixture.queued(docs, targets, 20)[0].collect()}
    passes = [(i, r) for i in sizes for r in range(1, 4)]
    u = {(r["i"], r["r"]): r["u"] for r in spark.createDataFrame(passes, "i long, r int").withColumn("u", _ranks.draw(20, "i", "r")).collect()}
    for budget in (0, 500, 3000, None, 10**7):
        queue = []
        for s in share:
            done = 0
            for r in range(1, most[s] + 1):
                for i in sorted((i for i in sizes if sizes[i][0] == s), key=lambda i: (u[i, r], i)):
                    done += sizes[i][1]
                    queue.append((done / share[s], s, i, r, sizes[i][1]))
        total, expected = 0, set()
        limit = budget if budget is not None else sum(n for _, n in sizes.values())
        for _, _, i, r, n in sorted(queue):
            total += n
            if total > limit:
                break
            expected.add((i, r))
        assert {(r["doc_id"], r["repeat_no"]) for r in mixture.mix(docs, targets, budget).collect()} == expected


def test_residue(spark):
    normal = ["Patients with onset in the left hand were seen in {} cases over the years of the register.", "The dose of the drug is raised in steps if the liver enzymes stay below {} times the limit.", "A web survey could not be completed by {} people whose browser had JavaScript turned off."]
    bad = ["Please enable JavaScript in your browser to view this page.", "404 Not Found. The requested page could not be located on this server.", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "The endpoint was {{measure}}, seen at the visit.", "Your content goes here."]
    rows = [(i, normal[i % 3].format(i) + " " + normal[(i + 1) % 3].format(i + 1)) for i in range(300)]
    rows += [(1000 + i, (normal[i % 2].format(i) + " " if i % 2 else "") + bad[i % 5]) for i in range(40)]
    rows += [(2000, None), (2001, ""), (2002, "ok"), (2003, "Menu   Search   Log in\n" + normal[0].format(5)), (2004, "The set {SOD1, FUS} in <p>text</p> <|endoftext|> [n = 5; 3%] ends."), (2005, normal[1].format(4) * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("clash"))
    found = {r["doc_id"] for r in residue.residue(df, "doc_id", "text").collect()}
    assert found == {r[0] for r in rows if 1000 <= r[0] < 2000}
    assert residue.residue(df.limit(0), "doc_id", "text").count() == 0


def test_residue_is_not_what_talks_about_it(spark):
    talk = ["Server error rates of the monitoring unit stayed below {}%, with 4 timeouts of code 503.", "The report form of the Wex{} study uses {{subject_id}} and {{visit_date}} as field codes, which monitors fill in.", "The letter template of clinic {} asks families to insert name and date."]
    normal = "The register holds {} cases, with a mean onset at an age of {} years in the left hand."
    rows = [(i, normal.format(i, i % 90) + " " + talk[i % 3].format(i)) for i in range(120)] + [(1000 + i, normal.format(i, i) + " The dose was " + ["{0}", "{{dose}}", "<%= dose %>", "[INSERT DOSE]"][i % 4] + " at week 3.") for i in range(60)]
    rows += [(2000 + i, ["Internal Server Error: java.lang.Exception at x.y(a.java:3)", "503 Service Unavailable", "Nothing to display."][i % 3]) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in residue.residue(df, "doc_id", "text").collect()} == {i for i, _ in rows if i >= 1000}


def test_residue_model_finds_messages_that_are_not_trusted():
    content = [f"the register holds {i} cases with a mean onset at an age of {i % 90} years in the {w} hand" for i, w in enumerate(["left", "right", "other"] * 60)]
    seeds = ["please enable scripts in your browser to view this page", "your browser does not support scripts", "page not found", "please log in to view this page", "the requested page was not found on this server", "your session has expired"] * 5
    withheld = ["please log in again", "your page was not found on this server"] * 3
    examples = []
    for text in seeds + content + withheld:
        words = _words.Words([text], 0)
        examples.append(np.sort(residue.features(words)[1]).astype(np.int32).tobytes())
    fitted = residue.model([1] * len(seeds) + [0] * (len(content) + len(withheld)), examples)
    odds = [residue.score(_words.Words([t], 0), [t], fitted)[0] for t in content + withheld]
    assert max(odds[: len(content)]) < 0 < min(odds[len(content) :])


def test_queries_run(spark, data):
    from sievemill.llm import oracles, queries

    assert set(oracles.SQL) <= set(queries.QUERIES)
    for n, keys in (("p1_found", ["table_name", "row_id", "defect"]), ("p2_found", ["pair_id_a", "pair_id_b"]), ("p3_found", ["table_name", "row_id"]), ("p4_found", ["pair_id", "question_id"]), ("p8_found", ["doc_id"])):
        df = queries.QUERIES[n](spark, data)
        assert df.columns == keys
        rows = [tuple(r) for r in df.collect()]
        assert rows and len(rows) == len(set(rows))


def test_a_task_of_the_join_gets_no_more_records_as_tables_grow():
    assert neardup.join_tasks(10_000, 12) == 12
    for records in (200_000, 20_000_000):
        assert records / neardup.join_tasks(records, 610 if records > 1_000_000 else 12) <= 17_000
