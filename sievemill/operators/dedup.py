"""Exact and near duplicates of whole texts and of paragraphs, and leaks between two sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.words import let, n_words, runs, words
from ..session import materialize

#: Bands and rows of a band by threshold; their product is at most 128 permutations.
BANDS = {0.85: (8, 16), 0.7: (14, 9)}


def shingle_set(text: Column, k: int = 5) -> Column:
    """Distinct runs of k lower-cased words; with fewer words, the words themselves."""
    return let(words(F.lower(text)), lambda w: F.array_distinct(F.when(F.size(w) >= k, runs(w, k)).otherwise(w)))


def hashed(shingle: Column) -> Column:
    """64 bits that stand for the shingle."""
    return F.xxhash64(shingle)


def banded(df: DataFrame, key: str, text: str, threshold: float = 0.85, k: int = 5) -> DataFrame:
    """key and band: one hash per band of a MinHash signature, told apart by the band's number.

    The signature is one aggregation of the exploded shingles, the minimum under each seed; texts without words have none.
    """
    b, r = BANDS[threshold]
    rows = df.select(F.col(key), F.explode(shingle_set(F.col(text), k)).alias("s")).select(key, F.xxhash64("s").alias("v"))
    signed = rows.groupBy(key).agg(*[F.min(F.xxhash64(F.lit(seed), "v")).alias(f"m{seed}") for seed in range(b * r)])
    bands = F.array(*[F.xxhash64(F.lit(i), *[f"m{j}" for j in range(i * r, (i + 1) * r)]) for i in range(b)])
    return signed.select(key, F.explode(bands).alias("band"))


def exact(df: DataFrame, text: str, order: list[str]) -> DataFrame:
    """The first record of each text; null texts are one group, as are empty ones. Only hashes are shuffled and joined back."""
    first = df.groupBy(F.sha2(F.coalesce(F.col(text), F.lit("\u0000null")), 256).alias("__h")).agg(F.min(F.struct(*order)).alias("__first"))
    return df.join(first.select(*[F.col("__first")[c].alias(c) for c in order]), order, "left_semi")


def leaders(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(leaders, copies): k and t of the first record of each sequence of lower-cased words, and pairs a < b of a leader and
    each later record of the same words. Records without words are in neither."""
    hashes = df.where(F.size(words(text)) > 0).select(F.col(key).alias("k"), F.sha2(F.array_join(words(F.lower(text)), " "), 256).alias("h"), F.col(text).alias("t"))
    leader = hashes.groupBy("h").agg(F.min("k").alias("k"))
    copies = hashes.drop("t").join(leader.withColumnRenamed("k", "a"), "h").where(F.col("a") < F.col("k")).select("a", F.col("k").alias("b"))
    return hashes.join(leader, ["h", "k"], "left_semi").select("k", "t"), copies


def shared_bands(one: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Pairs a < b of the first row of a band and each other one of it; the others of a band share it too, and are not listed."""
    keyed = materialize(banded(one, "k", "t", threshold), "bands")
    first = keyed.groupBy("band").agg(F.min("k").alias("a"))
    return keyed.join(first, "band").where(F.col("a") < F.col("k")).select("a", F.col("k").alias("b")).distinct()


def first_of_bands(one: DataFrame, threshold: float = 0.85, most_rounds: int = 100) -> DataFrame:
    """The rows (column n) that fall if each row falls that shares a band with an earlier one that stays.

    A band is told by its first undecided row, so no pairs are made: a row stays if it is the first of all its bands, and what
    shares a band with it falls.
    """
    open_ = materialize(banded(one, "k", "t", threshold), "bands")
    fallen = None
    for _ in range(most_rounds):
        if open_.isEmpty():
            break
        first = open_.groupBy("band").agg(F.min("k").alias("m"))
        told = open_.join(first, "band")
        stays = told.groupBy("k").agg(F.min((F.col("k") == F.col("m")).cast("int")).alias("is_first")).where("is_first = 1").select("k")
        closed = told.join(stays.withColumnRenamed("k", "m"), "m", "left_semi").select("k", "band", "m")
        falls = materialize(closed.where(F.col("k") != F.col("m")).select(F.col("k").alias("n")).distinct(), "fallen")
        fallen = falls if fallen is None else fallen.unionByName(falls)
        open_ = materialize(open_.join(stays, "k", "left_anti").join(falls.withColumnRenamed("n", "k"), "k", "left_anti"), "bands")
    else:
        raise RuntimeError("no fixpoint within the allowed rounds")
    return one.where(F.lit(False)).select(F.col("k").alias("n")) if fallen is None else fallen


def band_pairs(df: DataFrame, key: str, text: str, threshold: float = 0.85) -> DataFrame:
    """Pairs a < b that share a band, told by the band's first record. Equal texts are joined through one representative, so copies do not multiply."""
    one, copies = leaders(df, key, text)
    return shared_bands(one, threshold).unionByName(copies)


def first_kept(pairs: DataFrame, nodes: DataFrame, key: str, most_rounds: int = 100) -> DataFrame:
    """Greedy by key: a record is dropped if it is linked to an earlier one that is kept. Returns the kept keys.

    This is the lexicographically first maximal independent set, not connected components: of a chain A-B-C without A-C, A
    and C stay. Each round keeps what has no undecided earlier neighbour and drops the later neighbours of what is kept.
    """
    edges = materialize(pairs.select("a", "b"), "edges")
    dropped = None
    for _ in range(most_rounds):
        if edges.isEmpty():
            break
        kept = edges.select(F.col("a").alias("n")).distinct().join(edges.select(F.col("b").alias("n")).distinct(), "n", "left_anti")
        out = edges.join(kept, edges["a"] == kept["n"], "left_semi").select(F.col("b").alias("n")).distinct()
        out = materialize(out, "dropped")
        dropped = out if dropped is None else dropped.unionByName(out)
        edges = materialize(edges.join(out, edges["a"] == out["n"], "left_anti").join(out, edges["b"] == out["n"], "left_anti").join(kept, edges["a"] == kept["n"], "left_anti"), "edges")
    else:
        raise RuntimeError("no fixpoint within the allowed rounds")
    keys = nodes.select(key)
    return keys if dropped is None else keys.join(dropped.select(F.col("n").alias(key)), key, "left_anti")


def near(df: DataFrame, key: str, text: str, threshold: float = 0.8, strict: bool = False) -> DataFrame:
    """The keys that near-duplicate removal keeps. A copy falls with its leader: to the leader, or to what the leader fell to.

    Leaders are linked by an exact join at threshold; strict links those that share a band for 0.85, and misses pairs by chance.
    """
    one, copies = leaders(df, key, text)
    nodes = df.join(copies.select(F.col("b").alias(key)), key, "left_anti")
    if strict:
        return nodes.select(key).join(first_of_bands(one).select(F.col("n").alias(key)), key, "left_anti")
    return first_kept(jaccard_pairs(one, "k", "t", threshold), nodes, key)


def jaccard_pairs(df: DataFrame, key: str, text: str, least: float, k: int = 5, apart: str | None = None) -> DataFrame:
    """Exact pairs a < b with shared and united shingles.

    A pair is opened by its first common shingle in the order from rare to common, which stands so early in both sets that the
    shingles from there on suffice for the similarity. The sets travel to the pairs as arrays, one row a pair.
    apart: a field of the key in which the two records of a pair must differ.
    """
    sets = df.select(F.col(key).alias("k"), F.explode(shingle_set(F.col(text), k)).alias("s")).select("k", hashed(F.col("s")).alias("s"))
    sets = materialize(sets, "shingles")  # read twice
    frequency = sets.groupBy("s").agg(F.count("*").alias("f"))
    own = sets.join(frequency, "s").groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "s"))), lambda x: x["s"]).alias("set"))  # one text's shingles
    own = materialize(own, "sets")
    n = F.size("set")
    opening = F.slice("set", 1, (n - F.ceil(n * least - 1e-9) + 1).cast("int"))
    prefix = own.select("k", n.alias("n"), F.posexplode(opening).alias("r", "s"))
    x, y = (prefix.select(F.col("k").alias(c), "s", F.col("n").alias(f"n{c}"), (F.col("n") - F.col("r")).alias(f"rest_{c}")) for c in "ab")
    asked = F.col("a")[apart] != F.col("b")[apart] if apart else F.lit(True)
    enough = F.least("rest_a", "rest_b") >= F.lit(least / (1 + least)) * (F.col("na") + F.col("nb")) - 1e-6
    found = x.join(y, "s").where(asked & (F.col("a") < F.col("b")) & (F.least("na", "nb") >= least * F.greatest("na", "nb")) & enough).select("a", "b").distinct()
    sides = [own.select(F.col("k").alias(c), F.col("set").alias(f"set_{c}")) for c in "ab"]
    counted = found.join(sides[0], "a").join(sides[1], "b").select("a", "b", F.size(F.array_intersect("set_a", "set_b")).cast("long").alias("n_shared"), (F.size("set_a") + F.size("set_b")).cast("long").alias("__n"))
    return counted.withColumn("n_union", F.col("__n") - F.col("n_shared")).where(F.col("n_shared") >= least * F.col("n_union")).select("a", "b", "n_shared", "n_union")


def paragraphs(df: DataFrame, key: str, text: str, separator: str = "\n\n", least_words: int = 50) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected keys): the first global occurrence of each qualifying paragraph stays, by key then position.

    Paragraphs under least_words always stay. A record that had a qualifying paragraph and lost them all is rejected.
    """
    parts = df.select(F.col(key), F.posexplode(F.split(F.col(text), separator)).alias("pos", "part")).withColumn("long", n_words("part") >= least_words)
    digest = F.sha2(F.array_join(words("part"), " "), 256)
    first = parts.where("long").groupBy(digest.alias("h")).agg(F.min(F.struct(key, "pos")).alias("m")).select(F.col(f"m.{key}").alias(key), F.col("m.pos").alias("pos"), F.lit(True).alias("is_first"))
    marked = parts.join(first, [key, "pos"], "left").withColumn("stays", ~F.col("long") | F.coalesce("is_first", F.lit(False)))
    built = marked.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("stays"), F.struct("pos", "part")))), lambda x: x["part"]), separator).alias(text),
        F.sum((F.col("long") & F.col("stays")).cast("long")).alias("n_long_kept"), F.sum(F.col("long").cast("long")).alias("n_long"), F.sum((~F.col("stays")).cast("long")).alias("n_removed"),
    )
    lost = (F.col("n_long") > 0) & (F.col("n_long_kept") == 0)
    return built.where(~lost).select(key, text, "n_removed", n_words(text).alias("word_count")), built.where(lost).select(key)


def cross_leaks(train: DataFrame, val: DataFrame, key: str, text: str, threshold: float = 0.7, strict: bool = False) -> DataFrame:
    """Keys of val whose text is linked to one of train, by an exact join at threshold; strict: by a shared band, which misses pairs by chance."""
    if strict:
        hit = banded(train, key, text, threshold).select("band").distinct()
        return banded(val, key, text, threshold).join(hit, "band", "left_semi").select(key).distinct()
    (ours, _), (theirs, copies) = leaders(train, key, text), leaders(val, key, text)
    both = [one.dropDuplicates(["k"]).select(F.struct(F.lit(side).alias("side"), "k").alias("k"), "t") for side, one in enumerate((ours, theirs))]
    pairs = jaccard_pairs(both[0].unionByName(both[1]), "k", "t", threshold, apart="side")
    hit = materialize(pairs.select(F.col("b.k").alias("a")).distinct(), "leaks")
    return hit.unionByName(copies.join(hit, "a", "left_semi").select(F.col("b").alias("a"))).select(F.col("a").alias(key)).distinct()
