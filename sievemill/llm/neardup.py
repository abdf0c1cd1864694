"""Near-duplicate records with small edits: an exact Jaccard metric-space join.

The metric is the Jaccard distance of shingle sets; two records are linked if their distance is at most r = 1 - similarity.
Whole records as pivots cannot separate such sets: nearly all distances are above 0.9 and every window is 2r wide. So the
pivots here are single shingles, in one global order from rare to common, and

* the Voronoi region of a record is that of its first pivot in this order;
* a record that misses i pivots before a shared one is at least i / |x u y| away from its neighbour (triangle inequality with
  what is shared); so a record is replicated into the regions of its next pivots only while this bound is within r, and two
  records meet in a region only if their windows around the pivot still leave room for the similarity;
* the smaller set of a pair may miss fewer pivots than the larger one; so only records whose window is that narrow stand on
  the side of the smaller sets, the others meet them, but not each other;
* regions expected to be large are split by size: each record goes to the parts of its own and those sizes that a neighbour
  which it first meets there can have. Splits by further pivots would multiply the replicas at each level and save nothing, as
  the pivots of large regions come together, in set phrases.

Every bound is a necessary condition, so no link is lost, and a last check on the whole sets makes the result exact.
The order and the splits come from a sample; they decide the cost, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ._words import Words, chunks, mix, shingles

#: Records in the sample that orders the pivots and plans the splits, and slots of the tables made from it.
SAMPLE, SLOTS = 20_000, 1 << 21
#: Members on the side of the smaller sets that a region may be expected to have before it is split by size, times the sample
#: must have seen such a region, and the ratio of the sizes of neighbouring parts.
REGION, SEEN, RATIO = 3_000, 3, 1.4
#: Records per task of the join of regions: each has some 36 replicas, which are sorted on both sides.
TASK_RECORDS = 16_000
#: Bits of a shingle's hash that are kept, below them of the pivot order.
BITS = np.uint64(44)
_LOW = np.uint64((1 << 44) - 1)
#: Bits of the parity sketch that goes into the regions, and words of the one that candidates are compared by next.
NARROW, WIDE = 128 + 24, 16
#: What a record's size and reach are told up to, in 22 and 16 bits; larger ones exclude nothing.
SIZES, REACHES = (1 << 22) - 1, (1 << 16) - 1
#: Sides on which a record stands in a region, told in the 2 bits above its size.
BOTH, SMALLER, LARGER = 0, 1, 2
#: Bits, per class and at most, of the set that tells which records occur in a candidate pair; beyond the most it lets more through.
FILTER_BITS, FILTER = 16, 1 << 28
#: Members of one class that are paired by one task.
MEMBERS = 1_000


@dataclass
class Join:
    """What the tasks need; order: by slot how often the sample has the shingle; split: at most one table, by slot whether a region is split."""

    k: int
    least_words: int
    similarity: float
    order: np.ndarray
    split: list[np.ndarray] = field(default_factory=list)


def _sets(words: Words, job: Join) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, pivot rank and shingle of each distinct shingle, sorted by doc and pivot order; records under least_words have none."""
    s, doc, _ = shingles(words, job.k)
    keep = words.counts()[doc] >= max(job.least_words, job.k)
    s, doc = s[keep] & _LOW, doc[keep]
    rare = job.order[(s % np.uint64(SLOTS)).astype(np.int64)].astype(np.uint64)
    packed = np.sort((doc.astype(np.uint64) << np.uint64(52)) | (rare << BITS) | s)
    if len(packed):
        packed = packed[np.concatenate([[True], packed[1:] != packed[:-1]])]
    doc = (packed >> np.uint64(52)).astype(np.int64)
    return doc, (packed >> BITS) & np.uint64(255), packed & _LOW


def _class_ids(s: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each whole set: records with the same set are one class."""
    with np.errstate(over="ignore"):
        a = np.add.reduceat(mix(s), start)
        b = np.bitwise_xor.reduceat(mix(s ^ np.uint64(0x5851F42D4C957F2D)), start)
        return mix(a + mix(b + size.astype(np.uint64)))


def _parity(s: np.ndarray, start: np.ndarray, bits: int, seed: int) -> np.ndarray:
    """Integers per set whose bits are the parities of the shingles hashed to them: never more bits differ than shingles do."""
    place = mix(s + np.uint64(seed)) % np.uint64(bits)
    bit, at, zero = np.uint64(1) << (place & np.uint64(63)), place >> np.uint64(6), np.uint64(0)
    return np.stack([np.bitwise_xor.reduceat(np.where(at == np.uint64(w), bit, zero), start) for w in range(-(-bits // 64))], axis=1)


def _edges(most: int) -> np.ndarray:
    """The least sizes of the parts, up to that of the size most."""
    edges = [1]
    while edges[-1] <= most:
        edges.append(max(edges[-1] + 1, int(edges[-1] * RATIO)))
    return np.array(edges)


def _regions(s: np.ndarray, start: np.ndarray, size: np.ndarray, job: Join) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, np.ndarray]]:
    """key, row of start, rank of the pivot, 1 (the pivots that are shared up to there) and side, of every region a record is replicated into."""
    # x and y are linked only if |x n y| >= s/(1+s) (|x|+|y|) and |y| >= s |x|: so at least ceil(s |x|) of x are shared, and
    # ceil(2s/(1+s) |x|) if x is not the larger one.
    shared, t = np.ceil(job.similarity * size - 1e-9).astype(np.int64), job.similarity / (1 + job.similarity)
    window = size - shared  # pivots of x that may be missed
    narrow = size - np.ceil(2 * t * size - 1e-6).astype(np.int64)
    doc = np.repeat(np.arange(len(start)), window + 1)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(window + 1) - (window + 1), window + 1)
    key, side = s[start[doc] + at], np.where(at <= narrow[doc], BOTH, LARGER)
    hot = job.split[0][(key % np.uint64(SLOTS)).astype(np.int64)] if job.split else np.zeros(len(key), bool)
    yield key[~hot], doc[~hot], at[~hot], 1, side[~hot]
    if not hot.any():
        return
    key, doc, at, side = key[hot], doc[hot], at[hot], side[hot]
    # sizes of a neighbour y with this first common pivot: |y| >= s |x|, |x| >= s |y| and |x| - at >= s/(1+s) (|x|+|y|)
    own = size[doc]
    least, most = np.ceil(job.similarity * own - 1e-6), np.floor(np.minimum(own / job.similarity, (own - at) / t - own) + 1e-6)
    edges = _edges(int(own.max() / job.similarity) + 1)
    low, high, own = (np.searchsorted(edges, x, "right") - 1 for x in (least, most, own))
    n = np.maximum(high - low + 1, 0)
    row = np.repeat(np.arange(len(key)), n)
    other, own = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n), own[row]
    with np.errstate(over="ignore"):
        parts = np.minimum(own, other).astype(np.uint64) << np.uint64(32) | np.maximum(own, other).astype(np.uint64)
        key = mix(mix(parts + np.uint64(1)) + key[row])
    yield key, doc[row], at[row], 1, np.where(own < other, SMALLER, np.where(own > other, LARGER, side[row]))


def _lower(batch: pa.RecordBatch) -> list[str]:
    return [(t or "").lower() for t in batch.column("text").to_pylist()]


def _sampler(job: Join):
    """Counts by slot of what the sample has of each shingle, if there is no order yet, or else of each region's side of the smaller sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for words in chunks(_lower(batch)):
                doc, _, s = _sets(words, job)
                if not len(doc):
                    continue
                if not job.order.any():
                    keys = s
                else:
                    start = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                    keys = np.concatenate([key[side != LARGER] for key, _, _, _, side in _regions(s, start, np.diff(np.append(start, len(doc))), job)])
                total += np.bincount((keys % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(slot, pa.int64()), "n": pa.array(total[slot], pa.int64())})

    return run


def _postings(job: Join):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # classes this task has sent: copies cost nothing further on
        for batch in batches:
            for words in chunks(_lower(batch)):
                doc, _, s = _sets(words, job)
                if not len(doc):
                    continue
                start = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                size = np.diff(np.append(start, len(doc)))
                cid = _class_ids(s, start, size)
                fresh = np.array([c not in seen and not seen.add(c) for c in cid.tolist()])
                if not fresh.any():
                    continue
                parity = _parity(s, start, NARROW, 1)[fresh]
                start, size, cid = start[fresh], size[fresh], cid[fresh]
                for key, row, at, level, side in _regions(s, start, size, job):
                    if len(key):
                        # nr: the side, the set's size, the pivots it can share at most, given the rank of the last one, and the sketch's last bits
                        told = side.astype(np.uint64) << np.uint64(62) | np.minimum(size[row], SIZES).astype(np.uint64) << np.uint64(40) | np.minimum(size[row] - at + level - 1, REACHES).astype(np.uint64) << np.uint64(24) | parity[row, 2]
                        columns = (key, cid[row], np.ascontiguousarray(parity[row, 0]), np.ascontiguousarray(parity[row, 1]), told)
                        yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in columns], names=["key", "cid", "p0", "p1", "nr"])

    return run


def hash_words(h: np.ndarray) -> np.uint64:
    """A hash of a sequence of words; none has a hash too."""
    place = mix(np.arange(1, len(h) + 1, dtype=np.uint64))
    return mix(np.array([(h * place).sum() + np.uint64(len(h)) + np.uint64(0xA0761D6478BD642F)], np.uint64))[0]


def _members(job: Join, short: bool):
    """Each record's class; short: also of the records that are too small for a set, by their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column("id").to_numpy(zero_copy_only=False), np.int64)
            for words in chunks(_lower(batch)):
                doc, _, s = _sets(words, job)
                if len(doc):
                    start = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                    cid = _class_ids(s, start, np.diff(np.append(start, len(doc))))
                if short:
                    left = np.setdiff1d(np.arange(words.docs), doc)
                    base = np.searchsorted(words.doc, np.arange(words.docs + 1))
                    with np.errstate(over="ignore"):
                        own = [hash_words(words.hash[base[d] : base[d + 1]]) for d in left.tolist()]
                    if len(left):
                        yield pa.RecordBatch.from_arrays([pa.array(np.array(own, np.uint64).view(np.int64)), pa.array(ids[words.first + left])], names=["cid", "id"])
                if len(doc):
                    yield pa.RecordBatch.from_arrays([pa.array(cid.view(np.int64)), pa.array(ids[words.first + doc[start]])], names=["cid", "id"])

    return run


def _of_wanted(job: Join, wanted: np.ndarray, whole: bool):
    """Wide sketches with sizes, or whole sets, of the records that occur in a candidate pair; wanted: bits of their classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for words in chunks(_lower(batch)):
                doc, _, s = _sets(words, job)
                if not len(doc):
                    continue
                start = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                end = np.append(start[1:], len(doc))
                cid = _class_ids(s, start, end - start)
                bit = cid % np.uint64(len(wanted) * 64)
                hit = (wanted[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
                rows = [i for i in np.flatnonzero(hit).tolist() if cid[i] not in seen and not seen.add(int(cid[i]))]
                if not rows:
                    continue
                if whole:
                    content = [(np.sort(s[start[i] : end[i]]) & np.uint64((1 << 40) - 1)).view(np.uint8).reshape(-1, 8)[:, :5].tobytes() for i in rows]
                else:
                    sketch, size = _parity(s, start, 64 * WIDE, 2), (end - start).astype(np.uint64)
                    content = [size[i].tobytes() + sketch[i].tobytes() for i in rows]
                yield pa.RecordBatch.from_arrays([pa.array(cid[rows].view(np.int64)), pa.array(content, pa.binary())], names=["cid", "content"])

    return run


def _near_sketches(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, WIDE + 1) for c in ("content_a", "content_b"))
            apart = np.bitwise_count(a[:, 1:] ^ b[:, 1:]).sum(axis=1)
            keep = pa.array(apart <= (1 - similarity) / (1 + similarity) * (a[:, 0] + b[:, 0]).astype(np.float64) + 1e-6)
            yield pa.RecordBatch.from_arrays([batch.column("ca").filter(keep), batch.column("cb").filter(keep)], names=["ca", "cb"])

    return run


def _verify(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("content_a").to_pylist(), batch.column("content_b").to_pylist()
            keep, value = [], []
            for i, (x, y) in enumerate(zip(a, b, strict=True)):
                packed = np.zeros(((len(x) + len(y)) // 5, 8), np.uint8)
                packed[:, :5] = np.frombuffer(x + y, np.uint8).reshape(-1, 5)
                z = np.sort(packed.view(np.uint64).ravel())
                shared = int(np.count_nonzero(z[1:] == z[:-1]))
                if shared >= similarity * (len(z) - shared) - 1e-9:
                    keep.append(i)
                    value.append(shared / (len(z) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("ca").take(pa.array(keep, pa.int64())), batch.column("cb").take(pa.array(keep, pa.int64())), pa.array(value, pa.float64())], names=["ca", "cb", "jaccard"])

    return run


def _slots(counted: DataFrame) -> np.ndarray:
    """At most SLOTS rows come to the driver, whatever the data."""
    table = counted.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[table.column("slot").to_numpy()] = table.column("n").to_numpy()
    return out


def join_tasks(records: int, least: int) -> int:
    return max(least, -(-records // TASK_RECORDS))


def similar_pairs(df: DataFrame, id_col: str, text_col: str, similarity: float = 0.8, k: int = 5, least_words: int = 5, short: bool = False) -> tuple[DataFrame, DataFrame]:
    """All pairs of different texts at or above the Jaccard similarity, and the classes of equal ones.

    Returns (links, members): links has ca, cb, jaccard, one row per pair of classes; members has cid and id, one row per
    record and class. A class is all records with the same shingle set (similarity 1). Null text counts as empty; records
    with fewer than least_words or k words belong to no class, or, with short, to that of the records of the same words. An id with several different texts belongs to several
    classes; repeated rows count once. Other columns of df are not read, whatever their names.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    job = Join(k, least_words, similarity, np.zeros(SLOTS, np.uint8))
    total, texts = rows.agg(F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64("text"))).first()
    share = min(1.0, SAMPLE / max(1, total))
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1) if share < 1 else rows
    job.order = np.minimum(_slots(sample.mapInArrow(_sampler(job), "slot long, n long")), 255).astype(np.uint8)
    if total > REGION and job.order.any():
        counts = _slots(sample.mapInArrow(_sampler(job), "slot long, n long"))
        hot = (counts / share > REGION) & ((counts >= SEEN) | (share == 1))
        if hot.any():
            job.split.append(hot)
    shared = spark.sparkContext.broadcast(job)

    def over(frame: DataFrame, make, schema: str) -> DataFrame:
        return frame.mapInArrow(lambda batches: make(shared.value)(batches), schema)

    postings = over(rows, _postings, "key long, cid long, p0 long, p1 long, nr long")
    # as many tasks as the records need: a task's share does not grow with the data
    tasks = join_tasks(total, int(spark.conf.get("spark.sql.shuffle.partitions")))
    side = postings.repartition(tasks, "key")
    if 2 * texts < total:  # each task sends its own copies
        side = side.distinct()
    # the sides are told apart by what is not known before it runs: so that both read the same exchange, and Python runs once
    stands = F.when(F.spark_partition_id() >= 0, F.shiftrightunsigned("nr", 62))
    a, b = (side.where(stands != none).select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("cid", "p0", "p1", "nr")]) for x, none in (("a", LARGER), ("b", SMALLER)))
    n, reach = ([cut(F.col(f"nr_{x}")).cast("int") for x in "ab"] for cut in (lambda c: F.shiftrightunsigned(c, 40).bitwiseAND(F.lit(SIZES)), lambda c: F.shiftright(c, 24).bitwiseAND(F.lit(REACHES))))
    both, least_reach, t = n[0] + n[1], F.least(*reach), similarity / (1 + similarity)
    apart = F.bit_count(F.col("p0_a").bitwiseXOR(F.col("p0_b"))) + F.bit_count(F.col("p1_a").bitwiseXOR(F.col("p1_b"))) + F.bit_count(F.col("nr_a").bitwiseXOR(F.col("nr_b")).bitwiseAND(F.lit((1 << 24) - 1)))
    ordered = (n[0] < n[1]) | ((n[0] == n[1]) & (F.col("cid_a") < F.col("cid_b"))) | ((n[0] == SIZES) & (n[1] == SIZES) & (F.col("cid_a") != F.col("cid_b")))
    near = ordered & ((least_reach == REACHES) | (least_reach >= t * both - 1e-6)) & ((F.greatest(*n) == SIZES) | (apart <= (1 - 2 * t) * both + 1e-6))
    met = a.join(b.hint("merge"), "key").where(near)
    candidates = materialize(met.select(F.least("cid_a", "cid_b").alias("ca"), F.greatest("cid_a", "cid_b").alias("cb")).distinct(), "near-candidates")

    def with_content(pairs: DataFrame, whole: bool) -> DataFrame:
        """The pairs with what is needed of both records, whose classes are found in the text again by a bit set of fixed size."""
        bits_wanted = 2 * pairs.count() * FILTER_BITS
        size = min(FILTER, 1 << max(16, bits_wanted.bit_length()))
        ids = pairs.select(F.explode(F.array("ca", "cb")).alias("cid")).select(F.col("cid").bitwiseAND(F.lit(size - 1)).alias("bit"))
        marked = ids.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("bits")).toArrow()
        wanted = np.zeros(size // 64, np.uint64)
        wanted[marked.column("word").to_numpy()] = marked.column("bits").to_numpy().view(np.uint64)
        bits = spark.sparkContext.broadcast(wanted)
        found = rows.mapInArrow(lambda batches: _of_wanted(shared.value, bits.value, whole)(batches), "cid long, content binary").dropDuplicates(["cid"])
        first = found.select(F.col("cid").alias("ca"), F.col("content").alias("content_a"))
        second = found.select(F.col("cid").alias("cb"), F.col("content").alias("content_b"))
        return pairs.join(first, "ca").join(second, "cb").select("ca", "cb", "content_a", "content_b")

    closer = materialize(with_content(candidates, False).mapInArrow(_near_sketches(similarity), "ca long, cb long"), "near-closer")
    links = with_content(closer, True).mapInArrow(_verify(similarity), "ca long, cb long, jaccard double")
    members = over(rows, lambda j: _members(j, short), "cid long, id long").distinct()
    return links, members


def duplicate_groups(df: DataFrame, id_col: str, text_col: str, similarity: float = 0.8, k: int = 5, least_words: int = 5) -> DataFrame:
    """One row per record: its id, its class and the number of classes it is linked to; similar_pairs says what a class is.

    Records of too few words have no links; those of the same words are one class, those without words another.
    """
    links, members = similar_pairs(df, id_col, text_col, similarity, k, least_words, short=True)
    count = links.select(F.explode(F.array("ca", "cb")).alias("cid")).groupBy("cid").agg(F.count("*").alias("n_links"))
    return members.join(count, "cid", "left").select("id", F.col("cid").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def id_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """The links between ids, a < b: those of linked classes and those within a class.

    Classes of more than MEMBERS records are paired in parts: the members on one side are dealt to the parts, and what they
    meet is sent to each part.
    """
    m = materialize(members, "near-members")
    sizes = m.groupBy("cid").agg(F.count("*").alias("n"))
    dealt = (sizes.agg(F.max("n")).first()[0] or 0) > MEMBERS  # with one part for all, nothing needs to be told of parts
    parts = sizes.select("cid", F.ceil(F.col("n") / MEMBERS).cast("int").alias("parts"))

    def to_parts(frame: DataFrame, cid: str) -> DataFrame:
        return frame.join(parts.withColumnRenamed("cid", cid), cid).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))) if dealt else frame

    own = m.join(parts, "cid").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")) if dealt else m
    by = ["part"] if dealt else []
    own = own.select("cid", *by, F.col("id").alias("ia"))
    within = own.join(to_parts(m, "cid").select("cid", *by, F.col("id").alias("ib")), ["cid", *by]).where(F.col("ia") < F.col("ib")).select("ia", "ib")
    first = to_parts(links.select("ca", "cb"), "ca").join(own.withColumnRenamed("cid", "ca"), ["ca", *by]).select("ia", "cb")
    second = to_parts(first, "cb").join(own.select(F.col("cid").alias("cb"), *by, F.col("ia").alias("ib")), ["cb", *by])
    both = second.select("ia", "ib").unionByName(within).where(F.col("ia") != F.col("ib"))
    return both.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b")).distinct()
