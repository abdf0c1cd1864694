"""A sample whose category shares match target proportions, by swap repair over counts.

A random sample that keeps the floors is drawn as counts per category signature; counts are exchanged between signatures
as long as that brings the shares nearer to their targets; then as many records of each signature are taken in random order.
Only counts per signature, of which there are as many as targets and one more, ever leave the tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ._ranks import buckets_for, draw, running

#: The signature of records whose category is null or has no target.
OTHER = "(other)"


def normal(column: str):
    """A category or source name without differences of case, spacing and hyphens; null and blank stay null."""
    plain = F.regexp_replace(F.lower(F.trim(F.regexp_replace(F.col(column), r"\s+", " "))), r"[\s_-]+", "_")
    return F.when(F.length(plain) > 0, plain)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n draws without return are good, for populations of any size; probabilities below 1e-17 of the mode's count as none."""
    if good + bad < 1_000_000_000:  # what the library's own draw takes
        return int(rng.hypergeometric(good, bad, n))
    low, high = max(0, n - bad), min(n, good)
    mode = min(max((n + 1) * (good + 1) // (good + bad + 2), low), high)

    def side(step: int) -> np.ndarray:
        """Probabilities from the mode on, in units of the mode's, until they vanish."""
        parts, at, weight = [], mode, 1.0
        while True:
            k = at + step * np.arange(1, 65_537, dtype=np.float64)
            a, b = (k, good - k + 1) if step > 0 else (good - k, k + 1)
            c, d = (bad - n + k, n - k + 1) if step > 0 else (n - k, bad - n + k + 1)
            ratio = np.where((k >= low) & (k <= high), (b * d) / (a * c), 0.0)
            parts.append(weight * np.cumprod(ratio))
            if parts[-1][-1] < 1e-17:
                return np.concatenate(parts)
            at, weight = at + step * 65_536, parts[-1][-1]

    up, down = side(1), side(-1)
    total = np.concatenate([down[::-1], [1.0], up])
    return int(mode - len(down) + np.searchsorted(np.cumsum(total), rng.random() * total.sum()))


def start_counts(available: dict[str, int], floors: dict[str, int], size: int, seed: int) -> dict[str, int]:
    """Counts of a random sample of the size that holds the floors, or all there is where less is there."""
    names = sorted(available)
    taken = {k: min(floors.get(k, 0), available[k]) for k in names}
    rest = size - sum(taken.values())
    while rest < 0:  # the floors alone are more than the sample: the largest gives way
        k = max(names, key=lambda x: (taken[x], x))
        taken[k] -= 1
        rest += 1
    left = np.array([available[k] - taken[k] for k in names], np.int64)
    rng = np.random.default_rng(seed)
    pool, more = int(left.sum()), min(rest, int(left.sum()))
    for k, n in zip(names, left.tolist(), strict=True):  # a multivariate hypergeometric draw, one category after the other
        got = hypergeometric(rng, n, pool - n, more)
        taken[k] += got
        pool, more = pool - n, more - got
    return taken


def repair(counts: dict[str, int], available: dict[str, int], floors: dict[str, int], shares: dict[str, float]) -> dict[str, int]:
    """Exchange counts from a signature above its target to one below it, by halving steps, until no exchange lowers the deviation."""
    counts, size = dict(counts), sum(counts.values())
    goal = {k: shares.get(k, 0.0) * size for k in counts}
    least = {k: min(floors.get(k, 0), available[k], counts[k]) for k in counts}

    def off(k: str, n: int) -> float:
        """The deviation of a signature: its squared distance from the target, in units of the target."""
        return (n - goal[k]) ** 2 / max(goal[k], 1.0)

    step = 1 << max(0, size.bit_length() - 1)
    while step:
        moved = True
        while moved:
            moved = False
            over = sorted((k for k in counts if counts[k] - step >= least[k]), key=lambda k: (off(k, counts[k] - step) - off(k, counts[k]), k))
            under = sorted((k for k in counts if counts[k] + step <= available[k]), key=lambda k: (off(k, counts[k] + step) - off(k, counts[k]), k))
            for a in over:
                for b in under:
                    if a == b:
                        continue
                    if off(a, counts[a] - step) + off(b, counts[b] + step) < off(a, counts[a]) + off(b, counts[b]) - 1e-9:
                        counts[a] -= step
                        counts[b] += step
                        moved = True
                        break
                if moved:
                    break
        step //= 2
    return counts


def plan(df: DataFrame, key: str, category: str, targets: DataFrame, share: float, seed: int) -> tuple[DataFrame, list[tuple]]:
    """(key and category, one row per key; rows of category, target, floor, available, sampled). Targets are one row per category."""
    wanted = {r["name"]: (float(r["target_share"] or 0), int(r["min_rows"] or 0)) for r in targets.select(normal("category").alias("name"), "target_share", "min_rows").where(F.col("name").isNotNull()).collect()}
    name = normal(category)
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("row_id"), F.when(name.isin(*wanted), name).otherwise(F.lit(OTHER)).alias("category"))
    rows = materialize(rows.groupBy("row_id").agg(F.min("category").alias("category")), "sample-rows")
    available = {k: 0 for k in wanted} | {r["category"]: r["n"] for r in rows.groupBy("category").agg(F.count("*").alias("n")).collect()}
    floors, shares = {k: v[1] for k, v in wanted.items()}, {k: v[0] for k, v in wanted.items()}
    size = int(share * sum(available.values()))
    counts = repair(start_counts(available, floors, size, seed), available, floors, shares)
    return rows, [(k, shares.get(k, 0.0), floors.get(k, 0), available[k], counts[k]) for k in sorted(counts)]


_PLAN = "category string, target_share double, min_rows int, available long, sampled long"


def sample(df: DataFrame, key: str, category: str, targets: DataFrame, share: float = 0.5, seed: int = 20) -> DataFrame:
    """row_id and category of the sampled records.

    share: the sample's size as a share of the distinct keys. Rows with a null key are left out; a key counts once, with the
    smallest of its categories; an empty table gives an empty sample.
    """
    rows, counts = plan(df, key, category, targets, share, seed)
    quota = df.sparkSession.createDataFrame(counts, _PLAN).select("category", "sampled")
    drawn = rows.withColumn("__u", draw(seed, "row_id")).withColumn("__one", F.lit(1))
    total = sum(c[3] for c in counts)
    ranked = running(drawn, ["category"], "__one", "__u", ["row_id"], buckets_for(total), "__rank")
    return ranked.join(F.broadcast(quota), "category").where(F.col("__rank") <= F.col("sampled")).select("row_id", "category")


def report(df: DataFrame, key: str, category: str, targets: DataFrame, share: float = 0.5, seed: int = 20) -> DataFrame:
    """Per category what was asked for, what there is and what was reached, and why a share was missed.

    outcome: met (within one row), shortage (all there is, and less than the target), floor (kept above the target by min_rows),
    no_target (records of other categories), surplus (takes what others lack) or gives_way (to the floors of others).
    """
    _, counts = plan(df, key, category, targets, share, seed)
    table = df.sparkSession.createDataFrame(counts, _PLAN)
    size = max(1, sum(c[4] for c in counts))
    goal, n = F.col("target_share") * size, F.col("sampled")
    met = F.abs(n - goal) <= 1.0
    outcome = (
        F.when(met, "met").when((n < goal) & (n == F.col("available")), "shortage").when((n > goal) & (n <= F.col("min_rows")), "floor")
        .when(F.col("category") == OTHER, "no_target").when(n > goal, "surplus").otherwise("gives_way")
    )
    return table.select("category", "target_share", "min_rows", "available", "sampled", (n / F.lit(size)).alias("actual_share"), met.alias("share_met"), (n >= F.col("min_rows")).alias("floor_met"), outcome.alias("outcome"))
