"""Difficulty bins, splits, sample subsets, bootstraps and augmentations (ops 46-58).

Randomness: every random choice is an order by ``md5(seed|keys)`` (see
:func:`pickwise.functions.columns.hash_order`), so results are identical across
partitionings and reruns and can be written in SQL.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pickwise.functions.columns import hash_order, hash_unit, series_udf
from pickwise.functions.quantiles import kth_smallest
from pickwise.functions.ranks import global_rank
from pickwise.functions.topk import group_topk


def bin_edges(bins: int) -> list[float]:
    """Edges 0, 1/b, 2/b, ... exactly as ``np.arange(0, 1.1, 1/b)`` produces them."""
    return [float(e) for e in np.arange(0, 1.1, 1 / bins)]


def edge_bin(x, edges) -> F.Column:
    """Right-open bin index of x among ``edges`` (digitize - 1), clipped to [0, len-2]."""
    cnt = None
    for e in edges:
        t = F.when(x >= F.lit(e), 1).otherwise(0)
        cnt = t if cnt is None else cnt + t
    return F.least(F.greatest(cnt - 1, F.lit(0)), F.lit(len(edges) - 2))


def difficulty_bins(df: DataFrame, bins: int = 10) -> DataFrame:
    """(problem_id, mean_y, difficulty): bin of the problem's mean(y)."""
    per = df.groupBy("problem_id").agg(F.avg("y").alias("mean_y"))
    return per.withColumn("difficulty", edge_bin(F.col("mean_y"), bin_edges(bins)).cast("int"))


def difficulty_label(df: DataFrame) -> DataFrame:
    """Hard if mean(y) <= 0.1, Medium if <= 0.5, else Easy."""
    per = df.groupBy("problem_id").agg(F.avg("y").alias("mean_y"))
    return per.withColumn("difficulty_label", F.when(F.col("mean_y") <= 0.1, "Hard")
                          .when(F.col("mean_y") <= 0.5, "Medium").otherwise("Easy"))


def _rank_threshold_by_group(keyed: DataFrame, group_col: str, key_col: str, ks: dict) -> dict:
    """For each group value g: the ks[g]-th smallest ``key_col`` inside the group (exact).

    Groups are few (difficulty bins), so each becomes one column for
    :func:`kth_smallest`; nothing is sorted in a single task."""
    cols = {g: F.when(F.col(group_col) == F.lit(g), F.col(key_col)) for g in ks}
    wide = keyed.select(*[c.alias(f"g{g}") for g, c in cols.items()])
    got = kth_smallest(wide, {f"g{g}": k for g, k in ks.items() if k >= 1})
    return {g: got.get(f"g{g}") for g in ks}


def stratified_split(df: DataFrame, train: float = 0.8, seed: int = 42, bins: int = 10) -> DataFrame:
    """(problem_id, difficulty, set): per difficulty bin, the floor(train * n_bin) problems with the
    smallest md5(seed|problem_id) are 'train', the rest 'test'.  train = 1 -> train = test = all;
    train = 0 -> no train rows, every problem in test.

    The problems' bins and hashes are kept (one narrow row a problem): counts, thresholds and every use of the split
    read them, and not the samples again. A kept table also keeps its partitions, so joins by problem move no row."""
    b = difficulty_bins(df, bins).select("problem_id", "difficulty")
    if train >= 1.0:
        return b.withColumn("set", F.explode(F.array(F.lit("train"), F.lit("test"))))
    if train <= 0.0:
        return b.withColumn("set", F.lit("test"))
    keyed = b.withColumn("__h", hash_unit(seed, "problem_id")).persist(StorageLevel.MEMORY_AND_DISK)
    counts = {r["difficulty"]: r["n"] for r in keyed.groupBy("difficulty").agg(F.count(F.lit(1)).alias("n")).collect()}
    ks = {g: int(math.floor(train * n)) for g, n in counts.items()}
    thr = _rank_threshold_by_group(keyed, "difficulty", "__h", ks)
    cond = None
    for g, t in thr.items():
        c = (F.col("difficulty") == F.lit(g)) & (F.lit(t is not None) & (F.col("__h") <= F.lit(t if t is not None else -1.0)))
        cond = c if cond is None else cond | c
    return keyed.select("problem_id", "difficulty",
                        F.when(cond, "train").otherwise("test").alias("set"))


def with_fixed_test(split: DataFrame, fixed: DataFrame, levels: DataFrame) -> DataFrame:
    """The split with a test set of its own: the problems of ``fixed`` are the test set whatever the split
    says, and none of them trains.  ``levels``: (problem_id, difficulty) of all problems."""
    ids = fixed.select("problem_id").distinct()
    train = split.where("set = 'train'").join(ids, "problem_id", "left_anti")
    return train.unionByName(levels.select("problem_id", "difficulty").join(ids, "problem_id").withColumn("set", F.lit("test")))


def train_queries(split: DataFrame, q: float, seed: int = 42) -> DataFrame:
    """Subset of the train problems: q < 1 -> floor(q * n_train) per difficulty bin (stratified),
    q > 1 -> int(q) problems at random, q = 1 -> all.  Test rows are kept unchanged."""
    tr = split.filter(F.col("set") == "train")
    rest = split.filter(F.col("set") != "train")
    if q == 1:
        return split
    keyed = tr.withColumn("__h", hash_unit(seed + 1, "problem_id"))
    if q < 1:
        counts = {r["difficulty"]: r["n"] for r in tr.groupBy("difficulty").agg(F.count(F.lit(1)).alias("n")).collect()}
        thr = _rank_threshold_by_group(keyed, "difficulty", "__h",
                                       {g: int(math.floor(q * n)) for g, n in counts.items()})
        cond = F.lit(False)
        for g, t in thr.items():
            if t is not None:
                cond = cond | ((F.col("difficulty") == F.lit(g)) & (F.col("__h") <= F.lit(t)))
    else:
        n = keyed.count()
        t = kth_smallest(keyed.select("__h"), {"__h": min(int(q), n)})["__h"]
        cond = F.col("__h") <= F.lit(t)
    return keyed.filter(cond).drop("__h").unionByName(rest)


def subsample_samples(df: DataFrame, n, seed: int = 42, first: bool = False, n_total: int | None = None) -> DataFrame:
    """Keep the same sample positions in every problem: a fraction (n < 1: int(n * R)) or a
    count (n > 1) of the R positions, the first ones or a seeded random choice of positions."""
    if n_total is None:
        n_total = df.agg(F.max("sample_idx")).first()[0] + 1
    m = int(n * n_total) if n < 1 else min(int(n), n_total)
    if first:
        return df.filter(F.col("sample_idx") < m)
    pos = df.sparkSession.range(n_total).select(F.col("id").cast("int").alias("sample_idx"))
    chosen = group_topk(pos.withColumn("__g", F.lit(0)), ["__g"], [hash_order(seed, "sample_idx")], m,
                        salt_buckets=1).select("sample_idx")
    return df.join(F.broadcast(chosen), "sample_idx", "left_semi")  # at most R rows


def bin_distribution(split: DataFrame) -> DataFrame:
    """Train / test problem counts per difficulty bin."""
    return split.groupBy("difficulty").pivot("set", ["train", "test"]).agg(F.count(F.lit(1))).fillna(0)


def bootstrap_samples(df: DataFrame, k: int, b: int, seed: int = 42) -> DataFrame:
    """B bootstrap draws: per (draw, problem) k of the problem's samples without replacement
    (smallest md5(seed|draw|problem|sample)); problems with fewer than k samples are left out."""
    n = df.groupBy("problem_id").agg(F.count(F.lit(1)).alias("__n"))
    d = df.join(n, "problem_id").filter(F.col("__n") >= k).drop("__n")
    rep = d.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(b - 1))))
    return group_topk(rep, ["draw", "problem_id"],
                      [hash_order(seed, "draw", "problem_id", "sample_idx")], k, rank_col="slot")


def train_val_split(df: DataFrame, frac: float = 0.9, seed: int = 42) -> DataFrame:
    """Shuffle all (problem, sample) rows with md5 order; the first int(frac * n) are 'train'."""
    keyed = df.withColumn("__h", hash_unit(seed, "problem_id", "sample_idx"))
    n = keyed.count()
    m = int(frac * n)
    if m <= 0:
        return keyed.withColumn("split", F.lit("val")).drop("__h")
    t = kth_smallest(keyed.select("__h"), {"__h": m})["__h"]
    return keyed.withColumn("split", F.when(F.col("__h") <= F.lit(t), "train").otherwise("val")).drop("__h")


def augment_noise(df: DataFrame, verifiers, sd: float = 0.1, seed: int = 42) -> DataFrame:
    """score + N(0, sd): normal draws by Box-Muller from two md5 uniforms (partition-independent)."""
    out = df
    for i, v in enumerate(verifiers):
        u1 = F.greatest(hash_unit(f"{seed}:{i}:a", "problem_id", "sample_idx"), F.lit(1e-12))
        u2 = hash_unit(f"{seed}:{i}:b", "problem_id", "sample_idx")
        z = F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(2 * math.pi) * u2)
        out = out.withColumn(v, F.col(v) + F.lit(sd) * z)
    return out


def augment_dropout(df: DataFrame, verifiers, rate: float = 0.1, seed: int = 42) -> DataFrame:
    """Multiply each score by a Bernoulli(1 - rate) mask (md5 uniform < rate -> 0)."""
    out = df
    for i, v in enumerate(verifiers):
        u = hash_unit(f"{seed}:{i}", "problem_id", "sample_idx")
        out = out.withColumn(v, F.when(u < F.lit(rate), F.col(v) * 0.0).otherwise(F.col(v)))
    return out


def _beta_from_uniform(u: np.ndarray, alpha: float) -> np.ndarray:
    """Beta(alpha, alpha) values from one uniform per row, by Joehnk's rejection on whole arrays.

    Each row has a counter-based stream of its own (its uniform's bits, mixed with the attempt's
    number), so a row's value does not depend on its batch."""
    key = (u * 2.0 ** 52).astype(np.uint64)
    out = np.full(len(u), 0.5)
    left = np.arange(len(u))
    attempt = 0

    def stream(i):
        with np.errstate(over="ignore"):
            x = key[left] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(2 * attempt + i + 1) * np.uint64(0xD1342543DE82EF95)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0 ** 53

    while len(left):
        a, b = stream(0) ** (1 / alpha), stream(1) ** (1 / alpha)
        taken = (a + b <= 1) & (a + b > 0)
        out[left[taken]] = (a / (a + b))[taken]
        left = left[~taken]
        attempt += 1
    return out


def augment_mixup(df: DataFrame, verifiers, alpha: float = 0.2, seed: int = 42, vectors=()) -> DataFrame:
    """Convex mix of scores, labels and array columns (``vectors``, such as an embedding) with one
    partner row: lambda ~ Beta(alpha, alpha).

    Partner = the row whose md5 rank is the next one (cyclic) - an equi-join on a
    rank, no pairs.  Lambda comes from the row's md5 uniform, a batch at a time.
    """
    import pandas as pd

    keyed = df.withColumn("__h", hash_order(seed, "problem_id", "sample_idx"))
    ranked = global_rank(keyed, ["__h", "problem_id", "sample_idx"], "__r")
    n = ranked.count()
    partner = ranked.select(((F.col("__r") + 1) % F.lit(n)).alias("__r"),
                            *[F.col(v).alias(f"__p_{v}") for v in [*verifiers, *vectors]], F.col("y").alias("__p_y"))

    def beta(u):
        return pd.Series(_beta_from_uniform(u.to_numpy(dtype=float), alpha))

    beta = series_udf(beta)

    j = ranked.join(partner, "__r").withColumn("lam", beta(hash_unit(seed, "problem_id", "sample_idx")))
    lam = F.col("lam")
    return j.select("problem_id", "sample_idx",
                    *[(lam * F.col(v) + (F.lit(1.0) - lam) * F.col(f"__p_{v}")).alias(v) for v in verifiers],
                    *[F.transform(F.arrays_zip(F.col(v).alias("a"), F.col(f"__p_{v}").alias("b")),
                                  lambda e: lam * e["a"] + (F.lit(1.0) - lam) * e["b"]).alias(v) for v in vectors],
                    (lam * F.col("y") + (F.lit(1.0) - lam) * F.col("__p_y")).alias("y_mix"), "lam")


def drop_unsolvable(df: DataFrame) -> DataFrame:
    """Keep problems with at least one correct sample."""
    ok = df.groupBy("problem_id").agg(F.max("y").alias("__m")).filter(F.col("__m") == 1).select("problem_id")
    return df.join(ok, "problem_id", "left_semi")


def balanced_batches(df: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """(problem_id, batch, solvable): problems in md5 order cut into batches of ``size``; every batch
    gets at least one solvable problem: a batch without one receives a solvable problem re-used
    round robin (solvable rank = batch mod n_solvable)."""
    per = df.groupBy("problem_id").agg(F.max("y").alias("solvable"))
    keyed = per.withColumn("__h", hash_unit(seed, "problem_id"))
    ranked = global_rank(keyed, ["__h", "problem_id"], "__r")
    b = ranked.withColumn("batch", (F.col("__r") / F.lit(size)).cast("int"))
    has = b.groupBy("batch").agg(F.max("solvable").alias("__has"))
    solv = b.filter(F.col("solvable") == 1)
    srank = global_rank(solv.select("problem_id", "__h"), ["__h", "problem_id"], "__s")
    ns = solv.count()
    base = b.select("problem_id", "batch", "solvable", F.lit(0).alias("reused"))
    if ns == 0:
        return base
    need = has.filter(F.col("__has") == 0).select("batch", (F.col("batch") % F.lit(ns)).alias("__s"))
    extra = need.join(srank, "__s").select("problem_id", "batch", F.lit(1).alias("solvable"), F.lit(1).alias("reused"))
    return base.unionByName(extra)
