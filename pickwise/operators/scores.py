"""Score repair, normalisation and binarisation over the wide score table.

Conventions: ``df`` has ``problem_id``, ``sample_idx``, usually ``y``, and one
DOUBLE column per verifier.  NULL = missing, -1 = abstain.  Per-problem
statistics are computed with a grouped aggregate (map-side partial
aggregation) and joined back on ``problem_id`` instead of a window, so one
huge problem is combined on every map task and split by AQE's skew join
rather than landing whole in one task.  Per-verifier statistics are one-row
aggregates joined back with a broadcast (the row count is 1 by construction).
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pickwise.functions import whole
from pickwise.functions.columns import safe_div, series_udf
from pickwise.functions.isotonic import fit_groups, fitted_groups
from pickwise.functions.joins import join_back, written
from pickwise.functions.quantiles import ceil_rank, grouped_ranks, kth_smallest, long_scores, select_ranks, values_at
from pickwise.functions.ranks import global_rank
from pickwise.functions.whole import groups_of, numbers, parted, with_whole

DISCRETE = (-1.0, 0.0, 1.0)


def _others(df, verifiers):
    return [c for c in df.columns if c not in verifiers]


def _replace(df, exprs: dict, drop=()):
    """Project ``df`` keeping column order, replacing the columns in ``exprs``."""
    cols = [exprs[c].alias(c) if c in exprs else F.col(c) for c in df.columns if c not in drop]
    return df.select(*cols)


# ---------------------------------------------------------------------------
# 35  normalize_gate: per scope, should the verifier be normalised at all?

def gate_stats(df: DataFrame, verifiers, by=()) -> DataFrame:
    """min, max, non-null count, rows and count of values outside {-1,0,1} per verifier (and scope)."""
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for v in verifiers:
        c = F.col(v)
        aggs += [F.min(c).alias(f"{v}__min"), F.max(c).alias(f"{v}__max"),
                 F.count(c).alias(f"{v}__n"),
                 F.count_if(~c.isin(*DISCRETE)).alias(f"{v}__nd")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def _keep_expr(v, prefix=""):
    """True when the gate leaves the verifier alone (all missing, discrete, or inside [0,1])."""
    mn, mx = F.col(f"{prefix}{v}__min"), F.col(f"{prefix}{v}__max")
    return ((F.col(f"{prefix}{v}__n") == 0) | (F.col(f"{prefix}{v}__nd") == 0)
            | ((mn >= 0) & (mx <= 1)))


def normalize_gate(df: DataFrame, verifiers, scope: str = "all_problems") -> DataFrame:
    """Long table (scope keys, verifier, lo, hi, n, n_nondiscrete, action)."""
    by = ["problem_id"] if scope == "per_problem" else []
    st = gate_stats(df, verifiers, by)
    # one pass over the statistics: each row opens into V verifier rows
    each = F.explode(F.array(*[F.struct(
        F.lit(v).alias("verifier"), F.col(f"{v}__min").cast("double").alias("lo"), F.col(f"{v}__max").cast("double").alias("hi"),
        F.col(f"{v}__n").alias("n"), F.col(f"{v}__nd").alias("n_nondiscrete")) for v in verifiers]))
    action = (F.when(F.col("n") == 0, "skip_missing").when(F.col("n_nondiscrete") == 0, "skip_discrete")
              .when((F.col("lo") >= 0) & (F.col("hi") <= 1), "skip_in_range").otherwise("normalize"))
    return st.select(*by, each.alias("s")).select(*by, "s.*").withColumn("action", action)


# ---------------------------------------------------------------------------
# 33 / 34  min-max normalisation

def _keep(st: dict, v: str) -> bool:
    """Gate decision from one verifier's statistics (all missing, discrete, or inside [0,1])."""
    mn, mx = st[f"{v}__min"], st[f"{v}__max"]
    return st[f"{v}__n"] == 0 or st[f"{v}__nd"] == 0 or (mn >= 0 and mx <= 1)


def minmax_all(df: DataFrame, verifiers) -> DataFrame:
    """(x - min) / (max - min) per verifier over all rows, behind the gate.

    Fit / transform: one aggregate pass brings the 4V statistics to the driver, the
    transform is a projection with those numbers as literals.  A constant verifier
    outside [0,1] gives NULL (0/0), see Q7.
    """
    st = gate_stats(df, verifiers).first().asDict()
    exprs = {}
    for v in verifiers:
        if _keep(st, v):
            continue
        mn, mx = st[f"{v}__min"], st[f"{v}__max"]
        exprs[v] = (F.lit(None).cast("double") if mx == mn
                    else (F.col(v) - F.lit(mn)) / F.lit(mx - mn))
    return _replace(df, exprs)


def minmax_per_problem(df: DataFrame, verifiers) -> DataFrame:
    """Min-max within each problem behind a per-problem gate.

    A problem whose values are all equal (and none missing) falls back to the
    verifier's global min/max; equal values with some missing give NULL.  Per-problem
    statistics are a grouped aggregate joined back on problem_id; the global bounds
    (2V numbers) are literals.
    """
    per = gate_stats(df, verifiers, ["problem_id"])
    per = per.select("problem_id", *[F.col(c).alias("p_" + c) for c in per.columns if c != "problem_id"])
    g = df.agg(*[F.min(v).alias(f"{v}__min") for v in verifiers],
               *[F.max(v).alias(f"{v}__max") for v in verifiers]).first().asDict()
    j = join_back(df, per, "problem_id")
    exprs = {}
    for v in verifiers:
        mn, mx = F.col(f"p_{v}__min"), F.col(f"p_{v}__max")
        const = (mn == mx) & (F.col(f"p_{v}__n") == F.col("p___rows"))
        gmn, gmx = g[f"{v}__min"], g[f"{v}__max"]
        fallback = (F.lit(None).cast("double") if gmn is None or gmx == gmn
                    else (F.col(v) - F.lit(gmn)) / F.lit(gmx - gmn))
        exprs[v] = (F.when(_keep_expr(v, "p_"), F.col(v))
                    .when(const, fallback)
                    .otherwise(safe_div(F.col(v) - mn, mx - mn)))
    return _replace(j, exprs, drop=set(per.columns[1:]))


def range_check(df: DataFrame, verifiers) -> DataFrame:
    """Rows whose normalised score left [0,1] (should be empty; the reference raises)."""
    bad = reduce(lambda a, b: a | b, [(F.col(v) < 0) & (F.col(v) != -1) | (F.col(v) > 1) for v in verifiers])
    return df.filter(bad)


# ---------------------------------------------------------------------------
# 36 quantile / 37 winsorize (scope = all problems)

def winsorize(df: DataFrame, verifiers, lower: float = 0.05, upper: float = 0.95, scope: str = "all_problems") -> DataFrame:
    """Clip each verifier at its lower / upper discrete percentile, then min-max if outside [0,1].

    Bounds are the values of 1-based rank ceil(q * n) among the non-null values
    (the documented percentile meaning, Q8).  Gate as in :func:`minmax_all`, or per problem as in
    :func:`minmax_per_problem` with ``scope='per_problem'`` (bounds by ``percentile_disc``).
    """
    if scope == "per_problem":
        return _winsorize_per_problem(df, verifiers, lower, upper)
    st = gate_stats(df, verifiers).first().asDict()
    work = [v for v in verifiers
            if not (st[f"{v}__n"] == 0 or st[f"{v}__nd"] == 0
                    or (st[f"{v}__min"] >= 0 and st[f"{v}__max"] <= 1))]
    ranks = {v: (ceil_rank(lower, st[f"{v}__n"]), ceil_rank(upper, st[f"{v}__n"])) for v in work}
    found = select_ranks(df, {(None, v): r for v, r in ranks.items()})
    exprs = {}
    for v in work:
        a, b = (found[None, v][r] for r in ranks[v])
        clipped = F.least(F.greatest(F.col(v), F.lit(a)), F.lit(b))
        if a >= 0 and b <= 1:
            exprs[v] = clipped
        else:
            exprs[v] = safe_div(clipped - F.lit(a), F.lit(b) - F.lit(a))
    return _replace(df, exprs)


def _wide(found: DataFrame, verifiers, *parts: str) -> DataFrame:
    """(problem_id, verifier__part...) of a table (problem_id, verifier, part...)."""
    return found.groupBy("problem_id").agg(*[F.max(F.when(F.col("verifier") == v, F.col(p))).alias(f"{v}__{p}") for v in verifiers for p in parts])


def _winsorize_per_problem(df: DataFrame, verifiers, lower: float, upper: float) -> DataFrame:
    st = gate_stats(df, verifiers, ["problem_id"])
    ranked, groups = grouped_ranks(long_scores(df, verifiers, "problem_id", "sample_idx"), ["problem_id"], ["sample_idx"])
    ends = F.explode(F.array(*[F.struct(F.lit(n).alias("part"), (F.col("__start") + F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("n"))) - 1).cast("long").alias("__at"))
                               for n, p in (("a", lower), ("b", upper))]))
    found = values_at(ranked, groups.select("problem_id", "verifier", ends.alias("e")).select("problem_id", "verifier", "e.*"))
    bounds = found.groupBy("problem_id", "verifier").agg(*[F.max(F.when(F.col("part") == n, F.col("value"))).alias(n) for n in ("a", "b")])
    j = join_back(df, st.join(_wide(bounds, verifiers, "a", "b"), "problem_id", "left"), "problem_id")
    exprs = {}
    for v in verifiers:
        a, b = F.col(f"{v}__a"), F.col(f"{v}__b")
        clipped = F.least(F.greatest(F.col(v), a), b)
        exprs[v] = F.when(_keep_expr(v) | F.col(v).isNull(), F.col(v)).when((a >= 0) & (b <= 1), clipped).otherwise(safe_div(clipped - a, b - a))
    return _replace(j, exprs, drop={c for c in j.columns if "__" in c})


def _quantile_map(x, qs, levels, normal: bool):
    """Scores to levels by interpolation from both sides; optionally on to standard normal values."""
    import numpy as np
    from statistics import NormalDist

    out = 0.5 * (np.interp(x, qs, levels) - np.interp(-x, -qs[::-1], -levels[::-1]))
    out[x + 1e-7 > qs[-1]] = 1.0
    out[x - 1e-7 < qs[0]] = 0.0
    if normal:
        uniq, back = np.unique(np.clip(out, 1e-7, 1 - 1e-7), return_inverse=True)
        inv = NormalDist().inv_cdf
        out = np.array([inv(u) if u == u else np.nan for u in uniq.tolist()])[back]
    out[np.isnan(x)] = np.nan
    return out


def _between(x, lo, hi, i, m):
    """Level of x between the breakpoints number i and i + 1 of m."""
    level = lambda k: k / (m - 1)
    return level(i) + F.when(hi > lo, (x - lo) / (hi - lo)).otherwise(F.lit(0.0)) * (level(i + 1) - level(i))


def _quantile_per_problem(df: DataFrame, verifiers, n_quantiles: int, normal: bool) -> DataFrame:
    """Each problem's own quantiles. Problems of few samples (at most ``n_quantiles``) are mapped whole, in the one task
    that their rows move to: a score goes to the middle of the places of its equals over n - 1. Larger
    ones share one sort of their scores."""
    from statistics import NormalDist

    small, large = parted(df, "problem_id", min(whole.GROUP_ROWS, n_quantiles))
    verifiers = list(verifiers)

    def values(table, starts):
        group, sizes = groups_of(starts, len(table)), np.diff(np.append(starts, len(table)))
        out = []
        for v in verifiers:
            x, there = numbers(table[v])
            own, score = group[there], x[there]
            order = np.lexsort((score, own))
            g, s = own[order], score[order]
            n = np.bincount(own, minlength=len(starts))
            first = np.concatenate([[0], np.cumsum(n)[:-1]])
            level, keep = np.full(len(x), np.nan), n == 0
            if len(s):
                place = np.arange(len(s)) - first[g]
                run = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (s[1:] != s[:-1]) & ~(np.isnan(s[1:]) & np.isnan(s[:-1]))]))
                length = np.diff(np.append(run, len(s)))
                a = np.repeat(place[run], length)
                with np.errstate(invalid="ignore", divide="ignore"):
                    got = (2 * a + np.repeat(length, length) - 1) / (2.0 * (n[g] - 1))
                got[n[g] == 1] = np.nan
                some = n > 0
                lo, hi = np.full(len(starts), np.nan), np.full(len(starts), np.nan)
                lo[some], hi[some] = s[first[some]], s[(first + n - 1)[some]]
                level[np.flatnonzero(there)[order]] = np.where(s - 1e-7 < lo[g], 0.0, np.where(s + 1e-7 > hi[g], 1.0, got))
                keep |= (np.bincount(own[~np.isin(score, DISCRETE)], minlength=len(starts)) == 0) | ((lo >= 0) & (hi <= 1))
            out += [pa.array(level, mask=np.isnan(level)), np.repeat(keep, sizes).astype(float)]
        return out

    mapped = with_whole(small, "problem_id", [n for v in verifiers for n in (f"{v}__to", f"{v}__keep")], values)
    exprs = {}
    for v in verifiers:
        to = F.col(f"{v}__to")
        if normal:
            inv = NormalDist().inv_cdf
            to = F.when(F.col(v).isNotNull(), series_udf(lambda p: p.map(inv))(F.least(F.greatest(to, F.lit(1e-7)), F.lit(1 - 1e-7))))
        exprs[v] = F.when(F.col(f"{v}__keep") == 1, F.col(v)).otherwise(to)
    out = _replace(mapped, exprs, drop={f"{v}__{c}" for v in verifiers for c in ("to", "keep")})
    return out if large is None else out.unionByName(_quantile_by_places(large, verifiers, n_quantiles, normal))


def _quantile_by_places(df: DataFrame, verifiers, n_quantiles: int, normal: bool) -> DataFrame:
    """Quantiles of problems of any size, from places in one sort of all scores.

    A score of a problem with n <= n_quantiles scores maps to the middle of the places of its
    equals over n - 1. In a larger problem the breakpoints around a score are known by its place: it is joined
    with those two only, so a problem with very many rows has as many keys as breakpoints."""
    from statistics import NormalDist

    base = written(df.withColumn("__row", F.monotonically_increasing_id()), "quantile-rows")
    ranked, groups = grouped_ranks(long_scores(base, verifiers, "problem_id", "__row"), ["problem_id"], ["__row"])
    ranked = written(ranked, "quantile-ranks")
    groups = written(groups, "quantile-groups")
    key = ["problem_id", "verifier"]
    runs = ranked.groupBy(*key, "score").agg(F.min("__at").alias("__a"), F.max("__at").alias("__b"))
    ends = groups.select(*key, "__start", "n").join(
        runs.groupBy(*key).agg(F.min("score").alias("lo"), F.max("score").alias("hi")), key)
    placed = join_back(runs, ends, key).withColumns({"__a": F.col("__a") - F.col("__start"), "__b": F.col("__b") - F.col("__start")})
    small = placed.where(F.col("n") <= n_quantiles).select(*key, "score", "lo", "hi", safe_div(F.col("__a") + F.col("__b"), 2.0 * (F.col("n") - 1)).alias("level"))
    m = n_quantiles
    if m > 1 and not groups.where(F.col("n") > m).isEmpty():
        # breakpoint i stands at place i * (n - 1) / (m - 1), between two whole places
        at = F.col("i") * (F.col("n") - 1) / (m - 1)
        points = (groups.where(F.col("n") > m).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).withColumn("__p", at)
                  .withColumn("end", F.explode(F.array(F.lit(0), F.lit(1))))
                  .withColumn("__at", F.col("__start") + F.least(F.floor("__p") + F.col("end"), F.col("n") - 1)))
        q = (values_at(ranked, points.select(*key, "i", "end", (F.col("__p") - F.floor("__p")).alias("share"), "__at"))
             .groupBy(*key, "i").agg(F.max("share").alias("share"), F.max(F.when(F.col("end") == 0, F.col("value"))).alias("v0"), F.max(F.when(F.col("end") == 1, F.col("value"))).alias("v1"))
             .select(*key, "i", (F.col("v0") + (F.col("v1") - F.col("v0")) * F.col("share")).alias("q")))
        q = written(q, "breakpoints")
        big = placed.where(F.col("n") > m)
        level_of = lambda place: place * (m - 1) / (F.col("n") - 1)
        big = big.withColumns({"up": F.least(F.floor(level_of(F.col("__b"))), F.lit(m - 2)).cast("int"),
                               "down": F.greatest(F.ceil(level_of(F.col("__a"))) - 1, F.lit(0)).cast("int")})
        pair = q.join(q.select(*key, (F.col("i") - 1).alias("i"), F.col("q").alias("q1")), [*key, "i"])
        for side in ("up", "down"):
            big = big.join(pair.select(*key, F.col("i").alias(side), F.col("q").alias(f"{side}0"), F.col("q1").alias(f"{side}1")), [*key, side])
        forward, backward = (_between(F.col("score"), F.col(f"{s}0"), F.col(f"{s}1"), F.col(s), m) for s in ("up", "down"))
        # equal breakpoints: from above the last, from below the first of them
        forward = F.when(F.col("score") >= F.col("up1"), (F.col("up") + 1) / (m - 1)).otherwise(forward)
        backward = F.when(F.col("score") <= F.col("down0"), F.col("down") / (m - 1)).when(F.col("score") >= F.col("down1"), (F.col("down") + 1) / (m - 1)).otherwise(backward)
        small = small.unionByName(big.select(*key, "score", "lo", "hi", (0.5 * (forward + backward)).alias("level")))
    x = F.col("score")
    level = F.when(x - 1e-7 < F.col("lo"), 0.0).when(x + 1e-7 > F.col("hi"), 1.0).otherwise(F.col("level"))
    if normal:
        inv = NormalDist().inv_cdf
        level = series_udf(lambda p: p.map(inv))(F.least(F.greatest(level, F.lit(1e-7)), F.lit(1 - 1e-7)))
    mapped = written(small.select(*key, "score", level.alias("value")), "quantile-levels")
    per = gate_stats(base, verifiers, ["problem_id"])
    j = join_back(base, per, "problem_id")
    values = ranked.select(*key, "score", "__row").join(mapped, [*key, "score"]).groupBy("__row").agg(
        *[F.max(F.when(F.col("verifier") == v, F.col("value"))).alias(f"{v}__to") for v in verifiers])
    j = j.join(values, "__row", "left")
    exprs = {v: F.when(_keep_expr(v), F.col(v)).otherwise(F.col(f"{v}__to")) for v in verifiers}
    return _replace(j, exprs, drop={c for c in j.columns if "__" in c})


def quantile_norm(df: DataFrame, verifiers, n_quantiles: int = 1000, output: str = "uniform", scope: str = "all_problems") -> DataFrame:
    """Uniform quantile transform per verifier (scope all problems), behind the gate.

    Reference quantiles: linear-interpolated percentiles of the non-missing values
    at ``min(n, n_quantiles)`` evenly spaced levels, made non-decreasing; the
    exact order statistics of all verifiers come from one :func:`select_ranks`.  A score maps to the
    average of forward and backward piecewise-linear interpolation, clipped to
    0 / 1 within 1e-7 of the end points.  ``output='normal'`` goes on to standard normal values,
    which are then min-max scaled (they leave [0, 1]); ``scope='per_problem'`` takes each problem's own
    quantiles.  The breakpoints (<= n_quantiles
    numbers) travel in the closure of an Arrow-batched pandas UDF.
    """
    import numpy as np
    import pandas as pd

    normal = output == "normal"
    if scope == "per_problem":
        out = _quantile_per_problem(df, verifiers, n_quantiles, normal)
        return minmax_per_problem(out, verifiers) if normal else out
    st = gate_stats(df, verifiers).first().asDict()
    work = [v for v in verifiers
            if not (st[f"{v}__n"] == 0 or st[f"{v}__nd"] == 0
                    or (st[f"{v}__min"] >= 0 and st[f"{v}__max"] <= 1))]
    places, wants = {}, {}
    for v in work:
        n = st[f"{v}__n"]
        m = min(n, n_quantiles)
        levels = np.linspace(0, 1, m)
        pos = np.arange(m) * (n - 1) / max(1, m - 1)  # whole numbers stay whole
        lo_r = np.floor(pos).astype(int) + 1
        hi_r = np.minimum(n, lo_r + 1)
        places[v] = levels, pos, lo_r, hi_r
        wants[None, v] = set(lo_r.tolist()) | set(hi_r.tolist())
    found = select_ranks(df, wants)
    exprs = {}
    for v in work:
        levels, pos, lo_r, hi_r = places[v]
        got = found[None, v]
        lo_v = np.array([got[r] for r in lo_r])
        hi_v = np.array([got[r] for r in hi_r])
        qs = np.maximum.accumulate(lo_v + (hi_v - lo_v) * (pos - np.floor(pos)))

        def make(qs=qs, levels=levels):
            def transform(x):
                return pd.Series(_quantile_map(x.to_numpy(dtype=float), qs, levels, normal))
            return series_udf(transform)

        exprs[v] = make()(F.col(v))
    out = _replace(df, exprs)
    return minmax_all(out, work) if normal else out


# ---------------------------------------------------------------------------
# 38 fill_missing, 39 preprocess_score

def fill_missing(df: DataFrame, verifiers, how="zero") -> DataFrame:
    """Replace NULL by 0 (``how='zero'``) or by the mean of that (problem, verifier).

    Mean of an all-missing (problem, verifier) falls back to the verifier's global mean
    (Q27, a literal); ``fill_fallback`` = 1 marks such rows.
    """
    if how in (0, "zero"):
        return df.fillna(0.0, subset=list(verifiers))
    per = df.groupBy("problem_id").agg(*[F.avg(v).alias(f"__m_{v}") for v in verifiers])
    g = df.agg(*[F.avg(v).alias(v) for v in verifiers]).first().asDict()
    j = join_back(df, per, "problem_id")
    exprs = {v: F.coalesce(F.col(v), F.col(f"__m_{v}"), F.lit(g[v]).cast("double")) for v in verifiers}
    fb = reduce(lambda a, b: a | b, [F.col(v).isNull() & F.col(f"__m_{v}").isNull() for v in verifiers])
    return j.select(*[exprs[c].alias(c) if c in exprs else F.col(c) for c in df.columns],
                    F.when(fb, 1).otherwise(0).alias("fill_fallback"))


def preprocess_score(df: DataFrame, verifier: str, threshold: float | None = None) -> DataFrame:
    """Legacy single-verifier preprocessing: untouched if inside [0,1], else min-max
    when max > min; then optional threshold -> 0/1."""
    mn, mx = df.agg(F.min(verifier), F.max(verifier)).first()
    c = F.col(verifier)
    if mn is not None and mn >= 0 and mx <= 1:
        norm = c
    elif mn is not None and mx > mn:
        norm = (c - F.lit(mn)) / F.lit(mx - mn)
    else:
        norm = c
    if threshold is not None:
        norm = F.when(norm >= F.lit(threshold), 1.0).otherwise(0.0)
    return _replace(df, {verifier: norm})


# ---------------------------------------------------------------------------
# 29 smooth, 30 interpolate

SMOOTH_BLOCK = 4_096


def smooth_scores(df: DataFrame, verifiers, w: int = 3) -> DataFrame:
    """Moving average over a problem's samples in sample_idx order, zero padded, always divided
    by w (np.convolve 'same'); gaps in sample_idx do not count, only positions do.

    One range sort numbers the rows; blocks of consecutive numbers are smoothed apart, and only the
    w - 1 rows at a block's border go to its neighbour as well. So a huge problem spreads over all
    tasks, and rows move once.  A NULL inside the window makes the result NULL."""
    from pyspark.sql import Window

    left, right = w // 2, (w - 1) - w // 2
    size = max(SMOOTH_BLOCK, 4 * w)
    at, own = F.col("__at"), F.floor(F.col("__at") / size)
    ranked = global_rank(df, ["problem_id", "sample_idx"], "__at")  # neighbours of a problem have neighbouring numbers
    inside = F.pmod(at, F.lit(size))
    # a row is read by windows up to ``left`` numbers after it and ``right`` before it
    homes = F.filter(F.array(own, F.when(inside >= size - left, own + 1), F.when(inside < right, own - 1)), lambda b: b.isNotNull())
    blocks = ranked.withColumn("__block", F.explode(homes))
    window = Window.partitionBy("__block", "problem_id").orderBy("__at").rowsBetween(-left, right)
    exprs = {v: F.when(F.count(v).over(window) < F.count(F.lit(1)).over(window), F.lit(None).cast("double"))
             .otherwise(F.sum(F.col(v).cast("double")).over(window) / F.lit(float(w))) for v in verifiers}
    smoothed = blocks.select(*[exprs[c].alias(c) if c in exprs else F.col(c) for c in df.columns], "__at", "__block")
    return smoothed.where(F.col("__block") == own).drop("__at", "__block")


def interpolate_missing(df: DataFrame, verifiers) -> DataFrame:
    """Missing score = inverse-distance (1/(d+1e-6)) weighted mean of the 2 nearest present
    verifiers by column position (lower position first on ties).  Row-local, no shuffle."""
    arr = F.array(*[F.struct(F.lit(i).alias("pos"), F.col(v).alias("val")) for i, v in enumerate(verifiers)])
    present = F.filter(arr, lambda s: s["val"].isNotNull())
    exprs = {}
    for i, v in enumerate(verifiers):
        near = F.slice(F.array_sort(F.transform(present, lambda s: F.struct(
            F.abs(s["pos"] - F.lit(i)).alias("d"), s["pos"].alias("pos"), s["val"].alias("val")))), 1, 2)
        wsum = F.aggregate(near, F.lit(0.0), lambda acc, s: acc + F.lit(1.0) / (s["d"] + F.lit(1e-6)))
        vsum = F.aggregate(near, F.lit(0.0), lambda acc, s: acc + s["val"] / (s["d"] + F.lit(1e-6)))
        exprs[v] = F.when(F.col(v).isNotNull(), F.col(v)).when(F.size(present) > 0, vsum / wsum)
    return _replace(df, exprs)


# ---------------------------------------------------------------------------
# 40-43 binarisation

def binarize_fixed(df: DataFrame, verifiers, t: float = 0.5) -> DataFrame:
    """1.0 if score >= t else 0.0; -1 stays -1; missing compares false -> 0.0 (as NaN does)."""
    exprs = {v: F.when(F.col(v) == -1, -1.0).when(F.col(v) >= F.lit(t), 1.0).otherwise(0.0)
             for v in verifiers}
    return _replace(df, exprs)


def _binary_flags(df, verifiers, by=()):
    """Per verifier (and scope): is the value set exactly {0, 1}? count of non-abstain values."""
    aggs = [F.avg("y").alias("__cb")]
    for v in verifiers:
        c = F.col(v)
        aggs += [(F.count_if(c == 0) > 0) & (F.count_if(c == 1) > 0)
                 & (F.count_if(~c.isin(0.0, 1.0) | c.isNull()) == 0),
                 F.count_if(c != -1)]
        aggs[-2] = aggs[-2].alias(f"{v}__bin")
        aggs[-1] = aggs[-1].alias(f"{v}__na")
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def _apply_thresholds(df, verifiers, tcol):
    exprs = {v: F.when(F.col(v) == -1, -1.0).when(F.col(v) >= tcol(v), 1.0).otherwise(0.0) for v in verifiers}
    return exprs


def binarize_class_balance(df: DataFrame, verifiers) -> DataFrame:
    """Threshold t_v = sorted non-abstain scores at 1-based rank ceil((1-cb)*n), cb = mean(y).

    Exactly-{0,1} verifiers and all-abstain verifiers use 0.5; a rank below 1
    (cb = 1) is clipped to 1 (Q11).  Order statistics come from
    :func:`kth_smallest` (no whole-column sort).
    """
    st = _binary_flags(df, verifiers).first().asDict()
    cb = st["__cb"]
    ks, thr = {}, {}
    for v in verifiers:
        n = st[f"{v}__na"]
        if st[f"{v}__bin"] or n == 0:
            thr[v] = 0.5
        else:
            ks[v] = min(n, max(1, math.ceil((1.0 - cb) * n)))
    nonab = df.select(*[F.when(F.col(v) != -1, F.col(v)).alias(v) for v in ks])
    thr.update(kth_smallest(nonab, ks))
    return _replace(df, _apply_thresholds(df, verifiers, lambda v: F.lit(thr[v])))


def binarize_per_problem(df: DataFrame, verifiers) -> DataFrame:
    """Per-problem class-balance thresholds: cb and the sort are within the problem.

    The rank is ceil((1-cb_p)*n_p) clipped to [1, n_p] where n_p counts the
    problem's non-abstain scores.  A verifier whose values over the whole table
    are exactly {0,1} keeps 0.5. Problems of few samples find their thresholds whole, in the task that
    their rows move to; the larger ones share one sort of their scores.
    """
    glob = _binary_flags(df, verifiers).first().asDict()
    cont = [v for v in verifiers if not glob[f"{v}__bin"]]
    if not cont:
        return binarize_fixed(df, verifiers, 0.5)
    small, large = parted(df, "problem_id")

    def values(table, starts):
        group, sizes = groups_of(starts, len(table)), np.diff(np.append(starts, len(table)))
        y, known = numbers(table["y"])
        with np.errstate(invalid="ignore"):
            cb = np.bincount(group[known], y[known], len(starts)) / np.bincount(group[known], minlength=len(starts))
        out = []
        for v in cont:
            x, there = numbers(table[v])
            there &= x != -1
            own = group[there]
            n = np.bincount(own, minlength=len(starts))
            # without any label: the smallest score
            k = np.where(np.isnan(cb), 1, np.minimum(n, np.maximum(1, np.ceil((1.0 - cb) * n)))).astype(np.int64)
            at = np.concatenate([[0], np.cumsum(n)[:-1]]) + np.maximum(k, 1) - 1
            ordered = x[there][np.lexsort((x[there], own))]
            t = np.full(len(starts), np.nan)
            t[n > 0] = ordered[at[n > 0]]
            out.append(pa.array(np.repeat(t, sizes), mask=np.repeat(n == 0, sizes)))
        return out

    parts = [with_whole(small, "problem_id", [f"__t_{v}" for v in cont], values)]
    parts.append(df.where("problem_id is null").select("*", *[F.lit(None).cast("double").alias(f"__t_{v}") for v in cont]))
    if large is not None:
        parts.append(join_back(large, _thresholds_by_places(large, cont), "problem_id", "left").select(*parts[0].columns))
    exprs = {}
    for v in verifiers:
        t = F.coalesce(F.col(f"__t_{v}"), F.lit(0.5)) if v in cont else F.lit(0.5)
        exprs[v] = F.when(F.col(v) == -1, -1.0).when(F.col(v) >= t, 1.0).otherwise(0.0)
    return _replace(reduce(DataFrame.unionByName, parts), exprs, drop={f"__t_{v}" for v in cont})


def _thresholds_by_places(df: DataFrame, cont) -> DataFrame:
    """(problem_id, __t_verifier...): class-balance thresholds of problems of any size, from places in one sort of all scores."""
    cbp = df.groupBy("problem_id").agg(F.avg("y").alias("cb"))
    voting = df.select("problem_id", "sample_idx", *[F.when(F.col(v) != -1, F.col(v)).alias(v) for v in cont])
    ranked, groups = grouped_ranks(long_scores(voting, cont, "problem_id", "sample_idx"), ["problem_id"], ["sample_idx"])
    k = F.least(F.col("n"), F.greatest(F.lit(1), F.ceil((F.lit(1.0) - F.col("cb")) * F.col("n"))))
    found = values_at(ranked, groups.join(cbp, "problem_id").select("problem_id", "verifier", (F.col("__start") + k - 1).cast("long").alias("__at")))
    thr = found.groupBy("problem_id").pivot("verifier", cont).agg(F.first("value"))
    return thr.select("problem_id", *[F.col(v).alias(f"__t_{v}") for v in cont])


def binarize_per_cluster(df: DataFrame, verifiers, clusters: DataFrame) -> DataFrame:
    """Class-balance thresholds within each cluster (``clusters``: problem_id, cluster_id).

    Exactly-{0,1} verifiers keep 0.5 (Q10).  Rank ceil((1-cb_c)*n_c) clipped to [1, n_c].
    Clusters are few and large: :func:`select_ranks` finds the thresholds of all (cluster, verifier)
    pairs together, from counts alone."""
    glob = _binary_flags(df, verifiers).first().asDict()
    cont = [v for v in verifiers if not glob[f"{v}__bin"]]
    d = df.join(clusters, "problem_id")
    stats = d.groupBy("cluster_id").agg(F.avg("y").alias("cb"),
                                        *[F.count_if(F.col(v) != -1).alias(f"n_{v}") for v in cont]).collect()
    ks = {(r["cluster_id"], v): min(r[f"n_{v}"], max(1, math.ceil((1.0 - r["cb"]) * r[f"n_{v}"]))) for r in stats for v in cont if r[f"n_{v}"]}
    voting = d.select("cluster_id", *[F.when(F.col(v) != -1, F.col(v)).alias(v) for v in cont])
    found = select_ranks(voting, {key: [k] for key, k in ks.items()}, "cluster_id")
    exprs = {}
    for v in verifiers:
        t = F.lit(0.5)
        for (c, vv), k in ks.items():
            if vv == v:
                t = F.when(F.col("cluster_id") == F.lit(c), F.lit(found[c, v][k])).otherwise(t)
        exprs[v] = F.when(F.col(v) == -1, -1.0).when(F.col(v) >= t, 1.0).otherwise(0.0)
    return _replace(d, exprs)


# ---------------------------------------------------------------------------
# 14 negate, 44 vote_check, 45 majority verifier

def negate_verifier(df: DataFrame, names) -> DataFrame:
    """Add ``~x`` = 1 - x (-1 stays -1) for each name; an existing ``~x`` column wins."""
    out = df
    for v in names:
        neg = "~" + v
        if neg in df.columns:
            continue
        out = out.withColumn(neg, F.when(F.col(v) == -1, -1.0).otherwise(F.lit(1.0) - F.col(v)))
    return out


def vote_check(df: DataFrame, verifiers, shifted: bool = False) -> DataFrame:
    """Verifiers whose votes leave {-1,0,1} ({0,1,2} after the +1 shift), or that do not
    have exactly two distinct values (naive Bayes), with counts."""
    allowed = (0.0, 1.0, 2.0) if shifted else DISCRETE
    # one scan: values are counted per (verifier, value) in every task, then per verifier
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("verifier"), F.col(v).cast("double").alias("score")) for v in verifiers]))
    values = df.select(each.alias("s")).select("s.*").groupBy("verifier", "score").agg(F.count(F.lit(1)).alias("k"))
    out = values.groupBy("verifier").agg(
        F.coalesce(F.sum(F.when(F.col("score").isNotNull() & ~F.col("score").isin(*allowed), F.col("k"))), F.lit(0)).alias("n_outside"),
        F.count("score").alias("n_distinct"))
    return out.filter((F.col("n_outside") > 0) | (F.col("n_distinct") != 2))


def majority_verifier(df: DataFrame, answer_col: str = "answer", out: str = "mv_verifier") -> DataFrame:
    """Score of a sample = frequency of its answer in the problem, min-max scaled over the
    problem's distinct answers; all frequencies equal or one answer -> 1.  NULL is an answer."""
    key = F.coalesce(F.col(answer_col), F.lit("\u0000NULL"))
    d = df.withColumn("__ans", key)
    cnt = d.groupBy("problem_id", "__ans").agg(F.count(F.lit(1)).alias("__c"))
    rng = cnt.groupBy("problem_id").agg(F.min("__c").alias("__mn"), F.max("__c").alias("__mx"),
                                        F.count(F.lit(1)).alias("__k"))
    # counts and their range meet on the small side; the samples are joined once
    j = join_back(d, cnt.join(rng, "problem_id"), ["problem_id", "__ans"])
    score = (F.when((F.col("__k") == 1) | (F.col("__mn") == F.col("__mx")), F.lit(1.0))
             .otherwise((F.col("__c") - F.col("__mn")).cast("double") / (F.col("__mx") - F.col("__mn"))))
    return j.select(*[F.col(c) for c in df.columns], score.alias(out))


# ---------------------------------------------------------------------------
# 31 / 32 calibration

def calibrate_isotonic(df: DataFrame, verifiers) -> DataFrame:
    """Per (problem, verifier): isotonic fit of the scores against linspace(0, 1, n) in sample
    order (the targets rise with sample position, Q28), then each score mapped through the
    fit.

    Problems of few samples are fitted whole, in the one task that their rows move to. Of the larger ones, one range
    sort in sample order gives the targets, one in score order the places; their fits
    are pooled by pieces of places (:func:`pickwise.functions.isotonic.fit_groups`), so a problem
    with very many samples is fitted by many tasks. Rows without a problem have no fit."""
    small, large = parted(df, "problem_id")
    verifiers = list(verifiers)

    def values(table, starts):
        group, place = groups_of(starts, len(table)), numbers(table["sample_idx"])
        place = np.where(place[1], place[0], -np.inf)
        out = []
        for v in verifiers:
            x, there = numbers(table[v])
            fit = np.full(len(x), np.nan)
            fit[there] = fitted_groups(group[there], place[there], x[there])
            out.append(pa.array(fit, mask=~there))
        return out

    fits = with_whole(small, "problem_id", [f"{v}__fit" for v in verifiers], values)
    out = _replace(fits, {v: F.col(f"{v}__fit") for v in verifiers}, drop={f"{v}__fit" for v in verifiers})
    out = out.unionByName(_replace(df.where("problem_id is null"), {v: F.lit(None).cast("double") for v in verifiers}))
    return out if large is None else out.unionByName(_calibrate_by_places(large, verifiers))


def _calibrate_by_places(df: DataFrame, verifiers) -> DataFrame:
    """:func:`calibrate_isotonic` of problems of any size."""
    base = written(df.withColumn("__row", F.monotonically_increasing_id()), "isotonic-input")
    scores = long_scores(base, verifiers, "problem_id", "sample_idx", "__row")
    ordered = global_rank(scores, ["problem_id", "verifier", "sample_idx", "__row"], "__pos")
    groups = written(ordered.groupBy("problem_id", "verifier").agg(F.min("__pos").alias("start"), F.count(F.lit(1)).alias("n")), "isotonic-groups")
    target = F.when(F.col("n") > 1, (F.col("__pos") - F.col("start")) / (F.col("n") - 1)).otherwise(F.lit(0.0))
    aimed = join_back(ordered, groups, ["problem_id", "verifier"]).withColumn("y", target)
    ranked = global_rank(aimed, ["problem_id", "verifier", "score", "__row"], "at")  # both sorts begin a group at the same number
    fits = fit_groups(ranked.select(F.col("__row").alias("row"), "start", "n", "at", F.col("score").alias("x"), "y"))
    named = fits.join(groups.select("start", "verifier"), "start")
    wide = named.groupBy("row").agg(*[F.max(F.when(F.col("verifier") == v, F.col("value"))).alias(f"{v}__fit") for v in verifiers])
    j = base.join(wide, F.col("__row") == F.col("row"), "left")
    return _replace(j, {v: F.col(f"{v}__fit") for v in verifiers}, drop={"__row", "row", *(f"{v}__fit" for v in verifiers)})


def calibrate_sigmoid(df: DataFrame, verifiers) -> DataFrame:
    """Per verifier over all rows: logistic regression (L2, C = 1) of (score > median) on the
    score (taken in standard units while fitting), then the score replaced by the fitted probability.  The median is exact (two order
    statistics from :func:`select_ranks`); the fit is the distributed Newton of
    :func:`pickwise.models.logistic.logistic_fit` with one feature."""
    from pickwise.models.logistic import logistic_fit

    counts = df.agg(*[F.count(v).alias(v) for v in verifiers]).first().asDict()
    found = select_ranks(df, {(None, v): ((n + 1) // 2, n // 2 + 1) for v, n in counts.items()})
    exprs = {}
    for v in verifiers:
        n = counts[v]
        if n == 0:
            continue
        med = (found[None, v][(n + 1) // 2] + found[None, v][n // 2 + 1]) / 2.0
        # centred and scaled for the fit; the penalty stays that of the plain score
        sd = df.agg(F.stddev_pop(v)).first()[0] or 1.0
        d = df.filter(F.col(v).isNotNull()).select(((F.col(v) - F.lit(med)) / F.lit(sd)).alias("x"), (F.col(v) > F.lit(med)).cast("int").alias("y"))
        prm = logistic_fit(d, ["x"], class_weight=None, C=sd * sd, iters=200).first()
        if prm is None:  # one target class only: nothing to fit, keep the scores
            continue
        exprs[v] = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(prm["b0"]) + F.lit(prm["b1"]) * (F.col(v) - F.lit(med)) / F.lit(sd))))
    return _replace(df, exprs)
