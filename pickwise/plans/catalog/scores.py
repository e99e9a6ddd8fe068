"""Catalog: score repair, normalisation, binarisation (ops 14, 29-45)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pickwise.functions.columns import r6
from pickwise.operators import scores as S
from pickwise.operators.sampling import difficulty_bins
from pickwise.plans.catalog import sqlparts as Q
from pickwise.plans.registry import register
from pickwise.sources.fixtures import F1_REWARD_MODELS, F1_VERIFIERS, f1

IDS = ["problem_id", "sample_idx"]
ALL = F1_VERIFIERS


def _out(df, vs, extra=()):
    return df.select(*IDS, *extra, *[r6(v, v) for v in vs])


def _sel(src, vs, extra=""):
    return f"SELECT problem_id, sample_idx{extra}, {Q.round_cols(vs)} FROM {src}"


# ---------------------------------------------------------------- 33, 34, 35

@register("minmax_all", sql=f"WITH n AS ({Q.minmax_all('f1', ALL)}) {_sel('n', ALL)}")
def minmax_all(spark, sf):
    return _out(S.minmax_all(f1(spark, sf), ALL), ALL)


def _sql_minmax_pp(vs):
    stats = ", ".join(f"min({v}) AS {v}__min, max({v}) AS {v}__max, count({v}) AS {v}__n, "
                      f"count_if({v} NOT IN (-1, 0, 1)) AS {v}__nd" for v in vs)
    glob = ", ".join(f"min({v}) AS g_{v}__min, max({v}) AS g_{v}__max" for v in vs)
    exprs = ", ".join(
        f"round(CASE WHEN p.{v}__n = 0 OR p.{v}__nd = 0 OR (p.{v}__min >= 0 AND p.{v}__max <= 1) THEN {v} "
        f"WHEN p.{v}__min = p.{v}__max AND p.{v}__n = p.__rows THEN ({v} - g_{v}__min) / nullif(g_{v}__max - g_{v}__min, 0) "
        f"ELSE ({v} - p.{v}__min) / nullif(p.{v}__max - p.{v}__min, 0) END, 6) AS {v}" for v in vs)
    return (f"WITH p AS (SELECT problem_id, count(*) AS __rows, {stats} FROM f1 GROUP BY problem_id), "
            f"g AS (SELECT {glob} FROM f1) "
            f"SELECT f1.problem_id, f1.sample_idx, {exprs} FROM f1 JOIN p ON f1.problem_id = p.problem_id, g")


@register("minmax_per_problem", sql=_sql_minmax_pp(ALL))
def minmax_per_problem(spark, sf):
    return _out(S.minmax_per_problem(f1(spark, sf), ALL), ALL)


def _sql_gate(vs):
    parts = []
    for v in vs:
        parts.append(
            f"SELECT '{v}' AS verifier, min({v}) AS lo, max({v}) AS hi, count({v}) AS n, "
            f"count_if({v} NOT IN (-1, 0, 1)) AS n_nondiscrete FROM f1")
    body = " UNION ALL ".join(parts)
    return (f"SELECT verifier, round(lo, 6) AS lo, round(hi, 6) AS hi, n, n_nondiscrete, "
            f"CASE WHEN n = 0 THEN 'skip_missing' WHEN n_nondiscrete = 0 THEN 'skip_discrete' "
            f"WHEN lo >= 0 AND hi <= 1 THEN 'skip_in_range' ELSE 'normalize' END AS action FROM ({body})")


@register("normalize_gate", sql=_sql_gate(ALL))
def normalize_gate(spark, sf):
    g = S.normalize_gate(f1(spark, sf), ALL)
    return g.select("verifier", r6("lo", "lo"), r6("hi", "hi"), "n", "n_nondiscrete", "action")


# ---------------------------------------------------------------- 29, 30

SMOOTH = ["rm_q", "rm_null", "j80"]


def _sql_smooth(vs, w):
    left, right = w // 2, (w - 1) - w // 2
    win = f"(PARTITION BY problem_id ORDER BY sample_idx ROWS BETWEEN {left} PRECEDING AND {right} FOLLOWING)"
    exprs = ", ".join(
        f"round(CASE WHEN count({v}) OVER {win} < count(*) OVER {win} THEN NULL "
        f"ELSE sum({v}) OVER {win} / {float(w)} END, 6) AS {v}" for v in vs)
    return f"SELECT problem_id, sample_idx, {exprs} FROM f1"


@register("smooth_scores", sql=_sql_smooth(SMOOTH, 3))
def smooth_scores(spark, sf):
    return _out(S.smooth_scores(f1(spark, sf).select(*IDS, *SMOOTH), SMOOTH, 3), SMOOTH)


@register("smooth_scores_w4", sql=_sql_smooth(SMOOTH, 4))
def smooth_scores_w4(spark, sf):
    return _out(S.smooth_scores(f1(spark, sf).select(*IDS, *SMOOTH), SMOOTH, 4), SMOOTH)


INTERP = ["rm_null", "rm_disc", "j_abstain", "j80"]


def _sql_interp(vs):
    structs = ", ".join(f"{{'pos': {i}, 'val': {v}}}" for i, v in enumerate(vs))
    exprs = []
    for i, v in enumerate(vs):
        near = (f"list_slice(list_sort(list_transform(list_filter([{structs}], lambda s: s.val IS NOT NULL), "
                f"lambda s: {{'d': abs(s.pos - {i}), 'pos': s.pos, 'val': s.val}})), 1, 2)")
        exprs.append(
            f"round(CASE WHEN {v} IS NOT NULL THEN {v} WHEN len({near}) > 0 THEN "
            f"list_sum(list_transform({near}, lambda s: s.val / (s.d + 1e-6))) / "
            f"list_sum(list_transform({near}, lambda s: 1.0 / (s.d + 1e-6))) END, 6) AS {v}")
    return f"SELECT problem_id, sample_idx, {', '.join(exprs)} FROM f1"


@register("interpolate_missing", sql=_sql_interp(INTERP))
def interpolate_missing(spark, sf):
    return _out(S.interpolate_missing(f1(spark, sf), INTERP), INTERP)


# ---------------------------------------------------------------- 37, 36

WINS = ["rm_q", "rm_price", "rm_disc"]


def _sql_winsorize(vs, lo=0.05, hi=0.95):
    parts = []
    for v in vs:
        parts.append(f"""{v}_b AS (
  SELECT max(CASE WHEN rk = k_lo THEN {v} END) AS a, max(CASE WHEN rk = k_hi THEN {v} END) AS b,
         max(mn) AS mn, max(mx) AS mx, max(nd) AS nd, max(n) AS n
  FROM (SELECT {v}, row_number() OVER (ORDER BY {v}) AS rk,
               greatest(1, CAST(ceil({lo}::DOUBLE * count({v}) OVER ()) AS BIGINT)) AS k_lo,
               greatest(1, CAST(ceil({hi}::DOUBLE * count({v}) OVER ()) AS BIGINT)) AS k_hi,
               min({v}) OVER () AS mn, max({v}) OVER () AS mx,
               count_if({v} NOT IN (-1, 0, 1)) OVER () AS nd, count({v}) OVER () AS n
        FROM f1 WHERE {v} IS NOT NULL))""")
    exprs = []
    for v in vs:
        b = f"{v}_b"
        clipped = f"least(greatest({v}, {b}.a), {b}.b)"
        exprs.append(
            f"round(CASE WHEN {b}.n = 0 OR {b}.nd = 0 OR ({b}.mn >= 0 AND {b}.mx <= 1) THEN {v} "
            f"WHEN {b}.a >= 0 AND {b}.b <= 1 THEN {clipped} "
            f"ELSE ({clipped} - {b}.a) / nullif({b}.b - {b}.a, 0) END, 6) AS {v}")
    return (f"WITH {', '.join(parts)} SELECT problem_id, sample_idx, {', '.join(exprs)} FROM f1, "
            + ", ".join(f"{v}_b" for v in vs))


@register("winsorize", sql=_sql_winsorize(WINS))
def winsorize(spark, sf):
    return _out(S.winsorize(f1(spark, sf), WINS), WINS)


@register("winsorize_per_problem", sql="""WITH g AS (SELECT problem_id, min(rm_q) AS mn, max(rm_q) AS mx, count(rm_q) AS n, count_if(rm_q NOT IN (-1, 0, 1)) AS nd,
  quantile_disc(rm_q, 0.05) AS a, quantile_disc(rm_q, 0.95) AS b FROM f1 GROUP BY problem_id)
SELECT problem_id, sample_idx, round(CASE WHEN rm_q IS NULL OR n = 0 OR nd = 0 OR (mn >= 0 AND mx <= 1) THEN rm_q
  WHEN a >= 0 AND b <= 1 THEN least(greatest(rm_q, a), b) ELSE (least(greatest(rm_q, a), b) - a) / nullif(b - a, 0) END, 6) AS rm_q
FROM f1 JOIN g USING (problem_id)""")
def winsorize_per_problem(spark, sf):
    return _out(S.winsorize(f1(spark, sf), ["rm_q"], scope="per_problem"), ["rm_q"])


@register("quantile_norm_normal")
def quantile_norm_normal(spark, sf):
    """Normal target, min-max scaled as the scores leave [0, 1]."""
    return _out(S.quantile_norm(f1(spark, sf), ["rm_q", "rm_price"], output="normal"), ["rm_q", "rm_price"])


def _sql_quantile(v, by, levels=1000):
    """Breakpoints by rank, then the place of each score between the distinct ones (equal ones: the middle of their numbers)."""
    key, on = (f"{by}, ", f" AND a.{by} = b.{by}") if by else ("", "")
    part = f"PARTITION BY {by} " if by else ""
    group = f"GROUP BY {by}" if by else ""
    using = f"USING ({by})" if by else "ON true"
    asof = f"x.{by} = d.{by} AND " if by else ""
    return f"""{v}_n AS (SELECT {key}count({v}) AS n, least(count({v}), {levels}) AS m, min({v}) AS mn, max({v}) AS mx, count_if({v} NOT IN (-1, 0, 1)) AS nd FROM f1 {group}),
{v}_r AS (SELECT {key}{v} AS x, row_number() OVER ({part}ORDER BY {v}) AS r FROM f1 WHERE {v} IS NOT NULL),
{v}_p AS (SELECT {key}n, m, unnest(range(m)) AS i FROM {v}_n),
{v}_q AS (SELECT {'a.' + by + ', ' if by else ''}i, a.x + (coalesce(b.x, a.x) - a.x) * (pos - floor(pos)) AS q
          FROM (SELECT *, i * (n - 1) / greatest(m - 1, 1)::DOUBLE AS pos FROM {v}_p) p
          JOIN {v}_r a ON a.r = floor(pos) + 1{f' AND a.{by} = p.{by}' if by else ''} LEFT JOIN {v}_r b ON b.r = a.r + 1{on}),
{v}_d AS (SELECT {key}q, min(i) AS first, max(i) AS last FROM {v}_q GROUP BY {key}q),
{v}_e AS (SELECT *, lead(q) OVER ({part}ORDER BY q) AS following FROM {v}_d),
{v}_m AS (SELECT x.problem_id, x.sample_idx, CASE WHEN n = 0 OR nd = 0 OR (mn >= 0 AND mx <= 1) THEN x.{v}
            WHEN x.{v} - 1e-7 < mn THEN 0.0 WHEN x.{v} + 1e-7 > mx THEN 1.0
            WHEN x.{v} = d.q THEN (d.first + d.last) / 2.0 / (m - 1) ELSE (d.last + (x.{v} - d.q) / (d.following - d.q)) / (m - 1) END AS {v}
          FROM f1 x JOIN {v}_n {using} ASOF LEFT JOIN {v}_e d ON {asof}x.{v} >= d.q)"""


def _quantile_oracle(vs, by=None):
    return (f"WITH {', '.join(_sql_quantile(v, by) for v in vs)} SELECT problem_id, sample_idx, {', '.join(f'round({v}, 6) AS {v}' for v in vs)} FROM "
            + " JOIN ".join(f"{v}_m" if i == 0 else f"{v}_m USING (problem_id, sample_idx)" for i, v in enumerate(vs)))


@register("quantile_norm_per_problem", sql=_quantile_oracle(["rm_q", "rm_price"], "problem_id"))
def quantile_norm_per_problem(spark, sf):
    return _out(S.quantile_norm(f1(spark, sf), ["rm_q", "rm_price"], scope="per_problem"), ["rm_q", "rm_price"])


@register("quantile_norm", sql=_quantile_oracle(["rm_q", "rm_price"]))
def quantile_norm(spark, sf):
    return _out(S.quantile_norm(f1(spark, sf), ["rm_q", "rm_price"]), ["rm_q", "rm_price"])


# ---------------------------------------------------------------- 38, 39

@register("fill_missing", sql="""
SELECT problem_id, sample_idx,
       round(coalesce(rm_null, avg(rm_null) OVER (PARTITION BY problem_id), avg(rm_null) OVER ()), 6) AS rm_null,
       round(coalesce(rm_q, avg(rm_q) OVER (PARTITION BY problem_id), avg(rm_q) OVER ()), 6) AS rm_q,
       CASE WHEN (rm_null IS NULL AND avg(rm_null) OVER (PARTITION BY problem_id) IS NULL)
              OR (rm_q IS NULL AND avg(rm_q) OVER (PARTITION BY problem_id) IS NULL) THEN 1 ELSE 0 END AS fill_fallback
FROM f1""")
def fill_missing(spark, sf):
    d = S.fill_missing(f1(spark, sf).select(*IDS, "rm_null", "rm_q"), ["rm_null", "rm_q"], "mean")
    return d.select(*IDS, r6("rm_null", "rm_null"), r6("rm_q", "rm_q"), "fill_fallback")


@register("fill_missing_zero", sql="SELECT problem_id, sample_idx, round(coalesce(rm_null, 0.0), 6) AS rm_null FROM f1")
def fill_missing_zero(spark, sf):
    d = S.fill_missing(f1(spark, sf).select(*IDS, "rm_null"), ["rm_null"], 0)
    return d.select(*IDS, r6("rm_null", "rm_null"))


@register("preprocess_score", sql="""
SELECT problem_id, sample_idx,
  CAST(CASE WHEN (CASE WHEN mn >= 0 AND mx <= 1 THEN rm_price WHEN mx > mn THEN (rm_price - mn) / (mx - mn) ELSE rm_price END) >= 0.5
       THEN 1 ELSE 0 END AS DOUBLE) AS rm_price
FROM f1, (SELECT min(rm_price) AS mn, max(rm_price) AS mx FROM f1)""")
def preprocess_score(spark, sf):
    d = S.preprocess_score(f1(spark, sf), "rm_price", 0.5)
    return d.select(*IDS, r6("rm_price", "rm_price"))


# ---------------------------------------------------------------- 40-43

_NORM = f"n AS ({Q.minmax_all('f1', ALL)})"


@register("binarize_fixed", sql=f"WITH {_NORM}, b AS ({Q.binarize('n', ALL)}) {_sel('b', ALL)}")
def binarize_fixed(spark, sf):
    d = S.binarize_fixed(S.minmax_all(f1(spark, sf), ALL), ALL, 0.5)
    return _out(d, ALL)


def _sql_thr_global(src, vs):
    parts = []
    for v in vs:
        parts.append(f"""{v}_s AS (SELECT count_if({v} <> -1) AS n, avg(y) AS cb,
    count_if({v} = 0) > 0 AND count_if({v} = 1) > 0 AND count_if({v} NOT IN (0, 1) OR {v} IS NULL) = 0 AS isbin FROM {src}),
{v}_t AS (SELECT CASE WHEN s.isbin OR s.n = 0 THEN 0.5 ELSE (
    SELECT x.{v} FROM (SELECT {v}, row_number() OVER (ORDER BY {v}) AS rk FROM {src} WHERE {v} <> -1) x
    WHERE x.rk = least(s.n, greatest(1, CAST(ceil((1.0::DOUBLE - s.cb) * s.n) AS BIGINT)))) END AS t FROM {v}_s s)""")
    return parts


def _sql_apply_thr(src, vs, tref):
    return ", ".join(
        f"CAST(CASE WHEN {v} = -1 THEN -1 WHEN {v} >= {tref(v)} THEN 1 ELSE 0 END AS DOUBLE) AS {v}" for v in vs)


def _sql_bin_cb(vs):
    parts = _sql_thr_global("n", vs)
    return (f"WITH {_NORM}, {', '.join(parts)} SELECT problem_id, sample_idx, "
            f"{_sql_apply_thr('n', vs, lambda v: f'{v}_t.t')} FROM n, " + ", ".join(f"{v}_t" for v in vs))


@register("binarize_class_balance", sql=_sql_bin_cb(ALL))
def binarize_class_balance(spark, sf):
    d = S.binarize_class_balance(S.minmax_all(f1(spark, sf), ALL), ALL)
    return _out(d, ALL)


def _sql_bin_group(vs, key, src_join):
    """Thresholds per group ``key`` (problem_id or cluster_id) over non-abstain values of
    non-binary verifiers (binary = exactly {0,1} over the whole table)."""
    glob = ", ".join(
        f"count_if({v} = 0) > 0 AND count_if({v} = 1) > 0 AND count_if({v} NOT IN (0, 1) OR {v} IS NULL) = 0 AS {v}__bin"
        for v in vs)
    thr = []
    for v in vs:
        thr.append(f"""{v}_t AS (
  SELECT {key}, max(CASE WHEN rk = least(n, greatest(1, CAST(ceil((1.0::DOUBLE - cb) * n) AS BIGINT))) THEN {v} END) AS t
  FROM (SELECT d.{key}, {v}, c.cb, row_number() OVER (PARTITION BY d.{key} ORDER BY {v}) AS rk,
               count(*) OVER (PARTITION BY d.{key}) AS n
        FROM d JOIN (SELECT {key}, avg(y) AS cb FROM d GROUP BY {key}) c ON d.{key} = c.{key}
        WHERE {v} <> -1) GROUP BY {key})""")
    exprs = ", ".join(
        f"CAST(CASE WHEN d.{v} = -1 THEN -1 WHEN d.{v} >= (CASE WHEN g.{v}__bin THEN 0.5 ELSE coalesce({v}_t.t, 0.5) END) "
        f"THEN 1 ELSE 0 END AS DOUBLE) AS {v}" for v in vs)
    joins = " ".join(f"LEFT JOIN {v}_t ON d.{key} = {v}_t.{key}" for v in vs)
    return (f"WITH {_NORM}, d AS ({src_join}), g AS (SELECT {glob} FROM d), {', '.join(thr)} "
            f"SELECT d.problem_id, d.sample_idx, {exprs} FROM d CROSS JOIN g {joins}")


@register("binarize_per_problem", sql=_sql_bin_group(ALL, "problem_id", "SELECT * FROM n"))
def binarize_per_problem(spark, sf):
    d = S.binarize_per_problem(S.minmax_all(f1(spark, sf), ALL), ALL)
    return _out(d, ALL)


_BINS_SQL = """SELECT n.*, bins.cluster_id FROM n JOIN (
  SELECT problem_id, CAST(least(floor(avg(y) * 4 + 1e-9), 3) AS INT) AS cluster_id FROM n GROUP BY problem_id) bins
  ON n.problem_id = bins.problem_id"""


@register("binarize_per_cluster", sql=_sql_bin_group(ALL, "cluster_id", _BINS_SQL))
def binarize_per_cluster(spark, sf):
    n = S.minmax_all(f1(spark, sf), ALL)
    clusters = difficulty_bins(n, 4).select("problem_id", F.col("difficulty").alias("cluster_id"))
    d = S.binarize_per_cluster(n, ALL, clusters)
    return _out(d, ALL)


# ---------------------------------------------------------------- 14, 44, 45

@register("negate_verifier", sql="""
SELECT problem_id, sample_idx,
       round(CASE WHEN j80 = -1 THEN -1 ELSE 1 - j80 END, 6) AS "~j80",
       round(CASE WHEN j_abstain = -1 THEN -1 ELSE 1 - j_abstain END, 6) AS "~j_abstain"
FROM f1""")
def negate_verifier(spark, sf):
    d = S.negate_verifier(f1(spark, sf), ["j80", "j_abstain"])
    return d.select(*IDS, r6("`~j80`", "~j80"), r6("`~j_abstain`", "~j_abstain"))


def _sql_vote_check(vs):
    parts = [f"SELECT '{v}' AS verifier, count_if({v} IS NOT NULL AND {v} NOT IN (-1, 0, 1)) AS n_outside, "
             f"count(DISTINCT {v}) AS n_distinct FROM f1" for v in vs]
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE n_outside > 0 OR n_distinct <> 2"


@register("vote_check", sql=_sql_vote_check(ALL))
def vote_check(spark, sf):
    return S.vote_check(f1(spark, sf), ALL)


@register("majority_verifier", sql="""
WITH c AS (SELECT problem_id, answer, count(*) AS cnt FROM f1 GROUP BY problem_id, answer),
r AS (SELECT problem_id, min(cnt) AS mn, max(cnt) AS mx, count(*) AS k FROM c GROUP BY problem_id)
SELECT f1.problem_id, f1.sample_idx,
       round(CASE WHEN r.k = 1 OR r.mn = r.mx THEN 1.0 ELSE CAST(c.cnt - r.mn AS DOUBLE) / (r.mx - r.mn) END, 6) AS mv_verifier
FROM f1 JOIN c ON f1.problem_id = c.problem_id AND f1.answer IS NOT DISTINCT FROM c.answer
JOIN r ON f1.problem_id = r.problem_id""")
def majority_verifier(spark, sf):
    d = S.majority_verifier(f1(spark, sf))
    return d.select(*IDS, r6("mv_verifier", "mv_verifier"))
