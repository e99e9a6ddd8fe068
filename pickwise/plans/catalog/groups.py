"""Catalog: nearest train problems, routing, clusters (ops 59-63, 65-76)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pickwise.functions.columns import r6
from pickwise.operators import groups as G
from pickwise.operators import neighbors as NB
from pickwise.operators.sampling import difficulty_bins, stratified_split
from pickwise.plans.catalog.metrics import _split_sql
from pickwise.plans.registry import register
from pickwise.sources.fixtures import F1_CLEAN_JUDGES, f1, f4

JV = F1_CLEAN_JUDGES


def _sets(spark, sf, src=None):
    d = src if src is not None else f1(spark, sf)
    split = stratified_split(d, 0.8, 42, 10)
    test = d.join(split.filter(F.col("set") == "test").select("problem_id"), "problem_id", "left_semi")
    train = d.join(split.filter(F.col("set") == "train").select("problem_id"), "problem_id", "left_semi")
    return test, train


def _mean_vec_sql(src):
    return f"SELECT problem_id, avg(j80) AS a, avg(j70) AS b, avg(j60) AS c FROM {src} GROUP BY problem_id"


_SETS_SQL = f"""{_split_sql()},
te AS ({_mean_vec_sql('f1')} HAVING problem_id IN (SELECT problem_id FROM split WHERE set = 'test')),
tr AS ({_mean_vec_sql('f1')} HAVING problem_id IN (SELECT problem_id FROM split WHERE set = 'train'))"""

_DIST = "sqrt((te.a - tr.a) * (te.a - tr.a) + (te.b - tr.b) * (te.b - tr.b) + (te.c - tr.c) * (te.c - tr.c))"


def _out(nn):
    return nn.select("test_id", "train_id", r6("distance", "distance"), "rank")


@register("nearest_by_mean", sql=f"""WITH {_SETS_SQL}
SELECT te.problem_id AS test_id, tr.problem_id AS train_id, round({_DIST}, 6) AS distance,
       CAST(row_number() OVER (PARTITION BY te.problem_id ORDER BY {_DIST}, tr.problem_id) AS INT) AS rank
FROM te, tr QUALIFY rank <= 2""")
def nearest_by_mean(spark, sf):
    test, train = _sets(spark, sf)
    return _out(G.nearest_by_mean(test, train, JV, "euclidean", 2))


def _cov_sql():
    pairs = [(a, b) for a in JV for b in JV]
    cov = ", ".join(f"round(covar_samp({a}, {b}), 9) AS c_{a}_{b}" for a, b in pairs)
    mu = ", ".join(f"round(avg({v}), 9) AS m_{v}" for v in JV)
    dmu = " + ".join(f"(te.m_{v} - tr.m_{v}) * (te.m_{v} - tr.m_{v})" for v in JV)
    dcov = " + ".join(f"(te.c_{a}_{b} - tr.c_{a}_{b}) * (te.c_{a}_{b} - tr.c_{a}_{b})" for a, b in pairs)
    dist = f"(sqrt({dmu}) + sqrt({dcov}))"
    return f"""WITH {_split_sql('0.8', 42, 10, 'f1')},
v AS (SELECT problem_id, {mu}, {cov} FROM f1 GROUP BY problem_id HAVING count(*) >= 2),
te AS (SELECT * FROM v WHERE problem_id IN (SELECT problem_id FROM split WHERE set = 'test')),
tr AS (SELECT * FROM v WHERE problem_id IN (SELECT problem_id FROM split WHERE set = 'train'))
SELECT te.problem_id AS test_id, tr.problem_id AS train_id, round({dist}, 6) AS distance,
       CAST(row_number() OVER (PARTITION BY te.problem_id ORDER BY {dist}, tr.problem_id) AS INT) AS rank
FROM te, tr QUALIFY rank = 1"""


@register("nearest_by_cov", sql=_cov_sql())
def nearest_by_cov(spark, sf):
    """Features rounded to 9 digits so that equal covariances tie identically in any engine."""
    test, train = _sets(spark, sf, f1(spark, sf))
    return _out(G.nearest_by_cov(test, train, JV, 1, digits=9))


def _emb_sql(k):
    dot = "list_reduce(list_transform(list_zip(te.e, tr.e), lambda p: p[1] * p[2]), lambda x, y: x + y)"
    na = "sqrt(list_reduce(list_transform(te.e, lambda x: x * x), lambda x, y: x + y))"
    nb = "sqrt(list_reduce(list_transform(tr.e, lambda x: x * x), lambda x, y: x + y))"
    dist = f"(1.0 - {dot} / ({na} * {nb}))"
    return f"""WITH te AS (SELECT problem_id, CAST(embedding AS DOUBLE[]) AS e FROM f4 WHERE split = 'test'),
tr AS (SELECT problem_id, CAST(embedding AS DOUBLE[]) AS e FROM f4 WHERE split = 'train')
SELECT te.problem_id AS test_id, tr.problem_id AS train_id, round({dist}, 6) AS distance,
       CAST(row_number() OVER (PARTITION BY te.problem_id ORDER BY {dist}, tr.problem_id) AS INT) AS rank
FROM te, tr QUALIFY rank <= {k}"""


@register("nearest_by_embedding", fixtures=("f4",), sql=_emb_sql(3))
def nearest_by_embedding(spark, sf):
    e = f4(spark, sf)
    nn = G.nearest_by_embedding(e.filter(F.col("split") == "test"), e.filter(F.col("split") == "train"), "cosine", 3)
    return _out(nn)


_CL_SQL = """cl AS (SELECT problem_id, CAST(least(greatest((CAST(m >= 0.0 AS INT) + CAST(m >= 0.25 AS INT) + CAST(m >= 0.5 AS INT)
         + CAST(m >= 0.75 AS INT) + CAST(m >= 1.0 AS INT)) - 1, 0), 3) AS INT) AS cluster_id
       FROM (SELECT problem_id, avg(y) AS m FROM f1 GROUP BY problem_id))"""


@register("nearest_in_cluster", sql=f"""WITH {_SETS_SQL}, {_CL_SQL},
tec AS (SELECT te.*, cl.cluster_id FROM te JOIN cl USING (problem_id)),
trc AS (SELECT tr.*, cl.cluster_id FROM tr JOIN cl USING (problem_id))
SELECT te.problem_id AS test_id, tr.problem_id AS train_id, round({_DIST}, 6) AS distance,
       CAST(row_number() OVER (PARTITION BY te.problem_id ORDER BY {_DIST}, tr.problem_id) AS INT) AS rank
FROM tec te JOIN trc tr ON te.cluster_id = tr.cluster_id QUALIFY rank = 1""")
def nearest_in_cluster(spark, sf):
    """Clusters = 4 difficulty bins (every bin has train problems, so no fallback rows here)."""
    d = f1(spark, sf)
    test, train = _sets(spark, sf, d)
    cl = difficulty_bins(d, 4).select("problem_id", F.col("difficulty").alias("cluster_id"))
    nn = G.nearest_in_cluster(NB.mean_vectors(test, JV), NB.mean_vectors(train, JV), cl, cl, 1)
    return _out(nn)


@register("route_model", sql=f"""WITH {_SETS_SQL},
trained AS (SELECT problem_id FROM f1 GROUP BY problem_id HAVING count(DISTINCT y) = 2),
trt AS (SELECT * FROM tr WHERE problem_id IN (SELECT problem_id FROM trained))
SELECT te.problem_id AS problem_id, tr.problem_id AS model_id, round({_DIST}, 6) AS distance
FROM te, trt tr QUALIFY row_number() OVER (PARTITION BY te.problem_id ORDER BY {_DIST}, tr.problem_id) = 1""")
def route_model(spark, sf):
    """Per-problem models exist only for train problems with both labels (as naive Bayes skips)."""
    d = f1(spark, sf)
    test, train = _sets(spark, sf, d)
    trained = train.groupBy("problem_id").agg(F.count_distinct("y").alias("n")).filter(F.col("n") == 2)
    r = G.route_model(NB.mean_vectors(test, JV), NB.mean_vectors(train, JV), trained)
    return r.select("problem_id", "model_id", r6("distance", "distance"))


# ---------------------------------------------------------------- 65-68

def _split_bucket_sql(pos, n, c):
    return (f"CAST(CASE WHEN {pos} < ({n} // {c} + 1) * ({n} % {c}) THEN {pos} // ({n} // {c} + 1) "
            f"ELSE {n} % {c} + ({pos} - ({n} // {c} + 1) * ({n} % {c})) // ({n} // {c}) END AS INT)")


@register("cluster_random", sql=f"""
WITH p AS (SELECT DISTINCT problem_id FROM f1),
r AS (SELECT problem_id, row_number() OVER (ORDER BY CAST(('0x' || substr(md5(concat_ws('|', '42', CAST(problem_id AS VARCHAR))), 1, 13)) AS UBIGINT), problem_id) - 1 AS pos,
             count(*) OVER () AS n FROM p)
SELECT problem_id, {_split_bucket_sql('pos', 'n', 5)} AS cluster_id FROM r""")
def cluster_random(spark, sf):
    return G.cluster_random(f1(spark, sf), 5, 42)


@register("cluster_difficulty", sql=f"""
WITH p AS (SELECT problem_id, avg(y) AS m FROM f1 GROUP BY problem_id),
r AS (SELECT problem_id, row_number() OVER (ORDER BY m, problem_id) - 1 AS pos, count(*) OVER () AS n FROM p)
SELECT problem_id, {_split_bucket_sql('pos', 'n', 4)} AS cluster_id FROM r""")
def cluster_difficulty(spark, sf):
    return G.cluster_difficulty(f1(spark, sf), 4)


def _binned_sql(c):
    return f"""WITH {_split_sql()},
trp AS (SELECT problem_id, avg(y) AS m FROM f1 WHERE problem_id IN (SELECT problem_id FROM split WHERE set = 'train') GROUP BY problem_id),
tep AS (SELECT problem_id, avg(y) AS m FROM f1 WHERE problem_id IN (SELECT problem_id FROM split WHERE set = 'test') GROUP BY problem_id),
mm AS (SELECT min(m) AS lo, max(m) AS hi FROM trp),
e AS (SELECT i, CASE WHEN i = {c - 1} THEN hi ELSE lo + i * ((hi - lo) / {c - 1}) END AS edge FROM mm, (SELECT unnest(range({c})) AS i))
SELECT problem_id, CAST(least(greatest((SELECT count(*) FROM e WHERE m >= edge), 1), {c}) - 1 AS INT) AS cluster_id, 'train' AS set FROM trp
UNION ALL
SELECT problem_id, CAST(least(greatest((SELECT count(*) FROM e WHERE i < {c - 1} AND m >= edge), 1), {c}) - 1 AS INT), 'test' FROM tep"""


@register("cluster_binned_difficulty", sql=_binned_sql(4))
def cluster_binned_difficulty(spark, sf):
    test, train = _sets(spark, sf)
    return G.cluster_binned_difficulty(train, 4, test)


_UNIQ = "SELECT problem_id, count(DISTINCT answer) AS n_unique FROM f1 GROUP BY problem_id"


@register("cluster_answer_count", sql=f"""
WITH u AS ({_UNIQ}), r AS (SELECT *, row_number() OVER (ORDER BY n_unique DESC, problem_id) - 1 AS pos, count(*) OVER () AS n FROM u)
SELECT problem_id, n_unique, {_split_bucket_sql('pos', 'n', 3)} AS cluster_id FROM r""")
def cluster_answer_count(spark, sf):
    return G.cluster_answer_count(f1(spark, sf), 3, "uniform")


@register("cluster_answer_count_ties", sql=f"""
WITH u AS ({_UNIQ}), d AS (SELECT n_unique, row_number() OVER (ORDER BY n_unique DESC) - 1 AS pos, count(*) OVER () AS n
                           FROM (SELECT DISTINCT n_unique FROM u))
SELECT problem_id, u.n_unique, {_split_bucket_sql('pos', 'n', 3)} AS cluster_id FROM u JOIN d ON u.n_unique = d.n_unique""")
def cluster_answer_count_ties(spark, sf):
    return G.cluster_answer_count(f1(spark, sf), 3, "preserve_ties")


_GREEDY_SQL = f"""
WITH RECURSIVE u AS ({_UNIQ}),
hist AS (SELECT n_unique, count(*) AS q, row_number() OVER (ORDER BY n_unique DESC) AS j FROM u GROUP BY n_unique),
tot AS (SELECT CAST(sum(q) AS DOUBLE) / 3 AS target FROM hist),
g(j, n_unique, bucket, cur, size) AS (
  SELECT 0, NULL::BIGINT, 0, 0, 0::BIGINT
  UNION ALL
  SELECT h.j, h.n_unique,
    CASE WHEN g.size + h.q > t.target * 1.5 AND g.cur < 2
         THEN CASE WHEN g.size < t.target * 0.5 THEN g.cur ELSE g.cur + 1 END ELSE g.cur END,
    CASE WHEN g.size + h.q > t.target * 1.5 AND g.cur < 2
         THEN CASE WHEN g.size < t.target * 0.5 THEN g.cur ELSE g.cur + 1 END
         WHEN g.size + h.q >= t.target AND g.cur < 2 THEN g.cur + 1 ELSE g.cur END,
    CASE WHEN g.size + h.q > t.target * 1.5 AND g.cur < 2
         THEN CASE WHEN g.size < t.target * 0.5 THEN g.size + h.q ELSE h.q END
         WHEN g.size + h.q >= t.target AND g.cur < 2 THEN 0 ELSE g.size + h.q END
  FROM g JOIN hist h ON h.j = g.j + 1, tot t)
SELECT u.problem_id, u.n_unique, CAST(g.bucket AS INT) AS cluster_id FROM u JOIN g ON u.n_unique = g.n_unique"""


@register("cluster_answer_count_greedy", sql=_GREEDY_SQL)
def cluster_answer_count_greedy(spark, sf):
    """Greedy fill on the count histogram (at most R distinct counts, decided on the driver)."""
    return G.cluster_answer_count(f1(spark, sf), 3, "uniform_with_ties")


# ---------------------------------------------------------------- 69-73 (fitted, rows-only)

@register("cluster_kmeans")
def cluster_kmeans(spark, sf):
    e = f4(spark, sf)
    return G.cluster_kmeans(e.filter(F.col("split") == "train"), 10, e.filter(F.col("split") == "test"))


@register("cluster_gmm")
def cluster_gmm(spark, sf):
    return G.cluster_gmm(f4(spark, sf), 4)


@register("cluster_hierarchical")
def cluster_hierarchical(spark, sf):
    return G.cluster_hierarchical(f4(spark, sf), 10)


@register("cluster_density")
def cluster_density(spark, sf):
    """DBSCAN with eps 0.5, 5 points, on the unit-normalised embeddings."""
    e = f4(spark, sf).select("problem_id", NB.normalise(F.col("embedding").cast("array<double>")).alias("embedding"))
    return G.cluster_density(e, 0.5, 5)


@register("cluster_spectral")
def cluster_spectral(spark, sf):
    return G.cluster_spectral(f4(spark, sf), 10, 10)


# ---------------------------------------------------------------- 74-76

@register("cluster_map", sql="""SELECT problem_id, CAST(least(greatest((CAST(m >= 0.0 AS INT) + CAST(m >= 0.25 AS INT) + CAST(m >= 0.5 AS INT)
         + CAST(m >= 0.75 AS INT) + CAST(m >= 1.0 AS INT)) - 1, 0), 3) AS INT) AS cluster_id
FROM (SELECT problem_id, avg(y) AS m FROM f1 GROUP BY problem_id)""")
def cluster_map(spark, sf):
    """JSON lines {"<problem>": "<cluster>"} written from the difficulty bins, read back."""
    d = f1(spark, sf)
    b = difficulty_bins(d, 4)
    lines = b.select(F.to_json(F.create_map(F.col("problem_id").cast("string"),
                                            F.col("difficulty").cast("string"))).alias("value"))
    return G.cluster_map(lines, d)


@register("cluster_on_all", sql="""
WITH p AS (SELECT problem_id, avg(y) AS m FROM f1 GROUP BY problem_id),
r AS (SELECT problem_id, row_number() OVER (ORDER BY m, problem_id) - 1 AS pos, count(*) OVER () AS n FROM p)
SELECT problem_id, s AS set, CAST(CASE WHEN pos < (n // 4 + 1) * (n % 4) THEN pos // (n // 4 + 1)
       ELSE n % 4 + (pos - (n // 4 + 1) * (n % 4)) // (n // 4) END AS INT) AS cluster_id
FROM r, (SELECT unnest(['train', 'test']) AS s)""")
def cluster_on_all(spark, sf):
    """Train = test (split 1.0): both sets share one clustering of all problems."""
    d = f1(spark, sf)
    return G.cluster_on_all(d, d, lambda both: G.cluster_difficulty(both, 4)).select("problem_id", "set", "cluster_id")


@register("cluster_stats", sql=f"""
WITH u AS ({_UNIQ}), r AS (SELECT *, row_number() OVER (ORDER BY n_unique DESC, problem_id) - 1 AS pos, count(*) OVER () AS n FROM u),
c AS (SELECT problem_id, n_unique, {_split_bucket_sql('pos', 'n', 3)} AS cluster_id FROM r)
SELECT cluster_id, count(*) AS size, min(n_unique) AS min_unique, max(n_unique) AS max_unique FROM c GROUP BY cluster_id""")
def cluster_stats(spark, sf):
    d = f1(spark, sf)
    a = G.cluster_answer_count(d, 3, "uniform").select("problem_id", "cluster_id")
    return G.cluster_stats(a, d)
