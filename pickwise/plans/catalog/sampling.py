"""Catalog: difficulty bins, splits, subsets, bootstraps, augmentations (ops 46-58)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pickwise.functions.columns import r6
from pickwise.operators import sampling as SA
from pickwise.plans.catalog.metrics import _split_sql
from pickwise.plans.registry import register
from pickwise.sources.fixtures import f1

IDS = ["problem_id", "sample_idx"]


def _md5_unit(seed, *cols):
    parts = ", ".join([f"'{seed}'"] + [f"CAST({c} AS VARCHAR)" for c in cols])
    return f"CAST(('0x' || substr(md5(concat_ws('|', {parts})), 1, 13)) AS UBIGINT) / 4503599627370496.0"


def _md5(seed, *cols):
    parts = ", ".join([f"'{seed}'"] + [f"CAST({c} AS VARCHAR)" for c in cols])
    return f"md5(concat_ws('|', {parts}))"


@register("difficulty_bins", sql=f"WITH {_split_sql()} SELECT problem_id, round(mean_y, 6) AS mean_y, difficulty FROM bins")
def difficulty_bins(spark, sf):
    return SA.difficulty_bins(f1(spark, sf), 10).select("problem_id", r6("mean_y", "mean_y"), "difficulty")


@register("difficulty_label", sql="""SELECT problem_id, round(m, 6) AS mean_y,
  CASE WHEN m <= 0.1 THEN 'Hard' WHEN m <= 0.5 THEN 'Medium' ELSE 'Easy' END AS difficulty_label
FROM (SELECT problem_id, avg(y) AS m FROM f1 GROUP BY problem_id)""")
def difficulty_label(spark, sf):
    return SA.difficulty_label(f1(spark, sf)).select("problem_id", r6("mean_y", "mean_y"), "difficulty_label")


@register("stratified_split", sql=f"WITH {_split_sql()} SELECT problem_id, difficulty, set FROM split")
def stratified_split(spark, sf):
    return SA.stratified_split(f1(spark, sf), 0.8, 42, 10)


@register("stratified_split_all", sql=f"""WITH {_split_sql()}
SELECT problem_id, difficulty, s AS set FROM bins, (SELECT unnest(['train', 'test']) AS s)""")
def stratified_split_all(spark, sf):
    """train = 1.0: test equals train (every problem in both sets)."""
    return SA.stratified_split(f1(spark, sf), 1.0, 42, 10)


@register("fixed_test_split", sql=f"""WITH {_split_sql()},
fixed AS (SELECT problem_id FROM f1 GROUP BY problem_id HAVING count(*) >= 6)
SELECT problem_id, difficulty, 'train' AS set FROM split ANTI JOIN fixed USING (problem_id) WHERE set = 'train'
UNION ALL SELECT problem_id, difficulty, 'test' AS set FROM bins SEMI JOIN fixed USING (problem_id)""")
def fixed_test_split(spark, sf):
    """A given table of problems (here those with six samples or more) is the test set; the others train as the split says."""
    d = f1(spark, sf)
    split = SA.stratified_split(d, 0.8, 42, 10)
    fixed = d.groupBy("problem_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 6")
    return SA.with_fixed_test(split, fixed, SA.difficulty_bins(d, 10))


@register("train_queries", sql=f"""WITH {_split_sql()},
tr AS (SELECT problem_id, difficulty, set, row_number() OVER (PARTITION BY difficulty ORDER BY {_md5_unit(43, 'problem_id')}) AS rk,
              count(*) OVER (PARTITION BY difficulty) AS n FROM split WHERE set = 'train')
SELECT problem_id, difficulty, set FROM tr WHERE rk <= floor(0.5::DOUBLE * n)
UNION ALL SELECT problem_id, difficulty, set FROM split WHERE set <> 'train'""")
def train_queries(spark, sf):
    split = SA.stratified_split(f1(spark, sf), 0.8, 42, 10)
    return SA.train_queries(split, 0.5, 42)


@register("train_queries_count", sql=f"""WITH {_split_sql()},
tr AS (SELECT problem_id, difficulty, set, row_number() OVER (ORDER BY {_md5_unit(43, 'problem_id')}) AS rk FROM split WHERE set = 'train')
SELECT problem_id, difficulty, set FROM tr WHERE rk <= 500
UNION ALL SELECT problem_id, difficulty, set FROM split WHERE set <> 'train'""")
def train_queries_count(spark, sf):
    split = SA.stratified_split(f1(spark, sf), 0.8, 42, 10)
    return SA.train_queries(split, 500, 42)


@register("subsample_samples", sql=f"""
WITH r AS (SELECT max(sample_idx) + 1 AS n FROM f1),
pos AS (SELECT CAST(p AS INT) AS sample_idx FROM (SELECT unnest(range(n)) AS p FROM r)),
chosen AS (SELECT sample_idx FROM (SELECT sample_idx, row_number() OVER (ORDER BY {_md5(42, 'sample_idx')}) AS rk FROM pos), r
           WHERE rk <= CAST(floor(0.5::DOUBLE * r.n) AS BIGINT))
SELECT problem_id, sample_idx, y FROM f1 WHERE sample_idx IN (SELECT sample_idx FROM chosen)""")
def subsample_samples(spark, sf):
    return SA.subsample_samples(f1(spark, sf), 0.5, 42).select(*IDS, "y")


@register("subsample_first", sql="""SELECT problem_id, sample_idx, y FROM f1
WHERE sample_idx < (SELECT CAST(floor(0.5::DOUBLE * (max(sample_idx) + 1)) AS BIGINT) FROM f1)""")
def subsample_first(spark, sf):
    return SA.subsample_samples(f1(spark, sf), 0.5, 42, first=True).select(*IDS, "y")


@register("bin_distribution", sql=f"""WITH {_split_sql()}
SELECT difficulty, count_if(set = 'train') AS train, count_if(set = 'test') AS test FROM split GROUP BY difficulty""")
def bin_distribution(spark, sf):
    return SA.bin_distribution(SA.stratified_split(f1(spark, sf), 0.8, 42, 10))


@register("bootstrap_samples", sql=f"""
WITH f AS (SELECT f1.*, count(*) OVER (PARTITION BY problem_id) AS n FROM f1),
rep AS (SELECT f.*, d AS draw FROM f, (SELECT unnest(range(3)) AS d) WHERE n >= 2),
rk AS (SELECT problem_id, sample_idx, y, CAST(draw AS INT) AS draw,
              CAST(row_number() OVER (PARTITION BY draw, problem_id ORDER BY {_md5(42, 'draw', 'problem_id', 'sample_idx')}) AS INT) AS slot FROM rep)
SELECT draw, problem_id, sample_idx, y, slot FROM rk WHERE slot <= 2""")
def bootstrap_samples(spark, sf):
    b = SA.bootstrap_samples(f1(spark, sf).select(*IDS, "y"), 2, 3, 42)
    return b.select(F.col("draw").cast("int").alias("draw"), *IDS, "y", F.col("slot").cast("int").alias("slot"))


@register("train_val_split", sql=f"""SELECT problem_id, sample_idx,
  CASE WHEN rk <= CAST(floor(0.9::DOUBLE * n) AS BIGINT) THEN 'train' ELSE 'val' END AS split
FROM (SELECT problem_id, sample_idx, row_number() OVER (ORDER BY {_md5_unit(42, 'problem_id', 'sample_idx')}) AS rk,
             count(*) OVER () AS n FROM f1)""")
def train_val_split(spark, sf):
    return SA.train_val_split(f1(spark, sf), 0.9, 42).select(*IDS, "split")


@register("augment_noise", sql=f"""SELECT problem_id, sample_idx, round(rm_disc + 0.1 * sqrt(-2.0 * ln(greatest(
    {_md5_unit('42:0:a', 'problem_id', 'sample_idx')}, 1e-12))) * cos(6.283185307179586::DOUBLE * {_md5_unit('42:0:b', 'problem_id', 'sample_idx')}), 6) AS rm_disc
FROM f1""")
def augment_noise(spark, sf):
    """Gaussian noise from md5 uniforms (Box-Muller): the same draws in any engine."""
    d = SA.augment_noise(f1(spark, sf).select(*IDS, "rm_disc"), ["rm_disc"], 0.1, 42)
    return d.select(*IDS, r6("rm_disc", "rm_disc"))


@register("augment_dropout", sql=f"""SELECT problem_id, sample_idx,
  round(CASE WHEN {_md5_unit('42:0', 'problem_id', 'sample_idx')} < 0.1 THEN rm_disc * 0.0 ELSE rm_disc END, 6) AS rm_disc,
  round(CASE WHEN {_md5_unit('42:1', 'problem_id', 'sample_idx')} < 0.1 THEN j80 * 0.0 ELSE j80 END, 6) AS j80
FROM f1""")
def augment_dropout(spark, sf):
    d = SA.augment_dropout(f1(spark, sf).select(*IDS, "rm_disc", "j80"), ["rm_disc", "j80"], 0.1, 42)
    return d.select(*IDS, r6("rm_disc", "rm_disc"), r6("j80", "j80"))


@register("augment_mixup")
def augment_mixup(spark, sf):
    """Mixup with one partner per row and Beta(0.2, 0.2) weights; rows-only check."""
    return SA.augment_mixup(f1(spark, sf).select(*IDS, "y", "rm_disc", "j80"), ["rm_disc", "j80"], 0.2, 42)


@register("drop_unsolvable", sql="""SELECT problem_id, sample_idx, y FROM f1
WHERE problem_id IN (SELECT problem_id FROM f1 GROUP BY problem_id HAVING max(y) = 1)""")
def drop_unsolvable(spark, sf):
    return SA.drop_unsolvable(f1(spark, sf)).select(*IDS, "y")


@register("balanced_batches", sql=f"""
WITH per AS (SELECT problem_id, max(y) AS solvable FROM f1 GROUP BY problem_id),
r AS (SELECT problem_id, solvable, {_md5_unit(42, 'problem_id')} AS h FROM per),
b AS (SELECT problem_id, solvable, CAST((row_number() OVER (ORDER BY h, problem_id) - 1) // 64 AS INT) AS batch, h FROM r),
s AS (SELECT problem_id, row_number() OVER (ORDER BY h, problem_id) - 1 AS si FROM b WHERE solvable = 1),
ns AS (SELECT count(*) AS ns FROM s),
need AS (SELECT batch FROM b GROUP BY batch HAVING max(solvable) = 0)
SELECT problem_id, batch, solvable, 0 AS reused FROM b
UNION ALL
SELECT s.problem_id, need.batch, 1, 1 FROM need, ns, s WHERE s.si = need.batch % ns.ns""")
def balanced_batches(spark, sf):
    out = SA.balanced_batches(f1(spark, sf), 64, 42)
    return out.select("problem_id", F.col("batch").cast("int").alias("batch"), "solvable", "reused")
