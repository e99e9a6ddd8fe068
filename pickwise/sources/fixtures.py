"""Project the driver's TPC-H-ish tables into verification-shaped tables.

Each fixture is ONE SQL text used by both engines: Spark gets it through
``spark.sql(text, lineitem=<DataFrame>)`` (placeholders are DataFrames), DuckDB
gets the same text with the placeholders replaced by its view names.  Literal
braces are doubled for ``str.format``.

F1  responses + verifier scores (problem = order, sample = line item)
F1dev sparse dev labels
F2  documents with few labels (problem = source, sample = document)
F3  text replies (assistant turns after a user turn)
F4  problem vectors (embeddings)
F5  experiment runs (events)
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Verifier columns of F1, by kind.
F1_REWARD_MODELS = ["rm_q", "rm_price", "rm_disc", "rm_null"]
F1_JUDGES = ["j80", "j70", "j60", "j_abstain", "j_always"]
F1_VERIFIERS = F1_REWARD_MODELS + F1_JUDGES
# Judges with known, conditionally independent error rates.
F1_CLEAN_JUDGES = ["j80", "j70", "j60"]
F2_VERIFIERS = ["v_len", "v_len_vote", "v_vowel", "v_lines"]

F1_SQL = """
WITH b AS (
  SELECT l.*,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) - 1 AS INT) AS sample_idx,
         CASE l_orderkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS gt_answer
  FROM {lineitem} l),
c AS (SELECT *, CASE WHEN l_returnflag = gt_answer THEN 1 ELSE 0 END AS y FROM b)
SELECT l_orderkey AS problem_id, sample_idx,
       CASE WHEN l_partkey % 41 = 0 THEN NULL WHEN l_partkey % 43 = 0 THEN 'NO_ANSWER' ELSE l_returnflag END AS answer,
       gt_answer, CAST(y AS INT) AS y,
       l_quantity + 25 * y AS rm_q,
       l_extendedprice AS rm_price,
       l_discount * 10 AS rm_disc,
       CASE WHEN l_linenumber = 6 THEN NULL ELSE l_tax * 10 END AS rm_null,
       CAST(CASE WHEN l_partkey % 10 < 8 THEN y ELSE 1 - y END AS DOUBLE) AS j80,
       CAST(CASE WHEN l_suppkey % 10 < 7 THEN y ELSE 1 - y END AS DOUBLE) AS j70,
       CAST(CASE WHEN CAST(floor(l_partkey / 10.0) AS BIGINT) % 10 < 6 THEN y ELSE 1 - y END AS DOUBLE) AS j60,
       CAST(CASE WHEN l_linenumber = 5 THEN -1 WHEN l_suppkey % 4 < 3 THEN y ELSE 1 - y END AS DOUBLE) AS j_abstain,
       CAST(CASE WHEN l_partkey % 50 = 0 THEN 0 ELSE 1 END AS DOUBLE) AS j_always
FROM c
"""

F1DEV_SQL = """
SELECT problem_id, sample_idx, y AS dev_label FROM {f1} WHERE problem_id % 20 = 0
"""

F2_SQL = """
SELECT CAST(substr(d.source, 4) AS BIGINT) AS problem_id,
       CAST(row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) - 1 AS INT) AS sample_idx,
       d.doc_id, d.lang AS answer, l.quality AS y, l.toxic AS toxic,
       CAST(d.n_chars AS DOUBLE) AS v_len,
       CAST(CASE WHEN d.n_chars < 100 THEN -1 WHEN d.n_chars BETWEEN 200 AND 20000 THEN 1 ELSE 0 END AS DOUBLE) AS v_len_vote,
       1.0 - CAST(length(translate(d.text, 'aeiouAEIOU', '')) AS DOUBLE) / length(d.text) AS v_vowel,
       CAST(length(d.text) - length(replace(d.text, chr(10), '')) AS DOUBLE) AS v_lines
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id
"""

F3_SQL = """
WITH t AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_text, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_role FROM {conversations})
SELECT conv_id AS problem_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS sample_idx, turn,
       prev_text AS instruction, text AS response,
       concat(text, chr(10), CASE (conv_id + turn) % 5 WHEN 0 THEN 'True' WHEN 1 THEN 'Verdict: FALSE'
            WHEN 2 THEN concat(chr(92), 'boxed{{-1}}') WHEN 3 THEN concat('first ', chr(92), 'boxed{{-1}} then ', chr(92), 'boxed{{2}}') ELSE 'cannot say' END) AS judge_reply,
       concat('The answer is: ', substr('ABCDEFGHIJ', CAST((conv_id * 7 + turn * 3) % 10 + 1 AS INT), 1)) AS answer_reply
FROM t WHERE role = 'assistant' AND prev_role = 'user'
"""

F4_SQL = """
SELECT vec_id AS problem_id, embedding, label,
       CASE WHEN vec_id % 5 = 0 THEN 'test' ELSE 'train' END AS split
FROM {embeddings}
"""

F5_SQL = """
SELECT event_id AS run_id, event_type AS model_type,
       CASE user_id % 2 WHEN 0 THEN '8B' ELSE '70B' END AS model_size,
       CAST(CASE user_id % 3 WHEN 0 THEN 0.8 ELSE 1.0 END AS DOUBLE) AS train_split,
       CASE user_id % 5 WHEN 0 THEN 'per_problem' ELSE 'per_dataset' END AS model_class,
       value / 500.0 AS test_select_accuracy
FROM {events}
"""

# name -> (sql text, base tables or fixtures it reads)
FIXTURES: dict[str, tuple[str, tuple[str, ...]]] = {
    "f1": (F1_SQL, ("lineitem",)),
    "f1dev": (F1DEV_SQL, ("f1",)),
    "f2": (F2_SQL, ("documents", "labels")),
    "f3": (F3_SQL, ("conversations",)),
    "f4": (F4_SQL, ("embeddings",)),
    "f5": (F5_SQL, ("events",)),
}

BASE_TABLES = ("region nation customer supplier part orders lineitem events documents "
               "embeddings pages benchmark labels conversations").split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Fixtures read several times by one query (statistics pass, fit, score, driver round trips)
# are persisted: the narrow score table is built once per query instead of once per pass.
PERSISTED = {"f1"}


def fixture(spark: SparkSession, sf_dir: str, name: str, persist: bool = True) -> DataFrame:
    """Build fixture ``name`` as a lazy Spark DataFrame over the tables in ``sf_dir``. ``persist`` False: for a query
    that keeps the columns it needs itself."""
    text, deps = FIXTURES[name]
    args = {}
    for dep in deps:
        args[dep] = fixture(spark, sf_dir, dep) if dep in FIXTURES else read_table(spark, sf_dir, dep)
    df = spark.sql(text, **args)
    if persist and name in PERSISTED:
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
    return df


def f1(spark, sf_dir, persist: bool = True):
    return fixture(spark, sf_dir, "f1", persist)


def f1dev(spark, sf_dir):
    return fixture(spark, sf_dir, "f1dev")


def f2(spark, sf_dir):
    return fixture(spark, sf_dir, "f2")


def f3(spark, sf_dir):
    return fixture(spark, sf_dir, "f3")


def f4(spark, sf_dir):
    return fixture(spark, sf_dir, "f4")


def f5(spark, sf_dir):
    return fixture(spark, sf_dir, "f5")


# ---------------------------------------------------------------- DuckDB side

def _order_fixtures(names) -> list[str]:
    out: list[str] = []

    def visit(n):
        for dep in FIXTURES[n][1]:
            if dep in FIXTURES:
                visit(dep)
        if n not in out:
            out.append(n)

    for n in names:
        visit(n)
    return out


def duckdb_ctes(names) -> str:
    """CTE list (without the leading WITH) defining fixtures ``names`` for DuckDB."""
    parts = []
    for n in _order_fixtures(names):
        text, deps = FIXTURES[n]
        parts.append(f"{n} AS ({text.format(**{d: d for d in deps})})")
    return ",\n".join(parts)


def with_fixtures(sql: str, *names: str) -> str:
    """Prefix a DuckDB query body with the fixture CTEs it reads."""
    if not names:
        return sql
    ctes = duckdb_ctes(names)
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


# ---------------------------------------------------------------- F6 list form

F6_SCORES = ["rm_q", "rm_null"]
F6_VERDICTS = ["j80", "j70"]


def f6(spark, sf_dir):
    """F1 in the reference's list form: one row per problem, lists ordered by sample_idx.

    ``answer`` is the ground truth (NULL for problem_id % 97 = 0, to exercise
    ``check_input``); ``rm_q_scores`` is one entry short for problem_id % 7 = 0
    (a score list shorter than its samples, for ``check_lengths``)."""
    from pyspark.sql import functions as F

    from pickwise.sources.tables import collect_samples

    d = f1(spark, sf_dir).select(
        "problem_id", "sample_idx", "gt_answer",
        F.concat(F.lit("The answer is: "), F.coalesce("answer", F.lit(""))).alias("samples"),
        F.col("answer").alias("extracted_answers"), F.col("y").alias("answer_correct"),
        *[F.col(v).alias(f"{v}_scores") for v in F6_SCORES],
        *[F.array(F.col(v)).alias(f"{v}_verdicts") for v in F6_VERDICTS])
    lists = ["samples", "extracted_answers", "answer_correct", *[f"{v}_scores" for v in F6_SCORES],
             *[f"{v}_verdicts" for v in F6_VERDICTS]]
    g = collect_samples(d, lists)
    gt = d.groupBy("problem_id").agg(F.min("gt_answer").alias("gt"))
    out = g.join(gt, "problem_id").select(
        "problem_id", F.concat(F.lit("problem "), F.col("problem_id").cast("string")).alias("instruction"),
        F.when(F.col("problem_id") % 97 == 0, F.lit(None).cast("string")).otherwise(F.col("gt")).alias("answer"),
        *[c for c in lists])
    return out.withColumn("rm_q_scores", F.when(F.col("problem_id") % 7 == 0,
                                                F.slice("rm_q_scores", 1, F.size("rm_q_scores") - 1))
                          .otherwise(F.col("rm_q_scores")))


F6_SQL_CTE = """f6 AS (SELECT problem_id, 'problem ' || CAST(problem_id AS VARCHAR) AS instruction,
  CASE WHEN problem_id % 97 = 0 THEN NULL ELSE min(gt_answer) END AS answer,
  list('The answer is: ' || coalesce(answer, '') ORDER BY sample_idx) AS samples,
  list(answer ORDER BY sample_idx) AS extracted_answers, list(y ORDER BY sample_idx) AS answer_correct,
  CASE WHEN problem_id % 7 = 0 THEN list_slice(list(rm_q ORDER BY sample_idx), 1, count(*) - 1)
       ELSE list(rm_q ORDER BY sample_idx) END AS rm_q_scores,
  list(rm_null ORDER BY sample_idx) AS rm_null_scores,
  list([j80] ORDER BY sample_idx) AS j80_verdicts, list([j70] ORDER BY sample_idx) AS j70_verdicts
FROM f1 GROUP BY problem_id)"""
