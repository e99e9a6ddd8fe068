"""Catalog: prompts, answers, verdicts, steps (ops 131-149).

Problems come from ``benchmark`` (options are the first words of the item
text), replies from fixture F3 (``conversations``).
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pickwise.functions import text as TX
from pickwise.functions.columns import r6
from pickwise.operators import text as T
from pickwise.plans.registry import register
from pickwise.sources.fixtures import f3, f4, read_table

IDS = ["problem_id", "sample_idx"]
SUBJECTS = ["college_biology", "high_school_physics", "professional_law", "college_physics", "astronomy",
            "professional_medicine", "college_mathematics", "virology", "professional_accounting", "econometrics"]


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def _bench(spark, sf, n_opt=4):
    b = read_table(spark, sf, "benchmark")
    return b.select(F.col("item_id"), F.col("text").alias("question"),
                    F.slice(F.split("text", " "), 1, n_opt).alias("options"),
                    (F.col("item_id") % n_opt).cast("int").alias("answer_index"))


def _choices_sql(opts):
    return f"array_to_string(list_transform({opts}, lambda x, i: chr(CAST(64 + i AS INT)) || ') ' || x), chr(10))"


def _prompt_sql(n_opt, tail):
    opts = f"list_slice(string_split(text, ' '), 1, {n_opt})"
    return (f"SELECT item_id, 'Question: ' || text || chr(10) || chr(10) || 'Choices:' || chr(10) || {_choices_sql(opts)} "
            f"|| chr(10) || chr(10) || {q(tail)} AS problem, chr(CAST(65 + item_id % {n_opt} AS INT)) AS answer FROM benchmark")


@register("prompt_choices", fixtures=(), sql=_prompt_sql(4, TX.CHOICE_TAIL_MMLU))
def prompt_choices(spark, sf):
    return T.prompt_choices(_bench(spark, sf, 4), style="mmlu").select("item_id", "problem", "answer")


@register("prompt_choices_10", fixtures=(), sql=_prompt_sql(10, TX.CHOICE_TAIL_LETTER))
def prompt_choices_10(spark, sf):
    return T.prompt_choices(_bench(spark, sf, 10), style="letter").select("item_id", "problem", "answer")


@register("prompt_open", fixtures=(), sql=f"""SELECT item_id, 'Problem: ' || text || chr(10) || chr(10) || {q(TX.OPEN_TAIL)} AS prompt,
  string_split(text, ' ')[1] AS answer, {q(TX.DEFAULT_SUBJECT)} AS subject_filled FROM benchmark""")
def prompt_open(spark, sf):
    b = read_table(spark, sf, "benchmark").select(
        "item_id", F.col("text").alias("problem"), F.element_at(F.split("text", " "), 1).alias("solution"),
        F.lit(None).cast("string").alias("subject"))
    return T.prompt_open(b).select("item_id", "prompt", "answer", "subject_filled")


def _shuffled_sql(seed=42):
    words = "string_split(text, ' ')"
    items = ", ".join(f"{{'h': md5(concat_ws('|', '{seed}', CAST(item_id AS VARCHAR), '{i}')), 'i': {i}, 't': {words}[{i + 1}]}}"
                      for i in range(4))
    opts = f"list_transform(list_sort([{items}]), lambda s: s.t)"
    return f"""WITH o AS (SELECT item_id, text, {opts} AS options, {words}[1] AS correct FROM benchmark)
SELECT item_id, 'Question: ' || text || chr(10) || chr(10) || 'Choices:' || chr(10) || {_choices_sql('options')}
       || chr(10) || chr(10) || {q(TX.CHOICE_TAIL_LETTER)} AS problem,
       chr(CAST(64 + list_position(options, correct) AS INT)) AS answer FROM o"""


@register("prompt_shuffled_choices", fixtures=(), sql=_shuffled_sql())
def prompt_shuffled_choices(spark, sf):
    b = read_table(spark, sf, "benchmark")
    w = F.split("text", " ")
    d = b.select("item_id", F.col("text").alias("question"), *[F.element_at(w, i + 1).alias(f"o{i}") for i in range(4)])
    out = T.prompt_shuffled_choices(d, "item_id", "o0", ["o1", "o2", "o3"], "question", 42)
    return out.select("item_id", "problem", "answer")


_SUBJ_SQL = "[" + ", ".join(q(s) for s in SUBJECTS) + f"][CAST(item_id % {len(SUBJECTS)} AS INT) + 1]"


@register("filter_subjects", fixtures=(), sql=f"""SELECT item_id, subject FROM (SELECT item_id, {_SUBJ_SQL} AS subject FROM benchmark)
WHERE subject IN ({', '.join(q(s) for s in TX.COLLEGE_SUBJECTS)})""")
def filter_subjects(spark, sf):
    b = read_table(spark, sf, "benchmark")
    subj = F.element_at(F.array(*[F.lit(s) for s in SUBJECTS]), (F.col("item_id") % len(SUBJECTS)).cast("int") + 1)
    return T.filter_subjects(b.select("item_id", subj.alias("subject")), "college")


@register("repeat_prompts", fixtures=(), sql="SELECT item_id, CAST(s AS INT) AS sample_idx FROM benchmark, (SELECT unnest(range(4)) AS s)")
def repeat_prompts(spark, sf):
    b = read_table(spark, sf, "benchmark").select("item_id")
    return T.repeat_prompts(b, 4, "item_id").select("item_id", F.col("sample_idx").cast("int"))


@register("gather_samples", fixtures=(), sql="""SELECT c_custkey, list(o_orderkey ORDER BY o_orderkey)[1:5] AS samples FROM
  (SELECT o_custkey AS c_custkey, o_orderkey FROM orders) GROUP BY c_custkey""")
def gather_samples(spark, sf):
    """Orders as generated batches of one or two samples, gathered to the first five of each customer."""
    o = read_table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("batch_no"), F.array("o_orderkey").alias("response"))
    return T.gather_samples(o, 5, "c_custkey")


# ---------------------------------------------------------------- answers

def _duck_strip(x):
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


LOOSE = "(?i)(?:the answer is:?\\s*)?([A-D])"
STRICT = "(?i)the answer is:?\\s*\\(?([A-D])\\)?\\b"


def _duck_letter(x):
    return f"CASE WHEN regexp_extract({x}, '{LOOSE}', 1) <> '' THEN upper(regexp_extract({x}, '{LOOSE}', 1)) END"


def _duck_strict(x):
    return (f"CASE WHEN len(regexp_extract_all({x}, '{STRICT}', 1)) > 0 "
            f"THEN upper(regexp_extract_all({x}, '{STRICT}', 1)[-1]) END")


@register("extract_letter", fixtures=("f3",), sql=f"""SELECT problem_id, sample_idx, {_duck_letter('answer_reply')} AS letter_reply,
  {_duck_letter('response')} AS letter_response, {_duck_strict('answer_reply')} AS letter_strict FROM f3""")
def extract_letter(spark, sf):
    d = f3(spark, sf)
    return d.select(*IDS, TX.extract_letter("answer_reply").alias("letter_reply"),
                    TX.extract_letter("response").alias("letter_response"),
                    TX.extract_letter("answer_reply", mode="strict").alias("letter_strict"))


# the oracle's pattern: nested braces up to depth 3, which is all that the fixtures hold
BOXED_SQL = r"\\boxed\{((?:[^{}]|\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\})*)\}"


@register("extract_boxed", fixtures=("f3",), sql=f"""SELECT problem_id, sample_idx,
  CASE WHEN len(regexp_extract_all(judge_reply, '{BOXED_SQL}', 1)) > 0 THEN regexp_extract_all(judge_reply, '{BOXED_SQL}', 1)[-1] END AS boxed FROM f3""")
def extract_boxed(spark, sf):
    return f3(spark, sf).select(*IDS, TX.extract_boxed("judge_reply").alias("boxed"))


def _answers_spark(d):
    bs = F.lit("\\")
    t, c = F.col("turn").cast("string"), F.col("problem_id").cast("string")
    return d.select(*IDS, F.when(F.col("turn") % 3 == 0, F.concat(F.lit("The answer is: "), bs, F.lit("boxed{"), bs,
                                                                    F.lit("frac{"), t, F.lit("}{"), c, F.lit("}}")))
                    .when(F.col("turn") % 3 == 1, F.concat(F.lit("  "), bs, F.lit("sqrt{"), t, F.lit("} ")))
                    .otherwise(F.concat(bs, F.lit("boxed{"), t, F.lit("} and more"))).alias("raw"))


_ANS_SQL = """SELECT problem_id, sample_idx, CASE WHEN turn % 3 = 0 THEN 'The answer is: ' || chr(92) || 'boxed{' || chr(92) || 'frac{'
   || CAST(turn AS VARCHAR) || '}{' || CAST(problem_id AS VARCHAR) || '}}'
   WHEN turn % 3 = 1 THEN '  ' || chr(92) || 'sqrt{' || CAST(turn AS VARCHAR) || '} '
   ELSE chr(92) || 'boxed{' || CAST(turn AS VARCHAR) || '} and more' END AS raw FROM f3"""


def _duck_normalize(x):
    a = f"(CASE WHEN starts_with(lower({x}), 'the answer is:') THEN {_duck_strip(f'substr({x}, 15)')} ELSE {x} END)"
    a = _duck_strip(a)
    a = f"(CASE WHEN regexp_matches({a}, '^\\\\boxed\\{{(.*)\\}}') THEN regexp_extract({a}, '^\\\\boxed\\{{(.*)\\}}', 1) ELSE {a} END)"
    a = f"regexp_replace({a}, '\\\\frac\\{{(\\d+)\\}}\\{{(\\d+)\\}}', '\\1/\\2', 'g')"
    a = f"regexp_replace({a}, '\\\\sqrt\\{{(\\d+)\\}}', '√\\1', 'g')"
    return a


@register("normalize_answer", fixtures=("f3",), sql=f"WITH a AS ({_ANS_SQL}) SELECT problem_id, sample_idx, {_duck_normalize('raw')} AS normalized FROM a")
def normalize_answer(spark, sf):
    a = _answers_spark(f3(spark, sf))
    return a.select(*IDS, TX.normalize_answer("raw").alias("normalized"))


GT_SQL = "substr('ABCD', CAST(problem_id % 4 + 1 AS INT), 1)"


def _gt(d):
    return d.withColumn("gt_answer", F.substring(F.lit("ABCD"), (F.col("problem_id") % 4 + 1).cast("int"), 1))


def _verify_sql(x):
    return (f"CASE WHEN {x} IS NULL OR {x} = '' THEN false ELSE coalesce(upper({_duck_strip(x)}) = upper({_duck_strip(GT_SQL)}), false) END")


@register("verify_answers", fixtures=("f3",), sql=f"""SELECT problem_id, sample_idx, {_verify_sql(_duck_letter('answer_reply'))} AS correct FROM f3""")
def verify_answers(spark, sf):
    d = _gt(f3(spark, sf))
    return d.select(*IDS, TX.verify_choice(TX.extract_letter("answer_reply"), "gt_answer").alias("correct"))


@register("verify_answers_math", fixtures=("f3",), sql=f"""WITH a AS ({_ANS_SQL})
SELECT problem_id, sample_idx, coalesce({_duck_normalize('raw')} = {_duck_normalize("CAST(sample_idx AS VARCHAR)")}, false) AS correct FROM a""")
def verify_answers_math(spark, sf):
    """Normalised string equality of the built answers with the sample index as truth."""
    a = _answers_spark(f3(spark, sf))
    return a.select(*IDS, TX.verify_math("raw", F.col("sample_idx").cast("string")).alias("correct"))


@register("label_samples", fixtures=("f3",), sql=f"""WITH l AS (SELECT problem_id, sample_idx, {_duck_letter('answer_reply')} AS e FROM f3)
SELECT problem_id, round(avg(CAST({_verify_sql('e')} AS DOUBLE)), 6) AS accuracy, count_if(e IS NULL) AS failures, count(*) AS n
FROM l GROUP BY problem_id""")
def label_samples(spark, sf):
    lab = T.label_samples(_gt(f3(spark, sf)), "answer_reply", "gt_answer", "choice")
    acc = T.label_accuracy(lab)
    return acc.select("problem_id", r6("accuracy", "accuracy"), "failures", "n")


# ---------------------------------------------------------------- judges

def _user_sql():
    return (f"'Problem: ' || instruction || chr(10) || chr(10) || 'Solution to evaluate:' || chr(10) || response "
            f"|| chr(10) || chr(10) || {q('Analyze the reasoning and solution, then on a new line state True or False:')}")


@register("build_messages", fixtures=("f3",), sql=f"""SELECT problem_id, sample_idx,
  'System: ' || {q(TX.JUDGE_SYSTEM)} || chr(10) || chr(10) || 'User: ' || {_user_sql()} || chr(10) || chr(10) || 'Assistant: ' AS prompt FROM f3""")
def build_messages(spark, sf):
    return T.build_messages(f3(spark, sf), style="flat").select(*IDS, "prompt")


@register("build_messages_gemini", fixtures=("f3",), sql=f"""SELECT problem_id, sample_idx, {q(TX.JUDGE_SYSTEM)} AS system,
  'user' AS role, {_user_sql()} AS content FROM f3""")
def build_messages_gemini(spark, sf):
    m = T.build_messages(f3(spark, sf), style="gemini")
    return m.select(*IDS, "system", F.col("messages")[0]["role"].alias("role"), F.col("messages")[0]["content"].alias("content"))


def _parts_sql(template, **values):
    import re
    out, pos = [], 0
    for m in re.finditer(r"\{(instruction|sample)\}", template):
        out += [q(template[pos:m.start()]), values[m[1]]]
        pos = m.end()
    return " || ".join([*out, q(template[pos:])])


@register("build_messages_scene", fixtures=("f3",), sql=f"""SELECT problem_id, sample_idx, {q(TX.SCENE_SYSTEM)} AS system,
  {_parts_sql(TX.SCENE_USER, instruction='instruction', sample='response')} AS user FROM f3""")
def build_messages_scene(spark, sf):
    m = T.build_messages(f3(spark, sf), task="scene")
    return m.select(*IDS, F.col("messages")[0]["content"].alias("system"), F.col("messages")[1]["content"].alias("user"))


@register("critique_prompt_scene", fixtures=("f3",), sql=f"""SELECT problem_id, sample_idx, {q(TX.SCENE_CRITIQUE_SYSTEM)} AS system,
  {_parts_sql(TX.SCENE_CRITIQUE_USER, instruction='instruction', sample='response')} AS user FROM f3""")
def critique_prompt_scene(spark, sf):
    m = T.build_messages(f3(spark, sf), task="scene_critique")
    return m.select(*IDS, F.col("messages")[0]["content"].alias("system"), F.col("messages")[1]["content"].alias("user"))


def _tagged_sql(x):
    return (f"array_to_string(list_transform(string_split({x}, chr(10) || chr(10)), lambda p, i: '<paragraph_' || CAST(i - 1 AS VARCHAR) "
            f"|| '>' || chr(10) || p || chr(10) || '</paragraph_' || CAST(i - 1 AS VARCHAR) || '>'), chr(10))")


@register("critique_prompt", fixtures=("f3",), sql=f"""SELECT problem_id, sample_idx, {q(TX.CRITIQUE_SYSTEM)} AS system,
  {q(TX.CRITIQUE_USER.split('{instruction}')[0])} || instruction || {q(TX.CRITIQUE_USER.split('{instruction}')[1].split('{solution}')[0])}
  || {_tagged_sql('judge_reply || chr(10) || chr(10) || response')} || {q(TX.CRITIQUE_USER.split('{solution}')[1])} AS user FROM f3""")
def critique_prompt(spark, sf):
    """Replies made of two paragraphs (judge reply, blank line, response) to exercise the tags."""
    d = f3(spark, sf).withColumn("two", F.concat("judge_reply", F.lit("\n\n"), "response"))
    m = T.critique_prompt(d, "instruction", "two")
    return m.select(*IDS, F.col("messages")[0]["content"].alias("system"), F.col("messages")[1]["content"].alias("user"))


def _duck_verdict(x):
    t = f"lower({_duck_strip(x)})"
    parts = [f"{_duck_strip(f'string_split({t}, chr(10))[-1]')}", f"{_duck_strip(f'string_split({t}, chr(10))[1]')}",
             f"{_duck_strip(f'string_split({t}, {q(chr(46))})[-1]')}", f"{_duck_strip(f'string_split({t}, {q(chr(46))})[1]')}"]
    whens = " ".join(f"WHEN contains({p}, '{w}') THEN {v}" for p in parts for w, v in (("true", "1.0"), ("false", "0.0")))
    return f"CAST(CASE {whens} END AS DOUBLE)"


CRIT_SQL = "\\\\boxed\\{(-?\\d+)\\}"


def _duck_critique(x):
    return (f"CAST(CASE WHEN len(regexp_extract_all({x}, '{CRIT_SQL}', 1)) > 0 THEN "
            f"CASE WHEN CAST(regexp_extract_all({x}, '{CRIT_SQL}', 1)[-1] AS INT) = -1 THEN 1.0 ELSE 0.0 END END AS DOUBLE)")


@register("parse_verdict", fixtures=("f3",), sql=f"SELECT problem_id, sample_idx, {_duck_verdict('judge_reply')} AS verdict FROM f3")
def parse_verdict(spark, sf):
    return f3(spark, sf).select(*IDS, TX.parse_verdict("judge_reply").alias("verdict"))


@register("parse_critique", fixtures=("f3",), sql=f"SELECT problem_id, sample_idx, {_duck_critique('judge_reply')} AS critique_verdict FROM f3")
def parse_critique(spark, sf):
    return f3(spark, sf).select(*IDS, TX.parse_critique("judge_reply").alias("critique_verdict"))


@register("average_verdicts", fixtures=("f3",), sql=f"""WITH v AS (SELECT problem_id, sample_idx, {_duck_verdict('judge_reply')} AS verdict FROM f3
  UNION ALL SELECT problem_id, sample_idx, {_duck_critique('judge_reply')} FROM f3)
SELECT problem_id, sample_idx, round(avg(verdict), 6) AS verdict_mean, count(verdict) AS n_verdicts FROM v GROUP BY problem_id, sample_idx""")
def average_verdicts(spark, sf):
    """Two verdicts per reply (true/false parse and boxed critique) averaged where present."""
    p = T.parse_replies(f3(spark, sf))
    long = p.select(*IDS, "verdict").unionByName(p.select(*IDS, F.col("critique_verdict").alias("verdict")))
    a = T.average_verdicts(long)
    return a.select(*IDS, r6("verdict_mean", "verdict_mean"), "n_verdicts")


# ---------------------------------------------------------------- steps

_STEPS_SQL = ("list_filter(list_transform(string_split(response, chr(10)), lambda s: " + _duck_strip("s") + "), lambda s: s <> '')")


@register("explode_steps", fixtures=("f3",), sql=f"""SELECT problem_id, sample_idx, CAST(generate_subscripts(l, 1) - 1 AS INT) AS step_idx, unnest(l) AS step
FROM (SELECT problem_id, sample_idx, {_STEPS_SQL} AS l FROM f3)""")
def explode_steps(spark, sf):
    return T.explode_steps(f3(spark, sf)).select(*IDS, F.col("step_idx").cast("int"), "step")


@register("step_rewards", fixtures=("f3",), sql=f"""WITH s AS (SELECT problem_id, sample_idx, unnest(l) AS step
  FROM (SELECT problem_id, sample_idx, {_STEPS_SQL} AS l FROM f3)),
a AS (SELECT problem_id, sample_idx, min(length(step) / 100.0) AS mn, max(length(step) / 100.0) AS mx, avg(length(step) / 100.0) AS av
      FROM s GROUP BY problem_id, sample_idx)
SELECT f3.problem_id, f3.sample_idx, round(a.mn, 6) AS min_scores, round(a.mx, 6) AS max_scores, round(a.av, 6) AS avg_scores
FROM f3 LEFT JOIN a ON f3.problem_id = a.problem_id AND f3.sample_idx = a.sample_idx""")
def step_rewards(spark, sf):
    """Step scores from a stub scorer (characters / 100) aggregated per sample."""
    d = f3(spark, sf)
    steps = T.explode_steps(d).withColumn("step_score", F.length("step") / 100.0)
    out = T.step_rewards(d, steps)
    return out.select(*IDS, *[r6(c, c) for c in ("min_scores", "max_scores", "avg_scores")])


def _tokens(spark, sf):
    """Word tokens: the instruction's words (masked) then each step's words; logp from word length."""
    d = f3(spark, sf)
    steps = T.explode_steps(d)
    words = steps.select(*IDS, "step_idx", F.posexplode(F.split("step", " ")).alias("w", "word"))
    last = F.max("w").over(Window.partitionBy(*IDS, "step_idx"))
    resp = words.select(*IDS, "step_idx", (F.col("step_idx") * 100000 + F.col("w")).alias("pos"),
                        (-F.length("word") / 10.0).alias("logp"), F.lit(-0.4).alias("ref_logp"),
                        F.lit(True).alias("in_response"), (F.col("w") == last).alias("step_end"))
    ins = d.select(*IDS, F.posexplode(F.split("instruction", " ")).alias("w", "word")).select(
        *IDS, F.lit(-1).alias("step_idx"), (F.col("w") - 100000).alias("pos"), (-F.length("word") / 10.0).alias("logp"),
        F.lit(-0.4).alias("ref_logp"), F.lit(False).alias("in_response"), F.lit(False).alias("step_end"))
    return resp.unionByName(ins)


@register("step_logratio", fixtures=("f3",), sql=f"""WITH s AS (SELECT problem_id, sample_idx, generate_subscripts(l, 1) - 1 AS step_idx, unnest(l) AS step
  FROM (SELECT problem_id, sample_idx, {_STEPS_SQL} AS l FROM f3)),
w AS (SELECT problem_id, sample_idx, step_idx, generate_subscripts(ws, 1) - 1 AS wi, unnest(ws) AS word, len(ws) AS nw
      FROM (SELECT *, string_split(step, ' ') AS ws FROM s)),
c AS (SELECT problem_id, sample_idx, step_idx, wi, nw,
             sum(0.001 * ((-length(word) / 10.0) - (-0.4))) OVER (PARTITION BY problem_id, sample_idx ORDER BY step_idx * 100000 + wi
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM w)
SELECT problem_id, sample_idx, CAST(step_idx AS INT) AS step_idx, round(cum, 6) AS step_score FROM c WHERE wi = nw - 1""")
def step_logratio(spark, sf):
    out = T.step_logratio(_tokens(spark, sf), 0.001)
    return out.select(*IDS, F.col("step_idx").cast("int"), r6("step_score", "step_score"))


@register("reduce_scorer_output", fixtures=("f4",), sql="""SELECT problem_id,
  round(sqrt(list_reduce(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x), lambda a, b: a + b)), 6) AS l2,
  round(CAST(embedding[5] AS DOUBLE), 6) AS attribute,
  round(1.0 / (1.0 + exp(CAST(embedding[1] AS DOUBLE) - CAST(embedding[2] AS DOUBLE))), 6) AS two_logits FROM f4""")
def reduce_scorer_output(spark, sf):
    e = f4(spark, sf).withColumn("v", F.col("embedding").cast("array<double>"))
    l2 = T.reduce_scorer_output(e, "v", "l2").select("problem_id", F.col("score").alias("l2"))
    at = T.reduce_scorer_output(e, "v", "attribute", 5).select("problem_id", F.col("score").alias("attribute"))
    tl = T.reduce_scorer_output(e, "v", "two_logits").select("problem_id", F.col("score").alias("two_logits"))
    out = l2.join(at, "problem_id").join(tl, "problem_id")
    return out.select("problem_id", r6("l2", "l2"), r6("attribute", "attribute"), r6("two_logits", "two_logits"))
