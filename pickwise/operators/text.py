"""Text table operators: prompts, labelling, judge messages, verdicts, step scores (ops 131-149).

Every operator takes a whole problem / reply / step table and returns a table
keyed by (problem_id, sample_idx); the work is native column expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pickwise.functions import text as TX
from pickwise.functions.topk import group_topk
from pickwise.functions.columns import col, hash_order


# ---------------------------------------------------------------- 131-135 prompts

def prompt_choices(df: DataFrame, question: str = "question", options: str = "options",
                   answer_index: str = "answer_index", style: str = "letter") -> DataFrame:
    """'Question: ...\\n\\nChoices:\\nA) ...\\n\\n<tail>' and the answer letter.
    ``style``: 'mmlu' (A-D tail) or 'letter' (MMLU-Pro / GPQA tail)."""
    tail = TX.CHOICE_TAIL_MMLU if style == "mmlu" else TX.CHOICE_TAIL_LETTER
    problem = F.concat(F.lit("Question: "), col(question), F.lit("\n\nChoices:\n"), TX.choices_text(options),
                       F.lit("\n\n" + tail))
    return df.withColumn("problem", problem).withColumn("answer", F.char(F.lit(65) + col(answer_index)))


def prompt_open(df: DataFrame, problem: str = "problem", solution: str = "solution",
                subject: str | None = "subject") -> DataFrame:
    """Open problem prompt; the answer is the solution; subject defaults to mathematics."""
    subj = F.coalesce(col(subject), F.lit(TX.DEFAULT_SUBJECT)) if subject and subject in df.columns \
        else F.lit(TX.DEFAULT_SUBJECT)
    return df.select("*", F.concat(F.lit("Problem: "), col(problem), F.lit("\n\n" + TX.OPEN_TAIL)).alias("prompt"),
                     col(solution).alias("answer"), subj.alias("subject_filled"))


def prompt_shuffled_choices(df: DataFrame, key: str, correct: str, incorrect, question: str, seed: int = 42) -> DataFrame:
    """Four options (correct + three incorrect) in a seeded md5 order per problem; the letter of
    the first option equal to the correct text is the answer."""
    opts = F.array(*[F.struct(hash_order(seed, key, F.lit(i)).alias("h"), F.lit(i).alias("i"), col(c).alias("t"))
                     for i, c in enumerate([correct, *incorrect])])
    shuffled = F.transform(F.array_sort(opts), lambda s: s["t"])
    d = df.withColumn("options", shuffled)
    pos = F.array_position(F.col("options"), col(correct))
    return (prompt_choices(d.withColumn("__ai", (pos - 1).cast("int")), question, "options", "__ai", "letter")
            .drop("__ai"))


def filter_subjects(df: DataFrame, group: str = "college", subject: str = "subject") -> DataFrame:
    names = TX.COLLEGE_SUBJECTS if group == "college" else TX.PROFESSIONAL_SUBJECTS
    return df.filter(col(subject).isin(names))


def repeat_prompts(df: DataFrame, n: int, key: str = "problem_id") -> DataFrame:
    """One row per (problem, sample slot 0..n-1), ready for batch generation; no shuffle."""
    return df.withColumn("sample_idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def gather_samples(generated: DataFrame, n: int, key: str = "problem_id", batch: str = "batch_no", sample: str = "response") -> DataFrame:
    """Generated batches back to one row per problem: ``samples`` in batch order, cut to the first n.

    ``generated``: one row per (problem, batch) with an array of samples; n bounds a row's list."""
    slots = generated.select(key, batch, F.posexplode(F.col(sample)).alias("pos", "text"))
    first = group_topk(slots, [key], [F.col(batch), F.col("pos")], n, salt_col="pos")
    return first.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("rk", "text"))), lambda s: s["text"]).alias("samples"))


# ---------------------------------------------------------------- 136-140 answers

def label_samples(df: DataFrame, reply: str = "response", truth: str = "gt_answer", kind: str = "choice",
                  n_options: int = 4) -> DataFrame:
    """Extract the answer of every reply and verify it; failures give NULL / false."""
    if kind == "choice":
        ext = TX.extract_letter(reply, n_options)
        ok = TX.verify_choice(ext, truth)
    else:
        ext = TX.extract_boxed(reply)
        ok = TX.verify_math(ext, truth)
    return df.withColumn("extracted_answer", ext).withColumn("answer_correct", ok)


def label_accuracy(labelled: DataFrame) -> DataFrame:
    """Per-problem accuracy and extraction failures of a labelled reply table."""
    return labelled.groupBy("problem_id").agg(
        F.avg(F.col("answer_correct").cast("double")).alias("accuracy"),
        F.count_if(F.col("extracted_answer").isNull()).alias("failures"),
        F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- 141-145 judges

def build_messages(df: DataFrame, instruction: str = "instruction", sample: str = "response",
                   task: str = "reasoning", style: str = "messages") -> DataFrame:
    """Judge input for every (problem, sample): ``messages`` ARRAY<STRUCT<role, content>>, or the
    flat prompt 'Role: content' blocks ending 'Assistant: ' (``style='flat'``), or with the first
    system message split off and the rest as user/model turns (``style='gemini'``)."""
    if task == "critique":
        system = F.lit(TX.CRITIQUE_SYSTEM)
        user = TX.fill_template(TX.CRITIQUE_USER, instruction=instruction, solution=TX.paragraphs_tagged(sample))
    elif task in ("scene", "scene_critique"):
        system = F.lit(TX.SCENE_SYSTEM if task == "scene" else TX.SCENE_CRITIQUE_SYSTEM)
        user = TX.fill_template(TX.SCENE_USER if task == "scene" else TX.SCENE_CRITIQUE_USER, instruction=instruction, sample=sample)
    else:
        system = F.lit(TX.JUDGE_SYSTEM)
        user = TX.fill_template(TX.JUDGE_USER, instruction=instruction, sample=sample)
    msgs = F.array(F.struct(F.lit("system").alias("role"), system.alias("content")),
                   F.struct(F.lit("user").alias("role"), user.alias("content")))
    d = df.withColumn("messages", msgs)
    if style == "flat":
        flat = F.concat(F.array_join(F.transform("messages", lambda m: F.concat(
            F.upper(F.substring(m["role"], 1, 1)), F.lower(F.substring(m["role"], 2, 1 << 20)),
            F.lit(": "), m["content"], F.lit("\n\n"))), ""), F.lit("Assistant: "))
        return d.withColumn("prompt", flat)
    if style == "gemini":
        first_sys = F.element_at(F.filter("messages", lambda m: m["role"] == "system"), 1)
        rest = F.filter("messages", lambda m: m["role"] != "system")
        rest = F.transform(rest, lambda m: F.struct(
            F.when(m["role"] == "assistant", "model").otherwise("user").alias("role"), m["content"].alias("content")))
        return d.withColumn("system", F.coalesce(first_sys["content"], F.lit(""))).withColumn("messages", rest)
    return d


def critique_prompt(df: DataFrame, instruction: str = "instruction", sample: str = "response") -> DataFrame:
    return build_messages(df, instruction, sample, task="critique", style="messages")


def parse_replies(df: DataFrame, reply: str = "judge_reply") -> DataFrame:
    """Verdict (true/false) and critique (boxed index) of every judge reply."""
    return df.withColumn("verdict", TX.parse_verdict(reply)).withColumn("critique_verdict", TX.parse_critique(reply))


def average_verdicts(verdicts: DataFrame, value: str = "verdict") -> DataFrame:
    """Mean of the non-null verdicts of each sample; NULL when none (long table in)."""
    return verdicts.groupBy("problem_id", "sample_idx").agg(F.avg(value).alias("verdict_mean"),
                                                           F.count(value).alias("n_verdicts"))


# ---------------------------------------------------------------- 146-149 steps and raw scorer output

def explode_steps(df: DataFrame, response: str = "response") -> DataFrame:
    """(problem_id, sample_idx, step_idx, step): non-empty stripped lines of each response."""
    steps = F.filter(F.transform(F.split(col(response), "\n"), lambda s: TX.strip_ws(s)), lambda s: s != "")
    return df.select("problem_id", "sample_idx", F.posexplode(steps).alias("step_idx", "step"))


def step_prompt(df: DataFrame, instruction: str = "instruction", response: str = "response") -> DataFrame:
    """Process-reward prompt: steps joined by the step separator (plus a trailing one)."""
    steps = F.filter(F.transform(F.split(col(response), "\n"), lambda s: TX.strip_ws(s)), lambda s: s != "")
    msgs = F.array(F.struct(F.lit("system").alias("role"), F.lit(TX.STEP_SYSTEM).alias("content")),
                   F.struct(F.lit("user").alias("role"), col(instruction).alias("content")),
                   F.struct(F.lit("assistant").alias("role"),
                            F.concat(F.array_join(steps, TX.STEP_SEPARATOR), F.lit(TX.STEP_SEPARATOR)).alias("content")))
    return df.withColumn("messages", msgs)


def step_rewards(samples: DataFrame, step_scores: DataFrame, score: str = "step_score") -> DataFrame:
    """min / max / mean of the step scores of each sample; NULL for samples without steps."""
    agg = step_scores.groupBy("problem_id", "sample_idx").agg(
        F.min(score).alias("min_scores"), F.max(score).alias("max_scores"), F.avg(score).alias("avg_scores"))
    return samples.select("problem_id", "sample_idx").join(agg, ["problem_id", "sample_idx"], "left")


def step_logratio(tokens: DataFrame, coef: float = 0.001) -> DataFrame:
    """Implicit process reward: running sum over response tokens of coef * (logp - ref_logp)
    (tokens before the response masked), read at each step's last token.
    ``tokens``: (problem_id, sample_idx, pos, logp, ref_logp, in_response, step_idx, step_end)."""
    w = (Window.partitionBy("problem_id", "sample_idx").orderBy("pos")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    term = F.lit(coef) * (F.col("logp") - F.col("ref_logp")) * F.col("in_response").cast("double")
    run = tokens.withColumn("cum", F.sum(term).over(w))
    return run.filter(F.col("step_end")).select("problem_id", "sample_idx", "step_idx", F.col("cum").alias("step_score"))


def reduce_scorer_output(df: DataFrame, c: str, how: str = "l2", index: int = 1) -> DataFrame:
    """One score per row from raw scorer output: L2 norm of a reward vector (``l2``), one
    attribute of several (``attribute``, 1-based), or the positive-class probability of two
    logits (``two_logits``: 1 / (1 + exp(l0 - l1)))."""
    v = col(c)
    if how == "l2":
        s = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    elif how == "attribute":
        s = F.element_at(v, index)
    else:
        s = F.lit(1.0) / (F.lit(1.0) + F.exp(F.element_at(v, 1) - F.element_at(v, 2)))
    return df.withColumn("score", s.cast("double"))
