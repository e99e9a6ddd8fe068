"""Batch-scoring contract (ops 150-152): run any scorer over all (problem, sample) pairs.

The model itself is outside this package (GPU inference is not built); a scorer
is a Python callable ``scorer(instructions, responses) -> list of scores`` that
each task calls on its own Arrow batches, cut into ``batch`` rows.  The rows of a
failing call are tried again one by one and only those that fail alone get NULL, so
the result does not depend on how rows were cut; for scalar scorers a NULL score becomes
0.0, process scorers (``kind='process'``) keep NULL.  No shuffle: the scores
stay aligned with their rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score_batch(df: DataFrame, scorer, out: str, batch: int = 64, kind: str = "scalar",
                instruction: str = "instruction", response: str = "response") -> DataFrame:
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", `{out}` double"

    def run(batches):
        for pdf in batches:
            scores = []
            for start in range(0, len(pdf), batch):
                chunk = pdf.iloc[start:start + batch]
                asked = list(zip(chunk[instruction].tolist(), chunk[response].tolist()))
                got = _call(scorer, asked)
                scores.extend(got if got is not None else [(_call(scorer, [one]) or [None])[0] for one in asked])
            s = pd.Series(scores, dtype="float64")
            if kind == "scalar":
                s = s.fillna(0.0)
            yield pdf.assign(**{out: s.to_numpy()})

    return df.mapInPandas(run, schema)


def _call(scorer, pairs):
    """Scores of (instruction, response) pairs, None if the call fails or returns another number of scores."""
    try:
        got = list(scorer([a for a, _ in pairs], [b for _, b in pairs]))
    except Exception:  # noqa: BLE001 - any failure of the scorer means no score
        return None
    return got if len(got) == len(pairs) else None


def score_many(df: DataFrame, scorers: dict, batch: int = 64, kinds: dict | None = None,
               instruction: str = "instruction", response: str = "response") -> DataFrame:
    """One score column per scorer, chained (each is a narrow mapInPandas: no shuffle)."""
    out = df
    for name, fn in scorers.items():
        out = score_batch(out, fn, name, batch, (kinds or {}).get(name, "scalar"), instruction, response)
    return out


def inference_cost(problems: DataFrame, n_samples: int, n_reward_models: int, n_judges: int,
                   n_verdicts: int = 1) -> DataFrame:
    """Model calls per stage: generation = rows x samples, reward models = rows x samples x RMs,
    judges = rows x samples x judges x verdicts."""
    n = problems.agg(F.count(F.lit(1)).alias("rows"))
    gen = F.col("rows") * F.lit(n_samples)
    return n.select(F.explode(F.array(
        F.struct(F.lit("generation").alias("stage"), gen.alias("calls")),
        F.struct(F.lit("reward_models").alias("stage"), (gen * F.lit(n_reward_models)).alias("calls")),
        F.struct(F.lit("judges").alias("stage"), (gen * F.lit(n_judges * n_verdicts)).alias("calls")),
        F.struct(F.lit("total").alias("stage"),
                 (gen * F.lit(1 + n_reward_models + n_judges * n_verdicts)).alias("calls")))).alias("c")).select("c.*")


def length_ratio_scorer(instructions, responses):
    """A deterministic stand-in scorer for tests: response length / (1 + instruction length)."""
    return [len(r) / (1 + len(i)) if r is not None and i is not None else None
            for i, r in zip(instructions, responses)]
