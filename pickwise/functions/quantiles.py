"""Exact order statistics without sorting a column in one task.

Few groups, any number of ranks (:func:`select_ranks`). Doubles are taken as 64-bit integers of the
same order. A round counts, in every task, the rows under each wanted prefix of these bits by their next
digit; the counts are added by Spark, and the digits that hold a wanted rank become the prefixes of
the next round. All columns, groups and ranks share the rounds; a prefix whose rows are all
equal is an answer at once. At most CELLS counters per round reach the driver, whatever the table's size.

Many groups (:func:`grouped_ranks`). One range sort by (group, column, value) numbers all scores; a group begins
at its least number, so a rank within a group is one unique number. Groups of a few rows share a task, a group with a
third of all rows lies over many, and joins on the unique number have no hot key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pickwise.functions.ranks import global_rank
from pickwise.session import ship_package

CELLS = 1 << 17         # counters of a round, all columns and groups together
SIGN = np.uint64(1 << 63)


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles (-0.0 counts as 0.0; NaN is the largest, as in Spark)."""
    x = np.where(np.isnan(x), np.nan, np.asarray(x, float) + 0.0)
    bits = np.ascontiguousarray(x).view(np.uint64)
    return np.where(bits & SIGN, ~bits, bits | SIGN)


def from_bits(bits: np.ndarray) -> np.ndarray:
    bits = np.asarray(bits, np.uint64)
    return np.where(bits & SIGN, bits & ~SIGN, ~bits).view(np.float64)


def _counted(data: DataFrame, columns: Sequence[str], group_col: str | None, prefixes: dict, depth: int, digit: int) -> list:
    """(slot, prefix, n, lo, hi) of the non-empty cells ``depth + digit`` bits deep under the wanted prefixes.

    ``prefixes``: (group, column) -> sorted array of the wanted values of the first ``depth`` bits."""
    slots = {key: i for i, key in enumerate(prefixes)}
    wanted = list(prefixes.values())
    by_group: dict = {}
    for group, column in prefixes:
        by_group.setdefault(group, []).append(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            names = np.asarray(batch.column(len(columns)).to_pylist(), object) if group_col else None
            values = [batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(columns))]
            there = [np.asarray(batch.column(i).is_valid()) for i in range(len(columns))]
            for group, own in by_group.items():
                rows = slice(None) if names is None else np.flatnonzero(names == group)
                for column in own:
                    c, slot = columns.index(column), slots[group, column]
                    bits = ordered_bits(values[c][rows][there[c][rows]])
                    if depth:
                        top = bits >> np.uint64(64 - depth)
                        at = np.minimum(np.searchsorted(wanted[slot], top), len(wanted[slot]) - 1)
                        bits = bits[wanted[slot][at] == top]
                    if len(bits):
                        held.append(_cells(np.full(len(bits), slot), bits >> np.uint64(64 - depth - digit), np.ones(len(bits), np.int64), bits, bits))
            if sum(h.shape[1] for h in held) > 1 << 20:
                held = [_cells(*_columns(held))]
        if held:
            slot, prefix, n, lo, hi = _cells(*_columns(held))
            yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in (slot, prefix, n, lo, hi)], ["slot", "prefix", "n", "lo", "hi"])

    counted = data.mapInArrow(run, "slot long, prefix long, n long, lo long, hi long")
    # signed integers here: flipping the first bit keeps the order
    flip = F.lit(-(1 << 63))
    return (counted.groupBy("slot", "prefix").agg(F.sum("n").alias("n"), F.min(F.col("lo").bitwiseXOR(flip)).alias("lo"), F.max(F.col("hi").bitwiseXOR(flip)).alias("hi"))
            .collect())


def _columns(held: list[np.ndarray]) -> list[np.ndarray]:
    slot, prefix, n, lo, hi = np.concatenate(held, axis=1)
    return [slot.view(np.int64), prefix, n.view(np.int64), lo, hi]


def _cells(slot, prefix, n, lo, hi) -> np.ndarray:
    """One column per (slot, prefix): rows, least and largest value."""
    order = np.lexsort((prefix, slot))
    slot, prefix, n, lo, hi = slot[order], prefix[order], n[order], lo[order], hi[order]
    first = np.flatnonzero(np.concatenate([[True], (slot[1:] != slot[:-1]) | (prefix[1:] != prefix[:-1])]))
    return np.stack([slot[first].astype(np.int64).view(np.uint64), prefix[first], np.add.reduceat(n, first).astype(np.int64).view(np.uint64),
                     np.minimum.reduceat(lo, first), np.maximum.reduceat(hi, first)])


def select_ranks(df: DataFrame, wants: Mapping, group_col: str | None = None) -> dict:
    """{(group, column): {rank: value}} for ``wants`` {(group, column): 1-based ranks}, among non-null values.

    Without ``group_col`` the groups are None. Ranks out of range are left out. Exact for any
    data: a round reads at least one more bit of each wanted value."""
    wants = {key: sorted({int(r) for r in ranks if r is not None and r >= 1}) for key, ranks in wants.items()}
    wants = {key: ranks for key, ranks in wants.items() if ranks}
    found: dict = {key: {} for key in wants}
    if not wants:
        return found
    ship_package(df.sparkSession)
    columns = sorted({c for _, c in wants})
    keys = [group_col] if group_col else []
    data = df.select(*[F.col(c).cast("double") for c in columns], *keys).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        # of every prefix: the rows before it, and the ranks that it holds
        state = {key: {0: (0, ranks)} for key, ranks in wants.items()}
        depth = 0
        while state:
            cells = sum(len(s) for s in state.values())
            digit = min(64 - depth, max(1, int(math.log2(max(2, CELLS // cells)))))
            names = list(state)
            prefixes = {key: np.array(sorted(state[key]), np.uint64) for key in names}
            below: dict = {}
            for r in sorted(_counted(data, columns, group_col, prefixes, depth, digit), key=lambda r: (r["slot"], r["prefix"] % (1 << 64))):
                below.setdefault((r["slot"], (r["prefix"] % (1 << 64)) >> digit), []).append(r)
            following: dict = {}
            for (slot, prefix), rows in below.items():
                before, ranks = state[names[slot]][prefix]
                at = 0
                for r in rows:
                    mine = []
                    while at < len(ranks) and ranks[at] <= before + r["n"]:
                        mine.append(ranks[at])
                        at += 1
                    if mine:
                        if r["lo"] == r["hi"]:
                            value = float(from_bits(np.array([r["lo"] % (1 << 64)], np.uint64) ^ SIGN)[0])
                            found[names[slot]].update(dict.fromkeys(mine, value))
                        else:
                            following.setdefault(names[slot], {})[r["prefix"] % (1 << 64)] = (before, mine)
                    before += r["n"]
            state, depth = following, depth + digit
    finally:
        data.unpersist()
    return found


def kth_smallest(df: DataFrame, ks: dict[str, int]) -> dict[str, float | None]:
    """k-th smallest non-null value per column (k is 1-based; None if k is out of range)."""
    found = select_ranks(df, {(None, c): [k] for c, k in ks.items()})
    return {c: found.get((None, c), {}).get(k) for c, k in ks.items()}


def long_scores(df: DataFrame, columns: Sequence[str], *keep: str) -> DataFrame:
    """(keep..., verifier, score): the non-null scores of each row."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("verifier"), F.col(c).cast("double").alias("score")) for c in columns]))
    return df.select(*keep, each.alias("s")).select(*keep, "s.verifier", "s.score").where("score is not null")


def grouped_ranks(scores: DataFrame, keys: Sequence[str], tie: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows of ``scores`` with ``__at``, groups (keys, verifier, __start, n)) of a long table (keys, verifier, score).

    ``__at`` - ``__start`` is a row's 0-based place in its group by score; ``tie`` columns order equal
    scores and spread a value that very many rows share over tasks."""
    ranked = global_rank(scores, [*keys, "verifier", "score", *tie], "__at")
    groups = ranked.groupBy(*keys, "verifier").agg(F.min("__at").alias("__start"), F.count(F.lit(1)).alias("n"))
    return ranked, groups


def values_at(ranked: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` rows (..., __at) with the ``value`` that stands there; the numbers are unique, so no key is hot."""
    return wanted.join(ranked.select("__at", F.col("score").alias("value")), "__at").drop("__at")


def ceil_rank(p: float, n: int) -> int:
    """1-based rank of the discrete p-quantile: smallest value with cume_dist >= p."""
    return max(1, int(math.ceil(p * n)))
