"""Small groups that meet whole in one task, very many of them at a time.

Rows are dealt out by their key and sorted by it once; a task then hands over some tens of thousands of rows at a time,
cut between groups, so that a step works on all their groups by array operations. Only groups of
at most GROUP_ROWS rows may come this way: :func:`parted` tells them from the larger ones, which need a way that spreads a
group over tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pickwise.functions.joins import written
from pickwise.session import ship_package

GROUP_ROWS = 1_024      # rows of a group that is taken whole
STEP_ROWS = 65_536      # rows that a step gets, about

#: ``step(rows, start of each group)`` gives a table.
WholeStep = Callable[[pa.Table, np.ndarray], pa.Table]


def parted(df: DataFrame, key: str, most: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(rows of the groups of at most ``most`` rows, rows of the larger ones or None); rows without a key are in neither."""
    df = df.where(F.col(key).isNotNull())
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    large = written(sizes.where(F.col("__n") > (GROUP_ROWS if most is None else most)).select(key), "large-groups")
    if large.isEmpty():
        return df, None
    return df.join(large, key, "left_anti"), df.join(large, key, "left_semi").select(*df.columns)


def map_whole(rows: DataFrame, key: str, step: WholeStep, schema: str) -> DataFrame:
    """``step`` applied to all rows (none without a key), every group whole; one shuffle and one sort of them."""
    ship_package(rows.sparkSession)
    at = rows.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0

        def take(last: bool) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            keys = table.column(at)
            changed = np.asarray(pc.not_equal(keys[1:], keys[:-1]))
            starts = np.concatenate([[0], np.flatnonzero(changed) + 1])
            if not last:        # the last group may go on
                held.extend(table.slice(starts[-1]).to_batches())
                table, starts = table.slice(0, starts[-1]), starts[:-1]
            if len(starts):
                yield from step(table, starts).to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            count += batch.num_rows
            if count >= STEP_ROWS:
                yield from take(False)
                count = sum(b.num_rows for b in held)
        if held:
            yield from take(True)

    return rows.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def with_whole(rows: DataFrame, key: str, names: list[str], values: Callable[[pa.Table, np.ndarray], list]) -> DataFrame:
    """``rows`` with double columns ``names``: ``values(rows, starts)`` gives an array for each."""
    schema = ", ".join([*(f"`{n}` {t}" for n, t in rows.dtypes), *(f"`{n}` double" for n in names)])

    def step(table: pa.Table, starts: np.ndarray) -> pa.Table:
        for name, column in zip(names, values(table, starts), strict=True):
            table = table.append_column(name, column if isinstance(column, pa.Array) else pa.array(column, pa.float64()))
        return table

    return map_whole(rows, key, step, schema)


def numbers(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(values as doubles, whether they are there)."""
    there = np.asarray(column.is_valid().combine_chunks())
    return np.asarray(column.to_numpy(), float), there


def groups_of(starts: np.ndarray, n: int) -> np.ndarray:
    """The group's number of each row."""
    return np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
