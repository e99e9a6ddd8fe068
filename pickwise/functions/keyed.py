"""Rows that meet a small record of their key: broadcast while the records are few, grouped by key beyond that."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pickwise.functions.joins import written

SENT_BYTES = 32 << 20   # bytes of records that are sent to all tasks
OUT_BYTES = 4 << 20     # bytes of results that a task puts together
PART_ROWS = 4_096       # rows of a key that meet its record in one task, when grouped

#: ``step(key value, prepared record, rows)`` gives a table.
Step = Callable[[object, object, pa.Table], pa.Table]


def arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def with_record(rows: DataFrame, records: DataFrame, key: str, size: Column, prepare: Callable[[dict], object], step: Step, schema: str, spread: str,
                sent_bytes: int | None = None, part_rows: int | None = None, slice_rows: int | None = None) -> DataFrame:
    """``step`` applied to the rows of every key that has a record (one row of ``records``); other rows go.

    ``size``: the record's size in numbers, summed to decide whether the records travel to all tasks. Beyond that,
    rows and records are grouped by key, a key's rows in parts of about ``part_rows`` by the hash of column
    ``spread`` (so that a retried task deals them out alike). Both ways give the same rows.
    ``slice_rows``: the rows of a key meet a sent record so many at a time, for steps that make many rows of one."""
    sent_bytes, part_rows = SENT_BYTES if sent_bytes is None else sent_bytes, part_rows or PART_ROWS
    if (records.agg(F.sum(size)).first()[0] or 0) * 8 <= sent_bytes:
        shared = rows.sparkSession.sparkContext.broadcast({r[key]: prepare(r.asDict(True)) for r in records.collect()})

        def steps(table: pa.Table) -> Iterator[pa.Table]:
            coded = table[key].combine_chunks().dictionary_encode(null_encoding="encode")
            values, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            if len(values) > 1:  # rows of a key side by side: cut out, not looked for once per key
                order = np.argsort(at, kind="stable")
                table, at = table.take(pa.array(order)), at[order]
            ends = np.searchsorted(at, np.arange(len(values) + 1))
            for value, start, end in zip(values, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                if value in shared.value:
                    for first in range(start, end, slice_rows or max(1, end - start)):
                        yield step(value, shared.value[value], table.slice(first, min(end, first + (slice_rows or end)) - first))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0  # a batch with rows of very many keys gives one batch again
            for batch in batches:
                table = pa.Table.from_batches([batch])
                for made in steps(table) if len(table) else ():
                    held.append(made)
                    size += made.nbytes
                    if size > OUT_BYTES:
                        yield from pa.concat_tables(held).combine_chunks().to_batches()
                        held, size = [], 0
                if held:
                    yield from pa.concat_tables(held).combine_chunks().to_batches()
                    held, size = [], 0

        return rows.mapInArrow(run, schema)
    parts = written(rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("__parts")), "key-sizes")
    left = rows.join(parts, key).withColumn("__part", F.pmod(F.xxhash64(spread), F.col("__parts")).cast("int")).drop("__parts")
    right = records.join(parts, key).withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")
    empty = arrow_schema(schema).empty_table()

    def meet(mine: pa.Table, told: pa.Table) -> pa.Table:
        if not len(mine) or not len(told):
            return empty
        record = told.to_pylist()[0]
        return step(record[key], prepare(record), mine.drop_columns(["__part"]))

    return left.groupBy(key, "__part").cogroup(right.groupBy(key, "__part")).applyInArrow(meet, schema)


def summed(vectors: DataFrame, key: str, column: str = "v") -> DataFrame:
    """(key, v): element sums of equally long arrays, added position by position (a hot key's on every task)."""
    flat = vectors.select(key, F.posexplode(column).alias("at", "x")).groupBy(key, "at").agg(F.sum("x").alias("x"))
    return flat.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias(column))
