"""A table as a stream: written to files in event-time order, read in batches, state where it has room.

A window's state goes once the watermark has passed it. One batch of all rows keeps every window of the table at
once; batches in event-time order keep those of a batch and of the delay. So a larger table is dealt out by
ranges of event time, one file a range, and a batch reads as many files as a cluster's heap holds rows of. Rows
of equal time may be in several files: none of them is late.
"""

from __future__ import annotations

import math
import os
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pickwise.session import ensure_checkpoint_dir

BATCH_ROWS = 500_000    # rows of a batch for each core
FILES = 2               # files of a batch, and partitions of the state, for each core
STATE = "spark.sql.streaming.stateStore"
ON_DISK = {f"{STATE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
           f"{STATE}.rocksdb.boundedMemoryUsage": "true", f"{STATE}.rocksdb.maxMemoryUsageMB": "256", f"{STATE}.rocksdb.trackTotalNumberOfRows": "false"}


@contextmanager
def _settings(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """Session settings that a stream takes over as it starts, put back afterwards."""
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _ordered(spark: SparkSession, folder: str) -> bool:
    """Give the files of ``folder`` times in the order of their names, which a file stream reads them by; whether the store took them."""
    kind = spark._jvm.org.apache.hadoop.fs.Path
    fs = kind(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    listed = lambda: sorted((s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(kind(folder)) if s.getPath().getName().startswith("part-"))
    names = [name for name, _ in listed()]
    first = int(time.time() - len(names)) * 1000
    try:
        for i, name in enumerate(names):
            fs.setTimes(kind(folder, name), first + 1000 * i, -1)
    except Exception:  # a store without such times
        return False
    times = [at for _, at in listed()]
    return all(a < b for a, b in zip(times, times[1:]))


def held_rows(days: dict[int, int], delay: int = 1) -> int:
    """Most rows of ``days`` (day number -> rows) that a one-day window and a delay in days keep at once."""
    return max((sum(days.get(day + i, 0) for i in range(delay + 2)) for day in days), default=0)


def replay(rows: DataFrame, stream_of, days: dict[int, int], ts: str = "ts", batch_rows: int | None = None) -> DataFrame:
    """``stream_of(stream)`` run to its end over ``rows`` arriving in order of ``ts``, in append mode into Parquet files; the
    files read back. ``days``: rows of each day (number since 1970)."""
    spark = rows.sparkSession
    root = os.path.join(ensure_checkpoint_dir(spark), "pickwise-stream", uuid.uuid4().hex)
    source, cores, conf = os.path.join(root, "source"), spark.sparkContext.defaultParallelism, {}
    most = batch_rows or BATCH_ROWS * cores
    batches = math.ceil(sum(days.values()) / most)
    reader = spark.readStream.schema(rows.schema)
    if batches <= 1:
        rows.write.parquet(source)
    else:
        files = FILES * cores
        # further columns part the rows of one time
        rows.repartitionByRange(batches * files, ts, *[c for c in rows.columns if c != ts]).write.option("maxRecordsPerFile", 0).parquet(source)
        conf = {"spark.sql.shuffle.partitions": str(files), "spark.sql.streaming.maxBatchesToRetainInMemory": "1", "spark.sql.streaming.minBatchesToRetain": "2"}
        ordered = _ordered(spark, source)
        if ordered:
            reader = reader.option("maxFilesPerTrigger", files)
        if not ordered or held_rows(days) > most:
            conf = ({} if not ordered else conf) | ON_DISK
    out = stream_of(reader.parquet(source))
    with _settings(spark, conf):
        query = (out.writeStream.format("parquet").option("path", os.path.join(root, "out")).option("checkpointLocation", os.path.join(root, "checkpoint"))
                 .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(os.path.join(root, "out"))
