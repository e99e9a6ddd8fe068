"""Shared helpers of the text operators: table access, word splitting, hashing, durable intermediate tables."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pickwise.session import ensure_checkpoint_dir, ship_package

#: Characters that separate words: [\x20\x09-\x0D].  ``bytes.split()`` splits on exactly these.
SPACES = " \t\n\x0b\x0c\r"
#: ASCII-only lower-casing, as the word contracts ask.
_SPACE_BYTES = [c.encode() for c in SPACES]
LOWER_ASCII = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

BATCH_ROWS = 1_000
BATCH_BYTES = 16 << 20
MIX_A = np.uint64(0x9E3779B97F4A7C15)
MIX_B = np.uint64(0xBF58476D1CE4E5B9)
MIX_C = np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Checkpoint folder known, package on the workers, Arrow batches of bounded size; every operator
    with Python tasks calls it. Rows are whole texts, so a batch of Spark's usual 10,000 rows could
    hold a GB; batches are bounded by rows and by bytes."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """Return freed memory of this process to the system; Python workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:      # another C library: nothing to trim
        pass


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's generator, after which the worker keeps nothing of it."""
    @wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            _tables.cache_clear()
            give_back()
    return tidied


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder name inside the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back.

    Cuts lineage durably: a lost executor costs at most its running tasks."""
    spark = df.sparkSession
    path = scratch(spark, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    schema = df.schema
    return spark.read.schema(schema).parquet(path)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixing of an unsigned array (wraps)."""
    x = (x ^ (x >> np.uint64(30))) * MIX_B
    x = (x ^ (x >> np.uint64(27))) * MIX_C
    return x ^ (x >> np.uint64(31))


_BLOCK = 1 << 20
_LONG_WORD = 4096
_BASE = 0x9E6C63D0676A9A99


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    filled, step = 1, np.array([base & 0xFFFFFFFFFFFFFFFF], np.uint64)
    with np.errstate(over="ignore"):
        while filled < n:
            more = min(filled, n - filled)
            out[filled:filled + more] = out[:more] * step[0]
            filled += more
            step = step * step
    return out


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64 and of its inverse, for one block of bytes."""
    return _powers(_BASE, _BLOCK + 1), _powers(pow(_BASE, -1, 1 << 64), _BLOCK + 1)


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, byte offset) of every word ``[^\\x20\\x09-\\x0D]+`` of a text, by whole-array steps.

    A word's hash is a polynomial of its bytes, mixed with its length. Texts are taken in
    blocks of about a MB cut between words; words of over 4096 bytes are hashed one by one."""
    hashes, offsets, at = [], [], 0
    power, inverse = _tables()
    while at < len(raw):
        stop = len(raw)
        if stop - at > _BLOCK:
            stop = max(raw.rfind(c, at, at + _BLOCK) for c in _SPACE_BYTES) + 1
            if stop <= at:  # one word fills the block: up to its end
                stop = min((i for i in (raw.find(c, at) for c in _SPACE_BYTES) if i >= 0), default=len(raw))
        if stop - at > _BLOCK:
            hashes.append(np.array([xxhash.xxh3_64_intdigest(raw[at:stop])], np.uint64))
            offsets.append(np.array([at]))
        else:
            block = np.frombuffer(raw, np.uint8, stop - at, at)
            solid = np.zeros(len(block) + 2, np.int8)
            solid[1:-1] = ~((block == 32) | ((block >= 9) & (block <= 13)))
            edge = np.diff(solid)
            first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            if len(first):
                with np.errstate(over="ignore"):
                    sums = np.zeros(len(block) + 1, np.uint64)
                    np.cumsum((block.astype(np.uint64) + np.uint64(1)) * power[:len(block)], out=sums[1:])
                    size = (last - first).astype(np.uint64)
                    got = mix64((sums[last] - sums[first]) * inverse[first] + size * MIX_A)
                for i in np.flatnonzero(size > _LONG_WORD):
                    got[i] = xxhash.xxh3_64_intdigest(raw[at + first[i]:at + last[i]])
                hashes.append(got)
                offsets.append(first + at)
        at = stop
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(offsets)


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size``-word window of word hashes in order; of the whole sequence when it is shorter."""
    if not len(h):
        return h
    width = min(size, len(h))
    n = len(h) - width + 1
    out = np.full(n, np.uint64(width))
    with np.errstate(over="ignore"):
        for i in range(width):
            out = mix64(out * MIX_A + h[i:i + n])
    return out


def folded(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased; empty for null."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER_ASCII) if text else b""


def small_join(rows: DataFrame, few: DataFrame, keys: list[str], how: str = "inner", most: int = 200_000) -> DataFrame:
    """Join ``rows`` with ``few`` (one row per key), whatever the skew of ``rows``.

    ``few`` must be a stored table. Counted to have at most ``most`` rows, it is broadcast.
    Beyond that both sides are plain shuffled tables, so Spark's adaptive skew join splits
    the partitions of a key that very many rows share. Null keys match nothing."""
    if few.limit(most + 1).count() <= most:
        few = F.broadcast(few)
    return rows.join(few, keys, how)
