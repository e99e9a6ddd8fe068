"""Operator 13: bytes covered by repeated windows, by a depth-limited radix sort of suffixes.

Order of the digits. A window of ``depth`` bytes is a suffix read to that depth. Its bytes are sorted on
in this order: first the core, a fixed number of bytes from the window's anchor on; then
where the anchor stands in the window; then all bytes in eights. The anchor is the place of the
least hash among the window's first ``reach`` short grams (the leftmost, on ties), so it depends on the window's bytes
only: equal windows agree in every digit, and the groups that are equal after the last one are
exactly the repeated windows. All windows with one anchor (some 64 on average) share the core, so
the most significant pass sorts one record per anchor instead of one per byte.

First pass. Records are dealt by the hash of the core. A core that stands only once ends all its windows there. With a
record goes the hash of its whole block (every byte of its windows): records whose core and
block are equal, 128 bits together, are repeated throughout and need no further digit.

Further passes. Of cores with several different blocks, one record per block goes on and takes the
bytes of its block along. A task sorts the windows of its cores by whole arrays, eight bytes
a pass; a group that falls apart is sorted anew, a window that is left alone is dropped.

Hot groups. Equal records are combined before they are sent. A core with many blocks in one chunk is
dealt by core and block instead, and a core with more blocks than a task should hold sorts its
windows by their 128-bit hashes, which Spark counts with partial sums. No case is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pickwise.llm.common import MIX_A, _powers, mix64, prepare, stored

DEPTH = 400
PIECE = 1 << 19                 # bytes hashed at a time
CHUNK = 1 << 19                 # records gathered before they are sent
LOCAL_HOT = 32                  # blocks of one core in one chunk that travel by the core
MOST_BLOCKS = 4_000             # blocks of one core whose bytes meet in one task
BUCKET_BYTES = 8 << 20          # bytes of records of a bucket
BASES = (0x9E6C63D0676A9A99, 0xC2B2AE3D27D4EB4F)
RECORD = np.dtype([("core", "<u8"), ("block", "<u8"), ("text", "V12"), ("at", "<u4"), ("lead", "<u2"), ("runs", "<u2"), ("flag", "u1")])
SPAN = np.dtype([("text", "V12"), ("start", "<u4"), ("stop", "<u4")])
MANY, CROWDED = 1, 2            # flags: equal records stand elsewhere; other blocks of this core travel apart


class Scheme:
    """Sizes that follow from the depth: grams in reach of a window's start, bytes of a gram, bytes of a core."""

    def __init__(self, depth: int):
        if depth < 1 or depth > 100_000:
            raise ValueError("depth must lie between 1 and 100,000 bytes")
        self.depth = depth
        self.reach = max(1, depth * 8 // 25)
        self.gram = max(1, min(24, depth // 8))
        self.core = depth - self.reach + 1


@lru_cache(maxsize=4)
def _tables(size: int, which: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random values of the 256 bytes; powers of an odd base modulo 2^64 and of its inverse."""
    with np.errstate(over="ignore"):
        values = mix64(np.arange(1, 257, dtype=np.uint64) * MIX_A + np.uint64(which))
    return values, _powers(BASES[which], size), _powers(pow(BASES[which], -1, 1 << 64), size)


class Hashed:
    """Hashes of any stretch of some bytes, by prefix sums."""

    def __init__(self, raw: np.ndarray, which: int, size: int):
        values, power, self.inverse = _tables(size, which)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(values[raw] * power[:len(raw)], out=self.sums[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return mix64((self.sums[start + length] - self.sums[start]) * self.inverse[start] + np.asarray(length).astype(np.uint64) * MIX_A)


def anchored(raw: np.ndarray, ends: np.ndarray, scheme: Scheme, size: int) -> tuple[np.ndarray, ...]:
    """(text, anchor, first start, last start, core hash, block hash) of every run of windows with one anchor.

    ``raw`` holds texts one after another, ``ends`` their ends; places count from the start of ``raw``."""
    begins = np.concatenate([[0], ends[:-1]])
    counts = np.maximum(0, ends - begins - scheme.depth + 1)
    total = int(counts.sum())
    if not total:
        return (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),) * 2
    start = np.arange(total) + np.repeat(begins - (np.cumsum(counts) - counts), counts)
    with np.errstate(over="ignore"):
        one, two = Hashed(raw, 0, size), Hashed(raw, 1, size)
        n = len(raw) - scheme.gram + 1
        low = mix64((one.sums[scheme.gram:] - one.sums[:-scheme.gram]) * one.inverse[:n])
        low &= np.uint64(0xFFFFFFFFFF000000)                 # 40 bits of hash over 24 bits of place
        low |= np.arange(n, dtype=np.uint64)
        width = 1
        while 2 * width <= scheme.reach:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < scheme.reach:
            low = np.minimum(low[:len(low) - (scheme.reach - width)], low[scheme.reach - width:])
        at = (low[start] & np.uint64(0xFFFFFF)).astype(np.int64)
        fresh = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = start[np.append(fresh[1:], total) - 1]
        first, at = start[fresh], at[fresh]
        core = one.of(at, np.int64(scheme.core))
        block = mix64(two.of(first, last - first + scheme.depth) ^ ((at - first).astype(np.uint64) * MIX_A))
    return np.repeat(np.arange(len(ends)), counts)[fresh], at, first, last, core, block


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column of strings without nulls, as they lie in memory."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]


def records(names: np.ndarray, raw: np.ndarray, offsets: np.ndarray, scheme: Scheme) -> Iterator[np.ndarray]:
    """Records of all texts: whole texts together up to PIECE bytes, longer texts in pieces that count from their start."""
    size = PIECE + scheme.depth + 1
    i, n = 0, len(names)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1)
        low, high = int(offsets[i]), int(offsets[j])
        for begin in range(low, max(low + 1, high - scheme.depth + 1 if high - low > PIECE else low + 1), PIECE):
            end = min(high, begin + PIECE + scheme.depth - 1)
            ends = offsets[i + 1:j + 1] - begin if j > i + 1 or high - low <= PIECE else np.array([end - begin])
            text, at, first, last, core, block = anchored(raw[begin:end], ends, scheme, size)
            if len(text):
                out = np.zeros(len(text), RECORD)
                out["core"], out["block"], out["text"] = core, block, names[i + text]
                own = offsets[i + text] - begin            # where each text begins (before this piece, for later pieces)
                out["at"], out["lead"], out["runs"] = at - own, at - first, last - first + 1
                yield out
        i = j


def _groups(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, sizes) of the equal rows of sorted columns."""
    fresh = np.zeros(len(columns[0]), bool)
    fresh[0] = True
    for c in columns:
        fresh[1:] |= c[1:] != c[:-1]
    starts = np.flatnonzero(fresh)
    return starts, np.diff(np.append(starts, len(fresh)))


def _spans(rows: np.ndarray, depth: int) -> np.ndarray:
    """Covered bytes of records in the order of their texts; runs that follow each other are one span."""
    if not len(rows):
        return np.empty(0, SPAN)
    start = rows["at"].astype(np.int64) - rows["lead"]
    stop = start + rows["runs"] - 1 + depth
    fresh = np.concatenate([[True], (rows["text"][1:] != rows["text"][:-1]) | (start[1:] + depth - 1 != stop[:-1])])
    first = np.flatnonzero(fresh)
    out = np.zeros(len(first), SPAN)
    out["text"], out["start"], out["stop"] = rows["text"][first], start[first], stop[np.append(first[1:], len(rows)) - 1]
    return out


def _dealt(rows: np.ndarray, kind: int, bucket: np.ndarray) -> list[tuple[int, int, bytes]]:
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    starts, sizes = _groups(bucket) if len(rows) else ((), ())
    return [(int(bucket[i]), kind, rows[i:i + n].tobytes()) for i, n in zip(starts, sizes, strict=True)]


def combined(rows: np.ndarray, buckets: int, depth: int) -> list[tuple[int, int, bytes]]:
    """Packed (bucket, kind, data) of one chunk: 0 covered spans, 1 records by core, 2 records by core and block."""
    order = np.lexsort((rows["block"], rows["core"]))
    starts, sizes = _groups(rows["core"][order], rows["block"][order])
    several = np.zeros(len(rows), bool)
    several[order] = np.repeat(sizes > 1, sizes)
    found = _spans(rows[several], depth)
    one = rows[order[starts]]
    one["flag"] = np.where(sizes > 1, MANY, 0)
    starts, sizes = _groups(one["core"])
    apart = np.repeat(sizes > LOCAL_HOT, sizes)
    one["flag"][starts] |= np.where(sizes > LOCAL_HOT, CROWDED, 0).astype(np.uint8)
    apart[starts] = False
    plain, crowd = one[~apart], one[apart]
    n = np.uint64(buckets)
    out = _dealt(plain, 1, ((plain["core"] >> np.uint64(8)) % n).astype(np.int64))
    with np.errstate(over="ignore"):
        out += _dealt(crowd, 2, (mix64(crowd["core"] * MIX_A + crowd["block"]) % n).astype(np.int64))
    return out + _dealt(found, 0, np.arange(len(found)) % buckets)


_SENT_SQL = "bucket int, kind int, data binary"
_FOUND_SQL = "kind int, text binary, start long, stop long, core long, lead int, runs int, settled boolean"
_FOUND = pa.schema([("kind", pa.int32()), ("text", pa.binary()), ("start", pa.int64()), ("stop", pa.int64()), ("core", pa.int64()),
                    ("lead", pa.int32()), ("runs", pa.int32()), ("settled", pa.bool_())])


def _names(values: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(12), len(values), [None, pa.py_buffer(np.ascontiguousarray(values).tobytes())]).cast(pa.binary())


def _found_spans(spans: np.ndarray) -> pa.Table:
    n = len(spans)
    none = [pa.nulls(n, t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.bool_())]
    return pa.Table.from_arrays([pa.array(np.zeros(n, np.int32)), _names(spans["text"]), pa.array(spans["start"].astype(np.int64)), pa.array(spans["stop"].astype(np.int64)), *none], schema=_FOUND)


def first_pass(rows: DataFrame, buckets: int, scheme: Scheme) -> DataFrame:
    """Covered spans (kind 0) and, of cores with several blocks, one record per block (kind 1), stored by kind."""
    depth = scheme.depth

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            if not len(batch):
                continue
            raw, offsets = _bytes_of(batch.column(1))
            names = np.frombuffer(_bytes_of(batch.column(0))[0], "V12")
            for found in records(names, raw, offsets, scheme):
                held.append(found)
                size += len(found)
                if size >= CHUNK:
                    yield from _packed(combined(np.concatenate(held), buckets, depth))
                    held, size = [], 0
        if size:
            yield from _packed(combined(np.concatenate(held), buckets, depth))

    def receive(table: pa.Table) -> pa.Table:
        kinds = table["kind"].to_numpy()

        def of(kind: int, dtype: np.dtype) -> np.ndarray:
            parts = [np.frombuffer(v.as_buffer(), dtype) for v, k in zip(table["data"], kinds, strict=True) if k == kind]
            return np.concatenate(parts) if parts else np.empty(0, dtype)

        out = [_found_spans(of(0, SPAN))]
        for kind in (1, 2):
            rows = of(kind, RECORD)
            if not len(rows):
                continue
            rows = rows[np.lexsort((rows["block"], rows["core"]))]
            starts, sizes = _groups(rows["core"], rows["block"])
            flags = np.bitwise_or.reduceat(rows["flag"], starts)
            yes = (sizes > 1) | (flags & MANY > 0)
            out.append(_found_spans(_spans(rows[np.repeat(yes, sizes)], depth)))
            if kind == 1:        # cores with several blocks
                cores, blocks = _groups(rows["core"][starts])
                open_ = np.repeat((blocks > 1) | (np.bitwise_or.reduceat(flags, cores) & CROWDED > 0), blocks)
                starts, yes = starts[open_], yes[open_]
            go = rows[starts]
            begin = go["at"].astype(np.int64) - go["lead"]
            out.append(pa.Table.from_arrays([pa.array(np.ones(len(go), np.int32)), _names(go["text"]), pa.array(begin), pa.array(begin + go["runs"] - 1 + depth),
                                             pa.array(go["core"].view(np.int64) if go["core"].flags.c_contiguous else np.ascontiguousarray(go["core"]).view(np.int64)),
                                             pa.array(go["lead"].astype(np.int32)), pa.array(go["runs"].astype(np.int32)), pa.array(yes)], schema=_FOUND))
        return pa.concat_tables(out)

    return stored(rows.mapInArrow(send, _SENT_SQL).groupBy("bucket").applyInArrow(receive, _FOUND_SQL), "cores", "kind")


def _packed(rows: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 256):
        bucket, kind, data = zip(*rows[i:i + 256], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], ["bucket", "kind", "data"])


def radix(raw: np.ndarray, at: np.ndarray, group: np.ndarray, depth: int) -> np.ndarray:
    """Places in ``raw`` whose next ``depth`` bytes stand at another place of the same group as well.

    Most significant digits first, eight bytes a pass; a group of one is done, equal groups stay as they are."""
    order = np.argsort(group, kind="stable")
    at, group = at[order], group[order]
    width = 8 if depth >= 8 else 1
    words = np.ndarray((max(0, len(raw) - width + 1),), ">u8" if width == 8 else "u1", np.ascontiguousarray(raw), 0, (1,))

    def alone(group: np.ndarray) -> np.ndarray:
        starts, sizes = _groups(group)
        return np.repeat(sizes > 1, sizes)

    offset = 0
    while len(at):
        some = alone(group)
        at, group = at[some], group[some]
        if offset >= depth or not len(at):
            break
        digit = words[at + min(offset, depth - width)]
        starts, sizes = _groups(group)
        odd = digit != np.repeat(digit[starts], sizes)
        if odd.any():
            apart = np.flatnonzero(np.repeat(np.logical_or.reduceat(odd, starts), sizes))
            order = np.lexsort((digit[apart], group[apart]))
            at[apart], digit[apart] = at[apart][order], digit[apart][order]
            fresh = np.concatenate([[False], (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])])
            group = np.cumsum(fresh)
        offset += width
    return at


def _sort_blocks(depth: int):
    """Windows of a bucket of blocks that are repeated, as spans."""

    def run(table: pa.Table) -> pa.Table:
        raw, offsets = _bytes_of(table["data"].combine_chunks())
        runs, lead = table["runs"].to_numpy().astype(np.int64), table["lead"].to_numpy().astype(np.int64)
        owner = np.repeat(np.arange(len(runs)), runs)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
        _, core = np.unique(table["core"].to_numpy(), return_inverse=True)
        place = core[owner] * np.int64(1 << 17) + (lead[owner] - within)
        at = np.sort(radix(raw, offsets[owner] + within, place, depth))
        own = np.searchsorted(offsets, at, "right") - 1
        keep = ~table["settled"].to_numpy(zero_copy_only=False)[own]
        at, own = at[keep], own[keep]
        if not len(at):
            return pa.schema([("text", pa.binary()), ("start", pa.int64()), ("stop", pa.int64())]).empty_table()
        first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)]))
        last = np.append(first[1:], len(at)) - 1
        shift = (table["start"].to_numpy() - offsets[:-1])[own[first]]
        return pa.Table.from_arrays([table["text"].combine_chunks().take(pa.array(own[first])).cast(pa.binary()), pa.array(at[first] + shift), pa.array(at[last] + shift + depth)],
                                    ["text", "start", "stop"])

    return run


def _cut_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted blocks of each text, once per text and task."""
    seen: set[bytes] = set()
    for batch in batches:
        for name, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            if name in seen:
                continue
            seen.add(name)
            raw = text.as_py().encode("utf-8", "surrogatepass")
            for i in range(0, len(wanted), 512):
                part = wanted[i:i + 512]
                columns = [pa.array([name] * len(part), pa.binary())] + [pa.array([w[c] for w in part], t) for c, t in (("start", pa.int64()), ("core", pa.int64()), ("lead", pa.int32()), ("runs", pa.int32()), ("settled", pa.bool_()))]
                data = pa.array([raw[w["start"]:w["stop"]] for w in part], pa.binary())
                yield pa.RecordBatch.from_arrays([*columns, data], ["text", "start", "core", "lead", "runs", "settled", "data"])


def further_passes(texts: DataFrame, open_: DataFrame, scheme: Scheme, buckets: int, most: int = MOST_BLOCKS) -> DataFrame:
    """(text, start, stop): what further digits find repeated among the blocks that the first pass left open."""
    depth = scheme.depth
    once = stored(open_.groupBy("core", "text", "start", "stop", "lead", "runs").agg(F.count(F.lit(1)).alias("n"), F.max("settled").alias("settled")), "open-blocks")
    copied = once.where("n > 1").select("text", "start", "stop")      # a place that came twice belongs to a text with copies
    hot = stored(once.groupBy("core").count().where(F.col("count") > most).select("core"), "hot-cores")
    item = F.struct("start", "stop", "core", "lead", "runs", (F.col("settled") | (F.col("n") > 1)).alias("settled"))
    per_text = stored(once.groupBy(F.col("text").alias("name")).agg(F.collect_list(item).alias("items")), "blocks-by-text")
    joined = texts.join(per_text, "name").select("name", "text", "items")
    blocks = stored(joined.mapInArrow(_cut_blocks, "text binary, start long, core long, lead int, runs int, settled boolean, data binary"), "blocks")
    if hot.isEmpty():
        cold, crowded = blocks, None
    else:
        cold, crowded = blocks.join(hot, "core", "left_anti"), blocks.join(hot, "core", "left_semi")
    cold = cold.dropDuplicates(["text", "start", "lead"]).withColumn("bucket", F.pmod(F.xxhash64("core"), F.lit(buckets)).cast("int"))
    found = cold.groupBy("bucket").applyInArrow(_sort_blocks(depth), "text binary, start long, stop long").unionByName(copied)
    return found if crowded is None else found.unionByName(_hashed_windows(crowded.dropDuplicates(["text", "start", "lead"]), depth))


def _hashed_windows(blocks: DataFrame, depth: int) -> DataFrame:
    """(text, start, stop) of repeated windows of crowded cores, by both hashes of every window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start, core, lead, runs, data in zip(*(batch.column(c).to_pylist() for c in ("text", "start", "core", "lead", "runs", "data")), strict=True):
                raw, at = np.frombuffer(data, np.uint8), np.arange(runs)
                with np.errstate(over="ignore"):
                    one, two = (Hashed(raw, which, PIECE + depth + 1).of(at, np.int64(depth)).view(np.int64) for which in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array([name] * runs, pa.binary()), pa.array(start + at), pa.array([core] * runs), pa.array(lead - at), pa.array(one), pa.array(two)],
                                                 ["text", "start", "core", "place", "one", "two"])

    keys = ["core", "place", "one", "two"]
    windows = stored(blocks.mapInArrow(run, "text binary, start long, core long, place long, one long, two long"), "hot-windows")
    several = stored(windows.groupBy(*keys).count().where("count > 1").drop("count"), "hot-repeats")
    return windows.join(several, keys).select("text", "start", (F.col("start") + depth).alias("stop"))


def text_name(text: Column) -> Column:
    """96 bits of a text's MD5: equal texts are one text with copies."""
    return F.unhex(F.substring(F.md5(text), 1, 24))


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _maximal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, items): spans that overlap or touch become one."""
    for batch in batches:
        out = []
        for items in batch.column(1).to_pylist():
            merged: list[list[int]] = []
            for start, stop in sorted((s["start"], s["stop"]) for s in items):
                if merged and start <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], stop)
                else:
                    merged.append([start, stop])
            out.append([{"start": a, "stop": b} for a, b in merged])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, _SPANS)], ["name", "items"])


def _remove(width: int):
    """The bytes of each text outside its spans; ``width`` columns before the text go through."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, spans, kept = [], [], []
            for text, items in zip(batch.column(width), batch.column(width + 1).to_pylist(), strict=True):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                edges = [0, *(x for s in items or () for x in (s["start"], s["stop"])), len(raw)]
                sizes.append(len(raw))
                spans.append(items or [])
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(sizes, pa.int64()), pa.array(spans, _SPANS), pa.array(kept, pa.binary())],
                                             names=[*batch.schema.names[:width], "n_bytes", "spans", "kept"])
    return run


def remove_repeats(docs: DataFrame, keep: list[str], text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """``keep`` and (n_bytes, spans, kept): every byte covered by a repeated ``depth``-byte string is removed.

    Texts are UTF-8 bytes; null is empty. A string is repeated if it starts at another place of any text, its
    own included. ``spans`` are the maximal removed runs [start, stop), ``kept`` the other bytes, which need
    not be whole characters. Rows with equal texts are copies of each other, whatever their ids; shorter
    texts lose nothing; an empty table gives no rows. Columns other than ``keep`` are ignored."""
    prepare(docs.sparkSession)
    scheme = Scheme(depth)
    text = F.coalesce(F.col(text_col), F.lit(""))
    long = docs.select(text.alias("text")).where(F.octet_length("text") >= depth).select(text_name(F.col("text")).alias("name"), "text")
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    buckets = 1 + int(total * 2 * RECORD.itemsize / scheme.reach) // BUCKET_BYTES
    found = first_pass(long, buckets, scheme)
    rest = further_passes(long, found.where("kind = 1").drop("kind"), scheme, 4 * buckets)
    spans = found.where("kind = 0").select("text", "start", "stop").unionByName(rest)
    # copies of a text report the same spans: combined before they are listed and joined to every copy
    lists = spans.distinct().groupBy(F.col("text").alias("name")).agg(F.collect_list(F.struct("start", "stop")).alias("items"))
    per_text = stored(lists.mapInArrow(_maximal, "name binary, items array<struct<start: long, stop: long>>"), "covered")
    named = docs.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(keep)], text.alias("text")).withColumn("name", text_name(F.col("text")))
    joined = named.join(per_text, "name", "left").select(*[f"__{i}" for i in range(len(keep))], "text", "items")
    kinds = ", ".join(f"__{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    out = joined.mapInArrow(_remove(len(keep)), f"{kinds}, n_bytes long, spans array<struct<start: long, stop: long>>, kept binary")
    return out.toDF(*keep, "n_bytes", "spans", "kept")


def digests(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    out = remove_repeats(docs, ["doc_id"], depth=depth)
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))
