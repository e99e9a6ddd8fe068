"""Operator 4: substring deduplication by paragraph MinHash banding, with anchored passages.

Paragraphs. The pieces between newlines with ``least_words`` words or more. Each is the set
of its 5-word shingles; 64 MinHash values make 16 bands of 4, which lets a pair of
similarity 0.8 slip with a chance under 0.0003. Paragraphs that collide in a band are joined
and verified by exact Jaccard similarity (0.8 or more); equal ones share one class from the
start. Components of the verified links are the clusters.

Passages. A passage that stands inside longer, different paragraphs leaves those paragraphs
far from similar, so paragraphs alone would miss it. Windows of 30 words therefore start at
anchors, the least word-pair hash of every 21 consecutive ones (winnowing). Anchors depend
on the words only and lie at most 21 words apart; hence two documents that share more than
50 words in a row share a whole window. Equal windows of different documents are joined by
their 128-bit hash, and adjacent ones grow together into spans.

In each cluster the occurrence with the smallest document id stays and the others are
marked as removed. Signatures and windows are gathered per task, pre-aggregated, packed
into buckets and shuffled once; only what is shared comes back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pickwise.functions.components import component_labels
from pickwise.llm import setjoin
from pickwise.llm.common import MIX_A, folded, mix64, prepare, small_join, stored, tidy, window_hashes, word_hashes

BANDS, ROWS = 16, 4
SPAN = 30               # words of a passage window
REACH = 21              # anchors are the least of so many neighbours
LEAST_WORDS = 30        # words of a paragraph that counts
LOCAL_HOT = 32
_SEEDS = (np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def paragraphs(raw: bytes, h: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(words before, words, sorted distinct shingle hashes) of every paragraph that is long enough."""
    ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) if raw else np.empty(0, np.int64)
    cuts = np.concatenate([[0], np.searchsorted(at, ends), [len(h)]])
    long = np.flatnonzero(np.diff(cuts) >= LEAST_WORDS)
    shingles = window_hashes(h, setjoin.SHINGLE) if len(long) else h
    for first, last in zip(cuts[long].tolist(), cuts[long + 1].tolist(), strict=True):
        tokens = np.sort(shingles[first:last - setjoin.SHINGLE + 1])
        fresh = tokens[1:] != tokens[:-1]
        yield first, last - first, tokens if fresh.all() else tokens[np.concatenate([[True], fresh])]


def paragraph_sets(text: str | None) -> list[np.ndarray]:
    raw = folded(text)
    return [tokens for _, _, tokens in paragraphs(raw, *word_hashes(raw))]


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, bands) band hashes of non-empty sets; identical sets have identical rows."""
    tokens = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    low = np.empty((BANDS * ROWS, len(sets)), np.uint64)
    scratch = np.empty_like(tokens)
    with np.errstate(over="ignore"):
        for p, seed in enumerate(_SEEDS):  # tokens are mixed already: an odd multiple permutes them
            np.minimum.reduceat(np.multiply(tokens, seed, out=scratch), starts, out=low[p])
        out = np.empty((len(sets), BANDS), np.uint64)
        for band in range(BANDS):
            key = np.full(len(sets), np.uint64(band + 1))
            for row in low[band * ROWS:(band + 1) * ROWS]:
                key = mix64(key * MIX_A + row)
            out[:, band] = key
    return out


def anchored_windows(h: np.ndarray, span: int = SPAN, reach: int = REACH) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the windows of a sequence of word hashes; none if it is shorter than one."""
    n = len(h)
    if n < span:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        runs = {1: h}       # hashes of runs of 1, 2, 4, ... words, by doubling
        size = 1
        while 2 * size <= span:
            runs[2 * size] = mix64(runs[size][:-size] * MIX_A + runs[size][size:])
            size *= 2
        pick = runs[min(2, size)][:n - span + 1]
        if len(pick) <= reach:
            at = np.array([int(np.argmin(pick))])
        else:
            view = np.lib.stride_tricks.sliding_window_view(pick, reach)
            at = np.concatenate([np.argmin(view[i:i + 65536], axis=1) + np.arange(i, min(i + 65536, len(view)))
                                 for i in range(0, len(view), 65536)])
            at = at[np.concatenate([[True], at[1:] != at[:-1]])]  # the least of a moving window never moves back
        out, done = np.full(len(at), np.uint64(span)), 0
        while size:
            if span - done >= size:
                out = mix64(out * MIX_A + runs[size][at + done])
                done += size
            size //= 2
    return at, out


class _Dealt:
    """Rows of 64-bit columns, the first of them the key: distinct rows per chunk, dealt into buckets."""

    def __init__(self, buckets: int, kind: int, width: int, chunk: int = 1 << 20):
        self.buckets, self.kind, self.width, self.chunk = buckets, kind, width, chunk
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(np.stack([np.asarray(c).view(np.int64) if np.asarray(c).dtype == np.uint64 else np.asarray(c, np.int64) for c in columns]))
        self.size += self.parts[-1].shape[1]

    def full(self) -> bool:
        return self.size >= self.chunk

    def flush(self) -> list[tuple[int, int, bytes]]:
        """(bucket, kind, packed): plain rows under ``kind``; of a key with many rows in this chunk one stays
        plain and all go straight on under ``kind + 1``, into buckets that do not depend on the key."""
        if not self.size:
            return []
        rows = np.concatenate(self.parts, axis=1)
        self.parts, self.size = [], 0
        rows = rows[:, np.lexsort((rows[1], rows[0]))]
        starts = np.flatnonzero(np.concatenate([[True], rows[0][1:] != rows[0][:-1]]))
        sizes = np.diff(np.append(starts, rows.shape[1]))
        crowded = np.repeat(sizes > LOCAL_HOT, sizes)
        lead = np.zeros(rows.shape[1], bool)
        lead[starts] = True
        out = []
        plain, hot = rows[:, ~crowded | lead], rows[:, crowded]
        for kind, part, bucket in ((self.kind, plain, (plain[0].view(np.uint64) >> np.uint64(8)) % np.uint64(self.buckets)),
                                   (self.kind + 1, hot, (np.arange(hot.shape[1]) // 4096 + int(abs(hot[0, 0]) % 997 if hot.size else 0)) % self.buckets)):
            if part.size:
                bucket = bucket.astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                part, bucket = part[:, order], bucket[order]
                cuts = np.append(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), len(bucket))
                out += [(int(bucket[i]), kind, np.ascontiguousarray(part[:, i:j]).tobytes()) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        return out


#: Kinds of packed rows: paragraphs' bands (2 and 3), passages' windows (4 and 5); 1 is one paragraph.
_SENT_SQL = "bucket int, kind int, data binary, rk long, cls long, start long, n long, size long"
_SENT = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("data", pa.binary()), ("rk", pa.int64()), ("cls", pa.int64()),
                   ("start", pa.int64()), ("n", pa.int64()), ("size", pa.int64())])
_MADE_SQL = "kind int, key long, cls long, rk long, start long, n long, size long"
_MADE = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("cls", pa.int64()), ("rk", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("size", pa.int64())])


def index(rows: DataFrame, buckets: int) -> DataFrame:
    """Paragraphs (kind 1), shared bands (2) and shared windows (4) of all rows, stored by kind."""

    @tidy
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, windows = _Dealt(buckets, 2, 2), _Dealt(buckets, 4, 3)
        for batch in batches:
            info: list[tuple] = []
            sets: list[np.ndarray] = []
            held = 0            # tokens; few at a time stay in the processor's cache
            for rk, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = folded(value.as_py())
                h, offsets = word_hashes(raw)
                for before, size, tokens in paragraphs(raw, h, offsets):
                    info.append((rk, setjoin.set_key(tokens), before, size, len(tokens)))
                    sets.append(tokens)
                    held += len(tokens)
                at, keys = anchored_windows(h)
                if len(at):
                    windows.add(keys, np.full(len(at), rk, np.int64), at)
                if windows.full():
                    yield from _packed(windows.flush())
                if held > 20_000:
                    yield from _paragraphs(info, sets, bands, buckets)
                    info, sets, held = [], [], 0
            if info:
                yield from _paragraphs(info, sets, bands, buckets)
        yield from _packed(bands.flush() + windows.flush())

    made = rows.select("rk", "text").mapInArrow(send, _SENT_SQL).groupBy("bucket").applyInArrow(_receive, _MADE_SQL)
    return stored(made, "paragraphs", "kind")


def _paragraphs(info, sets, bands: _Dealt, buckets: int) -> Iterator[pa.RecordBatch]:
    keys = band_keys(sets)
    own = np.array([r[1] for r in info], np.int64)
    for b in range(BANDS):
        bands.add(keys[:, b], own)
    if bands.full():
        yield from _packed(bands.flush())
    rk, cls, before, words, size = zip(*info, strict=True)
    none = pa.nulls(len(info))
    yield pa.RecordBatch.from_arrays([pa.array([r % buckets for r in rk], pa.int32()), pa.array([1] * len(info), pa.int32()), none.cast(pa.binary()),
                                      *(pa.array(c, pa.int64()) for c in (rk, cls, before, words, size))], schema=_SENT)


def _packed(rows) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 256):
        bucket, kind, data = zip(*rows[i:i + 256], strict=True)
        none = pa.nulls(len(bucket), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), pa.array(data, pa.binary()), none, none, none, none, none], schema=_SENT)


def _receive(table: pa.Table) -> pa.Table:
    """Of one bucket: its paragraphs, and the rows of keys that two different owners share."""
    out = []
    kinds = table["kind"].to_numpy()
    own = table.filter(pa.array(kinds == 1))
    if len(own):
        out.append(pa.Table.from_arrays([pa.array(np.full(len(own), 1, np.int32)), pa.nulls(len(own), pa.int64()),
                                         *(own[c].combine_chunks() for c in ("cls", "rk", "start", "n", "size"))], schema=_MADE))
    for kind, width, columns in ((2, 2, ("key", "cls")), (3, 2, ("key", "cls")), (4, 3, ("key", "rk", "start")), (5, 3, ("key", "rk", "start"))):
        parts = [np.frombuffer(v.as_buffer(), np.int64).reshape(width, -1) for v, k in zip(table["data"], kinds, strict=True) if k == kind]
        if not parts:
            continue
        rows = np.concatenate(parts, axis=1)
        rows = rows[:, np.lexsort((rows[1], rows[0]))]
        starts = np.flatnonzero(np.concatenate([[True], rows[0][1:] != rows[0][:-1]]))
        sizes = np.diff(np.append(starts, rows.shape[1]))
        if kind % 2 == 0:  # the smallest and the largest owner of a key differ
            several = rows[1][starts] != rows[1][np.append(starts[1:], rows.shape[1]) - 1]
            rows = rows[:, np.repeat(several, sizes)]
        if rows.shape[1]:
            none = pa.nulls(rows.shape[1], pa.int64())
            found = {c: pa.array(rows[i]) for i, c in enumerate(columns)}
            out.append(pa.Table.from_arrays([pa.array(np.full(rows.shape[1], kind - kind % 2, np.int32)), *(found.get(c, none) for c in _MADE.names[1:])], schema=_MADE))
    return pa.concat_tables(out) if out else _MADE.empty_table()


def paragraph_clusters(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(rk, start, n, cluster) of the paragraphs that are similar to one of another document."""
    info = found.where("kind = 1").select("rk", "cls", "start", "n", "size")
    classes = stored(info.groupBy("cls").agg(F.min("rk").alias("rep"), F.max("size").alias("n"), F.lit(-1).cast("long").alias("slack"),
                                             (F.min("rk") != F.max("rk")).alias("copied")), "paragraph-classes")
    shared = stored(found.where("kind = 2").select(F.col("key").alias("sig"), "cls").distinct(), "bands")
    labels = component_labels(setjoin.class_links(rows, classes, shared, paragraph_sets, banded=True))
    clusters = stored(classes.join(labels, classes["cls"] == labels["node"], "left").where(F.col("component").isNotNull() | F.col("copied"))
                      .select("cls", F.coalesce("component", "cls").alias("cluster")), "clusters")
    return small_join(info, clusters, ["cls"]).select("rk", "start", "n", "cluster").distinct()


def passage_spans(found: DataFrame, ids: DataFrame) -> DataFrame:
    """(rk, id, start, n, owner): grown spans of windows that also stand in another document; owner has the smallest id."""
    windows = found.where("kind = 4").select("key", "rk", "start").distinct().join(ids, "rk")
    shared = stored(windows, "windows")
    first = F.min(F.struct(F.col("id").isNull().alias("nameless"), F.col("id"), F.col("rk")))
    owners = stored(shared.groupBy("key").agg(first.alias("first"), F.min("rk").alias("lo"), F.max("rk").alias("hi")).where("lo <> hi")
                    .select("key", F.col("first.id").alias("owner"), F.col("first.rk").alias("owner_rk")), "owners")
    placed = small_join(shared, owners, ["key"])
    inside = Window.partitionBy("rk").orderBy("start")
    fresh = F.coalesce((F.col("start") > F.lag("start").over(inside) + SPAN) | (F.col("owner_rk") != F.lag("owner_rk").over(inside)), F.lit(True))
    islands = placed.withColumn("fresh", fresh.cast("int")).withColumn("island", F.sum("fresh").over(inside))
    return islands.groupBy("rk", "island").agg(F.max("id").alias("id"), F.min("start").alias("start"), (F.max("start") + SPAN - F.min("start")).alias("n"),
                                               F.max("owner").alias("owner"), (F.max("owner_rk") != F.col("rk")).alias("removed"))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kind, start_word, n_words, cluster_id, removed): every repeated paragraph and passage.

    ``start_word`` counts the words before, over the whole text. ``cluster_id`` is the smallest
    document id of the paragraph's cluster, or that has the passage's windows (at a passage's
    ends two documents may share a window that the first lacks); ``removed`` is false for that one occurrence
    (the first in its document) and true for the others. Null, empty and short texts give no
    rows; a paragraph repeated only inside one document is none of these. Rows equal in id and
    text are one document; a null id ranks after all others."""
    prepare(docs.sparkSession)
    rows = setjoin.keyed_rows(docs, id_col, text_col)
    found = index(rows, setjoin.bucket_count(rows, 12_000_000))
    ids = stored(rows.select("rk", "id").distinct(), "ids")
    members = stored(paragraph_clusters(rows, found).join(ids, "rk"), "members")
    order = F.struct(F.col("id").isNull().alias("nameless"), F.col("id"), F.col("start"), F.col("rk"))
    heads = stored(members.groupBy("cluster").agg(F.min(order).alias("head")), "heads")
    named = small_join(members, heads, ["cluster"])
    whole = named.select(F.col("id").alias(id_col), F.lit("paragraph").alias("kind"), F.col("start").alias("start_word"), F.col("n").alias("n_words"),
                         F.col("head.id").alias("cluster_id"), ~((F.col("head.rk") == F.col("rk")) & (F.col("head.start") == F.col("start"))))
    spans = passage_spans(found, ids).select(F.col("id").alias(id_col), F.lit("passage").alias("kind"), F.col("start").alias("start_word"),
                                             F.col("n").alias("n_words"), F.col("owner").alias("cluster_id"), F.col("removed"))
    return whole.toDF(*spans.columns).unionByName(spans)
