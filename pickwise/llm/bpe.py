"""Operator 1: byte-level BPE encoding and decoding.

Two tiers. A minimal perfect hash over the vocabulary resolves each pre-token that is
itself a vocabulary entry (one hash, one byte comparison). Every other pre-token is
merged by a heap of adjacent pairs over a linked list of bytes, in O(n log n) for a
pre-token of n bytes, so that a text without a single space stays affordable.

The tables hold only the fixed vocabulary (about 50,000 entries); they are built once on
the driver and broadcast. Texts are processed in Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from pickwise.llm.common import prepare, tidy


def read_ranks(path: str) -> list[bytes]:
    """Rank file (base64 token, rank) -> token bytes by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens: list[bytes] = [b""] * len(pairs)
    for text, rank in pairs:
        tokens[int(rank)] = base64.b64decode(text)
    return tokens


_LOW64 = (1 << 64) - 1


def _slot(h: int, d: int, n: int) -> int:
    """Slot of a key's 64-bit hash under displacement ``d``."""
    return ((((h ^ (d * 0x9E3779B97F4A7C15)) & _LOW64) * 0xD6E8FEB86659FD93 & _LOW64) >> 24) % n


class PerfectHash:
    """Minimal perfect hash of a fixed set of byte strings: hash, bucket, displace.

    ``shift[bucket]`` >= 0 is the displacement of a bucket with several keys, and
    ``-slot - 1`` the slot of a bucket with one. Every slot holds exactly one key."""

    def __init__(self, keys: list[bytes], per_bucket: int = 3):
        self.size = n = len(keys)
        self.buckets = max(1, -(-n // per_bucket))
        self.shift = [0] * self.buckets
        self.slots = [0] * n
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        spread = []
        for i, key in enumerate(keys):
            h = xxhash.xxh3_128_intdigest(key)
            members[(h >> 96) % self.buckets].append(i)
            spread.append(h & _LOW64)
        free = np.ones(n, bool)
        order = sorted(range(self.buckets), key=lambda b: -len(members[b]))
        singles = [b for b in order if len(members[b]) == 1]
        for b in order:
            own = members[b]
            if len(own) < 2:
                break
            d = 0
            while True:
                spots = [_slot(spread[i], d, n) for i in own]
                if len(set(spots)) == len(spots) and all(free[s] for s in spots):
                    break
                d += 1
                if d > 64 * n:
                    raise ValueError("no displacement found; the keys are not distinct")
            self.shift[b] = d
            for i, s in zip(own, spots, strict=True):
                free[s] = False
                self.slots[s] = i
        for b, s in zip(singles, np.flatnonzero(free).tolist(), strict=True):
            self.shift[b] = -s - 1
            self.slots[s] = members[b][0]

    def index(self, key: bytes) -> int:
        """The one index that ``key`` can have; the caller compares the key kept there."""
        h = xxhash.xxh3_128_intdigest(key)
        d = self.shift[(h >> 96) % self.buckets]
        if d < 0:
            return self.slots[-d - 1]
        return self.slots[_slot(h & _LOW64, d, self.size)]


class Vocabulary:
    """Ranked tokens with the perfect hash over them."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        self.pattern = pattern
        self.hash = PerfectHash(tokens)

    def find(self, raw: bytes) -> int:
        i = self.hash.index(raw)
        return i if self.tokens[i] == raw else -1


class _Ranks(dict):
    """Bytes of a pair of parts -> rank, -1 if it is no token; a bounded memory (speed only)."""

    def __init__(self, find, bound: int):
        super().__init__()
        self.find, self.bound = find, bound

    def __missing__(self, raw: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        self[raw] = got = self.find(raw)
        return got


class Encoder(dict):
    """pre-token -> its ids as little-endian 32-bit bytes; a bounded memory of earlier answers (speed only).

    When the memory is full it becomes the older generation, from which pre-tokens that come
    again are taken over; those that do not are forgotten at the next turn."""

    def __init__(self, vocab: Vocabulary, bound: int = 350_000):
        super().__init__()
        self.vocab, self.bound, self.older = vocab, bound // 2, {}
        self.pattern = regex.compile(vocab.pattern)
        self.find = vocab.find
        self.ranks = _Ranks(vocab.find, bound // 2)

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            packed = self.answer(piece)
        if len(packed) <= 1024:
            if len(self) >= self.bound:
                self.older = dict(self)
                self.clear()
            self[piece] = packed
        return packed

    def answer(self, piece: str) -> bytes:
        """Tier one, then tier two."""
        raw = piece.encode("utf-8", "surrogatepass")
        whole = self.find(raw)
        ids = [whole] if whole >= 0 else self.merge(raw)
        return struct.pack(f"<{len(ids)}I", *ids)

    def merge(self, raw: bytes) -> list[int]:
        """Merge the lowest-ranked adjacent pair, leftmost first, until none is a token."""
        n = len(raw)
        end = list(range(1, n + 1))        # part i covers raw[i:end[i]]
        before = list(range(-1, n - 1))
        gone = [False] * n
        ranks, push = self.ranks, heapq.heappush
        heap = []
        for i in range(n - 1):
            r = ranks[raw[i:i + 2]]
            if r >= 0:
                heap.append((r, i, i + 2))
        heapq.heapify(heap)
        while heap:
            r, i, stop = heapq.heappop(heap)
            j = end[i]
            if gone[i] or j >= n or end[j] != stop or gone[j]:
                continue  # one of the two parts has been merged meanwhile
            end[i] = stop
            gone[j] = True
            if stop < n:
                before[stop] = i
                after = end[stop]
                q = ranks[raw[i:after]]
                if q >= 0:
                    push(heap, (q, i, after))
            k = before[i]
            if k >= 0:
                q = ranks[raw[k:stop]]
                if q >= 0:
                    push(heap, (q, k, stop))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[raw[i:end[i]]])
            i = end[i]
        return ids

    def encode(self, text: str) -> bytes:
        """All ids of a text, packed."""
        return b"".join(map(self.__getitem__, self.pattern.findall(text)))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.vocab.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def share_vocabulary(spark, path: str, pattern: str):
    """The built vocabulary as a broadcast; each task makes an encoder of its own, freed with it."""
    return spark.sparkContext.broadcast(Vocabulary(read_ranks(path), pattern))


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", out_col: str = "token_ids") -> DataFrame:
    """Append the token ids of ``text_col`` as a binary column of little-endian unsigned 32-bit integers.

    Null text counts as empty (no ids). All other columns stay; ``out_col`` replaces a
    column of that name. An empty table gives an empty table."""
    return _codec(df, path, pattern, text_col, out_col, lambda enc, v: enc.encode(v) if v else b"", "binary")


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """Append the bytes that packed ids stand for; null ids give empty bytes."""
    return _codec(df, path, pattern, ids_col, out_col, lambda enc, v: enc.decode(v) if v else b"", "binary")


def _codec(df, path, pattern, source, target, fn, kind) -> DataFrame:
    spark = df.sparkSession
    prepare(spark)
    shared = share_vocabulary(spark, path, pattern)
    schema = df.drop(target).schema.add(target, kind)
    names = [f.name for f in schema.fields[:-1]]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(shared.value)
        for batch in batches:
            values = batch.column(batch.schema.names.index(source))
            got = pa.array([fn(enc, v.as_py()) for v in values], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(names_at(batch, n)) for n in names] + [got], names=[*names, target])

    return df.mapInArrow(run, schema)


def names_at(batch: pa.RecordBatch, name: str) -> int:
    return batch.schema.names.index(name)


def digests(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode each text in one pass; return id, n_tokens, ids_sha256, decoded_sha256.

    Null text counts as empty. Rows may repeat; each gives one row. Other columns are not read."""
    spark = df.sparkSession
    prepare(spark)
    shared = share_vocabulary(spark, path, pattern)
    rows = df.select(df[id_col].cast("long").alias(id_col), df[text_col].cast("string").alias("text"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(shared.value)
        for batch in batches:
            counts, ids, back = [], [], []
            for v in batch.column(1):
                packed = enc.encode(v.as_py() or "")
                counts.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                back.append(hashlib.sha256(enc.decode(packed)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string")
