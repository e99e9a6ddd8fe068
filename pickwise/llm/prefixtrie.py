"""Operator 12: trie of shared conversation prefixes, as balanced parentheses per shard.

Paths. A turn is the MD5 of its role and text, so a conversation's path is a string of 16-byte
keys; binary order of such strings is the trie's depth-first order. Equal paths are one path with several ends.

Shards. The sorted paths are cut into ranges, and a task takes its range in chunks of a bounded
number of nodes. A chunk writes its own trie as balanced parentheses. The excess (open minus
closed) is kept with minima per block and over the blocks; ``find_close`` searches the block, climbs the
minima and searches one more block, for all nodes at once. The span of a node delimits its
subtree: the rank of "()" counts its leaves, cumulative arrays give its ends and savings.

Spines. Only the prefixes that a chunk's first and last path share with the neighbouring chunk stand in several
chunks. A chunk owns the nodes that its predecessor does not have. Every figure is a sum over
chunks once unowned nodes leave out what is counted once (their words, their place among their
parent's children), so the parts of a shared node merge by addition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pickwise.llm.common import prepare, small_join, stored

KEY, COUNT = 16, 8              # bytes of a turn's key and of its number of words
BLOCK = 64                      # parentheses of a block of the excess
CHUNK_NODES = 1 << 18
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
WORD = r"[^\x20\x09-\x0D]+"


class Parentheses:
    """Balanced parentheses of a trie given by the depths of its nodes in depth-first order."""

    def __init__(self, depth: np.ndarray):
        n = len(depth)
        self.opens = 2 * np.arange(n) - depth            # i nodes opened and i - depth closed before node i
        bits = np.full(2 * n, -1, np.int64)
        bits[self.opens] = 1
        self.excess = np.cumsum(bits)
        size = 1
        while size * BLOCK < 2 * n:
            size *= 2
        padded = np.zeros(size * BLOCK, np.int64)         # past the end: as closed as it gets
        padded[:2 * n] = self.excess
        self.size, self.padded = size, padded
        self.least = np.zeros(2 * size, np.int64)         # a heap of the blocks' minima: node i over 2i and 2i + 1
        self.least[size:] = padded.reshape(size, BLOCK).min(axis=1)
        while size > 1:
            half = size // 2
            self.least[half:size] = np.minimum(self.least[size:2 * size:2], self.least[size + 1:2 * size:2])
            size = half

    def _scan(self, start: np.ndarray, want: np.ndarray) -> np.ndarray:
        """First position from ``start`` to the end of its block with an excess of ``want`` or less; -1 without."""
        out = np.full(len(start), -1, np.int64)
        active = np.arange(len(start))
        at = start.copy()
        stop = (start // BLOCK + 1) * BLOCK
        while len(active):
            active = active[at[active] < stop[active]]
            hit = self.padded[at[active]] <= want[active]
            out[active[hit]] = at[active[hit]]
            active = active[~hit]
            at[active] += 1
        return out

    def find_close(self) -> np.ndarray:
        """Position of the parenthesis that closes each node."""
        want = self.excess[self.opens] - 1
        close = self._scan(self.opens + 1, want)
        left = np.flatnonzero(close < 0)
        if not len(left):
            return close
        node, goal = self.opens[left] // BLOCK + self.size, want[left]
        up = np.ones(len(left), bool)
        while up.any():      # climb until a right neighbour's minimum reaches the goal
            right = up & (node % 2 == 0)
            found = right & (self.least[np.minimum(node + 1, 2 * self.size - 1)] <= goal)
            node = np.where(found, node + 1, np.where(up, node // 2, node))
            up &= ~found
        while (below := node < self.size).any():      # go down to the first block that reaches it
            child = np.where(below, 2 * node, node)
            node = np.where(below & (self.least[child] > goal), child + 1, child)
        close[left] = self._scan((node - self.size) * BLOCK, goal)
        return close

    def leaf_rank(self) -> np.ndarray:
        """Number of "()" whose opening parenthesis stands before each position."""
        bits = np.diff(np.concatenate([[0], self.excess]))
        pair = np.zeros(len(bits) + 1, np.int64)
        pair[1:-1] = (bits[:-1] == 1) & (bits[1:] == -1)
        return np.cumsum(pair)


def shared_turns(a: bytes | None, b: bytes | None) -> int:
    """Turns that two paths have in common from the start; -1 if there is no such path."""
    if a is None or b is None:
        return -1
    n = min(len(a), len(b)) // KEY
    if a[:n * KEY] == b[:n * KEY]:
        return n
    x, y = (np.frombuffer(p, np.uint64, 2 * n).reshape(-1, 2) for p in (a, b))
    return int(np.flatnonzero((x != y).any(axis=1))[0])


class Chunk:
    """Sorted distinct paths: (keys, words, number of ends, least conv_id, digest of the ends)."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.nodes = 0

    def add(self, row: tuple) -> None:
        self.rows.append(row)
        self.nodes += len(row[0]) // KEY - (max(0, shared_turns(self.rows[-2][0], row[0])) if len(self.rows) > 1 else -1)

    def solve(self, before: bytes | None, after: bytes | None) -> pa.RecordBatch:
        """All nodes of this chunk; those that a neighbour has as well under their path's digest, as parts to be added."""
        paths = [r[0] for r in self.rows]
        lcp = [0, *(shared_turns(a, b) for a, b in zip(paths, paths[1:], strict=False))]
        length = [len(p) // KEY for p in paths]
        depths, words, parents, last = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], np.empty(len(paths), np.int64)
        at_depth = np.zeros(max(length) + 1, np.int64)        # the node of each depth on the current path
        n = 1
        for i, (shared, size) in enumerate(zip(lcp, length, strict=True)):
            fresh = size - shared
            if fresh:
                at_depth[shared + 1:size + 1] = np.arange(n, n + fresh)
                depths.append(np.arange(shared + 1, size + 1))
                words.append(np.frombuffer(self.rows[i][1], "<i8")[shared:size])
                parents.append(at_depth[shared:size].copy())
                n += fresh
            last[i] = at_depth[size]
        depth, weight, parent = np.concatenate(depths), np.concatenate(words), np.concatenate(parents)
        first_shared, last_shared = shared_turns(before, paths[0]), shared_turns(paths[-1], after)
        owned = np.arange(n) > first_shared                   # the nodes of the first path are numbered by depth

        trie = Parentheses(depth)
        close = trie.find_close()
        size = (close - trie.opens + 1) // 2
        stop = np.arange(n) + size
        rank = trie.leaf_rank()
        leaves = rank[close] - rank[trie.opens]
        if last_shared == length[-1]:                         # the next chunk goes on below the last path
            leaves[at_depth[:last_shared + 1]] -= 1

        def cumulative(values: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(values)])
            return total[stop] - total[:-1]

        ends = np.zeros(n, np.int64)
        ends[last] = [r[2] for r in self.rows]
        members = cumulative(ends)
        saved = cumulative((members - owned) * weight)
        children = np.bincount(parent[1:][owned[1:]], minlength=n)
        low, high = np.searchsorted(last, np.arange(n)), np.searchsorted(last, stop)
        least = np.minimum.reduceat(np.append([r[3] for r in self.rows], np.iinfo(np.int64).max), np.stack([low, high], axis=1).ravel())[::2]
        digest = np.full(n, None, object)
        digest[last] = [r[4] for r in self.rows]

        names = np.full(n, None, object)
        for path, upto, nodes in ((paths[0], first_shared, np.arange(first_shared + 1)), (paths[-1], last_shared, at_depth[:last_shared + 1])):
            running = hashlib.sha256()
            for d in range(upto + 1):
                if d:
                    running.update(path[(d - 1) * KEY:d * KEY])
                names[nodes[d]] = running.copy().digest()
        above = names[parent]
        above[0] = None
        known = np.array([x is None for x in above])
        known[0] = False
        return pa.RecordBatch.from_arrays([
            pa.array(names, pa.binary()), pa.array(above, pa.binary()), pa.array(least), pa.array(depth), pa.array(least[parent], mask=~known),
            pa.array(members), pa.array(children), pa.array(leaves), pa.array(saved), pa.array(digest, pa.string())], schema=_NODES)


_COLUMNS = ["node", "above", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
_KINDS = {"node": "binary", "above": "binary", "ends_sha256": "string"}
_NODES_SQL = ", ".join(f"{c} {_KINDS.get(c, 'long')}" for c in _COLUMNS)
_NODES = pa.schema([(c, {"binary": pa.binary(), "string": pa.string(), "long": pa.int64()}[_KINDS.get(c, "long")]) for c in _COLUMNS])


def paths(turns: DataFrame) -> DataFrame:
    """(conv_id, keys, words): each conversation's turns in order, 16 + 8 bytes a turn, without its texts.

    Range partitions write what they hold of a conversation as one piece; the pieces are put together by their order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("n"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("key")]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, conv, keys, words = TaskContext.get().partitionId(), None, [], []
        for batch in batches:
            out: list[tuple] = []
            for own, key, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if own != conv:
                    if keys:
                        out.append((conv, part, b"".join(keys), np.array(words, "<i8").tobytes()))
                    conv, keys, words = own, [], []
                keys.append(key)
                words.append(n)
            yield _pieces(out)
        if keys:
            yield _pieces([(conv, part, b"".join(keys), np.array(words, "<i8").tobytes())])

    pieces = (rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "key", "n")
              .mapInArrow(write, "conv_id long, part int, keys binary, words binary"))
    held = F.array_sort(F.collect_list(F.struct("part", "keys", "words")))
    joined = pieces.groupBy("conv_id").agg(held.alias("held"))

    def whole(field: str):
        return F.aggregate("held", F.lit(b""), lambda acc, x: F.concat(acc, x[field])).alias(field)

    return joined.select("conv_id", whole("keys"), whole("words"))


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    conv, part, keys, words = zip(*rows, strict=True) if rows else ((),) * 4
    return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(part, pa.int32()), pa.array(keys, pa.binary()), pa.array(words, pa.binary())], ["conv_id", "part", "keys", "words"])


def rebuilt(own: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """``paths`` with the first h turns taken from conversation ``c - c % every``; h is crc32 of c's decimals modulo ``most``.

    At most ``every`` conversations share a base, and at most ``most - 1`` turns of it travel."""
    base = own.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.substring("keys", 1, KEY * most).alias("head"), F.substring("words", 1, COUNT * most).alias("counts"))
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    rows = own.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(base, "base", "left")

    def spliced(head: str, tail: str, width: int):
        start = F.substring(F.coalesce(F.col(head), F.lit(b"")), F.lit(1), F.col("h") * width)
        return F.concat(start, F.substring(F.col(tail), F.col("h") * width + 1, F.lit((1 << 31) - 1))).alias(tail)

    return rows.select("conv_id", spliced("head", "keys", KEY), spliced("counts", "words", COUNT))


def end_digests(members: DataFrame) -> DataFrame:
    """(path, ends_sha256): SHA-256 of each path's sorted decimal conv_ids, hashed as they stream past in order.

    A digest is sequential, so the ids of a path (8 bytes each) pass through one task, which holds one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, running = None, None
        for batch in batches:
            done: list[tuple] = []
            for own, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own != path:
                    if running:
                        done.append((path, running.hexdigest()))
                    path, running = own, hashlib.sha256(str(conv).encode())
                else:
                    running.update(b",%d" % conv)
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], ["path", "ends_sha256"])
        if running:
            yield pa.RecordBatch.from_arrays([pa.array([path], pa.binary()), pa.array([running.hexdigest()], pa.string())], ["path", "ends_sha256"])

    return members.repartition("path").sortWithinPartitions("path", "conv_id").mapInArrow(run, "path binary, ends_sha256 string")


def distinct_paths(walks: DataFrame) -> DataFrame:
    """(keys, words, n_ends, conv_id, ends_sha256) of every distinct path; copies are combined before the shuffle."""
    named = walks.withColumn("path", F.unhex(F.sha2("keys", 256)))
    once = named.groupBy("path").agg(F.any_value("keys").alias("keys"), F.any_value("words").alias("words"), F.count(F.lit(1)).alias("n_ends"), F.min("conv_id").alias("conv_id"))
    return once.join(end_digests(named.select("path", "conv_id")), "path").drop("path")


def sharded(distinct: DataFrame) -> DataFrame:
    """(shard, kind, keys, ...): paths (kind 1) in ranges of the sorted order, with the neighbours' nearest paths (kinds 0 and 2).

    One row per shard, its two outermost paths, passes through the window that finds the neighbours."""
    ranged = stored(distinct.repartitionByRange("keys").withColumn("shard", F.spark_partition_id()), "trie-shards")
    ends = ranged.groupBy("shard").agg(F.min("keys").alias("low"), F.max("keys").alias("high"))
    along = Window.orderBy("shard")
    ends = ends.select("shard", F.lag("high").over(along).alias("before"), F.lead("low").over(along).alias("after"))
    none = {c: F.lit(None).cast(ranged.schema[c].dataType).alias(c) for c in ("words", "n_ends", "conv_id", "ends_sha256")}
    outer = [ends.where(F.col(c).isNotNull()).select("shard", F.lit(kind).alias("kind"), F.col(c).alias("keys"), *none.values()) for kind, c in ((0, "before"), (2, "after"))]
    return ranged.select("shard", F.lit(1).alias("kind"), "keys", *none).unionByName(outer[0]).unionByName(outer[1])


def encoded(shards: DataFrame, chunk_nodes: int = CHUNK_NODES) -> DataFrame:
    """Nodes of all shards; a node that several chunks share comes in parts (``node`` is not null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, before, chunk = None, None, Chunk()
        for batch in batches:
            for own, kind, *row in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if own != shard:
                    if chunk.rows:
                        yield chunk.solve(before, None)
                    shard, before, chunk = own, None, Chunk()
                if kind == 0:
                    before = row[0]
                elif kind == 2:
                    yield chunk.solve(before, row[0])
                    chunk = Chunk()
                else:
                    if chunk.nodes >= chunk_nodes:
                        yield chunk.solve(before, row[0])
                        before, chunk = chunk.rows[-1][0], Chunk()
                    chunk.add(tuple(row))
        if chunk.rows:
            yield chunk.solve(before, None)

    ordered = shards.repartition("shard").sortWithinPartitions("shard", "kind", "keys")
    return ordered.select("shard", "kind", "keys", "words", "n_ends", "conv_id", "ends_sha256").mapInArrow(run, _NODES_SQL)


def trie(walks: DataFrame, chunk_nodes: int = CHUNK_NODES) -> DataFrame:
    """One row per node of the trie over (conv_id, keys, words); no walks, no rows.

    conv_id is the smallest member, n_convs counts members, n_leaves the childless nodes of the subtree,
    saved_tokens the words that its nodes' further members need not store again."""
    prepare(walks.sparkSession)
    nodes = stored(encoded(sharded(distinct_paths(walks)), chunk_nodes), "trie-nodes")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = stored(nodes.where("node is not null").groupBy("node").agg(
        F.max("above").alias("above"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), *sums, F.max("ends_sha256").alias("ends_sha256")), "trie-spines")
    rows = nodes.where("node is null").drop("node").unionByName(merged.drop("node").withColumn("parent_conv_id", F.lit(None).cast("long")))
    least = merged.select(F.col("node").alias("above"), F.col("conv_id").alias("__least"))
    done = rows.where("above is null").select("*", F.lit(None).cast("long").alias("__least")).unionByName(small_join(rows.where("above is not null"), least, ["above"]).select(*rows.columns, "__least"))
    return done.select("conv_id", "depth", F.coalesce("parent_conv_id", "__least").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
                       F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))


def rebuilt_trie(turns: DataFrame) -> DataFrame:
    """Trie of all conversations of ``turns`` after they are rebuilt by the contract's rule.

    Turns are taken by ``turn`` (nulls first), those of one turn by role, then by the MD5 of role and text; null
    roles and texts are empty; rows without a conv_id belong to no conversation and are left out; repeated
    rows are turns of their own; other columns are ignored; an empty table gives no rows."""
    prepare(turns.sparkSession)
    own = stored(paths(turns), "paths")
    return trie(stored(rebuilt(own), "rebuilt-paths"))
