"""Operator 8: exact Jaccard self-join of word 5-grams, by universe partition and pigeonhole.

Sets. A document's set is the hashes of its distinct 5-word shingles (64 bits; for n sets
of s members the chance that any two members collide within a compared pair is about
s^2 / 2^64). Equal sets form one class; from here on there are only classes.

Signatures. Sizes fall into bands [2^c, 2^(c+1)). A band's scheme hashes the universe of
tokens into segments; a set's subset in a segment is summed into one signature. Two linked
sets r, s with |r| <= |s| differ in at most H = floor(|r| / 4) tokens, so when r weighs its
segments (1: equal subsets count as a match; 2: subsets within one deletion count too) to
at least H + 1, one weighted segment must match. Every set emits the signatures of its
non-empty segments, up to a position that depends on its size, and for a few segments also
those of its one-deletion neighbours; a set near the lower end of its band emits them for
the band below as well.

Light sets. When the tokens of a set crowd into few segments, its weight can stay under
H + 1 whatever it emits. Small sets therefore also emit their first floor(n / 5) + 1 tokens
in hash order: two linked sets always share one of these (prefix filter). Only light sets
probe them. Larger sets emit so many segments that a light one is not to be expected; if one
comes up all the same, the index is built again with the prefixes of sets of its size.

Cost-based allocation. Segments add up to a little more than H + 1; a set spends that
slack by not probing its most expensive signatures, those shared by the most classes. So
a passage that thousands of otherwise different documents share costs nothing, and no
pair is lost.

Links. Only connectivity is asked for, so classes that share signatures are first compared
with a hub (the class that shares most); what that connects needs no further comparison.
What remains between different components is compared exactly: pairs where few classes
share a signature; where many do (a family of near copies), the members that probe, or
those outside the family's largest component, are compared with all members, in blocks of
bounded size, of which only linking edges come back. Hubs, blocks and slack change the cost only: the
components are those of all links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pickwise.functions.components import component_labels
from pickwise.llm.common import MIX_A, folded, mix64, prepare, small_join, stored, tidy, window_hashes, word_hashes

SHINGLE = 5
#: Similarity 100 * |r & s| >= 80 * |r | s|.
NUM, DEN = 80, 100
FLAG_BITS = np.uint64(0x7F)
LOCAL_HOT = 32          # classes of one signature in one chunk that travel apart
FEW = 32                # classes of a signature compared pair by pair; beyond, in blocks
BLOCK = 512             # classes of a block
CHUNK = 1 << 20         # signatures gathered before they are sent
SMALL = 64              # light sets up to this size are linked by their prefixes
PREFIX_BAND = 63        # stands in a signature's flags for a prefix token; no set has 2^63 tokens
SPREADS = 6.5           # standard deviations of its weight that a set emits beyond the weight it needs


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text; empty without words."""
    return np.unique(window_hashes(word_hashes(folded(text))[0], SHINGLE))


def set_key(tokens: np.ndarray) -> int:
    """Signed 64-bit key of a set."""
    with np.errstate(over="ignore"):
        total = np.add.reduce(mix64(tokens ^ MIX_A)) if len(tokens) else np.uint64(0)
        return int(mix64(np.array([total + np.uint64(len(tokens)) * MIX_A]))[0].astype(np.int64))


@lru_cache(maxsize=64)
def scheme(band: int) -> tuple[int, int, np.ndarray]:
    """(segments, segments with deletions, positions that a set of size 2^band + i emits)."""
    low, high = 1 << band, 1 << (band + 1)
    m = max(1, int(0.6 * low) + 2)
    size = np.arange(low, min(high, low + (1 << 16)) if high - low > 1 << 16 else high, max(1, (high - low) >> 16))
    need, empty = size // 4 + 1, np.exp(-size / m)
    filled = 1 - empty
    spread = np.sqrt(np.maximum(0, need / filled * empty * (1 - empty * (1 + size / m * need / filled / m))))
    want = np.ceil(np.maximum(1.15 * need, need + SPREADS * spread) / filled).astype(np.int64) + 1
    return m, min(m, 2 + m // 40), np.minimum(m, np.maximum.accumulate(want))


def cutoff(band: int, size: int) -> int:
    """Positions that a set of ``size`` emits under the scheme of ``band``; never fewer for a larger set."""
    _, _, steps = scheme(band)
    low = 1 << band
    inside = min(size, 2 * low - 1) - low
    return int(steps[min(len(steps) - 1, inside * len(steps) // low)])


def signatures(tokens: np.ndarray, band: int, deletions: bool = True) -> tuple[np.ndarray, int]:
    """(signatures, weight) of a set under a band's scheme."""
    m, deletable, _ = scheme(band)
    with np.errstate(over="ignore"):
        seed = np.uint64((band + 1) * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)
        spot = (mix64(tokens ^ seed) >> np.uint64(16)) % np.uint64(m)
        used = spot < np.uint64(cutoff(band, len(tokens)))
        spot, value = spot[used], mix64((tokens[used] + seed) * MIX_A)
        order = np.argsort(spot, kind="stable")
        spot, value = spot[order], value[order]
        if not len(spot):
            return np.empty(0, np.uint64), 0
        starts = np.flatnonzero(np.concatenate([[True], spot[1:] != spot[:-1]]))
        sums = np.add.reduceat(value, starts)
        sizes = np.diff(np.append(starts, len(spot)))
        place = spot[starts]
        double = (place < deletable) & (sizes >= 2)
        weight = len(starts) + int(double.sum())
        flag = (np.uint64(band) << np.uint64(1)) | (place < deletable).astype(np.uint64)
        out = [(_seal(sums, place, seed) & ~FLAG_BITS) | flag]
        if double.any():
            each = np.repeat(double, sizes)
            owner = np.repeat(np.arange(len(starts)), sizes)[each]
            out.append((_seal(sums[owner] - value[each], place[owner], seed) & ~FLAG_BITS) | flag[owner])
        return np.concatenate(out), weight


def prefix(tokens: np.ndarray) -> np.ndarray:
    """Signatures of a set's first tokens in hash order: any two linked sets share one of them."""
    with np.errstate(over="ignore"):
        return (mix64(tokens[:len(tokens) // 5 + 1] * MIX_A) & ~FLAG_BITS) | np.uint64(PREFIX_BAND << 1)


def _seal(sums: np.ndarray, place: np.ndarray, seed: np.uint64) -> np.ndarray:
    return mix64(sums ^ mix64((place + np.uint64(1)) * MIX_A + seed))


def _bands(size: int) -> list[int]:
    """Own band, then the band below if a set there can be similar."""
    own = size.bit_length() - 1
    return [own, own - 1] if own and 4 * size <= 5 * ((1 << own) - 1) else [own]


class _Gather:
    """Signatures of many sets, cut into chunks and dealt into buckets."""

    def __init__(self, buckets: int):
        self.buckets, self.sigs, self.owners, self.size = buckets, [], [], 0

    def add(self, sigs: np.ndarray, owner: int) -> None:
        self.sigs.append(sigs)
        self.owners.append(np.full(len(sigs), owner, np.int64))
        self.size += len(sigs)

    def flush(self) -> list[tuple[int, bool, bytes]]:
        """(bucket, hot, packed rows): distinct pairs; a signature with many classes here leaves one of them
        in its bucket and sends all of them straight on."""
        if not self.size:
            return []
        sig, own = np.concatenate(self.sigs), np.concatenate(self.owners)
        self.sigs, self.owners, self.size = [], [], 0
        sig, own, starts = _grouped(sig, own)
        sizes = np.diff(np.append(starts, len(sig)))
        crowded = np.repeat(sizes > LOCAL_HOT, sizes)
        first = np.zeros(len(sig), bool)
        first[starts] = True
        out = []
        for hot, rows in ((False, ~crowded | first), (True, crowded)):
            s, o = sig[rows], own[rows]
            bucket = ((s >> np.uint64(8)) % np.uint64(self.buckets)).astype(np.int64) if not hot else (np.arange(len(s)) // 4096 + int(s[0] % 997) if len(s) else np.empty(0, np.int64)) % self.buckets
            order = np.argsort(bucket, kind="stable")
            s, o, bucket = s[order], o[order], bucket[order]
            cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(s) else []
            for i, at in enumerate(cuts):
                to = cuts[i + 1] if i + 1 < len(cuts) else len(s)
                out.append((int(bucket[at]), hot, np.stack([s[at:to].view(np.int64), o[at:to]]).tobytes()))
        return out


def _grouped(sig: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (signature, owner) in order, and where each signature starts."""
    order = np.lexsort((own, sig))
    sig, own = sig[order], own[order]
    fresh = np.ones(len(sig), bool)
    fresh[1:] = (sig[1:] != sig[:-1]) | (own[1:] != own[:-1])
    sig, own = sig[fresh], own[fresh]
    return sig, own, np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.empty(0, np.int64)


_SENT = pa.schema([("bucket", pa.int32()), ("hot", pa.bool_()), ("data", pa.binary()), ("rk", pa.int64()), ("id", pa.int64()),
                   ("n", pa.int64()), ("cls", pa.int64()), ("slack", pa.int64())])
_MADE = pa.schema([("kind", pa.int32()), ("sig", pa.int64()), ("cls", pa.int64()), ("rk", pa.int64()), ("id", pa.int64()), ("n", pa.int64()),
                   ("slack", pa.int64())])
_SENT_SQL = "bucket int, hot boolean, data binary, rk long, id long, n long, cls long, slack long"
_MADE_SQL = "kind int, sig long, cls long, rk long, id long, n long, slack long"


def keyed_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rk, id, text): ``rk`` stands for id and text together."""
    return docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("rk"), F.col(id_col).cast("long").alias("id"),
                       F.col(text_col).cast("string").alias("text"))


def bucket_count(rows: DataFrame, per_bucket: int = 4_000_000, least: int = 64) -> int:
    """Buckets for what a table's texts send: one for so many bytes of text, so that a bucket's rows stay a few MB."""
    volume = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(least, int(volume // per_bucket))


def whole_index(rows: DataFrame, small: int = SMALL) -> tuple[DataFrame, DataFrame]:
    """``index`` with the prefixes of sets as large as the largest light one."""
    buckets = bucket_count(rows)
    documents, shared = index(rows, buckets, small)
    light = documents.where("slack < 0").agg(F.max("n")).first()[0] or 0
    return (documents, shared) if light <= small else index(rows, buckets, light)


def index(rows: DataFrame, buckets: int, small: int = SMALL) -> tuple[DataFrame, DataFrame]:
    """(documents, shared): per document id, n, cls, slack; and (sig, cls) of signatures with two classes or more.

    Light sets of up to ``small`` tokens meet every set they can be linked with by a prefix."""

    @tidy
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather = _Gather(buckets)
        for batch in batches:
            info: list[tuple] = []
            for rk, ident, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                tokens = shingle_set(value.as_py())
                n, slack, key = len(tokens), 0, set_key(tokens)
                for i, band in enumerate(_bands(n) if n else ()):
                    sigs, weight = signatures(tokens, band)
                    gather.add(sigs, key)
                    if i == 0:
                        slack = weight - (n // 4 + 1)
                if n and 4 * n <= 5 * small:
                    gather.add(prefix(tokens), key)
                info.append((rk % buckets, rk, ident, n, key, slack))
                if gather.size >= CHUNK:
                    yield from _packed(gather.flush())
            if info:
                bucket, rks, ids, sizes, keys, slacks = zip(*info, strict=True)
                blank = pa.nulls(len(info))
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), blank.cast(pa.bool_()), blank.cast(pa.binary()), pa.array(rks, pa.int64()),
                                                  pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(slacks, pa.int64())],
                                                 schema=_SENT)
        yield from _packed(gather.flush())

    def receive(table: pa.Table) -> pa.Table:
        out = []
        info = table.filter(pa.compute.is_valid(table["rk"]))
        if len(info):
            none = pa.nulls(len(info), pa.int64())
            out.append(pa.Table.from_arrays([pa.array(np.full(len(info), 1, np.int32)), none, *(info[c].combine_chunks() for c in ("cls", "rk", "id", "n", "slack"))], schema=_MADE))
        for rows in _shared_rows(table):
            none = pa.nulls(rows.shape[1], pa.int64())
            out.append(pa.Table.from_arrays([pa.array(np.zeros(len(none), np.int32)), pa.array(rows[0]), pa.array(rows[1]), none, none, none, none], schema=_MADE))
        return pa.concat_tables(out) if out else _MADE.empty_table()

    made = stored(rows.mapInArrow(send, _SENT_SQL).groupBy("bucket").applyInArrow(receive, _MADE_SQL), "signatures", "kind")
    return (made.where("kind = 1").select("rk", "id", "n", "cls", "slack"),
            stored(made.where("kind = 0").select("sig", "cls").distinct(), "shared"))


def _packed(rows: list[tuple[int, bool, bytes]]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 256):
        bucket, hot, data = zip(*rows[i:i + 256], strict=True)
        none = pa.nulls(len(bucket), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(hot, pa.bool_()), pa.array(data, pa.binary()), none, none, none, none, none], schema=_SENT)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * both >= NUM * (len(a) + len(b) - both)


def sets_of(rows: DataFrame, classes: DataFrame, wanted: DataFrame, cut=None) -> DataFrame:
    """(cls, tokens) of the classes in ``wanted`` (a stored table of distinct ``cls``), from one row each.

    ``cut(text)`` yields the sets of a row's text; by default its one shingle set."""
    needed = stored(wanted.join(classes, "cls").groupBy(F.col("rep").alias("rk")).agg(F.collect_set("cls").alias("of")), "needed")
    texts = small_join(rows.select("rk", "text"), needed, ["rk"], most=500_000)
    cut = cut or _whole

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at_text, at_of = batch.schema.names.index("text"), batch.schema.names.index("of")
            keys, sets = [], []
            for value, of in zip(batch.column(at_text), batch.column(at_of).to_pylist(), strict=True):
                left = set(of)
                for tokens in cut(value.as_py()):
                    key = set_key(tokens)
                    if key in left:
                        left.remove(key)
                        keys.append(key)
                        sets.append(tokens.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.binary())], names=["cls", "tokens"])

    return texts.mapInArrow(run, "cls long, tokens binary").dropDuplicates(["cls"])


def _whole(text: str | None) -> list[np.ndarray]:
    return [shingle_set(text)]


def verified(pairs: DataFrame, rows: DataFrame, classes: DataFrame, cut=None) -> DataFrame:
    """Those of the stored pairs (a, b) that are linked, by exact intersection."""
    wanted = stored(pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct(), "wanted")
    sets = sets_of(rows, classes, wanted, cut)
    with_b = pairs.join(sets.select(F.col("cls").alias("b"), F.col("tokens").alias("tb")), "b")
    with_both = with_b.join(sets.select(F.col("cls").alias("a"), F.col("tokens").alias("ta")), "a").select("a", "b", "ta", "tb")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64))
                    for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return stored(with_both.mapInArrow(run, "a long, b long"), "verified")


def allocate(weighted: DataFrame, classes: DataFrame, banded: bool = False) -> tuple[DataFrame, DataFrame]:
    """(members, probes): the (sig, cls) that each class still probes after its allocation, and all classes of those signatures.

    A class gives up its most shared signatures as far as its slack goes; a light one (slack
    under 0) probes all it has and its prefix. members:
    (sig, cls, g, n, slack); probes: (sig, cls). ``banded``: signatures without a scheme,
    every member probes."""
    sized = stored(weighted.join(classes.select("cls", "n", "slack"), "cls"), "sized")
    if banded:
        return sized, sized.select("sig", "cls")
    band = F.shiftright("sig", 1).bitwiseAND(F.lit(63))
    own = sized.where((band == F.floor(F.log2("n") + 1e-9)) | ((band == PREFIX_BAND) & (F.col("slack") < 0)))
    price = F.when(F.col("sig").bitwiseAND(F.lit(1)) == 1, 2).otherwise(1)
    spent = F.sum(price).over(Window.partitionBy("cls").orderBy(F.desc("g"), "sig").rowsBetween(Window.unboundedPreceding, 0))
    probes = stored(own.withColumn("spent", spent).where("spent > slack").select("sig", "cls"), "probes")
    active = stored(probes.select("sig").distinct(), "active")
    return stored(small_join(sized, active, ["sig"]), "members"), probes


def hub_pairs(members: DataFrame) -> DataFrame:
    """One pair (hub, class) per class at most: the hub that shares most signatures with it.

    A signature's hub is its class that shares most in all. Pairs whose sizes exclude a link,
    or that share far too little for one, are left to the exact step."""
    score = members.groupBy("cls").agg(F.sum("g").alias("score"))
    hubs = stored(members.select("sig", "cls", "n").join(score, "cls").groupBy("sig").agg(
        F.max_by(F.struct(F.col("cls").alias("hub"), F.col("n").alias("hn")), "score").alias("h")).select("sig", "h.hub", "h.hn"), "hubs")
    near = small_join(members, hubs, ["sig"]).where((F.col("hub") != F.col("cls")) & (DEN * F.least("n", "hn") >= NUM * F.greatest("n", "hn")))
    votes = near.groupBy("hub", "cls").agg(F.count(F.lit(1)).alias("votes"), F.max("slack").alias("slack")).where(2 * F.col("votes") > F.col("slack"))
    return votes.groupBy("cls").agg(F.max_by("hub", "votes").alias("hub")).select(F.least("hub", "cls").alias("a"), F.greatest("hub", "cls").alias("b")).distinct()


def still_open(members: DataFrame, probes: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members and probes of the signatures that still join different components, with ``comp``."""
    named = stored(members.join(labels, members["cls"] == labels["node"], "left").select("sig", "cls", "g", "n", F.coalesce("component", "cls").alias("comp")), "named")
    mixed = stored(named.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("sig"), "mixed")
    left = stored(small_join(named, mixed, ["sig"]), "open")
    return left, left.join(probes, ["sig", "cls"], "left_semi")


def few_pairs(members: DataFrame, probes: DataFrame) -> DataFrame:
    """Pairs of different components where few classes share the signature: the probe is the smaller set."""
    r = probes.where(F.col("g") <= FEW).select("sig", F.col("cls").alias("r"), F.col("n").alias("rn"), F.col("comp").alias("rc"))
    s = members.where(F.col("g") <= FEW).select("sig", F.col("cls").alias("s"), F.col("n").alias("sn"), F.col("comp").alias("sc"))
    fits = (F.col("rc") != F.col("sc")) & (F.col("rn") <= F.col("sn")) & (DEN * F.col("rn") >= NUM * F.col("sn"))
    return r.join(s, "sig").where(fits).select(F.least("r", "s").alias("a"), F.greatest("r", "s").alias("b")).distinct()


def family_links(members: DataFrame, probes: DataFrame, rows: DataFrame, classes: DataFrame, cut=None) -> DataFrame | None:
    """Links of crowded signatures, inside families (classes tied together by them).

    Only classes that have enough of their tokens in common with others at all are kept. Of
    a family, either its probing classes or those outside its largest component, whichever
    are fewer, meet all of it: every link that could join two components has such an end."""
    crowded = stored(probes.where(F.col("g") > FEW).select("sig").distinct(), "crowded")
    if crowded.isEmpty():
        return None
    inside = stored(small_join(members, crowded, ["sig"]).select("sig", "cls", "comp", "n"), "inside")
    asking = small_join(probes.where(F.col("g") > FEW), crowded, ["sig"]).select("cls").distinct().withColumn("asks", F.lit(True))
    rich = _rich_classes(inside, rows, classes, cut)
    kept = stored(inside.join(rich, "cls"), "kept")
    tops = stored(kept.groupBy("sig").agg(F.min("cls").alias("top")), "tops")
    ties = small_join(kept.select("sig", "cls"), tops, ["sig"]).select(F.col("top").alias("a"), F.col("cls").alias("b")).where("a <> b")
    family = component_labels(ties).select(F.col("node").alias("cls"), F.col("component").alias("family"))
    placed = stored(kept.select("cls", "comp").distinct().join(family, "cls").join(asking, "cls", "left")
                    .select("cls", "comp", "family", F.coalesce("asks", F.lit(False)).alias("asks")), "placed")
    sizes = placed.groupBy("family", "comp").agg(F.count(F.lit(1)).alias("k"), F.count_if("asks").alias("asking"))
    plan = stored(sizes.groupBy("family").agg(F.max_by("comp", "k").alias("main"), F.max("k").alias("most"), F.sum("k").alias("size"), F.sum("asking").alias("asking"))
                  .withColumn("by_asking", F.col("asking") < F.col("size") - F.col("most"))
                  .withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
                  .withColumn("slices", F.ceil(F.greatest(F.least("asking", F.col("size") - F.col("most")), F.lit(1)) / (4 * BLOCK)).cast("int")), "plan")
    spread = stored(small_join(placed, plan.where("size > most and asking > 0"), ["family"]), "spread")
    full = spread.join(sets_of(rows, classes, stored(spread.select("cls").distinct(), "wanted"), cut), "cls")
    home = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    held = full.select("family", home.alias("block"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(False).alias("probe"), "cls", "comp", "tokens")
    sent = full.where(F.when(F.col("by_asking"), F.col("asks")).otherwise(F.col("comp") != F.col("main"))).select(
        "family", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("cls", F.lit(7)), F.col("slices")).cast("int").alias("slice"),
        F.lit(True).alias("probe"), "cls", "comp", "tokens")
    return stored(held.unionByName(sent).groupBy("family", "block", "slice").applyInArrow(_block_links, "a long, b long"), "family-links")


def _rich_classes(inside: DataFrame, rows: DataFrame, classes: DataFrame, cut=None) -> DataFrame:
    """Classes of which enough tokens occur in another class too: a link needs 0.8 of either set in common.

    Tokens are packed into buckets as signatures are; a bucket returns one count per class."""
    wanted = stored(inside.select("cls", "n").distinct(), "wanted")
    total = wanted.agg(F.sum("n")).first()[0] or 0
    buckets = max(4, int(16 * total // 12_000_000))

    @tidy
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather = _Gather(buckets)
        for batch in batches:
            for cls, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                gather.add(np.frombuffer(value.as_buffer(), np.uint64), cls)
                if gather.size >= CHUNK:
                    yield from _boxed(gather.flush())
        yield from _boxed(gather.flush())

    def count(table: pa.Table) -> pa.Table:
        owners = [rows[1] for rows in _shared_rows(table)]
        cls, k = np.unique(np.concatenate(owners), return_counts=True) if owners else (np.empty(0, np.int64), np.empty(0, np.int64))
        return pa.table({"cls": pa.array(cls, pa.int64()), "k": pa.array(k, pa.int64())})

    sets = sets_of(rows, classes, wanted.select("cls"), cut)
    counted = sets.mapInArrow(send, "bucket int, hot boolean, data binary").groupBy("bucket").applyInArrow(count, "cls long, k long")
    # a token crowded in one task is counted once more for the class that stands for it there: k may be too high, never too low
    return counted.groupBy("cls").agg(F.sum("k").alias("k")).join(classes.select("cls", "n"), "cls").where(DEN * F.col("k") >= NUM * F.col("n")).select("cls")


def _boxed(rows: list[tuple[int, bool, bytes]]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 256):
        bucket, hot, data = zip(*rows[i:i + 256], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(hot, pa.bool_()), pa.array(data, pa.binary())], names=["bucket", "hot", "data"])


def _shared_rows(table: pa.Table) -> list[np.ndarray]:
    """(2, rows) arrays of key and owner: of keys that two owners share, and of keys that were crowded in a task."""
    plain, hot, out = [], [], []
    for data, is_hot in zip(table["data"], table["hot"], strict=True):
        if data.is_valid:
            (hot if is_hot.as_py() else plain).append(np.frombuffer(data.as_buffer(), np.int64).reshape(2, -1))
    for parts, least in ((plain, 2), (hot, 1)):
        if parts:
            both = np.concatenate(parts, axis=1)
            sig, own, starts = _grouped(both[0].view(np.uint64), both[1])
            sizes = np.diff(np.append(starts, len(sig)))
            keep = np.repeat(sizes >= least, sizes)
            if keep.any():
                out.append(np.stack([sig[keep].view(np.int64), own[keep]]))
    return out


def _block_links(table: pa.Table) -> pa.Table:
    """Links between a block's members and its probes: per probe and component one edge."""
    probe = table["probe"].to_numpy(zero_copy_only=False).astype(bool)
    cls, comp = table["cls"].to_numpy(), table["comp"].to_numpy()
    sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in table["tokens"]]
    home = np.flatnonzero(~probe)
    a: list[int] = []
    b: list[int] = []
    if len(home):
        sizes = np.array([len(sets[i]) for i in home])
        tokens = np.concatenate([sets[i] for i in home])
        owner = np.repeat(np.arange(len(home)), sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        for p in np.flatnonzero(probe):
            own = sets[p]
            lo, hi = np.searchsorted(tokens, own, "left"), np.searchsorted(tokens, own, "right")
            runs = hi - lo
            total = int(runs.sum())
            if not total:
                continue
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(runs)[:-1]]), runs) + np.arange(total)
            both = np.bincount(owner[at], minlength=len(home))
            ok = (DEN * both >= NUM * (sizes + len(own) - both)) & (comp[home] != comp[p])
            if ok.any():
                _, one = np.unique(comp[home[ok]], return_index=True)
                a.extend([int(cls[p])] * len(one))
                b.extend(cls[home[ok][one]].tolist())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def linked_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id): the least id reachable by links of similarity 0.8 or more.

    One row per row of ``docs``. Null, empty and wordless texts have 0 shingles and are linked
    with nothing, equal texts included; their component is their own id. Fewer than five
    words make one shingle. Rows that repeat an id with other texts join that id's
    components; a null id never becomes a component's name unless nothing else is there. An
    empty table gives an empty table."""
    spark = docs.sparkSession
    prepare(spark)
    rows = keyed_rows(docs, id_col, text_col)
    documents, shared = whole_index(rows)
    classes = stored(documents.where("n > 0").groupBy("cls").agg(F.min("rk").alias("rep"), F.max("n").alias("n"), F.max("slack").alias("slack"),
                                                                F.min("id").alias("least")), "classes")
    edges = class_links(rows, classes, shared)
    labels = component_labels(edges)
    named = classes.join(labels, classes["cls"] == labels["node"], "left").select("cls", "least", F.coalesce("component", "cls").alias("comp"))
    names = named.groupBy("comp").agg(F.min("least").alias("name"))
    of_class = stored(named.join(names, "comp").select("cls", "name"), "names")
    out = small_join(documents, of_class, ["cls"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                      F.when(F.col("n") > 0, F.col("name")).otherwise(F.col("id")).alias("component_id"))


def class_links(rows: DataFrame, classes: DataFrame, shared: DataFrame, cut=None, banded: bool = False) -> DataFrame:
    """Edges (a, b) between classes whose components are those of all links among classes that share signatures."""
    crowd = stored(shared.groupBy("sig").agg(F.count(F.lit(1)).alias("g")).where("g > 1"), "crowd")
    members, probes = allocate(small_join(shared, crowd, ["sig"]), classes, banded)
    edges = verified(stored(hub_pairs(members), "hub-pairs"), rows, classes, cut)
    left, open_probes = still_open(members, probes, component_labels(edges))
    open_probes = stored(open_probes, "open-probes")
    found = edges.unionByName(verified(stored(few_pairs(left, open_probes), "few-pairs"), rows, classes, cut))
    families = family_links(left, open_probes, rows, classes, cut)
    return found if families is None else found.unionByName(families)
