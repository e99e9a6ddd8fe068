"""Exact k-nearest-neighbour and range joins over a pivot tree.

Tree. The train vectors of a node choose pivots among themselves (those with the smallest hashes,
about one for LEAF / 2 members, FAN at most); every member goes to the child of its nearest pivot. A child is known by
its pivot, its number of members and its radius, the largest distance of a member to the pivot.
Children of more than LEAF members are nodes of the next level, so the depth grows with the logarithm of
the table while a cell stays as small as it is.

Search. A point carries a bound: its range, or the distance within which k members of the nearest
cell lie. Level by level it goes to the children with d(point, pivot) - radius <= bound, and meets
the members of the cells that it ends in. So the number of candidates follows the number of
cells that the bound reaches, which the structure of the data decides and not their number.
On vectors of high dimension without clusters the triangle inequality rules out little and the join
approaches all pairs; no exact method avoids that. Where a hashed part of the points reaches over WIDE of the
members, points and members meet by tiles instead (:func:`all_pairs`), which copies a row once per tile and
not once per cell; the result is the same.

Tasks. The nodes of a level travel to all tasks while their bytes are counted to be few; beyond
that, rows and nodes are grouped by node. Points and members meet by cell, at most POINTS
points and CHUNK members at a time: a cell that very many points reach is copied to
several tasks, and a cell that could not be split (members at equal distances) is cut into pieces.
Distances are first taken as matrix products of BLOCK numbers at a time, with a bound on their rounding error; only pairs
that this leaves in question are computed again coordinate by coordinate, as SQL would.

The same holds for any metric; here euclidean distance, the angle (euclidean distance of unit
vectors, reported as 1 - cos) and the sum of two euclidean parts (means and covariances).

Identical train vectors are first reduced to the k with the lowest ids (only those can be
among the k nearest), and identical test vectors are solved once. Ties go to the lower id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pickwise.functions.joins import written
from pickwise.functions.keyed import Step, with_record
from pickwise.functions.topk import group_topk
from pickwise.session import ensure_checkpoint_dir, ship_package

LEAF = 512              # members of a cell that is not split
FAN = 512               # pivots of a node at most
CHUNK = 2_048           # members of a piece of a cell that cannot be split
POINTS = 4_096          # points that meet the members of a cell in one task
SLICE = 512             # rows that meet the pivots of a node at a time
BLOCK = 1 << 19         # distances that a task holds at a time
WIDE = 0.125            # share of all pairs beyond which points and members meet by tiles
WIDE_PAIRS = 1 << 24    # fewer pairs than this always go through the tree
TILES = 64              # pairs of tiles at least, and
TILE_ROWS = 32_768      # rows of a tile at most
NODE_BYTES = 32 << 20   # bytes of a level's pivots that are sent to all tasks
ROUNDING = 1e-12        # of the squared norms: more than a matrix product of doubles loses


def _norm(v):
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def normalise(v):
    n = _norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


@dataclass(frozen=True)
class Metric:
    """euclidean, cosine, or sum: two euclidean parts, the first ``head`` coordinates and the rest."""
    name: str = "euclidean"
    head: int = 0

    def space(self, v):
        """The vector (column) in which the triangle inequality holds."""
        return normalise(v) if self.name == "cosine" else v

    def flat(self, x: np.ndarray) -> np.ndarray:
        """The same for the rows of a matrix."""
        return x / np.sqrt((x * x).sum(1, keepdims=True)) if self.name == "cosine" else x

    def _parts(self) -> list[slice]:
        return [slice(0, self.head), slice(self.head, None)] if self.name == "sum" else [slice(None)]

    def bounds(self, x: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, rows) bounds from below and above of the distances in that space."""
        low, high = np.zeros((len(x), len(p))), np.zeros((len(x), len(p)))
        for s in self._parts():
            a, b = x[:, s], p[:, s]
            size = (a * a).sum(1)[:, None] + (b * b).sum(1)[None]
            square = np.maximum(size - 2 * a @ b.T, 0)
            low += np.sqrt(np.maximum(square - ROUNDING * size, 0))
            high += np.sqrt(square + ROUNDING * size)
        return low, high

    def exact(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Reported distances of rows and rows, summed coordinate by coordinate as an SQL expression does."""
        if self.name == "cosine":
            dot, one, two = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
            for j in range(a.shape[1]):
                dot += a[:, j] * b[:, j]
                one += a[:, j] * a[:, j]
                two += b[:, j] * b[:, j]
            return 1.0 - dot / (np.sqrt(one) * np.sqrt(two))
        out = np.zeros(len(a))
        for s in self._parts():
            total = np.zeros(len(a))
            for j in range(*s.indices(a.shape[1])):
                total += (a[:, j] - b[:, j]) * (a[:, j] - b[:, j])
            out = out + np.sqrt(total)
        return out


def matrix(column) -> np.ndarray:
    """(rows, coordinates) of an Arrow column of equally long lists."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = np.asarray(column.flatten().to_numpy(zero_copy_only=False), float)
    return values.reshape(len(column), -1) if len(column) else np.empty((0, 0))


@dataclass
class Node:
    """Pivots of a node and, once its members are assigned, its children."""
    pivots: np.ndarray
    count: np.ndarray = field(default_factory=lambda: np.empty(0, int))
    radius: np.ndarray = field(default_factory=lambda: np.empty(0))
    leaf: np.ndarray = field(default_factory=lambda: np.empty(0, bool))

    @staticmethod
    def of(pivots, kids, width: int) -> Node:
        node = Node(np.asarray(pivots, float).reshape(-1, width))
        n = len(node.pivots)
        node.count, node.radius, node.leaf = np.zeros(n, int), np.full(n, -np.inf), np.zeros(n, bool)
        for kid in kids or ():
            node.count[kid["child"]], node.radius[kid["child"]], node.leaf[kid["child"]] = kid["n"], kid["radius"], kid["leaf"]
        return node


def _by_node(rows: DataFrame, nodes: DataFrame, step: Step, schema: str) -> DataFrame:
    """``step(name, node, rows)`` for the rows of every node of ``nodes`` (node, width, pivots, kids); other rows go."""
    spread = "train_id" if "train_id" in rows.columns else "test_id"
    return with_record(rows, nodes, "node", F.size("pivots") + 8 * F.size("kids"), lambda r: Node.of(r["pivots"], r["kids"], r["width"]), step, schema, spread, NODE_BYTES, SLICE, SLICE)


def _schema(df: DataFrame, *more: str) -> str:
    return ", ".join([*(f"`{n}` {t}" for n, t in df.dtypes), *more])


class PivotTree:
    """Cells of the rows of (node, train_id, vec, lead); ``node`` names the root of each group, ``lead`` rows may be pivots."""

    def __init__(self, rows: DataFrame, metric: Metric, leaf: int = LEAF, fan: int = FAN):
        self.metric, self.levels, self.members = metric, [], None
        self.all = rows = written(rows, "members")
        self.rows = rows.count()
        while not rows.isEmpty():
            counts = rows.groupBy("node").agg(F.count(F.lit(1)).alias("__n"))
            wanted = F.least(F.lit(fan), F.ceil(2 * F.col("__n") / leaf).cast("int"))
            leads = rows.where("lead").join(counts.select("node", wanted.alias("__m")), "node")
            chosen = group_topk(leads, ["node"], [F.xxhash64("vec"), F.col("train_id")], F.col("__m"), salt_col="train_id", rank_col="__rk")
            vectors = F.transform(F.array_sort(F.collect_list(F.struct("__rk", "vec"))), lambda x: x["vec"])
            pivots = (chosen.groupBy("node").agg(F.max(F.size("vec")).alias("width"), F.flatten(vectors).alias("pivots"))
                      .withColumn("kids", F.array().cast("array<struct<child:int,n:bigint,radius:double,leaf:boolean>>")))
            pivots = written(pivots, "pivots")
            placed = written(_by_node(rows, pivots, self._assign(), _schema(rows, "child int", "__d double")), "placed")
            stats = placed.groupBy("node", "child").agg(F.count(F.lit(1)).alias("n"), F.max("__d").alias("radius"))
            # a child with nearly all members of its parent does not get smaller by splitting
            stats = written(stats.join(counts, "node").select("node", "child", "n", "radius", ((F.col("n") <= leaf) | (F.col("n") > 0.9 * F.col("__n"))).alias("leaf")), "children")
            kids = stats.groupBy("node").agg(F.collect_list(F.struct("child", "n", "radius", "leaf")).alias("kids"))
            self.levels.append(written(pivots.drop("kids").join(kids, "node"), "nodes"))
            named = placed.join(stats.select("node", "child", "leaf"), ["node", "child"]).withColumn("node", F.concat("node", F.lit("."), F.col("child")))
            cells = named.where("leaf").select(F.col("node").alias("cell"), "train_id", "vec")
            self.members = cells if self.members is None else self.members.unionByName(cells)
            rows = named.where("not leaf").select(*rows.columns)

    def _assign(self) -> Step:
        metric = self.metric

        def step(name: str, node: Node, table: pa.Table) -> pa.Table:
            _, high = metric.bounds(metric.flat(matrix(table["vec"])), metric.flat(node.pivots))
            near = high.argmin(1)
            return table.append_column("child", pa.array(near.astype(np.int32))).append_column("__d", pa.array(high[np.arange(len(near)), near]))

        return step

    def visits(self, points: DataFrame, choose) -> DataFrame:
        """(test_id, vec, bound, cell): ``choose(node, low, high, bounds)`` marks the children that each point goes to."""
        metric, found, at = self.metric, None, points.select("node", "test_id", "vec", "bound")
        for level in self.levels:

            def step(name: str, node: Node, table: pa.Table) -> pa.Table:
                low, high = metric.bounds(metric.flat(matrix(table["vec"])), metric.flat(node.pivots))
                bound = table["bound"].to_numpy()
                row, kid = np.nonzero(choose(node, low, high, np.where(np.isnan(bound), np.inf, bound)))
                out = table.take(pa.array(row))
                names = pa.array([f"{name}.{i}" for i in range(len(node.pivots))], pa.string()).take(pa.array(kid))
                return out.set_column(0, "node", names).append_column("leaf", pa.array(node.leaf[kid]))

            went = written(_by_node(at, level, step, _schema(at, "leaf boolean")), "visits")
            cells = went.where("leaf").select("test_id", "vec", "bound", F.col("node").alias("cell"))
            found = cells if found is None else found.unionByName(cells)
            at = went.where("not leaf").drop("leaf")
        return found

    def wide(self, points: DataFrame) -> bool:
        """Whether a hashed part of the points (node, test_id, vec, bound) reaches over WIDE of the members at the first level."""
        metric, n = self.metric, points.count()
        if n * self.rows <= WIDE_PAIRS:
            return False

        def step(name: str, node: Node, table: pa.Table) -> pa.Table:
            low, high = metric.bounds(metric.flat(matrix(table["vec"])), metric.flat(node.pivots))
            bound = table["bound"].to_numpy()
            met = (_reaching(node, low, high, np.where(np.isnan(bound), np.inf, bound)) * node.count).sum()
            return pa.table({"met": pa.array([float(met)]), "of": pa.array([float(len(table) * node.count.sum())])})

        some = points.where(F.pmod(F.xxhash64("test_id"), F.lit(max(1, n // 4_096))) == 0)
        met, of = _by_node(some, self.levels[0], step, "met double, of double").agg(F.sum("met"), F.sum("of")).first()
        return bool(of) and met > WIDE * of

    def meet(self, visits: DataFrame, evaluate, schema: str, members: DataFrame | None = None, more=(), piece: int | None = None) -> DataFrame:
        """``evaluate(points, members)`` on Arrow tables, for at most POINTS points of a cell and CHUNK members at a time
        (``piece`` of both if given). ``members``: those that take part, with further columns ``more``; else all."""
        members = self.members if members is None else members
        most_points, most_members = min(POINTS, piece or POINTS), min(CHUNK, piece or CHUNK)
        points = visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / most_points).cast("int").alias("__parts"))
        sizes = written(members.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / most_members).cast("int").alias("__chunks")).join(points, "cell"), "meetings")
        asked = visits.join(sizes, "cell").withColumns({"part": F.pmod(F.xxhash64("test_id"), F.col("__parts")), "chunk": F.explode(F.sequence(F.lit(0), F.col("__chunks") - 1))})
        told = members.join(sizes, "cell").withColumns({"chunk": F.pmod(F.xxhash64("train_id"), F.col("__chunks")), "part": F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))})
        keys = [F.col("cell"), F.col("part").cast("int").alias("part"), F.col("chunk").cast("int").alias("chunk")]
        left = asked.select(*keys, "test_id", "vec", "bound").groupBy("cell", "part", "chunk")
        right = told.select(*keys, "train_id", "vec", *more).groupBy("cell", "part", "chunk")
        return left.cogroup(right).applyInArrow(evaluate, schema)


def all_pairs(points: DataFrame, members: DataFrame, evaluate, schema: str, more=()) -> DataFrame:
    """``evaluate(points, members)`` for every two tiles of points (node, test_id, vec, bound) and members
    (node, train_id, vec, ``more``) of a node; a tile has TILE_ROWS rows at most, fewer while that gives less than TILES pairs."""
    n, m = (d.groupBy("node").agg(F.count(F.lit(1)).alias(c)) for d, c in ((points, "__n"), (members, "__m")))
    rows = F.least(F.lit(float(TILE_ROWS)), F.greatest(F.lit(256.0), F.sqrt(F.col("__n") * F.col("__m") / TILES)))
    sizes = n.join(m, "node").select("node", F.ceil(F.col("__n") / rows).cast("int").alias("__parts"), F.ceil(F.col("__m") / rows).cast("int").alias("__chunks"))
    sizes = written(sizes, "tiles")
    # equal ids may have different vectors, so the tile follows from both
    asked = points.join(sizes, "node").withColumns({"part": F.pmod(F.xxhash64("test_id", "vec"), F.col("__parts")), "chunk": F.explode(F.sequence(F.lit(0), F.col("__chunks") - 1))})
    told = members.join(sizes, "node").withColumns({"chunk": F.pmod(F.xxhash64("train_id", "vec"), F.col("__chunks")), "part": F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))})
    keys = [F.col("node"), F.col("part").cast("int").alias("part"), F.col("chunk").cast("int").alias("chunk")]
    left = asked.select(*keys, "test_id", "vec", "bound").groupBy("node", "part", "chunk")
    right = told.select(*keys, "train_id", "vec", *more).groupBy("node", "part", "chunk")
    return left.cogroup(right).applyInArrow(evaluate, schema)


def _nearest(k: int):
    """Children by distance of their pivots until they hold k members."""
    def choose(node: Node, low, high, bound):
        order = np.argsort(np.where(node.count > 0, low, np.inf), axis=1, kind="stable")
        before = np.cumsum(node.count[order], axis=1) - node.count[order]
        out = np.zeros(low.shape, bool)
        np.put_along_axis(out, order, (before < k) & (node.count[order] > 0), axis=1)
        return out
    return choose


def _reaching(node: Node, low, high, bound):
    """Children that can hold a member within the bound."""
    return (node.count > 0) & (low - node.radius <= bound[:, None] * (1 + 1e-12))


def _slices(n: int, m: int) -> Iterator[slice]:
    """Slices of n rows that each have BLOCK pairs with m members at most (or one row)."""
    step = max(1, BLOCK // max(1, m))
    return (slice(i, min(n, i + step)) for i in range(0, n, step))


def _exact(metric: Metric, a: np.ndarray, b: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Reported distances of the pairs, a part of them at a time."""
    return np.concatenate([metric.exact(a[row[i:i + 65536]], b[col[i:i + 65536]]) for i in range(0, len(row), 65536)] or [np.empty(0)])


def _squares(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by a matrix product, and by row a bound on their rounding error."""
    one, two = (a * a).sum(1), (b * b).sum(1)
    square = (-2 * a) @ b.T
    square += one[:, None]
    square += two
    return square, ROUNDING * (one + two.max())[:, None]


def _maybe(metric: Metric, a: np.ndarray, b: np.ndarray, bound: np.ndarray, k: int | None) -> np.ndarray:
    """Pairs that may lie within the bounds and, if ``k``, among the k nearest of their row."""
    limit = bound * (1 + 1e-12)
    if metric.name == "sum":
        low, high = metric.bounds(a, b)
        if k is not None and len(b) > k:
            limit = np.minimum(limit, np.partition(high, k - 1, axis=1)[:, k - 1] * (1 + 1e-12))
        return low <= limit[:, None]
    square, slack = _squares(a, b)
    limit = (limit * limit)[:, None] * (1 + 1e-12) + slack
    if k is not None and len(b) > k:
        limit = np.minimum(limit, np.partition(square, k - 1, axis=1)[:, k - 1:k] + 2 * slack)
    return square <= limit


def _bounds_of(metric: Metric, k: int):
    """(test_id, far): of each point, upper bounds of the distances to the k nearest members of the cell."""
    kind = pa.list_(pa.float64())

    def run(points: pa.Table, members: pa.Table) -> pa.Table:
        if not len(points) or not len(members):
            return pa.schema([("test_id", pa.int64()), ("far", kind)]).empty_table()
        a, b = metric.flat(matrix(points["vec"])), metric.flat(matrix(members["vec"]))
        n = min(k, len(b))
        least = np.concatenate([np.partition(metric.bounds(a[at], b)[1], n - 1, axis=1)[:, :n] for at in _slices(len(a), len(b))])
        far = pa.ListArray.from_arrays(np.arange(0, least.size + 1, n).astype(np.int32), least.ravel())
        return pa.Table.from_arrays([points["test_id"].combine_chunks(), far], ["test_id", "far"])

    return run


def _pairs(metric: Metric, k: int | None, id_type: pa.DataType):
    """(test_id, train_id, distance) of the pairs within the bound; the k nearest of each point, or all."""
    empty = pa.schema([("test_id", pa.int64()), ("train_id", id_type), ("distance", pa.float64())]).empty_table()

    def run(points: pa.Table, members: pa.Table) -> pa.Table:
        if not len(points) or not len(members):
            return empty
        a, b = matrix(points["vec"]), matrix(members["vec"])
        near = metric.flat(b)
        bound = points["bound"].to_numpy()
        bound = np.where(np.isnan(bound), np.inf, bound)
        ids = members["train_id"].combine_chunks()
        order = np.empty(len(ids), np.int64)
        order[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
        found = []
        for at in _slices(len(a), len(b)):
            row, col = np.nonzero(_maybe(metric, metric.flat(a[at]), near, bound[at], k))
            row += at.start
            distance = _exact(metric, a, b, row, col)
            if k is None:
                take = distance <= bound[row]
            else:
                by = np.lexsort((order[col], distance, row))
                row, col, distance = row[by], col[by], distance[by]
                take = np.arange(len(row)) - np.searchsorted(row, row) < k
            found.append((row[take], col[take], distance[take]))
        row, col, distance = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.Table.from_arrays([points["test_id"].combine_chunks().take(pa.array(row)), ids.take(pa.array(col)), pa.array(distance)], schema=empty.schema)

    return run


def _whole(df: DataFrame, vec: str, metric: Metric) -> DataFrame:
    df = df.where(F.col(vec).isNotNull() & ~F.exists(vec, lambda x: x.isNull()))
    return df.where(F.exists(vec, lambda x: x != 0)) if metric.name == "cosine" else df


def _root(group_col: str | None):
    return F.lit("") if group_col is None else F.concat(F.lit("g"), F.col(group_col).cast("string"))


def _id_type(df: DataFrame, column: str) -> tuple[str, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = df.schema[column].dataType
    return kind.simpleString(), to_arrow_type(kind)


def _none(ids: DataFrame, kind) -> DataFrame:
    return ids.limit(0).select(F.col("__id").alias("test_id"), F.col("__id").cast(kind).alias("train_id"), F.lit(0.0).alias("distance"), F.lit(0).alias("rank"))


def exact_knn(test: DataFrame, train: DataFrame, k: int = 1, vec: str = "vec", id_col: str = "problem_id",
              group_col: str | None = None, metric: str | Metric = "euclidean") -> DataFrame:
    """(test_id, train_id, distance, rank) for the k nearest train rows of every test row.

    ``metric``: euclidean, cosine (ranked and reported as 1 - cos), or a :class:`Metric`.
    ``group_col``: neighbours only within the same (non-null) group value.  Rows whose vector is null
    or holds a null (for cosine: or is all zeros) have no neighbours and are none."""
    _ready(test)
    metric = Metric(metric) if isinstance(metric, str) else metric
    test, train = _whole(test, vec, metric), _whole(train, vec, metric)
    keys = [group_col] if group_col else []
    as_double = F.col(vec).cast("array<double>")
    ids = written(test.select(F.col(id_col).alias("__id"), *keys, as_double.alias("__v")), "asked")
    if ids.isEmpty():  # nobody asks: no tree
        return _none(ids, train.schema[id_col].dataType)
    # the ids of the distinct test vectors are fixed by writing them (stable if an executor is lost)
    distinct = written(ids.select(*keys, "__v").distinct().withColumn("test_id", F.monotonically_increasing_id()), "points")
    points = distinct.select(_root(group_col).alias("node"), "test_id", F.col("__v").alias("vec"), F.lit(None).cast("double").alias("bound")).where("node is not null")
    tr = train.select(_root(group_col).alias("node"), F.col(id_col).alias("train_id"), as_double.alias("vec"), metric.space(as_double).alias("__g")).where("node is not null")
    tr = group_topk(tr, ["node", "__g"], [F.col("train_id")], k, salt_col="train_id", rank_col="__dup")
    tree = PivotTree(tr.select("node", "train_id", "vec", (F.col("__dup") == 1).alias("lead")), metric)
    if not tree.levels:
        return _none(ids, train.schema[id_col].dataType)
    far = tree.meet(tree.visits(points, _nearest(k)), _bounds_of(metric, k), "test_id long, far array<double>")
    reach = far.groupBy("test_id").agg(F.try_element_at(F.sort_array(F.flatten(F.collect_list("far"))), F.lit(k)).alias("bound"))
    bounded = points.drop("bound").join(reach, "test_id", "left").select(*points.columns)
    name, kind = _id_type(tr, "train_id")
    bounded = written(bounded, "bounded")
    evaluate, schema = _pairs(metric, k, kind), f"test_id long, train_id {name}, distance double"
    near = all_pairs(bounded, tree.all, evaluate, schema) if tree.wide(bounded) else tree.meet(tree.visits(bounded, _reaching), evaluate, schema)
    top = group_topk(near, ["test_id"], [F.col("distance"), F.col("train_id")], k, salt_col="train_id", rank_col="rank")
    found = distinct.join(top, "test_id").select(*keys, "__v", "train_id", "distance", F.col("rank").cast("int").alias("rank"))
    return ids.join(found, [*keys, "__v"]).select(F.col("__id").alias("test_id"), "train_id", "distance", "rank")


def range_pairs(test: DataFrame, train: DataFrame, radius, vec: str = "vec", id_col: str = "problem_id") -> DataFrame:
    """All (test_id, train_id, distance) with euclidean distance <= radius (a number, or a
    column of ``test`` holding a per-row radius; rows with a null radius have no pairs)."""
    _ready(test)
    metric = Metric()
    test, train = _whole(test, vec, metric), _whole(train, vec, metric)
    rc = F.lit(float(radius)) if isinstance(radius, (int, float)) else F.col(radius)
    as_double = F.col(vec).cast("array<double>")
    named = test.select(F.col(id_col).alias("__id"), as_double.alias("vec"), rc.cast("double").alias("bound")).where("bound is not null")
    named = written(named.withColumn("test_id", F.monotonically_increasing_id()), "points")
    rows = _leading(train.select(F.lit("").alias("node"), F.col(id_col).alias("train_id"), as_double.alias("vec")))
    tree = PivotTree(rows, metric)
    name, kind = _id_type(rows, "train_id")
    if not tree.levels:
        return named.limit(0).select(F.col("__id").alias("test_id"), F.col("__id").cast(name).alias("train_id"), F.col("bound").alias("distance"))
    points = named.select(F.lit("").alias("node"), "test_id", "vec", "bound")
    pairs = tree.meet(tree.visits(points, _reaching), _pairs(metric, None, kind), f"test_id long, train_id {name}, distance double", piece=1_024)
    return pairs.join(named.select("test_id", "__id"), "test_id").select(F.col("__id").alias("test_id"), "train_id", "distance")


def _leading(rows: DataFrame) -> DataFrame:
    """``rows`` (node, train_id, vec) with the mark ``lead`` on the least id of each vector."""
    alike = rows.groupBy(F.col("vec").alias("__v")).agg(F.min("train_id").alias("__least"))
    return rows.join(alike, F.col("vec") == F.col("__v")).select("node", "train_id", "vec", (F.col("train_id") == F.col("__least")).alias("lead"))


class Within:
    """Rows (id, vec) within ``radius`` of each other (euclidean), told without a list of all pairs.

    A dense group has as many pairs as the square of its rows; here a task only gives counts, a minimum
    or links that connect what its pairs connect, so the output follows the rows it met."""

    def __init__(self, df: DataFrame, radius: float, vec: str = "vec", id_col: str = "problem_id"):
        _ready(df)
        rows = _whole(df, vec, Metric()).select(F.lit("").alias("node"), F.col(id_col).alias("train_id"), F.col(vec).cast("array<double>").alias("vec"))
        self.tree = PivotTree(_leading(rows), Metric())
        # null ids meet others as points, as in a join's left side
        points = written(rows.select("node", F.col("train_id").alias("test_id"), "vec", F.lit(float(radius)).alias("bound")), "points")
        self.name, self.kind = _id_type(rows, "train_id")
        self.points, self.wide = points, bool(self.tree.levels) and self.tree.wide(points)
        self.visits = None if self.wide or not self.tree.levels else self.tree.visits(points, _reaching)

    def _meet(self, evaluate, schema: str, asked: DataFrame | None, told: DataFrame | None, more=()) -> DataFrame:
        if not self.tree.levels:
            return self.points.sparkSession.createDataFrame([], schema)
        pick = lambda d, ids: d if ids is None else d.join(ids, [c for c in ids.columns if c.endswith("_id")])
        if self.wide:
            return all_pairs(pick(self.points, asked), pick(self.tree.all, told), evaluate, schema, more)
        return self.tree.meet(pick(self.visits, asked), evaluate, schema, pick(self.tree.members, told), more)

    def counts(self) -> DataFrame:
        """(test_id, n): rows within the radius of the rows of an id, themselves included."""
        empty = pa.schema([("test_id", self.kind), ("n", pa.int64())])

        def run(points: pa.Table, members: pa.Table) -> pa.Table:
            n = np.zeros(len(points), np.int64)
            for at, near in _near(points, members):
                n[at] = near.sum(1)
            return pa.Table.from_arrays([points["test_id"].combine_chunks(), pa.array(n)], schema=empty)

        return self._meet(run, f"test_id {self.name}, n long", None, None).groupBy("test_id").agg(F.sum("n").alias("n")).where("n > 0")

    def links(self, ids: DataFrame) -> DataFrame:
        """(src, dst): edges that connect the same of ``ids`` (node) as all their pairs within the radius do."""
        out = pa.schema([("src", self.kind), ("dst", self.kind)])

        def run(points: pa.Table, members: pa.Table) -> pa.Table:
            m = len(members)
            parent = np.arange(m + len(points))
            for at, near in _near(points, members):
                row, col = np.nonzero(near)
                _unite(parent, row + m + at.start, col)
            node = np.flatnonzero(parent != np.arange(len(parent)))
            names = pa.concat_arrays([members["train_id"].combine_chunks(), points["test_id"].combine_chunks()])
            return pa.Table.from_arrays([names.take(pa.array(parent[node])), names.take(pa.array(node))], schema=out)

        asked, told = ids.select(F.col("node").alias("test_id")), ids.select(F.col("node").alias("train_id"))
        return self._meet(run, f"src {self.name}, dst {self.name}", asked, told)

    def least(self, asked: DataFrame, labels: DataFrame) -> DataFrame:
        """(test_id, label): of the ids of ``asked`` (test_id), the least label of a row of ``labels`` (train_id, label long) within the radius."""
        out = pa.schema([("test_id", self.kind), ("label", pa.int64())])

        def run(points: pa.Table, members: pa.Table) -> pa.Table:
            label, none = members["label"].to_numpy(), np.iinfo(np.int64).max
            got = np.full(len(points), none)
            for at, near in _near(points, members):
                got[at] = np.where(near, label[None], none).min(1, initial=none)
            take = pa.array(np.flatnonzero(got < none))
            return pa.Table.from_arrays([points["test_id"].combine_chunks().take(take), pa.array(got).take(take)], schema=out)

        return self._meet(run, f"test_id {self.name}, label long", asked, labels, ("label",)).groupBy("test_id").agg(F.min("label").alias("label"))


def _near(points: pa.Table, members: pa.Table) -> Iterator[tuple[slice, np.ndarray]]:
    """Slices of the points and which members lie within their bounds; pairs that rounding leaves in question are computed exactly."""
    if not len(points) or not len(members):
        return
    a, b, bound = matrix(points["vec"]), matrix(members["vec"]), points["bound"].to_numpy()
    for at in _slices(len(a), len(b)):
        square, slack = _squares(a[at], b)
        limit = (bound[at] * bound[at])[:, None]
        near = square <= limit * (1 - 1e-12) - slack
        row, col = np.nonzero(~near & (square <= limit * (1 + 1e-12) + slack))
        near[row, col] = _exact(Metric(), a[at], b, row, col) <= bound[at][row]
        yield at, near


def _unite(parent: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
    """Join the sets of the pairs in ``parent``, where every entry names the least of its set."""
    while True:
        a, b = parent[one], parent[two]
        apart = a != b
        if not apart.any():
            return
        one, two, a, b = one[apart], two[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while ((up := parent[parent]) != parent).any():
            parent[:] = up


def _ready(df: DataFrame) -> None:
    ensure_checkpoint_dir(df.sparkSession)
    ship_package(df.sparkSession)


def exact_knn_sum_metric(test: DataFrame, train: DataFrame, k: int = 1) -> DataFrame:
    """k nearest under d = |mu_a - mu_b| + |S_a - S_b|_F (``nearest_by_cov``): a sum of two metrics is one."""
    one = train.select(F.size("mu").alias("n")).first()

    def stack(df):
        return df.select("problem_id", F.concat("mu", "cov").alias("vec"))

    return exact_knn(stack(test), stack(train), k, metric=Metric("sum", one["n"] if one else 0))


def mean_vectors(df: DataFrame, verifiers, key: str = "problem_id") -> DataFrame:
    """(key, vec): per-problem mean of each verifier score."""
    g = df.groupBy(key).agg(*[F.avg(v).alias(v) for v in verifiers])
    return g.select(key, F.array(*[F.col(v).cast("double") for v in verifiers]).alias("vec"))


def cov_vectors(df: DataFrame, verifiers, key: str = "problem_id", digits: int | None = None) -> DataFrame:
    """(key, mu, cov): per-problem means and flattened sample covariance matrix, optionally rounded."""
    aggs = [F.avg(v).alias(f"m_{v}") for v in verifiers]
    for a in verifiers:
        for b in verifiers:
            aggs.append(F.covar_samp(a, b).alias(f"c_{a}_{b}"))
    g = df.groupBy(key).agg(*aggs)
    rnd = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    return g.select(key, F.array(*[rnd(F.col(f"m_{v}")) for v in verifiers]).alias("mu"),
                    F.array(*[rnd(F.col(f"c_{a}_{b}")) for a in verifiers for b in verifiers]).alias("cov"))
