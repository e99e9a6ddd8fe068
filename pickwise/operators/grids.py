"""Grids of fits: every (draw, first k samples, first v verifiers) cell from shared scans.

Samples of a draw are ordered once, so the samples of a smaller k are the first of a larger one, and a problem takes
part in the ks that it has samples for. A sample is one row with its place in every draw; problems of few rows are drawn from whole, in the
task their rows move to. Of each draw a row therefore belongs to all cells from the first k above its slot
to the last k within its problem's size. Moments are summed by (draw, those two bounds), one vector per task, and cumulative sums
over the bounds give every cell; the moments of fewer verifiers are a block of those of all. Label models
need no more than that. Logistic fits take one scan per Newton step for all cells together.
Selection accuracies of all methods and ks are columns of one grouped aggregate per problem; those of draws, and their
majority votes, are taken by array operations over whole problems, which hold at most the drawn samples.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pickwise.functions.columns import hash_order, sum_cols
from pickwise.functions.joins import join_back, written
from pickwise.functions.ranks import global_rank
from pickwise.functions.quantiles import select_ranks
from pickwise.functions.topk import group_topk
from pickwise.functions.whole import groups_of, map_whole, numbers, parted
from pickwise.models.label_model import _triples, balance_of, fit_mu_many
from pickwise.models.moments import triplet_weights
from pickwise.operators.metrics import NO_ANSWER
from pickwise.session import ship_package


class Cells:
    """Rows (problem_id, sample_idx, y, answer, s_i, w_i, n, slot_d): scores and votes of each row and its place in each draw."""

    def __init__(self, df: DataFrame, verifiers: Sequence[str], ks: Sequence[int], draws: int | None = None, seed: int = 42,
                 votes: DataFrame | None = None, answer: str | None = None, threshold: float = 0.5):
        """``draws`` None: one draw, in the order of sample_idx. ``votes`` (same keys and verifiers) or scores cut at ``threshold``."""
        ship_package(df.sparkSession)
        self.verifiers, self.ks, self.draws = list(verifiers), sorted(set(ks)), draws or 1
        scores = [F.col(v).cast("double").alias(f"s{i}") for i, v in enumerate(verifiers)]
        said = F.col(answer) if answer else F.lit(None).cast("string")
        keys = ["problem_id", "sample_idx"]
        rows = df.select(*keys, F.col("y").cast("int").alias("y"), said.alias("answer"), *scores)
        if votes is None:
            cut = [F.when(F.col(f"s{i}") == -1, -1.0).when(F.col(f"s{i}") >= threshold, 1.0).otherwise(0.0).alias(f"w{i}") for i in range(len(verifiers))]
            rows = rows.select("*", *cut)
        else:
            rows = rows.join(votes.select(*keys, *[F.col(v).cast("double").alias(f"w{i}") for i, v in enumerate(verifiers)]), keys)
        self.slots = [f"slot{d}" for d in range(self.draws)]
        if draws is None:
            size = df.groupBy("problem_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= self.ks[0])
            rows = join_back(rows, size, "problem_id").withColumn("slot0", F.col("sample_idx").cast("int")).where(F.col("slot0") < self.ks[-1])
        else:
            small, large = parted(rows, "problem_id")
            rows = self._drawn(small, seed)
            if large is not None:
                rows = rows.unionByName(self._drawn_spread(large, seed))
        self.rows = written(rows, "grid-cells")

    def _drawn(self, small: DataFrame, seed: int) -> DataFrame:
        """Rows of problems that come whole: their number and each row's place by md5 in each draw; rows that no draw takes go."""
        hashes = [F.unhex(hash_order(seed, F.lit(d), "problem_id", "sample_idx")).alias(f"__h{d}") for d in range(self.draws)]
        schema = ", ".join([*(f"{n} {t}" for n, t in small.dtypes), "n long", *(f"{c} int" for c in self.slots)])
        least, most, draws = self.ks[0], self.ks[-1], self.draws

        def step(table: pa.Table, starts: np.ndarray) -> pa.Table:
            size = len(table)
            group = groups_of(starts, size)
            n = np.diff(np.append(starts, size))[group]
            place, taken = [], np.zeros(size, bool)
            for d in range(draws):
                column = table[f"__h{d}"].combine_chunks()
                begin = int(np.frombuffer(column.buffers()[1], np.int32)[column.offset])
                digits = np.frombuffer(column.buffers()[2], ">u8", 2 * size, begin).reshape(size, 2).astype(np.uint64)
                at = np.empty(size, np.int64)
                at[np.lexsort((digits[:, 1], digits[:, 0], group))] = np.arange(size)
                place.append(at - starts[group])
                taken |= place[-1] < most
            out = table.drop_columns([f"__h{d}" for d in range(draws)]).append_column("n", pa.array(n, pa.int64()))
            for d, at in enumerate(place):
                out = out.append_column(f"slot{d}", pa.array(at, pa.int32()))
            return out.filter(pa.array(taken & (n >= least)))

        return map_whole(small.select("*", *hashes), "problem_id", step, schema)

    def _drawn_spread(self, large: DataFrame, seed: int) -> DataFrame:
        """The same of problems of many rows, which no task holds whole: a row for each draw that takes the sample."""
        size = large.groupBy("problem_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= self.ks[0])
        rows = join_back(large, size, "problem_id").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(self.draws - 1))))
        rows = group_topk(rows, ["draw", "problem_id"], [hash_order(seed, "draw", "problem_id", "sample_idx")], self.ks[-1], rank_col="slot")
        place = [F.when(F.col("draw") == d, F.col("slot") - 1).otherwise(self.ks[-1]).cast("int").alias(c) for d, c in enumerate(self.slots)]
        return rows.select(*large.columns, "n", *place)

    def inside(self, k: int) -> Column:
        """Whether the row is of the cell of the first draw."""
        return (F.col("slot0") < k) & (F.col("n") >= k)

    def _passes(self, names: Sequence[str], body: Callable) -> DataFrame:
        """(key, at, value): sums over all rows of ``body(batch columns)`` vectors per key."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict = {}
            for batch in batches:
                for key, vector in body([c.to_numpy(zero_copy_only=False) for c in batch.columns]):
                    held[key] = held[key] + vector if key in held else vector
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([v.tolist() for v in held.values()], pa.list_(pa.float64()))], ["key", "v"])

        parts = self.rows.select(*names).mapInArrow(run, "key long, v array<double>")
        return parts.select("key", F.posexplode("v").alias("at", "v")).groupBy("key", "at").agg(F.sum("v").alias("v"))

    def sums(self, names: Sequence[str], vector: Callable[[np.ndarray], np.ndarray]) -> dict:
        """{(draw, k): sum over the cell's rows} of ``vector(matrix of the named columns)``, in one scan."""
        ks, draws = np.array(self.ks), self.draws
        m = len(ks)

        def body(columns):
            n, *places = (np.asarray(c, np.int64) for c in columns[:1 + draws])
            if not len(n):
                return
            x = np.stack([np.asarray(c, float) for c in columns[1 + draws:]], axis=1)
            last = np.searchsorted(ks, n, "right") - 1
            for draw, slot in enumerate(places):
                first = np.searchsorted(ks, slot, "right")
                code = (draw * m + first) * m + last
                order = np.argsort(code, kind="stable")
                order = order[(first <= last)[order]]
                cuts = np.flatnonzero(np.diff(code[order])) + 1
                for own in np.split(order, cuts) if len(order) else ():
                    yield int(code[own[0]]), vector(x[own])

        total: dict = {}
        for r in self._passes(["n", *self.slots, *names], body).collect():
            total.setdefault(r["key"], {})[r["at"]] = r["v"]
        out: dict = {}
        for key, values in total.items():
            draw, first, last = key // (m * m), key // m % m, key % m
            v = np.array([values[i] for i in range(len(values))])
            for c in range(first, last + 1):
                out[draw, self.ks[c]] = out.get((draw, self.ks[c]), 0) + v
        return out

    # ---- fits

    def logistic(self, split: float = 1.0, C: float = 1.0, iters: int = 40, tol: float = 1e-9) -> dict:
        """{(draw, k): coefficients, or the only label class as a float}: balanced L2 fits, one scan per Newton step for all cells.

        ``split`` below 1 (one draw): only the first share of the cell's rows, by problem and sample, teaches."""
        v, ks, p = len(self.verifiers), self.ks, len(self.verifiers) + 1
        names, draws = ["n", "y", *self.slots, *[f"s{i}" for i in range(v)]], self.draws
        limits = self._training_share(split) if split < 1 else {}
        source = self
        if limits:
            source = object.__new__(Cells)
            source.__dict__.update(self.__dict__)
            names.append("place")
            # once, and not in every pass: beyond a broadcast the join moves all rows
            source.rows = written(self.rows.join(self.places.select("problem_id", "place"), "problem_id").select(*names), "grid-shares")

        def members(columns, k, draw):
            n, slot = columns[0], columns[2 + draw]
            inside = (slot < k) & (n >= k) & ~np.isnan(np.asarray(columns[1], float))
            if k in limits:
                place, rest = limits[k]
                at = np.asarray(columns[-1], np.int64)
                inside &= (at < place) | ((at == place) & (slot < rest))
            return inside

        def classes(columns):
            for d in range(draws):
                for c, k in enumerate(ks):
                    own = members(columns, k, d)
                    if own.any():
                        yield int(d * len(ks) + c), np.array([own.sum(), np.asarray(columns[1], float)[own].sum()])

        counts: dict = {}
        for r in source._passes(names, classes).collect():
            counts.setdefault(r["key"], [0.0, 0.0])[r["at"]] = r["v"]
        found = {key: (float(n1 > 0) if n1 in (0, n) else None) for key, (n, n1) in counts.items()}
        beta = {key: np.zeros(p) for key, only in found.items() if only is None}
        active, moved = set(beta), {}
        reg = np.full(p, 1.0 / C)
        reg[0] = 0.0
        for _ in range(iters):
            if not active:
                break
            now = {key: beta[key] for key in active}

            def body(columns, now=now):
                y, at = np.asarray(columns[1], float), 2 + draws
                x = np.concatenate([np.ones((len(y), 1)), np.stack([np.asarray(c, float) for c in columns[at:at + v]], axis=1)], axis=1)
                for key, b in now.items():
                    own = members(columns, ks[key % len(ks)], key // len(ks))
                    if own.any():
                        n, n1 = counts[key]
                        xo, yo = x[own], y[own]
                        w = np.where(yo == 1, n / (2 * n1), n / (2 * (n - n1)))
                        eta = xo @ b
                        prob = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
                        h = (xo * (w * prob * (1 - prob))[:, None]).T @ xo
                        yield key, np.concatenate([xo.T @ (w * (prob - yo)), h.ravel()])

            got: dict = {}
            for r in source._passes(names, body).collect():
                got.setdefault(r["key"], np.zeros(p + p * p))[r["at"]] = r["v"]
            for key, s in got.items():
                step = np.linalg.lstsq(s[p:].reshape(p, p) + np.diag(reg), s[:p] + reg * beta[key], rcond=None)[0]
                beta[key] = beta[key] - step
                moved[key] = float(np.abs(step).max())
                if moved[key] < tol:
                    active.discard(key)
        if active and max(moved[k] for k in active) > 1e-6:
            warnings.warn(f"logistic cells: the last step still moved by {max(moved[k] for k in active):.3g}", stacklevel=2)
        return {(key // len(ks), ks[key % len(ks)]): beta.get(key, only) for key, only in found.items()}

    def _training_share(self, split: float) -> dict:
        """{k: (place of the problem at the end of the share, its samples that still belong)}; ``places`` numbers the problems."""
        problems = self.rows.groupBy("problem_id").agg(F.max("n").alias("n"))
        self.places = written(global_rank(problems, ["problem_id"], "place"), "grid-places")
        counts = self.places.agg(*[F.count_if(F.col("n") >= k).alias(f"k{k}") for k in self.ks]).first()
        share = {k: max(1, int(counts[f"k{k}"] * k * split)) for k in self.ks if counts[f"k{k}"]}
        wide = self.places.select(*[F.when(F.col("n") >= k, F.col("place")).alias(f"k{k}") for k in share])
        at = select_ranks(wide, {(None, f"k{k}"): [s // k + 1] for k, s in share.items()})
        return {k: (int(at[None, f"k{k}"].get(s // k + 1, 1 << 62)), s % k) for k, s in share.items()}

    def label_models(self, vs: Sequence[int], class_balance: float | None = None, continuous: bool = True) -> dict:
        """{(draw, k, v): (vote parameters (v, 2, 2), class balance, weights of the continuous model)} from one scan."""
        m = len(self.verifiers)
        triples = {v: _triples(v, 42) for v in vs}
        named = sorted({t for v, ts in triples.items() if v >= 3 for t in ts})

        def vector(x):
            s, w = x[:, :m], x[:, m:]
            hot = np.concatenate([w == 0, w == 1], axis=1).astype(float)
            signed = np.where(w == 1, 1.0, np.where(w == 0, -1.0, 0.0))
            out = [np.array([float(len(x))]), (hot.T @ hot).ravel()]
            for i, j, k in named:
                a, b, c = signed[:, i], signed[:, j], signed[:, k]
                both = (a != 0) & (b != 0) & (c != 0)
                out.append(np.array([both.sum(), (a * b * both).sum(), (a * c * both).sum(), (b * c * both).sum(), (a * b * c).sum()], float))
            for v in vs:
                own = s[:, :v]
                own = own[~np.isnan(own).any(axis=1)]
                out += [np.array([float(len(own)), own.var(axis=1).sum()]), own.sum(axis=0), (own.T @ own).ravel()]
            return np.concatenate(out)

        names = [f"s{i}" for i in range(m)] + [f"w{i}" for i in range(m)]
        cells, found = self.sums(names, vector), {}
        jobs: dict = {}
        for (draw, k), total in cells.items():
            n, at = total[0], 1 + 4 * m * m
            both = (total[1:at] / n).reshape(2, m, 2, m).transpose(1, 3, 0, 2)          # verifier, verifier, vote, vote
            tri = {}
            for t in named:
                tri[t] = total[at:at + 5]
                at += 5
            for v in vs:
                count, spread = total[at:at + 2]
                first, gram = total[at + 2:at + 2 + v] / max(count, 1), total[at + 2 + v:at + 2 + v + v * v].reshape(v, v) / max(count, 1)
                at += 2 + v + v * v
                weights = triplet_weights(gram, spread / max(count, 1), first[0]) if continuous and count else None
                balance = class_balance if class_balance is not None else balance_of([tri[t] for t in triples[v]] if v >= 3 else [])
                o = both[:v, :v].copy()
                m1 = np.stack([np.diagonal(o[:, :, s, s]) for s in (0, 1)], axis=1)
                o[np.arange(v), np.arange(v)] = 0
                jobs.setdefault(v, []).append(((draw, k, v), m1, o, balance, weights))
        for v, own in jobs.items():
            mu = np.clip(fit_mu_many(np.stack([j[1] for j in own]), np.stack([j[2] for j in own]), np.array([j[3] for j in own])), 0.01, 0.99)
            found.update({j[0]: (mu[i], j[3], j[4]) for i, j in enumerate(own)})
        return found

    # ---- scores of the fitted cells

    def _by_draw(self, vectors: dict, width: int, score: Callable[[list], Column]) -> list[Column]:
        """``score`` of each draw's vector (zeros where the cell has none)."""
        return [score([F.lit(float(x)) for x in vectors.get(d, np.zeros(width))]) for d in range(self.draws)]

    def logistic_score(self, fits: dict, k: int) -> list[Column]:
        p = len(self.verifiers) + 1
        vectors = {d: f for (d, kk), f in fits.items() if kk == k and not isinstance(f, float)}

        def score(b):
            eta = sum_cols([b[0], *[b[i + 1] * F.col(f"s{i}") for i in range(p - 1)]])
            return F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))

        return self._by_draw(vectors, p, score)

    def vote_score(self, fits: dict, k: int, v: int) -> list[Column]:
        vectors = {}
        for (d, kk, vv), (mu, balance, _) in fits.items():
            if (kk, vv) == (k, v):
                ratio = np.log(mu[:, :, 1]) - np.log(mu[:, :, 0])
                vectors[d] = np.concatenate([[np.log(balance) - np.log(1 - balance)], ratio[:, 0], ratio[:, 1]])

        def score(b):
            terms = [F.when(F.col(f"w{i}") == 0, b[1 + i]).when(F.col(f"w{i}") == 1, b[1 + v + i]).otherwise(F.lit(0.0)) for i in range(v)]
            return F.lit(1.0) / (F.lit(1.0) + F.exp(-sum_cols([b[0], *terms])))

        return self._by_draw(vectors, 1 + 2 * v, score)

    def continuous_score(self, fits: dict, k: int, v: int) -> list[Column]:
        vectors = {d: w for (d, kk, vv), (_, _, w) in fits.items() if (kk, vv) == (k, v) and w is not None}
        return self._by_draw(vectors, v, lambda b: sum_cols([b[i] * F.col(f"s{i}") for i in range(v)]))

    def mean_score(self, v: int) -> Column:
        return sum_cols([F.col(f"s{i}") for i in range(v)]) / F.lit(float(v))

    # ---- accuracies

    def accuracies(self, scorers: dict) -> DataFrame:
        """(draw, label, k, accuracy) of ``scorers`` {(label, k): score column, or one for each draw}: the label of each problem's
        top sample (the first on ties) in the first draw, averaged over the cell's problems; one aggregate per problem."""
        items = [(at, score if isinstance(score, Column) else score[0]) for at, score in scorers.items()]
        best = [F.max_by("y", F.when(self.inside(k), F.struct(score, -F.col("sample_idx")))).alias(f"c{i}") for i, ((_, k), score) in enumerate(items)]
        per = self.rows.groupBy("problem_id").agg(F.max("n").alias("n"), *best)
        mean = per.groupBy(F.lit(0).alias("draw")).agg(*[F.avg(F.when(F.col("n") >= k, F.col(f"c{i}"))).alias(f"c{i}") for i, ((_, k), _) in enumerate(items)])
        rows = F.explode(F.array(*[F.struct(F.lit(label).alias("label"), F.lit(k).alias("k"), F.col(f"c{i}").alias("accuracy")) for i, ((label, k), _) in enumerate(items)]))
        return mean.select("draw", rows.alias("r")).select("draw", "r.*")

    def draw_accuracies(self, scorers: dict, majority: bool = False) -> DataFrame:
        """:meth:`accuracies` in all draws and, labelled majority, the share of problems whose most frequent answer (the first
        on ties) is right in more than half of its samples. A problem holds no more rows than were drawn, so it comes whole."""
        by_id: dict = {}
        wanted = []         # (score's number, draw, k, cell)
        labels = list(scorers)
        for cell, ((_, k), score) in enumerate(scorers.items()):
            for d, c in enumerate([score] * self.draws if isinstance(score, Column) else score):
                wanted.append((by_id.setdefault(id(c), (len(by_id), c))[0], d, k, cell))
        votes = [("majority", k) for k in self.ks] if majority else []
        rows = self.rows.select("problem_id", F.col("sample_idx").cast("long").alias("sample_idx"), "y", "n", *self.slots,
                                *(["answer"] if majority else []), *[c.cast("double").alias(f"__c{i}") for i, c in by_id.values()])
        ks, draws, scores, before = self.ks, self.draws, len(by_id), len(labels)

        def step(table: pa.Table, starts: np.ndarray) -> pa.Table:
            y, labelled = numbers(table["y"])
            n, slot = table["n"].to_numpy(), [table[f"slot{d}"].to_numpy() for d in range(draws)]
            sample = table["sample_idx"].fill_null(np.iinfo(np.int64).max).to_numpy()
            group = groups_of(starts, len(y))
            inside = {(d, k): (slot[d] < k) & (n >= k) for d in range(draws) for k in ks}
            out = []        # draw, cell, right problems, problems with a label, rows
            for i in range(scores):
                order = np.lexsort((sample, ~_order_bits(*numbers(table[f"__c{i}"])), group))
                place = np.empty(len(y), np.int64)
                place[order] = np.arange(len(y))
                for _, d, k, cell in (w for w in wanted if w[0] == i):
                    top = np.minimum.reduceat(np.where(inside[d, k], place, len(y)), starts)
                    top = order[top[top < len(y)]]
                    top = top[labelled[top]]
                    out.append((d, cell, float(y[top].sum()), len(top), len(y)))
            if votes:
                out += [(d, before + c, *_majority(table, y, labelled, sample, group, starts, inside[d, k])) for d in range(draws) for c, k in enumerate(ks)]
            columns = list(zip(*out))
            return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64()))],
                            names=["draw", "cell", "hits", "seen", "rows"])

        sums = map_whole(rows, "problem_id", step, "draw int, cell int, hits double, seen long, rows long")
        sums = sums.groupBy("draw", "cell").agg(*[F.sum(c).alias(c) for c in ("hits", "seen", "rows")]).where("rows > 0")
        name = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(k).alias("k")) for label, k in labels + votes])[F.col("cell")]
        return sums.select("draw", name["label"].alias("label"), name["k"].alias("k"), F.try_divide("hits", "seen").alias("accuracy"))


def _order_bits(x: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Integers in Spark's order of doubles: null first, -0 as 0, NaN last."""
    bits = (x + 0.0).view(np.int64)
    key = np.where(bits < 0, bits ^ np.iinfo(np.int64).max, bits)
    return np.where(there, np.where(np.isnan(x), np.iinfo(np.int64).max, key), np.iinfo(np.int64).min)


def _majority(table: pa.Table, y, labelled, sample, group, starts, inside) -> tuple[float, int, int]:
    """(problems whose most frequent answer is right, problems with a labelled answer, answered rows) of a cell."""
    answer = table["answer"].combine_chunks().dictionary_encode(null_encoding="encode")
    code, words = answer.indices.to_numpy(), answer.dictionary.to_pylist()
    if NO_ANSWER in words:
        said = code != words.index(NO_ANSWER)
        inside, answered = inside & said, int(said.sum())
    else:
        answered = len(code)
    order = np.lexsort((code, group))
    code, whose, inside = code[order], group[order], inside[order]
    cut = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (whose[1:] != whose[:-1])]))
    problem = whose[cut]
    begin = np.flatnonzero(np.concatenate([[True], problem[1:] != problem[:-1]]))
    known = inside & labelled[order]
    last = np.iinfo(np.int64).max
    count, labels = np.add.reduceat(inside.astype(np.int64), cut), np.add.reduceat(known.astype(np.int64), cut)
    right = np.where(labels > 0, np.add.reduceat(np.where(known, y[order], 0.0), cut), -1.0)        # -1: no label
    first = np.minimum.reduceat(np.where(inside, sample[order], last), cut)
    most = np.maximum.reduceat(count, begin)
    best = count == most[problem]
    best &= first == np.minimum.reduceat(np.where(best, first, last), begin)[problem]
    hits = np.maximum.reduceat(np.where(best, right, -2.0), begin)
    seen = (most > 0) & (hits >= 0)
    return float((hits[seen] > most[seen] / 2.0).sum()), int(seen.sum()), answered
