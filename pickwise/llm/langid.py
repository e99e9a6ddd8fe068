"""Operator 7: language identification with interpolated Kneser-Ney character models.

One character model per language, order 5, over the letters of a word with a start and an
end mark (contexts do not cross words, so a word's score is the same wherever it stands).

Training: every labelled row that the caller passes is counted. Each task counts the
distinct words of its rows per language, cuts them into n-grams and sends one count per
(language, n-gram); Spark adds them up. From the sums, the raw counts of the highest order
and the continuation counts (distinct left neighbours) of the lower ones give the
interpolated Kneser-Ney probabilities. N-grams seen fewer than ``min_count`` times are
left to the lower orders, and each language keeps at most ``max_grams`` n-grams an order,
the most frequent: these two parameters bound the model, so it may be broadcast.

Storage: per order one sorted array of 64-bit n-gram hashes with, per language, the log
probability and the back-off weight; a look-up is a binary search.

Prediction: cross-entropy per character (end marks included) under each model; the lowest
wins. ``score`` is the posterior of the winner for equal priors with the evidence of at
most ``evidence`` characters. Rejection is calibrated on a fifth of the labelled texts
(chosen by a hash of the text) that the counts leave out: a text is rejected when its
cross-entropy exceeds the mean of its language by more than ``least`` nats a character and
by more than ``slack`` times the largest excess seen there, both scaled by the square root
of the length, so that short texts have the room their noise needs.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pickwise.llm.common import prepare, stored, tidy

LETTERS = re.compile(r"[^\W\d_]+")
ORDER = 5
START, END = "\x02", "\x03"


def letter_words(text: str | None) -> list[str]:
    """Lower-cased runs of letters (Unicode category L) of a whole text."""
    if not text:
        return []
    words = LETTERS.findall(text.lower())
    if not "".join(words).isalpha():  # the pattern also passes numerals such as superscripts
        words = [w for word in words for w in "".join(c if c.isalpha() else " " for c in word).split()]
    return words


def _grams(word: str, order: int) -> Iterator[tuple[int, str]]:
    """(n, n-gram) of every position of a padded word: the longest context first."""
    padded = START + word + END
    for i in range(1, len(padded)):
        low = max(0, i - order + 1)
        yield i - low + 1, padded[low:i + 1]


def _hash(gram: str) -> int:
    return xxhash.xxh3_64_intdigest(gram.encode("utf-8", "surrogatepass"))


@dataclass
class Model:
    """Sorted n-gram hashes per order; columns of the matrices are the languages."""
    languages: list[str]
    order: int = ORDER
    keys: list[np.ndarray] = field(default_factory=list)      # by n - 1
    logp: list[np.ndarray] = field(default_factory=list)      # (grams, languages), natural log
    backoff: list[np.ndarray] = field(default_factory=list)   # of the gram as a context, log
    floor: np.ndarray | None = None                           # log probability of an unseen character
    mean: np.ndarray | None = None                            # cross-entropy of calibration rows
    limit: np.ndarray | None = None                           # calibrated bound on the scaled excess
    least: float = 0.0                                        # excess a character that is never rejected

    def find(self, n: int, hashes: np.ndarray) -> np.ndarray:
        """Index of each hash among the n-grams of that order, -1 if it is not there."""
        keys = self.keys[n - 1]
        if not len(keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return np.where(keys[at] == hashes, at, -1)

    def span_scores(self, spans: list[str]) -> np.ndarray:
        """Log probability of the last character of each span per language, backing off from its full length."""
        out = np.empty((len(spans), len(self.languages)))
        by_len: dict[int, list[int]] = defaultdict(list)
        for i, s in enumerate(spans):
            by_len[len(s)].append(i)
        for n, members in by_len.items():
            out[members] = self._level([spans[i] for i in members], n)
        return out

    def _level(self, spans: list[str], n: int) -> np.ndarray:
        if n == 0 or not spans:
            return np.tile(self.floor, (len(spans), 1))
        at = self.find(n, np.fromiter(map(_hash, spans), np.uint64, len(spans)))
        got = np.where((at >= 0)[:, None], self.logp[n - 1][at] if len(self.keys[n - 1]) else 0.0, np.nan)
        unseen = np.isnan(got)
        need = np.flatnonzero(unseen.any(axis=1))
        if len(need):
            shorter = [spans[i][1:] for i in need]
            lower = self._level(shorter, n - 1)
            if n > 1:
                ctx = self.find(n - 1, np.fromiter((_hash(spans[i][:-1]) for i in need), np.uint64, len(need)))
                weight = np.where((ctx >= 0)[:, None], self.backoff[n - 2][ctx] if len(self.keys[n - 2]) else 0.0, 0.0)
                lower = lower + np.nan_to_num(weight)
            got[need] = np.where(unseen[need], lower, got[need])
        return got


class _Rows:
    """Key -> row of a growing matrix, filled by ``make``; emptied at a bound (speed only)."""

    def __init__(self, width: int, make, bound: int):
        self.width, self.make, self.bound = width, make, bound
        self.clear()

    def clear(self):
        self.index: dict[str, int] = {}
        self.rows = np.zeros((1 << 12, self.width))

    def get(self, keys: list[str]) -> np.ndarray:
        """The rows of the keys, in order."""
        fresh = list(dict.fromkeys(k for k in keys if k not in self.index))
        if len(fresh) > self.bound:
            return np.vstack([self.get(keys[i:i + self.bound // 2]) for i in range(0, len(keys), self.bound // 2)])
        if fresh:
            if len(self.index) + len(fresh) > self.bound:
                self.clear()
                fresh = list(dict.fromkeys(keys))
            base = len(self.index)
            made = self.make(fresh)
            if base + len(fresh) > len(self.rows):
                grown = np.zeros((max(2 * len(self.rows), base + len(fresh)), self.width))
                grown[:base] = self.rows[:base]
                self.rows = grown
            self.rows[base:base + len(fresh)] = made
            self.index.update(zip(fresh, range(base, base + len(fresh)), strict=True))
        return self.rows[np.fromiter(map(self.index.__getitem__, keys), np.int64, len(keys))]


class Scorer:
    """Sums character log probabilities over texts, remembering words and spans met before."""

    def __init__(self, model: Model, bound: int = 300_000):
        self.model = model
        self.spans = _Rows(len(model.languages), model.span_scores, bound)
        self.words = _Rows(len(model.languages) + 1, self._word_rows, bound)

    def _word_rows(self, words: list[str]) -> np.ndarray:
        spans = [gram for word in words for _, gram in _grams(word, self.model.order)]
        sizes = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        out = np.empty((len(words), len(self.model.languages) + 1))
        out[:, :-1] = np.add.reduceat(self.spans.get(spans), starts, axis=0)
        out[:, -1] = sizes
        return out

    def totals(self, words: list[str]) -> np.ndarray:
        """Log probability per language, and the number of events, of a whole text."""
        total = np.zeros(len(self.model.languages) + 1)
        for i in range(0, len(words), 100_000):
            total += self.words.get(words[i:i + 100_000]).sum(axis=0)
        return total


def count_grams(rows: DataFrame, text_col: str, lang_col: str, order: int = ORDER) -> DataFrame:
    """(lang, gram, n) over the whole of every row: counted per task first, then added up by Spark."""
    pairs = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words[lang].update(letter_words(text.as_py()))
            if sum(map(len, words.values())) > 300_000:
                yield _flush(words, order)
        if words:
            yield _flush(words, order)

    return (pairs.mapInArrow(run, "lang string, gram string, n long")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


def _flush(words: dict[str, Counter], order: int) -> pa.RecordBatch:
    langs, grams, counts = [], [], []
    for lang, seen in words.items():
        total: Counter = Counter()
        for word, n in seen.items():
            for _, gram in _grams(word, order):
                total[gram] += n
        langs.extend([lang] * len(total))
        grams.extend(total)
        counts.extend(total.values())
    words.clear()
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(grams, pa.string()), pa.array(counts, pa.int64())],
                                      names=["lang", "gram", "n"])


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", order: int = ORDER,
        min_count: int = 2, max_grams: int = 200_000, slack: float = 2.0, least: float = 1.5) -> Model:
    """Fit the models on four fifths of the labelled texts; calibrate the rejection on the others.

    Rows with null text or null label teach nothing. Without any labelled letter the model
    has no language and predicts ``und`` only."""
    spark = rows.sparkSession
    prepare(spark)
    labelled = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    apart = F.pmod(F.xxhash64(F.col(text_col)), F.lit(5)) == 0
    counts = stored(count_grams(labelled.where(~apart), text_col, lang_col, order).where(F.col("n") >= min_count), "grams")
    model = _estimate(_strongest(counts, max_grams), order)
    model.least = least
    if model.languages:
        _calibrate(model, labelled.where(apart), text_col, lang_col, slack)
    return model


def _strongest(counts: DataFrame, max_grams: int) -> list[tuple[str, str, int]]:
    """At most ``max_grams`` n-grams per language and length, the most frequent (ties by text).

    The cut is a count threshold found from a histogram of counts, so no group meets in one task."""
    sized = counts.withColumn("size", F.length("gram"))
    levels = defaultdict(list)
    bucket = F.floor(F.log2("n") * 8).cast("int")
    for r in sized.groupBy("lang", "size", bucket.alias("level")).count().collect():
        levels[r["lang"], r["size"]].append((r["level"], r["count"]))
    keep = None
    for (lang, size), hist in levels.items():
        total, low = 0, None
        for level, n in sorted(hist, reverse=True):
            if total + n > max_grams:
                break
            total, low = total + n, level
        if low is not None:
            own = (F.col("lang") == lang) & (F.col("size") == size) & (bucket >= low)
            keep = own if keep is None else keep | own
    if keep is None:
        return []
    return [(r["lang"], r["gram"], r["n"]) for r in sized.where(keep).select("lang", "gram", "n").collect()]


def _estimate(counted: list[tuple[str, str, int]], order: int) -> Model:
    """Interpolated Kneser-Ney with one discount per order: D = n1 / (n1 + 2 n2), 0.5 to 0.9."""
    languages = sorted({lang for lang, _, _ in counted})
    model = Model(languages, order)
    per_lang = {lang: _one_language([(g, n) for w, g, n in counted if w == lang], order) for lang in languages}
    alphabet = {g[-1] for _, g, _ in counted}
    model.floor = np.full(len(languages), -np.log(len(alphabet) + 1000.0))
    for n in range(1, order + 1):
        grams = sorted({g for p, _ in per_lang.values() for g in p[n]} | {g for _, b in per_lang.values() for g in b[n]})
        hashes = np.fromiter(map(_hash, grams), np.uint64, len(grams))
        by = np.argsort(hashes)
        logp = np.full((len(grams), len(languages)), np.nan)
        back = np.full((len(grams), len(languages)), np.nan)
        for c, lang in enumerate(languages):
            p, b = per_lang[lang]
            for i, g in enumerate(grams):
                if g in p[n]:
                    logp[i, c] = np.log(p[n][g])
                if g in b[n]:
                    back[i, c] = np.log(b[n][g])
        model.keys.append(hashes[by])
        model.logp.append(logp[by])
        model.backoff.append(back[by])
    return model


def _one_language(counted: list[tuple[str, int]], order: int) -> tuple[dict, dict]:
    """Probabilities and back-off weights by n; a span that begins a word keeps its raw count."""
    raw: list[Counter] = [Counter() for _ in range(order + 1)]
    for gram, n in counted:
        raw[len(gram)][gram] += n
    counts: list[Counter] = [Counter() for _ in range(order + 1)]
    counts[order] = raw[order]
    for n in range(order - 1, 0, -1):
        for gram in counts[n + 1]:
            counts[n][gram[1:]] += 1                      # distinct left neighbours
        for gram, k in raw[n].items():                    # spans that begin a word have no left neighbour
            counts[n][gram] += k
    probs: list[dict] = [{} for _ in range(order + 1)]
    backs: list[dict] = [{} for _ in range(order + 1)]
    size = len({g[-1] for n in range(1, order + 1) for g in counts[n]}) or 1
    for n in range(1, order + 1):
        freq = Counter(counts[n].values())
        d = min(0.9, max(0.5, freq[1] / (freq[1] + 2 * freq[2]))) if freq[1] else 0.5
        totals, kinds = Counter(), Counter()
        for gram, k in counts[n].items():
            totals[gram[:-1]] += k
            kinds[gram[:-1]] += 1
        for gram, k in counts[n].items():
            ctx = gram[:-1]
            lower = 1.0 / (size + 1000.0) if n == 1 else _lower(probs, backs, gram[1:], size)
            probs[n][gram] = (k - d) / totals[ctx] + d * kinds[ctx] / totals[ctx] * lower
        if n > 1:
            for ctx, k in kinds.items():
                backs[n - 1][ctx] = d * k / totals[ctx]
    return probs, backs


def _lower(probs, backs, gram, size) -> float:
    n = len(gram)
    if n == 0:
        return 1.0 / (size + 1000.0)
    if gram in probs[n]:
        return probs[n][gram]
    weight = backs[n - 1].get(gram[:-1], 1.0) if n > 1 else 1.0
    return weight * _lower(probs, backs, gram[1:], size)


def _calibrate(model: Model, rows: DataFrame, text_col: str, lang_col: str, slack: float) -> None:
    """Mean cross-entropy per language, then the largest scaled excess, on rows not counted."""
    model.mean, model.limit = np.zeros(len(model.languages)), np.full(len(model.languages), np.inf)
    scored = stored(_scored(rows.select(F.col(lang_col).alias("label"), F.col(text_col).alias("text")), model)
                    .where((F.col("lang_pred") == F.col("label"))), "calibration")
    for r in scored.groupBy("label").agg((F.sum("nats") / F.sum("events")).alias("m")).collect():
        model.mean[model.languages.index(r["label"])] = r["m"]
    means = F.create_map(*[x for lang, m in zip(model.languages, model.mean.tolist(), strict=True) for x in (F.lit(lang), F.lit(m))])
    excess = (F.col("nats") / F.col("events") - means[F.col("label")]) * F.sqrt("events")
    for r in scored.groupBy("label").agg(F.max(excess).alias("x")).collect():
        model.limit[model.languages.index(r["label"])] = max(1.0, r["x"]) * slack


def _scored(df: DataFrame, model: Model, text_col: str = "text", evidence: int = 60) -> DataFrame:
    """Append lang_pred, score, nats, events, rejected (replacing columns of those names)."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)
    new = ["lang_pred", "score", "nats", "events", "rejected"]
    base = df.drop(*new)
    schema = StructType(list(base.schema.fields))
    for name, kind in zip(new, ("string", "double", "double", "long", "boolean"), strict=True):
        schema = schema.add(name, kind)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = Scorer(model)
        for batch in batches:
            got: list[tuple] = []
            for value in batch.column(batch.schema.names.index(text_col)):
                words = letter_words(value.as_py())
                if not words or not model.languages:
                    got.append(("und", 0.0, 0.0, 0, True))
                    continue
                total = scorer.totals(words)
                events = total[-1]
                cross = -total[:-1] / events
                best = int(np.argmin(cross))
                score = 1.0 / np.exp(-(cross - cross[best]) * min(events, evidence)).sum()
                excess = cross[best] - model.mean[best]
                over = excess > model.least and excess * np.sqrt(events) > model.limit[best]
                got.append((model.languages[best], float(score), float(cross[best] * events), int(events), bool(over)))
            cols = list(zip(*got, strict=True)) if got else [[]] * 5
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                                             names=[*batch.schema.names, *new])

    return base.mapInArrow(run, schema)


def predict(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Append lang_pred (``und`` for null text, no letters or no model), score in [0, 1], nats, events, rejected.

    Only ``text_col`` is read for the prediction. Repeated rows get equal answers; equal
    cross-entropies go to the alphabetically first language. ``rejected`` is true for
    ``und`` and for texts beyond the calibrated bound. All other columns stay."""
    prepare(df.sparkSession)
    return _scored(df, model, text_col)


def held_out(doc_id: Column) -> Column:
    """True for the quarter of the ids that nothing is learned from."""
    return F.crc32(doc_id.cast("string")) % 4 == 2
