"""Operator 13: repeated byte windows against brute force."""

import collections
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pickwise.llm import suffixes

DOCS = "doc_id long, text string"


def brute(texts, depth):
    """(removed bytes, spans, kept bytes) of every text."""
    raws = [(t or "").encode() for t in texts]
    seen = collections.Counter(raw[i:i + depth] for raw in raws for i in range(len(raw) - depth + 1))
    out = []
    for raw in raws:
        gone = bytearray(len(raw))
        for i in range(len(raw) - depth + 1):
            if seen[raw[i:i + depth]] > 1:
                gone[i:i + depth] = b"\1" * depth
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(raw), sum(gone), spans, bytes(b for b, g in zip(raw, gone, strict=True) if not g)))
    return out


def found(spark, texts, depth, **names):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], DOCS).withColumn("kept", F.lit("clash")).repartition(5)
    rows = suffixes.remove_repeats(df, ["doc_id"], depth=depth).collect()
    got = {r["doc_id"]: (r["n_bytes"], sum(s["stop"] - s["start"] for s in r["spans"]), len(r["spans"]), bytes(r["kept"])) for r in rows}
    assert len(rows) == len(got) == len(texts)
    return [got[i] for i in range(len(texts))]


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda n: "".join(rnd.choice("abcdé ") for _ in range(n))
    passages = [word(n) for n in (60, 90, 400)]
    texts = [word(rnd.randrange(0, 300)) for _ in range(30)]
    texts += [word(rnd.randrange(0, 60)) + rnd.choice(passages) + word(rnd.randrange(0, 60)) for _ in range(40)]
    base = word(500)
    texts += [base[:i] + "#" + base[i + 1:] for i in range(20, 480, 40)]          # near copies
    return texts + [base] * 5 + [passages[0][:49], passages[0][5:], None, "", None, "x" * 300, "xy" * 200, "abc" * 41, "é" * 100, texts[0]]


@pytest.mark.parametrize("depth", [1, 2, 7, 8, 50])
def test_equals_brute_force(spark, depth):
    texts = corpus(depth)
    assert found(spark, texts, depth) == brute(texts, depth)


def test_no_rows_and_only_short_texts(spark):
    assert suffixes.remove_repeats(spark.createDataFrame([], DOCS), ["doc_id"]).count() == 0
    assert found(spark, ["ab", "ab", None], 400) == [(2, 0, 0, b"ab"), (2, 0, 0, b"ab"), (0, 0, 0, b"")]


def test_crowded_cores_take_the_hashed_way_with_the_same_result(spark):
    """One passage in texts that differ around it: every block of its core differs."""
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage = word(110)
    texts = [word(rnd.randrange(30, 90)) + passage + word(rnd.randrange(30, 90)) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    named = df.select(suffixes.text_name(F.col("text")).alias("name"), "text")
    scheme = suffixes.Scheme(50)
    cores = suffixes.first_pass(named, 3, scheme)
    open_ = cores.where("kind = 1").drop("kind")
    spans = {}
    for most in (4_000, 5):
        rest = suffixes.further_passes(named, open_, scheme, 3, most)
        rows = cores.where("kind = 0").select("text", "start", "stop").unionByName(rest).collect()
        cover = collections.defaultdict(set)
        for r in rows:
            cover[bytes(r["text"])].update(range(r["start"], r["stop"]))
        spans[most] = cover
    assert open_.groupBy("core").count().agg(F.max("count")).first()[0] > 5
    assert spans[4_000] == spans[5] and sorted(map(len, spans[5].values())) == sorted(n for _, n, _, _ in brute(texts, 50) if n)


def test_long_texts_are_cut_into_pieces_without_a_seam(spark):
    rnd = np.random.default_rng(4)
    body = rnd.integers(97, 123, 2 * suffixes.PIECE + 5_000).astype(np.uint8).tobytes().decode()
    own = rnd.integers(65, 91, 3_000).astype(np.uint8).tobytes().decode()
    cut = body[suffixes.PIECE - 300:suffixes.PIECE + 300]                          # over the seam of two pieces
    texts = [body, own[:700] + cut + own[700:], own]
    got = found(spark, texts, 400)
    assert got[0][1:3] == (600, 1) and got[0][3].decode() == body.replace(cut, "")
    assert got[1] == (3_600, 3_600, 1, b"") and got[2] == (3_000, 3_000, 1, b"")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab", max_size=60), min_size=1, max_size=8), st.integers(1, 20))
def test_equal_windows_share_core_and_place(texts, depth):
    scheme = suffixes.Scheme(depth)
    raws = [t.encode() for t in texts]
    raw, offsets = np.frombuffer(b"".join(raws), np.uint8), np.cumsum([0, *map(len, raws)])
    names = np.frombuffer(b"".join(b"%012d" % i for i in range(len(raws))), "V12")
    where, seen = {}, set()
    for rows in suffixes.records(names, raw, offsets, scheme):
        for r in rows:
            doc = int(bytes(r["text"]))
            for j in range(int(r["runs"])):
                start = int(r["at"]) - int(r["lead"]) + j
                assert (doc, start) not in seen
                seen.add((doc, start))
                window, digit = raws[doc][start:start + depth], (int(r["core"]), int(r["lead"]) - j)
                assert len(window) == depth and where.setdefault(window, digit) == digit
    assert len(seen) == sum(max(0, len(r) - depth + 1) for r in raws)


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=120), st.integers(1, 24), st.integers(1, 3))
def test_radix_finds_exactly_the_repeated_places(raw, depth, groups):
    at = np.arange(max(0, len(raw) - depth + 1))
    group = at % groups
    count = collections.Counter((i % groups, raw[i:i + depth]) for i in at)
    got = sorted(suffixes.radix(np.frombuffer(raw, np.uint8), at, group, depth).tolist()) if len(at) else []
    assert got == [i for i in at if count[i % groups, raw[i:i + depth]] > 1]
