"""Operators across documents: line dedup, passages, set join, decontamination, the pipeline, the SQL forms."""

import collections
import random
import re

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline
from pickwise.llm import bpe, common, decontam, lines, passages, setjoin
from tools.oracle_check import table_hash

SMALL, MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s) for i, t, s in rows], DOCS)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def prose(rnd, n):
    return [f"{rnd.choice('bcdfg')}{rnd.randrange(10 ** 6)}" for _ in range(n)]


@pytest.mark.parametrize("key", ["op2_line_dedup", "op3_quality_rules", "op5_warc", "op6_url_filter", "op8_ngram_jaccard"])
def test_sql_form(spark, duck, key):
    df = E.queries()[key](spark, SMALL)
    rel = duck.execute(E.oracle_sql()[key])
    columns, rows = [d[0] for d in rel.description], rel.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert table_hash(df.columns, [tuple(r) for r in df.collect()])[0] == table_hash(columns, rows)[0]


# ---- word hashes

def test_word_hashes_follow_the_word_rule():
    for raw in (b"", b"  \n", b"a b  a\tb\x0b\x0cz\r\n\xc2\xa0x", b"x" * 5000 + b" y " + b"x" * 5000, b"ab " * 800_000, b"q" * 3_000_000):
        h, at = common.word_hashes(raw)
        words = raw.split()
        assert len(h) == len(words) and all(raw[a:a + len(w)] == w for a, w in zip(at[:1000].tolist(), words, strict=False))
        by_word = collections.defaultdict(set)
        for w, x in zip(words, h.tolist(), strict=True):
            by_word[w].add(x)
        assert all(len(x) == 1 for x in by_word.values()) and len({x for own in by_word.values() for x in own}) == len(by_word)


# ---- operator 2

def test_line_dedup_edges(spark):
    footer = "All rights reserved by the owners."
    rows = [(i, f"own line number {i} with words of its own\n{footer}\nanother own line {i} of some length", f"s{i}") for i in range(10)]
    rows += [(100 + i, f"{footer}\nx", f"s{i}") for i in range(9)] + [(200, None, "s"), (201, "", None), (202, "tiny\ntiny", None), (203, (footer + "\n") * 20_000, "s")]
    rows += [(300 + i, "one line that only two sites have in all", f"s{i % 2}") for i in range(30)]
    df = docs(spark, rows).withColumn("n_lines", F.lit("clash"))
    out = lines.dedup_lines(df)
    assert out.columns.count("n_lines") == 1 and out.count() == len(rows)
    got = {r["doc_id"]: r for r in out.collect()}
    assert all(got[i]["n_removed"] == 1 and footer not in got[i]["text"] and got[i]["text"].count("\n") == 1 for i in range(10))
    assert all(got[100 + i]["n_removed"] == 0 for i in range(9))          # mostly boilerplate: left whole
    assert got[200]["text"] is None and got[200]["n_lines"] == 0 and got[201]["text"] == "" and got[202]["n_removed"] == 0
    assert got[203]["n_removed"] == 0 and all(got[300 + i]["n_removed"] == 0 for i in range(30))
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_spread_near_the_threshold_is_exact(spark):
    rows = [(100 * k + i, f"line with a spread of {k} sites\n" + " ".join(prose(random.Random(100 * k + i), 30)), f"s{i}") for k in range(5, 12) for i in range(k)]
    got = {r["doc_id"]: r["n_removed"] for r in lines.dedup_lines(docs(spark, rows)).collect()}
    assert all(n == (d // 100 >= 8) for d, n in got.items())


# ---- operator 4

def test_passages_over_fifty_words_are_found(spark):
    rnd = random.Random(5)
    shared = [prose(rnd, 51 + 3 * k) for k in range(12)]
    rows = [(i, " ".join(prose(rnd, 200)), "s") for i in range(60)]
    hosts = {}
    for k, part in enumerate(shared):
        for j in range(2 + k % 3):
            d = 100 + 10 * k + j
            text = prose(rnd, rnd.randrange(0, 90)) + part + prose(rnd, rnd.randrange(0, 90))
            rows.append((d, " ".join(text).upper() if j else " ".join(text), "s"))
            hosts[d] = 100 + 10 * k
    got = passages.repeated_passages(docs(spark, rows)).collect()
    assert {r["doc_id"] for r in got} == set(hosts)
    # near a passage's ends two later documents may share an anchor that the first one lacks
    assert all(hosts[r["cluster_id"]] == hosts[r["doc_id"]] and r["removed"] == (r["doc_id"] != r["cluster_id"]) for r in got)
    assert {r["doc_id"] for r in got if r["cluster_id"] == hosts[r["doc_id"]]} == set(hosts)


def test_near_equal_paragraphs_and_edges(spark):
    rnd = random.Random(6)
    base = prose(rnd, 120)
    near = base[:60] + ["changed"] + base[61:]
    rows = [(1, "intro\n" + " ".join(base) + "\nend", "a"), (2, " ".join(near), "b"), (3, None, "a"), (4, "", "a"), (5, "short text", "a"), (None, " ".join(prose(rnd, 50)), "a"),
            (6, "\n".join([" ".join(prose(rnd, 40))] * 3), "a"), (7, "again " * 5_000, "a"), (7, "again " * 5_000, "a"), (8, " ".join(prose(rnd, 30_000)), "a")]
    df = docs(spark, rows).withColumn("kind", F.lit("clash"))
    got = passages.repeated_passages(df).collect()
    whole = {r["doc_id"]: r for r in got if r["kind"] == "paragraph"}
    assert set(whole) == {1, 2} and whole[1]["start_word"] == 1 and not whole[1]["removed"] and whole[2]["removed"] and whole[2]["cluster_id"] == 1
    assert {r["doc_id"] for r in got} == {1, 2}
    assert passages.repeated_passages(df.limit(0)).count() == 0


def test_op4_misses_no_document_of_the_table(spark):
    texts = {r["doc_id"]: words_of(r["text"]) for r in spark.read.parquet(f"{MID}/documents.parquet").collect()}
    have = collections.defaultdict(set)
    for d, w in texts.items():
        for i in range(len(w) - 50):
            have[tuple(w[i:i + 51])].add(d)
    must = {d for own in have.values() if len(own) > 1 for d in own}
    assert must <= {r["doc_id"] for r in E.queries()["op4_substring_dedup"](spark, MID).collect()}


# ---- operator 8

def brute_components(rows):
    sets, labels = [], list(range(len(rows)))
    for _, t in rows:
        w = words_of(t)
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())

    def root(i):
        while labels[i] != i:
            i = labels[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                labels[root(i)] = root(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        best[root(i)] = min(best.get(root(i), d), d)
    return {d: (len(sets[i]), best[root(i)]) for i, (d, _) in enumerate(rows)}


def test_components_equal_brute_force_on_hard_families(spark):
    """Chains and a large family whose members are near the threshold, a passage that all share, exact copies, tiny texts."""
    rnd = random.Random(7)
    rows, base, common_part = [], prose(rnd, 160), prose(rnd, 60)
    for _ in range(150):
        text = list(base)
        for _ in range(rnd.randrange(1, 7)):
            text[rnd.randrange(len(text))] = f"e{rnd.randrange(10 ** 6)}"
        rows.append(" ".join(text))
    chain = prose(rnd, 100)
    for _ in range(25):
        chain = chain[4:] + prose(rnd, 4)
        rows.append(" ".join(chain))
    rows += [" ".join(prose(rnd, 70) + common_part + prose(rnd, 20)) for _ in range(120)]
    rows += [rows[3]] * 40 + ["a b c", "A B C", "a b", "a b c d e", "a b c d e f", "", "  ", None, None]
    rnd.shuffle(rows)
    rows = [(i, t) for i, t in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_shingles", F.lit("clash"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in setjoin.linked_components(df).collect()}
    assert got == brute_components(rows)


def test_components_edges(spark):
    df = spark.createDataFrame([(None, "one two three four five six"), (4, "one two three four five six"), (4, "one two three four five six"), (None, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in setjoin.linked_components(df).collect()), key=str)
    assert got == [(0, 0, None), (0, 2, 4), (4, 2, 4), (4, 2, 4)]
    assert setjoin.linked_components(df.limit(0)).count() == 0


def test_pigeonhole_never_misses_a_similar_pair():
    """Any two sets of similarity 0.8 or more share a signature that the smaller one probes."""
    rnd = np.random.default_rng(8)
    for _ in range(400):
        n = int(rnd.integers(1, 400))
        a = rnd.integers(0, 2 ** 63, n, dtype=np.uint64)
        gone = int(rnd.integers(0, n // 5 + 1))
        b = np.concatenate([a[gone:], rnd.integers(0, 2 ** 63, int(rnd.integers(0, n // 5 + 1)), dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        if len(a) > len(b):
            a, b = b, a
        if not len(a) or not setjoin.similar(a, b):
            continue
        own = setjoin._bands(len(a))[0]
        assert own in setjoin._bands(len(b))
        sa, weight = setjoin.signatures(a, own)
        sb, _ = setjoin.signatures(b, own)
        shared = np.unique(sa[np.isin(sa, sb)])
        matched = int(np.where(shared & np.uint64(1) == 1, 2, 1).sum())
        assert matched > weight - (len(a) // 4 + 1)  # more than its slack: giving that up loses nothing


def probed(tokens):
    """Signatures by which a set finds the larger ones, and its weight less what it needs."""
    sigs, weight = setjoin.signatures(tokens, setjoin._bands(len(tokens))[0])
    slack = weight - (len(tokens) // 4 + 1)
    return (sigs if slack >= 0 else np.concatenate([sigs, setjoin.prefix(tokens)])), slack


def test_light_sets_meet_every_similar_set():
    rnd = np.random.default_rng(10)
    light = 0
    for n in [4] * 9_000 + [5, 8, 12, 16, 20, 32, 48, 64] * 150:
        a = np.unique(rnd.integers(0, 2 ** 63, n, dtype=np.uint64))
        sigs, slack = probed(a)
        if slack < 0:
            light += 1
            for _ in range(20):
                b = np.unique(np.concatenate([a, rnd.integers(0, 2 ** 63, n // 4, dtype=np.uint64)]))
                have = np.concatenate([setjoin.signatures(b, k)[0] for k in setjoin._bands(len(b))] + [setjoin.prefix(b)])
                assert setjoin.similar(a, b) and np.isin(sigs, have).any()
    assert light > 20


@pytest.mark.parametrize("n", [96, 128, 130, 192, 256, 300, 512])
def test_larger_sets_are_not_light(n):
    rnd = np.random.default_rng(11)
    assert min(probed(np.unique(rnd.integers(0, 2 ** 63, n, dtype=np.uint64)))[1] for _ in range(3_000)) >= 0


def test_components_of_short_texts_whose_shingles_share_a_segment(spark):
    rnd, rows = random.Random(12), []
    while len(rows) < 60:
        words = prose(rnd, 9)
        a, b = (setjoin.shingle_set(" ".join(words[:k])) for k in (8, 9))
        if not np.isin(setjoin.signatures(a, 2)[0], setjoin.signatures(b, 2)[0]).any():
            rows += [(len(rows), " ".join(words[:8])), (len(rows) + 1, " ".join(words))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in setjoin.linked_components(df).collect()} == {d: d - d % 2 for d, _ in rows}


def test_index_is_built_again_for_a_larger_light_set(spark, monkeypatch):
    asked, build = [], setjoin.index
    monkeypatch.setattr(setjoin, "index", lambda rows, buckets, small: asked.append(small) or build(rows, buckets, small))
    rows, rnd = [], random.Random(13)
    while not rows:
        words = prose(rnd, 8)
        if probed(setjoin.shingle_set(" ".join(words)))[1] < 0:
            rows = [(1, " ".join(words))]
    common.prepare(spark)
    setjoin.whole_index(setjoin.keyed_rows(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text"), small=3)
    assert asked == [3, 4]


def test_components_of_a_long_chain(spark):
    from pickwise.functions.components import component_labels

    rnd = random.Random(9)
    names = list(range(3_000))
    rnd.shuffle(names)
    edges = spark.createDataFrame(list(zip(names, names[1:])) + [(10_000, 10_001), (5, 5)], "a long, b long")
    got = {r["node"]: r["component"] for r in component_labels(edges).collect()}
    assert len(got) == 3_002 and {got[n] for n in names} == {0} and got[10_001] == 10_000


# ---- operator 10

BENCH = [(1, "If Tom has 5 apples and then Ann gives him 7 apples more, how many apples does Tom have?"),
         (2, "A train runs 60 km in 2 hours and stops; how far does it run in 5 hours at that same speed"), (3, "two words"), (4, None), (5, "alpha beta gamma delta"), (5, "")]


def test_templates_catch_other_values_and_check_the_slots(spark):
    rows = [(1, "x y z. If Bob has 9 apples and then Eve gives him 3 apples more, how many apples does Bob have? q"),
            (2, "If Bob has 9 apples and then Eve gives him 3 apples more, how many apples does Sam have?"),
            (3, "A TRAIN RUNS 90 miles in 3 hours and stops; how far does it run in 8 hours at that same speed"), (4, ""), (5, None),
            (6, "they say alpha beta gamma delta ok"), (7, "clean text stands here and nothing is to be seen in it " * 3), (8, BENCH[1][1]), (8, BENCH[1][1]),
            (9, "how many apples does he have " + "far from it all " * 30_000)]
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    df = docs(spark, [(i, t, "s") for i, t in rows]).withColumn("item_id", F.lit("clash"))
    got = {(r["doc_id"], r["item_id"]): (r["n_slots"], r["n_changed"]) for r in decontam.find_leaks(df, bench).collect()}
    assert got == {(1, 1): (4, 4), (3, 2): (5, 4), (6, 5): (0, 0), (8, 2): (5, 0)}
    assert decontam.find_leaks(df.limit(0), bench).count() == 0 == decontam.find_leaks(df, bench.limit(0)).count()


def test_items_made_mostly_of_placeholders(spark):
    """A verbatim copy of numbers counts; an item with few other windows is still found with other numbers."""
    numbers = "Add {} to the sum that he wrote down"
    bench = spark.createDataFrame([(1, "Compute 12 + 45 * 3 - 7"), (2, numbers.format(" ".join(map(str, range(10, 22)))))], "item_id long, text string")
    rows = [(1, "Please compute 12 + 45 * 3 - 7 at once"), (2, "Please compute 13 + 45 * 3 - 7 at once"), (3, numbers.format(" ".join(map(str, range(50, 62))))),
            (4, "nothing but " + " ".join(map(str, range(10, 22)))), (5, "so we add up to the sum")]
    got = {(r["doc_id"], r["item_id"]): r["n_windows"] for r in decontam.find_leaks(docs(spark, [(i, t, "s") for i, t in rows]), bench).collect()}
    assert got == {(1, 1): 1, (3, 2): 4, (4, 2): 6}


def test_op10_equals_brute_force(spark):
    """Items without numbers: leaks are the documents that hold half of an item's 7-word windows, or six."""
    tokens = {d["doc_id"]: re.findall(r"[^\W_]+", d["text"].lower()) for d in spark.read.parquet(f"{MID}/documents.parquet").collect()}
    items = {b["item_id"]: re.findall(r"[^\W_]+", b["text"].lower()) for b in spark.read.parquet(f"{MID}/benchmark.parquet").collect()}
    have = collections.defaultdict(set)
    for d, w in tokens.items():
        for i in range(len(w) - 6):
            have[tuple(w[i:i + 7])].add(d)
    must = set()
    for item, w in items.items():
        windows = [tuple(w[i:i + 7]) for i in range(len(w) - 6)]
        for d in set().union(*(have.get(x, set()) for x in windows)):
            if sum(d in have[x] for x in set(windows)) >= 0.5 * len(windows):
                must.add((d, item))
    got = {(r["doc_id"], r["item_id"]) for r in E.queries()["op10_decontaminate"](spark, MID).collect()}
    assert must and must <= got and len(got - must) <= 2


# ---- pipeline

def test_pipeline_equals_its_stages_by_brute_force(spark):
    source = spark.read.parquet(f"{SMALL}/documents.parquet")
    table = source
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r for r in table.collect()}
        path = common.scratch(spark, "test-stage")
        stage(spark, table, SMALL).write.parquet(path)
        table = spark.read.parquet(path)
        after = {r["doc_id"]: r for r in table.collect()}
        assert table.columns == source.columns and set(after) <= set(before)
        if name == "language_id":
            assert len(after) == len(before)  # every text here is in a learned language
        elif name == "line_dedup":
            spread = collections.defaultdict(set)
            for r in before.values():
                for x in r["text"].split("\n"):
                    if len(x.strip(" \t\r")) >= 15:
                        spread[x.strip(" \t\r")].add(r["source"])
            bad = {x for x, own in spread.items() if len(own) >= 8}
            for d, r in before.items():
                parts = r["text"].split("\n")
                size = sum(len(x.strip(" \t\r")) for x in parts if x.strip(" \t\r") in bad)
                keep = [x for x in parts if x.strip(" \t\r") not in bad] if size <= 0.5 * len(r["text"]) else parts
                assert after[d]["text"] == "\n".join(keep)
        elif name == "near_duplicates":
            groups = brute_components([(d, r["text"]) for d, r in before.items()])
            assert set(after) == {d for d, (_, c) in groups.items() if d == c}
        else:
            leaks = {r["doc_id"] for r in decontam.find_leaks(docs(spark, [(d, r["text"], "s") for d, r in before.items()]),
                                                               spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()}
            assert set(after) == set(before) - leaks
    enc = bpe.Encoder(bpe.Vocabulary(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN))
    out = corpus_pipeline.run(spark, SMALL).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in out} == {d: len(enc.encode(r["text"])) // 4 for d, r in after.items()}


def test_pipeline_stages_on_an_empty_table(spark):
    empty = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SMALL).count() == 0


def test_pipeline_stages_take_nulls_and_repeated_rows(spark):
    leak = spark.read.parquet(f"{SMALL}/benchmark.parquet").first()["text"]
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text, "en", "a", 9), (1, text, "en", "a", 9), (2, text, None, None, None), (None, text, "en", "a", 9), (None, leak, "en", "a", 9),
            (3, None, None, None, None), (4, "", "en", "a", 0), (5, leak, "en", "a", 1), (6, "word " * 30_000, "en", "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)
    assert all(stage[n](spark, df, SMALL).columns == df.columns for n in list(stage)[:-1])
    near = [r["doc_id"] for r in stage["near_duplicates"](spark, df, SMALL).collect()]
    assert sorted(near, key=str) == [1, 3, 4, 5, 6, None, None]
    clean = [r["doc_id"] for r in stage["decontaminate"](spark, df, SMALL).collect()]
    assert sorted(clean) == [1, 1, 2, 3, 4, 6]
    assert sorted(r["doc_id"] for r in stage["language_id"](spark, df, SMALL).where("doc_id in (3, 4)").collect()) == []
