"""Operators 11 and 12: conversation repair and the prefix trie, against brute force and SQL."""

import collections
import functools
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as E
from pickwise.llm import prefixtrie, repair
from tools.oracle_check import table_hash

SMALL = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


@pytest.mark.parametrize("key", ["op11_structure_repair", "op12_prefix_trie", "op13_suffix_dedup"])
def test_sql_form(spark, duck, key):
    df = E.queries()[key](spark, SMALL)
    rel = duck.execute(E.oracle_sql()[key])
    columns, rows = [d[0] for d in rel.description], rel.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert table_hash(df.columns, [tuple(r) for r in df.collect()])[0] == table_hash(columns, rows)[0]


# ---- operator 11

GRAMMAR = re.compile("(s?(ua)+)?")


def brute_audits(letters: str):
    """(cost, audit) by trying every edit of every row, up to three insertions in a row."""
    kinds = {c: (f, "suao"[i]) for f, row in repair.FAULTS.items() for i, c in enumerate(row)}

    @functools.lru_cache(maxsize=None)
    def best(i: int, last: str, inserted: int):
        options = []
        if i == len(letters) and last in ("", "a"):
            options.append((0, ""))
        allowed = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        if inserted < 3:
            options += [(2 + c, "I" + a) for r in "ua" if r in allowed for c, a in [best(i, r, inserted + 1)]]
        if i < len(letters):
            fault, role = kinds[letters[i]]
            c, a = best(i + 1, last, 0)
            options.append((3 + c, "D" + a))
            if fault in ("", "truncated"):
                extra = int(fault == "truncated")
                if role in allowed:
                    c, a = best(i + 1, role, 0)
                    options.append((extra + c, "K" + a))
                for r in "ua":
                    if r in allowed:
                        c, a = best(i + 1, r, 0)
                        options.append((2 + extra + c, "R" + a))
        return min(options, default=(10 ** 9, ""))

    return best(0, "", 0)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="suaoSUAO15", max_size=9), min_size=1, max_size=8))
def test_audits_equal_the_search_over_all_edits(signatures):
    ordered = sorted({repr_[::-1] for repr_ in signatures})
    got = {s: (c, a) for s, c, a in repair.solve(iter(ordered))}
    assert got == {s: brute_audits(s) for s in set(signatures)}


def test_long_signatures_are_linear():
    rnd = random.Random(2)
    text = "".join(rnd.choice("suaoSUAO1") for _ in range(200_000))
    (_, cost, audit), = repair.solve(iter([text]))
    assert len(audit.replace("I", "")) == len(text) and 0 < cost < 3 * len(text)
    assert repair.step.cache_info().currsize < 5_000      # few distinct tables: the automaton is small


def brute_repair(rows):
    """The contract, row by row, for rows (conv_id, turn, role, text)."""
    blank = lambda x: " " if x is None else str(x)
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        role, text = blank(role), blank(text)
        own = by[conv]
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, letters, counts = set(), "", collections.Counter()
        for _, role, text in own:
            solid = text.rstrip(SPACE)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated"
            seen.add((role, text))
            counts[fault] += 1
            at = "sua".find(role[0]) if role else -1
            letters += repair.FAULTS[fault][at if at >= 0 else 3]
        initials = [r[1][:1] for r in own]
        illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))
        cost, audit = brute_audits(letters)
        kept, i, told = [], 0, ""
        for e in audit:
            role = "assistant" if told[-1:] == "u" else "user"
            if e == "I":
                kept.append((role, ""))
            else:
                if e != "D":
                    kept.append((own[i][1] if e == "K" else role, own[i][2]))
                i += 1
            told = "".join(r[0][:1] for r in kept)
        assert GRAMMAR.fullmatch(told)
        turns = {r[0] for r in own if r[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest())
    return out


def test_op11_equals_brute_force_on_awkward_rows(spark):
    rnd = random.Random(11)
    rows = []
    for conv in range(60):
        for turn in range(rnd.randrange(1, 9)):
            rows.append((conv, turn * rnd.choice([1, 1, 2]), rnd.choice(["user", "assistant", "system", "tool", "", None]), rnd.choice(["Yes.", "no", " \t", "", None, "Well! \n", "é?", "cut off"])))
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Yes."), (70, None, "user", "first?"), (70, 0, "assistant", "then."), (71, 5, None, None)]
    rows += [(72, 1, "user", "same."), (72, 1, "user", "same."), (72, 1, "user", "same."), (73, 0, "user", "long. " * 50_000)]
    df = spark.createDataFrame(rows, TURNS).withColumn("audit", F.lit("clash")).withColumn("cost", F.lit(1))
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.repair_damaged(df.repartition(7)).collect()}
    want = brute_repair(rows)
    assert got == want and len(got) == len({r[0] for r in rows})
    assert repair.repair_damaged(df.limit(0)).count() == 0


def test_a_conversation_over_many_partitions_is_one(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"turn {i}.") for i in range(2_000)] + [(2, 0, "assistant", "x.")]
    df = spark.createDataFrame(rows, TURNS)
    plans = {r["conv_id"]: r for r in repair.plan_repairs(df).collect()}
    assert plans[1]["audit"] == "K" * 2_000 and plans[1]["cost"] == 0 and plans[2]["audit"] == "IK"
    kept = repair.repaired_rows(df, repair.plan_repairs(df)).where("conv_id = 1").orderBy("at").collect()
    assert [r["text"] for r in kept] == [r[3] for r in rows[:2_000]]


# ---- operator 12

@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=700))
def test_find_close_equals_a_stack(steps):
    depth = [0]
    for s in steps:
        depth.append(max(1, min(depth[-1] + 1, depth[-1] + 2 - s)))
    trie = prefixtrie.Parentheses(np.array(depth))
    want, stack, at = [0] * len(depth), [], 0
    for i, d in enumerate(depth):
        while len(stack) > d:
            want[stack.pop()] = at
            at += 1
        assert trie.opens[i] == at
        stack.append(i)
        at += 1
    while stack:
        want[stack.pop()] = at
        at += 1
    assert trie.find_close().tolist() == want


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text))


def brute_rebuilt(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, role, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), text))
    path = {c: [(t[2], t[4]) for t in sorted(v, key=lambda t: t[:4])] for c, v in own.items()}
    out = {}
    for c, turns in path.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = tuple(path.get(c - c % 20, [])[:h] + turns[h:])
    return out


def brute_trie(walks):
    members = collections.defaultdict(list)
    for c, path in walks.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    nodes = []
    for node, own in members.items():
        below = [n for n in members if n[:len(node)] == node]
        kids = {n for n in below if len(n) == len(node) + 1}
        leaves = [n for n in below if not any(m[:len(n)] == n and len(m) > len(n) for m in members)]
        saved = sum((len(members[n]) - 1) * words(n[-1][1]) for n in below if n)
        ends = ",".join(str(c) for c in sorted(c for c in own if walks[c] == node))
        nodes.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(nodes, key=str)


def test_op12_equals_brute_force_in_chunks_of_any_size(spark):
    rnd = random.Random(12)
    said = [("user", "a b"), ("assistant", "c d e"), ("user", ""), (None, None), ("system", " x\ty "), ("user", "a b.")]
    rows = [(c, t, *rnd.choice(said[:2 if t < 2 else 6])) for c in range(130) for t in range(rnd.randrange(1, 7)) if c % 20 or c > 60]
    rows += [(400 + i, t, "user", f"copy {t}") for i in range(40) for t in range(5)] + [(None, 0, "user", "lost"), (500, None, "user", "z"), (500, 0, "user", "y"), (501, 3, "user", "y"), (501, 3, "user", "y")]
    rows += [(600, t, "user", f"turn {t}") for t in range(300)] + [(601, t, "user", f"turn {t}") for t in range(250)]
    df = spark.createDataFrame(rows, TURNS).withColumn("depth", F.lit("clash"))
    walks = brute_rebuilt(rows)
    want = brute_trie(walks)
    turns = prefixtrie.rebuilt(prefixtrie.paths(df.repartition(5)))
    for chunk in (1, 7, 1 << 18):
        assert sorted((tuple(r) for r in prefixtrie.trie(turns, chunk).collect()), key=str) == want
    assert sorted((tuple(r) for r in prefixtrie.rebuilt_trie(df).collect()), key=str) == want
    assert prefixtrie.rebuilt_trie(df.limit(0)).count() == 0


def test_turnless_conversations_end_at_the_root(spark):
    lone = next(c for c in range(1, 1000) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    row, = prefixtrie.rebuilt_trie(spark.createDataFrame([(lone, 0, "user", "x")], TURNS)).collect()
    assert tuple(row) == (lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())
