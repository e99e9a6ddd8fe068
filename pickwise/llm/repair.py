"""Operator 11: cheapest repair of conversation structure over a suffix-shared automaton.

Signatures. Every row of a conversation becomes one letter: its role's initial (s, u, a, other)
and its first fault. Range partitions sorted by conversation and turn write these letters down
in order; a conversation's signature is the pieces of its partitions put together, one byte a row.

Automaton. Conversations with one signature are solved once. The distinct signatures are sorted
from their ends, so signatures with a common suffix lie side by side; a node is a distinct suffix,
visited once in a range of that order, and holds for each grammar state the cost to go and the edit that
the best audit starts with. Nodes whose tables differ by a constant only are one state of the
minimised automaton, so a step is computed once for all of them. The four edits of a state start
with different letters, so the least letter among the cheapest edits gives the ASCII-least audit.

Texts are never gathered: a sorted partition streams past, and the audit of a conversation, sent
ahead of its rows, says what happens to each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pickwise.llm.common import SPACES, prepare, stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1      # costs
START, SYSTEM, USER, ASSISTANT = range(4)                     # grammar states, named by the last role
FINAL = (START, ASSISTANT)
NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
ROLE = {USER: "user", ASSISTANT: "assistant"}
FAULTS = {"": "suao", "truncated": "SUAO", "blank": "1234", "duplicate": "5678"}
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def damage(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of ``turns`` after damage by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 removes ``[.!?]``, 3 repeats the row, 4 sets role user.
    Null parts of the hashed key, null roles and null texts count as one space; conv_id and turn
    themselves stay null."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind = F.crc32(key) % 20
    text = F.coalesce("text", blank)
    return (turns.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
            .select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
                    F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy"))


def _order(*more: str) -> list[Column]:
    """Rows of a conversation: by turn (nulls first), role, SHA-256 of the text."""
    return [F.col("conv_id").asc_nulls_first(), *(F.col(c) for c in more), F.col("turn").asc_nulls_first(), F.col("role"), F.col("sha")]


def _rows(turns: DataFrame) -> DataFrame:
    blank = F.lit(" ")
    return (turns.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
            .withColumn("sha", F.unhex(F.sha2("text", 256))))


def lettered(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, sha, letters): one row per distinct (turn, role, text), with a letter per repetition.

    Repetitions are counted before the shuffle. A row is a duplicate when an equal role and text has
    an earlier turn, or comes before it in the same turn."""
    solid = F.rtrim("text", F.lit(SPACES))
    same = (_rows(turns).withColumn("fault", F.when(solid == "", "blank").when(~F.substring(solid, -1, 1).isin(".", "!", "?"), "truncated").otherwise(""))
            .groupBy("conv_id", "turn", "role", "sha", "fault").agg(F.count(F.lit(1)).cast("int").alias("n")))
    same = stored(same, "conversation-rows")
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))
    again = (same.where("fault <> 'blank'").groupBy("conv_id", "role", "sha").agg(F.min(when).alias("first"), F.count(F.lit(1)).alias("places"))
             .where("places > 1").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("sha").alias("s"), "first"))
    joined = same.join(stored(again, "conversation-repeats"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("sha") == F.col("s")), "left")
    late = F.coalesce(when > F.col("first"), F.lit(False))
    kind = F.instr(F.lit("sua"), F.substring("role", 1, 1))
    kind = F.when((F.length("role") == 0) | (kind == 0), 4).otherwise(kind)

    def letter(fault: str) -> Column:
        return F.substring(F.lit(FAULTS[fault]), kind, F.lit(1))

    first = F.when(F.col("fault") == "blank", letter("blank")).when(late, letter("duplicate")).when(F.col("fault") == "truncated", letter("truncated")).otherwise(letter(""))
    rest = F.when(F.col("fault") == "blank", letter("blank")).otherwise(letter("duplicate"))
    return joined.select("conv_id", "turn", "role", "sha", F.concat(first, F.repeat(rest, F.col("n") - 1)).alias("letters"))


def signatures(turns: DataFrame) -> DataFrame:
    """(conv_id, signature) of every conversation with a row.

    A conversation that is larger than a range partition has one piece in each, so no task holds more
    than its own rows; the pieces, one byte a row like the audit itself, are put together by their order."""
    rows = lettered(turns)
    kind = rows.schema["conv_id"].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        open_id, piece, begun = None, [], False
        for batch in batches:
            ids, own = [], []
            for conv, letters in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if begun and conv != open_id:
                    ids.append(open_id)
                    own.append("".join(piece))
                    piece = []
                open_id, begun = conv, True
                piece.append(letters)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array([part] * len(ids), pa.int32()), pa.array(own, pa.string())], ["conv_id", "part", "piece"])
            last = batch.column(0).type
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([open_id], last), pa.array([part], pa.int32()), pa.array(["".join(piece)], pa.string())], ["conv_id", "part", "piece"])

    pieces = (rows.repartitionByRange(*_order()).sortWithinPartitions(*_order()).select("conv_id", "letters")
              .mapInArrow(write, f"conv_id {kind}, part int, piece string"))
    ordered = F.array_sort(F.collect_list(F.struct("part", "piece")))
    return pieces.groupBy("conv_id").agg(F.concat_ws("", F.transform(ordered, lambda x: x["piece"])).alias("signature"))


# ---- the automaton

def _target(state: int) -> int:
    """State after an inserted or re-roled row: only one of user and assistant may follow."""
    return ASSISTANT if state == USER else USER


def _inserted(costs: list[int], edits: list[str]) -> tuple[tuple[int, ...], str]:
    """Tables after insertions: they lead from any state to user, and to and fro between user and assistant."""
    plain = list(costs)
    for state in (USER, ASSISTANT, START, SYSTEM):
        via = INSERT + (plain[_target(state)] if state in (USER, ASSISTANT) else costs[USER])
        if (via, "I") < (costs[state], edits[state]):
            costs[state], edits[state] = via, "I"
    return tuple(costs), "".join(edits)


@lru_cache(maxsize=1 << 16)
def step(costs: tuple[int, ...], letter: str) -> tuple[tuple[int, ...], str]:
    """(costs, edits) of the node that puts ``letter`` before a node with ``costs``."""
    out, edits = [], []
    fault, at = next((f, row.index(letter)) for f, row in FAULTS.items() if letter in row)
    for state in range(4):
        options = [(DELETE + costs[state], "D")]
        if fault in ("", "truncated"):
            extra = TRUNCATED if fault else 0
            kept = NEXT.get("sua "[at], {}).get(state)
            if kept is not None:
                options.append((KEEP + extra + costs[kept], "K"))
            options.append((REROLE + extra + costs[_target(state)], "R"))
        cost, edit = min(options)
        out.append(cost)
        edits.append(edit)
    return _inserted(out, edits)


#: The empty suffix: "." stops.
END = _inserted([0, 1 << 60, 1 << 60, 0], [".", "?", "?", "."])


def reduced(signature: Column) -> Column:
    """Rows that must go differ by nothing that matters."""
    return F.translate(signature, "2345678", "1111111")


def audit_of(signature: str, tables: list[str]) -> str:
    """The best audit: ``tables[i]`` holds the edits of the suffix of i letters."""
    out, state, left = [], START, len(signature)
    while True:
        edit = tables[left][state]
        if edit == ".":
            return "".join(out)
        out.append(edit)
        if edit == "K":
            state = NEXT[signature[-left].lower()][state]
        elif edit != "D":
            state = _target(state)
        left -= edit != "I"


def solve(signatures_from_end: Iterator[str]) -> Iterator[tuple[str, int, str]]:
    """(signature, cost, audit) of signatures sorted by their reversed text; a shared suffix is solved once."""
    tables, state, base, before = [END[1]], [END[0]], [0], ""
    for backwards in signatures_from_end:
        shared = 0
        for x, y in zip(before, backwards, strict=False):
            if x != y:
                break
            shared += 1
        del tables[shared + 1:], state[shared + 1:], base[shared + 1:]
        for letter in backwards[shared:]:
            costs, edits = step(state[-1], letter)
            least = min(costs)
            state.append(tuple(c - least for c in costs))
            base.append(base[-1] + least)
            tables.append(edits)
        before = backwards
        yield backwards[::-1], base[-1] + state[-1][START], audit_of(backwards[::-1], tables)


def audits(signed: DataFrame) -> DataFrame:
    """(signature, cost, audit) of the distinct values of column ``signature``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> Iterator[str]:
            for batch in batches:
                yield from batch.column(0).to_pylist()

        found: list[tuple] = []
        size = 0
        for row in solve(told()):
            found.append(row)
            size += len(row[0])
            if len(found) >= 4096 or size > 1 << 22:
                yield _solved(found)
                found, size = [], 0
        if found:
            yield _solved(found)

    distinct = signed.select(F.reverse("signature").alias("backwards")).distinct()
    return distinct.repartitionByRange("backwards").sortWithinPartitions("backwards").mapInArrow(run, "signature string, cost long, audit string")


def _solved(rows: list[tuple]) -> pa.RecordBatch:
    signature, cost, audit = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(signature, pa.string()), pa.array(cost, pa.int64()), pa.array(audit, pa.string())], ["signature", "cost", "audit"])


def plan_repairs(turns: DataFrame) -> DataFrame:
    """(conv_id, blank, duplicate, truncated, illegal, cost, audit) of every conversation of ``turns``.

    Rows are taken by turn (nulls first), rows of one turn by role, then by SHA-256 of their text.
    Null roles and texts count as one space; null conv_ids are one conversation; other columns are
    ignored; an empty table gives no rows. A row with an empty role has an initial that fits nowhere."""
    prepare(turns.sparkSession)
    known = stored(signatures(turns), "signatures")
    sig = F.col("signature")
    plans = stored(audits(known.select(reduced(sig).alias("signature"))), "audits")
    initials = F.translate(sig, "SUAO12345678", "suaosuaosuao")
    legal = sum((F.regexp_count(initials, F.lit(pair)) for pair in ("su", "ua", "au")), F.lit(0))
    counted = known.select("conv_id", reduced(sig).alias("signature"), *(F.regexp_count(sig, F.lit(f"[{FAULTS[f]}]")).cast("long").alias(f) for f in ("blank", "duplicate", "truncated")),
                           (F.length(sig) - 1 - legal).cast("long").alias("illegal"))
    return counted.join(plans, "signature").drop("signature")


def repaired_rows(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_id, at, edit, role, text): the rows that stay or are put in, each conversation's in order and together.

    Audits travel ahead of the rows that they judge. A task streams its sorted rows and holds one audit
    and one batch; a conversation's rows follow each other in one partition, ``at`` counts them from 0."""
    rows = _rows(turns)
    kind = rows.schema["conv_id"].dataType.simpleString()
    heads = plans.select("conv_id", F.lit(0).alias("body"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.lit(b"").alias("sha"), F.col("audit").alias("text"))
    both = heads.unionByName(rows.select("conv_id", F.lit(1).alias("body"), "turn", "role", "sha", "text"))

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, next_edit, state = None, "", 0, 0, START
        for batch in batches:
            out: list[tuple] = []
            kind_of_id = batch.column(0).type

            def put(edit: str, role: str, text: str) -> None:
                nonlocal at, state
                out.append((conv, at, edit, role, text))
                at += 1
                state = {"u": USER, "a": ASSISTANT}.get(role[:1], SYSTEM)

            def insertions() -> None:
                nonlocal next_edit
                while next_edit < len(audit) and audit[next_edit] == "I":
                    put("I", ROLE[_target(state)], "")
                    next_edit += 1

            for own, body, role, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if not body:
                    conv, audit, at, next_edit, state = own, text, 0, 0, START
                else:
                    said = audit[next_edit]
                    next_edit += 1
                    if said == "K":
                        put("K", role, text)
                    elif said == "R":
                        put("R", ROLE[_target(state)], text)
                insertions()
            if out:
                ids, ats, edits, roles, texts = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, kind_of_id), pa.array(ats, pa.int64()), *(pa.array(c, pa.string()) for c in (edits, roles, texts))],
                                                 ["conv_id", "at", "edit", "role", "text"])

    return (both.repartition("conv_id").sortWithinPartitions(*_order("body")).select("conv_id", "body", "role", "text")
            .mapInArrow(edit, f"conv_id {kind}, at long, edit string, role string, text string"))


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of rows as ``repaired_rows`` leaves them: ``role:text`` joined by newlines, hashed as they stream past."""
    kind = repaired.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, running, last = None, None, None
        for batch in batches:
            ids, found, last = [], [], batch.column(0).type
            for own, at, role, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if at == 0:
                    if running:
                        ids.append(conv)
                        found.append(running.hexdigest())
                    conv, running = own, hashlib.sha256()
                else:
                    running.update(b"\n")
                running.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array(ids, last), pa.array(found, pa.string())], ["conv_id", "repaired_sha256"])
        if running:
            yield pa.RecordBatch.from_arrays([pa.array([conv], last), pa.array([running.hexdigest()], pa.string())], ["conv_id", "repaired_sha256"])

    return repaired.select("conv_id", "at", "role", "text").mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def repair_damaged(turns: DataFrame) -> DataFrame:
    """Counts, cheapest audit and digest of the repaired rows for every conv_id of ``turns``, after damage.

    A conversation that loses all its rows has zeros, an empty audit and the empty text's digest.
    ``gaps`` counts the turns missing between the least and the largest (0 when all are null)."""
    prepare(turns.sparkSession)
    own = turns.select("conv_id", "turn", "role", "text")
    after = damage(own)
    plans = stored(plan_repairs(after), "repair-plans")
    sums = stored(digests(repaired_rows(after, plans)), "repair-digests")
    spans = after.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    out = own.select(F.col("conv_id").alias("id")).distinct()
    for right in (spans, plans, sums):
        right = right.withColumnRenamed("conv_id", "__right")
        out = out.join(right, F.col("id").eqNullSafe(F.col("__right")), "left").drop("__right")
    counts = [F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(EMPTY_SHA)).alias("repaired_sha256"))
