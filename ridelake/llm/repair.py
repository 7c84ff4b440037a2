"""Cheapest repair of conversations by Knuth's lightest derivations.

A conversation should read as an optional system turn and then pairs of user and
assistant. Items are (turns from here to the end, what the grammar has seen so far);
a deduction joins an item and an edit of the turn before it, or an inserted turn, to
an item with one turn more. Items are popped from an agenda by (cost, turns taken,
edit), in which every deduction ranks above what it is made of, so an item is final
when it is popped, and the agenda ends with the item of the whole conversation.

Deductions run from the last turn to the first: an edit is put before an audit that is
already least, and the edits that can begin one item differ in their letters, so the
least letter at equal cost makes the least audit. Long conversations are dealt out in
blocks of turns. A block passes through an agenda for each of the four states it may
end in, and sends on the costs between its states and the order of its audits; the
cheapest way through the blocks then names the audit of each.

A block's turns meet as a letter and a fault each. The texts of a conversation pass
through one task as a stream, since a digest of the whole is a chain; they are never held.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridelake.llm.common import positions, short_batches, stage

#: Costs of edits, and what a truncated turn adds if it stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Turns that pass through the agenda together.
BLOCK = 4096
#: White space between words.
BLANKS = " \t\n\x0b\x0c\r"

# What the grammar has seen: nothing, a system turn, a user's, an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The one role that can follow by an inserted or renamed turn.
FOLLOWS = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
NAMES = {"u": "user", "a": "assistant"}
#: By state: those that reach it by a turn of a role.
_BEFORE = {q: [(p, x) for (p, x), to in NEXT.items() if to == q] for q in range(4)}

FAULTS = ("none", "blank", "duplicate", "truncated")
#: Neighbours that may stand together.
LEGAL = ("su", "ua", "au")


def _agenda(turns: list[tuple[str, int]], ends: list[int | None], last: bool, goals: set[int]) -> tuple[list[int | None], bytearray]:
    """Costs of the items before the first of ``turns`` (role letter, fault) and the edit each item begins with.

    ``ends`` are the final costs of the items after the last turn. After the conversation's ``last`` turn
    inserted ones may follow. It stops when the items ``goals`` before the first turn are final.
    """
    n = len(turns)
    edits, costs, left = bytearray(4 * (n + 1)), {}, set(goals)
    agenda = [(c, 0, "", n, q) for q, c in enumerate(ends) if c is not None]
    heapq.heapify(agenda)
    while agenda and left:
        cost, taken, edit, i, q = heapq.heappop(agenda)
        if (i, q) in costs:
            continue
        costs[i, q] = cost
        edits[4 * i + q] = ord(edit) if edit else 0
        if not i:
            left.discard(q)
        if i < n or last:
            for p, x in _BEFORE[q]:
                if x != "s":
                    heapq.heappush(agenda, (cost + INSERT, taken, "I", i, p))
        if i:
            role, fault = turns[i - 1]
            heapq.heappush(agenda, (cost + DELETE, taken + 1, "D", i - 1, q))
            if fault in (0, 3):
                more = TRUNCATED if fault == 3 else 0
                for p, x in _BEFORE[q]:
                    if x == role:
                        heapq.heappush(agenda, (cost + more, taken + 1, "K", i - 1, p))
                    if x != "s":
                        heapq.heappush(agenda, (cost + more + REROLE, taken + 1, "R", i - 1, p))
    return [costs.get((0, q)) for q in range(4)], edits


def _audit(roles: str, edits: bytearray, state: int, last: bool) -> str:
    """The edits from the item (before the first turn, ``state``) on, as its derivation has them."""
    audit, i, n = [], 0, len(roles)
    while i < n or last and edits[4 * i + state]:
        edit = chr(edits[4 * i + state])
        audit.append(edit)
        if edit != "D":
            state = NEXT[state, roles[i] if edit == "K" else FOLLOWS[state]]
        i += edit != "I"
    return "".join(audit)


def _block(roles: str, faults: bytes, first: bool, last: bool) -> tuple[list[int | None], list[str | None]]:
    """Cost and audit from each state before a block of turns (places ``4 * before + after``) to each state after it.

    A last block ends with the conversation, so it has one end only, at place ``4 * before``. A first block has only
    the state START before it. Turns are inserted before a turn of the block or at the very end, so that audits to
    different ends differ before either is over.
    """
    costs, audits = [None] * 16, [None] * 16
    for after in range(1 if last else 4):
        ends = [0, None, None, 0] if last else [0 if q == after else None for q in range(4)]
        found, edits = _agenda(list(zip(roles, faults)), ends, last, {START} if first else {0, 1, 2, 3})
        for before, cost in enumerate(found):
            if cost is not None and not (first and before):
                costs[4 * before + after], audits[4 * before + after] = cost, _audit(roles, edits, before, last)
    return costs, audits


def _path(costs: list[list[int | None]], ranks: list[list[int]]) -> tuple[int, list[int]]:
    """Cost of a whole conversation and the place that each of its blocks takes, from the costs and audit ranks of the blocks."""
    best, steps = [costs[-1][4 * p] for p in range(4)], []
    for cost, rank in zip(reversed(costs[:-1]), reversed(ranks[:-1])):
        step = []
        for p in range(4):
            ways = [(cost[4 * p + q] + best[q], rank[4 * p + q], q) for q in range(4) if cost[4 * p + q] is not None and best[q] is not None]
            step.append(min(ways, default=(None, 0, 0)))
        best = [s[0] for s in step]
        steps.append([s[2] for s in step])
    at, places = START, []
    for step in reversed(steps):
        places.append(4 * at + step[at])
        at = step[at]
    return best[START], [*places, 4 * at]


def _ranks(audits: list[str | None]) -> list[int]:
    order = {a: i for i, a in enumerate(sorted({a for a in audits if a is not None}))}
    return [order.get(a, 0) for a in audits]


def lightest(roles: str, faults: bytes, block: int = BLOCK) -> tuple[int, str]:
    """Cost and audit of the cheapest repair of turns, given as role initials and places in ``FAULTS``."""
    n, found = len(roles), []
    for start in range(0, n or 1, block):
        found.append(_block(roles[start : start + block], faults[start : start + block], not start, start + block >= n))
    cost, places = _path([c for c, _ in found], [_ranks(a) for _, a in found])
    return cost, "".join(audits[place] for (_, audits), place in zip(found, places))


def _marked(turns: DataFrame) -> DataFrame:
    """Turns with role letter, fault and the columns they are ordered by; null roles and texts count as one space."""
    turns = turns.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    return turns.withColumns({"first": F.substring("role", 1, 1), "print": F.md5(F.col("text").cast("binary"))})


def _trimmed(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANKS))


def _costed(blocks: DataFrame) -> DataFrame:
    """The blocks with what each can do: costs, audits and their ranks by place, and its neighbours that are illegal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, block, blocks, initials, faults in zip(*(c.to_pylist() for c in batch.columns)):
                roles = "".join(x if x in ("s", "u", "a") else "-" for x in initials)
                costs, audits = _block(roles, bytes(faults), not block, block == blocks - 1)
                wrong = sum(x + y not in LEGAL for x, y in zip(initials, initials[1:]))
                out.append((name, block, blocks, costs, _ranks(audits), audits, initials[0], initials[-1], wrong))
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)

    kind = dict(blocks.dtypes)["grp"]
    schema = f"grp {kind}, block long, blocks long, costs array<long>, ranks array<long>, audits array<string>, head string, tail string, wrong long"
    names = [part.split()[0] for part in schema.split(", ")]
    return blocks.mapInArrow(run, schema)


def _joined(blocks: DataFrame) -> DataFrame:
    """grp, cost, audit and illegal of each conversation from its blocks; a block sends on a few numbers, and audits are put together last."""
    one = blocks.filter("blocks = 1")
    one = one.select("grp", F.col("costs")[0].alias("cost"), F.col("audits")[0].alias("audit"), F.col("wrong").alias("illegal"))
    more = blocks.filter("blocks > 1")
    kind = dict(blocks.dtypes)["grp"]
    lines = more.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("block", "costs", "ranks", "head", "tail", "wrong"))).alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, line in zip(*(c.to_pylist() for c in batch.columns)):
                cost, places = _path([x["costs"] for x in line], [x["ranks"] for x in line])
                between = sum(x["tail"] + y["head"] not in LEGAL for x, y in zip(line, line[1:]))
                out.append((name, cost, places, between + sum(x["wrong"] for x in line)))
            kinds = [batch.schema.field(0).type, pa.int64(), pa.list_(pa.int64()), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["grp", "cost", "places", "illegal"])

    ways = lines.mapInArrow(run, f"grp {kind}, cost long, places array<long>, illegal long")
    ways = ways.select(F.col("grp").alias("g"), "cost", "illegal", F.posexplode("places").alias("b", "place"))
    pieces = more.join(ways, F.col("grp").eqNullSafe(F.col("g")) & (F.col("block") == F.col("b")))
    pieces = pieces.select("grp", "block", "cost", "illegal", F.col("audits")[F.col("place")].alias("piece"))
    audit = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "piece"))), lambda x: x["piece"]), "")
    long = pieces.groupBy("grp").agg(F.first("cost").alias("cost"), audit.alias("audit"), F.first("illegal").alias("illegal"))
    return one.unionByName(long)


def edits(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of each conversation in ``turns``.

    Takes conv_id, turn, role and text and ignores other columns. Turns are ordered by turn, nulls first;
    those of one turn by role and a digest of the text. A null role or text counts as one space. A turn's first fault
    counts: blank, duplicate (same role and text before it), truncated (no ``.!?`` at the end). Gaps are the
    numbers missing between the smallest and the largest turn; illegal, the neighbours that are not
    system-user, user-assistant or assistant-user. The audit has a letter for each edit: Delete, Insert, Keep
    or Rerole. Turns without a conversation make one of their own; no turns give no rows.
    """
    short_batches(turns.sparkSession)
    rows = _marked(turns)
    end = F.right(_trimmed(F.col("text")), F.lit(1))
    rows = rows.select("conv_id", "turn", "role", "first", "print", (end == "").alias("blank"), (~end.isin(".", "!", "?")).alias("cut"))
    # Equal turns are numbered without being held; the first of them is no duplicate.
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "print").orderBy("turn")) > 1
    fault = F.when(F.col("blank"), 1).when(F.col("again"), 2).when(F.col("cut"), 3).otherwise(0)
    rows = rows.withColumn("again", again).select(F.col("conv_id").alias("grp"), F.col("turn").cast("long").alias("turn"), "role", "print", "again", "first", fault.alias("fault"))
    placed = positions(rows, ["turn", "role", "print", "again"])

    by_turn = placed.groupBy("grp", "turn").agg(*(F.count(F.when(F.col("fault") == k, 1)).alias(name) for k, name in enumerate(FAULTS) if k))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
    counts = by_turn.groupBy("grp").agg(gaps.alias("gaps"), *(F.sum(name).alias(name) for name in FAULTS[1:]))

    in_order = F.sort_array(F.collect_list(F.struct("pos", "first", "fault")))
    blocks = placed.groupBy("grp", F.expr(f"pos div {block}").alias("block"), F.expr(f"(total - 1) div {block} + 1").alias("blocks")).agg(in_order.alias("x"))
    blocks = stage(_costed(blocks.select("grp", "block", "blocks", "x.first", "x.fault")), "blocks")
    found = _joined(blocks).withColumnRenamed("grp", "g")
    return counts.join(found, F.col("grp").eqNullSafe(F.col("g"))).select(F.col("grp").alias("conv_id"), "gaps", *FAULTS[1:], "illegal", "cost", "audit")


def repaired(turns: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the turns of each conversation after the edits that ``found`` has for it.

    Rows of a conversation are in one partition, in order. ``found`` has conv_id and audit, as ``edits`` gives them
    for the same turns; a conversation that keeps nothing has no rows.
    """
    short_batches(turns.sparkSession)
    kind = dict(turns.dtypes)["conv_id"]
    texts = _marked(turns).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "print", "text")
    audits = found.select("conv_id", F.lit(0).alias("kind"), F.lit(None).alias("turn"), F.lit(None).alias("role"), F.lit(None).alias("print"), F.col("audit").alias("text"))
    rows = audits.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "print")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, audit, at, q, place = None, "", 0, START, 0

        def inserted():
            nonlocal at, q, place
            while at < len(audit) and audit[at] == "I":
                yield name, place, NAMES[FOLLOWS[q]], ""
                q, at, place = NEXT[q, FOLLOWS[q]], at + 1, place + 1

        for batch in batches:
            out = []
            for conv, row, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text"))):
                if row == 0:
                    name, audit, at, q, place = conv, text, 0, START, 0
                    out += inserted()
                    continue
                edit, at = audit[at], at + 1
                if edit != "D":
                    role = role if edit == "K" else NAMES[FOLLOWS[q]]
                    out.append((name, place, role, text))
                    q, place = NEXT[q, role[:1]], place + 1
                out += inserted()
            types = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], ["conv_id", "place", "role", "text"])

    return rows.select("conv_id", "kind", "role", "text").mapInArrow(run, f"conv_id {kind}, place long, role string, text string")


def text_digests(rows: DataFrame) -> DataFrame:
    """(conv_id, digest): SHA-256 of ``role:text`` joined by newlines, of turns in order as ``repaired`` gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, digest, done, kind = None, None, [], pa.string()
        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, place, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if not place:
                    if digest:
                        done.append((name, digest.hexdigest()))
                    name, digest = conv, hashlib.sha256()
                digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done])], ["conv_id", "digest"])
                done = []
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([name], kind), pa.array([digest.hexdigest()])], ["conv_id", "digest"])

    return rows.mapInArrow(run, f"conv_id {dict(rows.dtypes)['conv_id']}, digest string")
