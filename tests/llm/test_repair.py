"""Repair of conversations against a plain search, in blocks of every size, and with every odd case."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest

from ridelake.llm import queries, repair
from ridelake.llm.queries import SQL, op11_conversation_repair
from tests.oracle_check import differences

SCHEMA = "conv_id long, turn long, role string, text string, grp string, pos int, kind string"
WORD = re.compile(r"[^\x20\x09-\x0D]")


def plain_lightest(turns):
    """Cost, audit and result of the cheapest repair of (role, text, fault), by a search over all states from the front."""
    best = {"": (0, "", ())}

    def inserted(states):
        out = dict(states)
        for _ in range(2):
            for seen, (cost, audit, kept) in list(out.items()):
                role = "assistant" if seen == "u" else "user"
                offer(out, role[0], (cost + 3, audit + "I", (*kept, (role, ""))))
        return out

    def offer(states, seen, way):
        if seen not in states or way[:2] < states[seen][:2]:
            states[seen] = way

    for role, text, fault in turns:
        after = {}
        for seen, (cost, audit, kept) in inserted(best).items():
            offer(after, seen, (cost + 4, audit + "D", kept))
            if fault in (0, 3):
                more = cost + fault
                if role and seen + role[:1] in ("s", "u", "su", "ua", "au"):
                    offer(after, role[0], (more, audit + "K", (*kept, (role, text))))
                new = "assistant" if seen == "u" else "user"
                offer(after, new[0], (more + 3, audit + "R", (*kept, (new, text))))
        best = after
    ends = inserted(best)
    return min((ends[s] for s in ("", "a") if s in ends), key=lambda w: w[:2])


def plain(rows):
    """The whole row of every conversation, from rows (conv_id, turn, role, text) after the damage."""
    groups, out = collections.defaultdict(list), {}
    for c, t, r, x in rows:
        groups[c].append((t is not None, t or 0, r if r is not None else " ", x if x is not None else " "))
    for c, turns in groups.items():
        turns.sort(key=lambda t: (*t[:3], hashlib.md5(t[3].encode()).hexdigest()))
        marked, seen = [], set()
        for _, _, role, text in turns:
            last = "".join(WORD.findall(text))[-1:]
            fault = 1 if not last else 2 if (role, text) in seen else 3 if last not in ".!?" else 0
            seen.add((role, text))
            marked.append((role, text, fault))
        numbers = [t[1] for t in turns if t[0]]
        cost, audit, kept = plain_lightest(marked)
        wrong = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in kept).encode()).hexdigest()
        out[c] = (gaps, *(sum(m[2] == k for m in marked) for k in (1, 2, 3)), wrong, cost, audit, digest)
    return out


def random_turns(n, seed):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", "", "ux", None], ["Yes.", "no", " \t\n", "", "Why?\n", "Go!", "é…", None, "end. \x0b\x1f", " "]
    return [
        (rng.choice([1, 1, 2, 3, None]), rng.choice([None, *range(n // 3)]), rng.choice(roles), rng.choice(texts + [f"t{rng.random()}."] * 8), "g", 0, None)
        for _ in range(n)
    ]


@pytest.mark.parametrize("seed", range(40))
def test_lightest_in_blocks(seed):
    rng = random.Random(seed)
    n = rng.randrange(0, 14)
    turns = [(rng.choice(["user", "assistant", "system", "x"]), "", rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(n)]
    want = plain_lightest(turns)[:2]
    roles = "".join("-" if t[0] == "x" else t[0][0] for t in turns)
    for block in (1, 2, 3, 5, 100):
        assert repair.lightest(roles, bytes(t[2] for t in turns), block) == want


def found(turns, block):
    edits = repair.edits(turns, block)
    digests = {r.conv_id: r.digest for r in repair.text_digests(repair.repaired(turns, edits)).collect()}
    none = hashlib.sha256(b"").hexdigest()
    return {r.conv_id: (*r[1:], digests.get(r.conv_id, none)) for r in edits.collect()}


@pytest.mark.parametrize("block", [3, 4096])
def test_edits(spark, block):
    rows = random_turns(120, block)
    turns = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(turns, block) == plain(r[:4] for r in rows)


def test_cut_turn_comes_before_its_copy(spark):
    rows = [(1, 0, "user", "cut", "g", 0, None)] * 3
    assert found(spark.createDataFrame(rows, SCHEMA), 4096) == plain(r[:4] for r in rows)


def test_empty(spark):
    turns = spark.createDataFrame([], SCHEMA)
    assert found(turns, 4096) == {}


def test_long_text_and_many_turns(spark):
    rows = [(7, i, "user" if i % 2 == 0 else "assistant", "word " * 50_000 + f"{i}.", "g", 0, None) for i in range(12)]
    rows += [(8, i, "user" if i % 3 else "assistant", f"{i}.", "g", 0, None) for i in range(900)]
    assert found(spark.createDataFrame(rows, SCHEMA), 64) == plain(r[:4] for r in rows)


def test_query_on_odd_rows(spark, tmp_path):
    rows = random_turns(400, 5) + random_turns(300, 6) + [(77, 5, "user", "x", "g", 0, None)]
    turns = spark.createDataFrame(rows, SCHEMA)
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    damaged = []
    for c, t, r, x, *_ in rows:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        kind = zlib.crc32(key.encode()) % 20
        r, x = (" " if r is None else r), (" " if x is None else x)
        row = (c, t, "user" if kind == 4 else r, "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x)
        damaged += [row] * (0 if kind == 0 else 2 if kind == 3 else 1)
    want = {r[0]: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in rows} | plain(damaged)
    got = op11_conversation_repair(spark, str(tmp_path))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r.conv_id: tuple(r[1:]) for r in got.collect()} == want


def test_query(spark, sf):
    assert differences(op11_conversation_repair(spark, sf), sf, SQL["op11_conversation_repair"]) == []
    assert queries._damaged(spark.read.parquet(f"{sf}/conversations.parquet")).columns == ["conv_id", "turn", "role", "text"]
