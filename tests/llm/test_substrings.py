"""Repeated windows of words against a plain version, over slabs and buckets of a few words, and with every odd case."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from ridelake.llm import substrings
from ridelake.llm.packing import pack, pack_bits, pack_words, unpack, unpack_bits, unpack_words
from ridelake.llm.queries import SQL, op12_substring_dedup
from tests.conftest import plan_of
from tests.oracle_check import differences

SCHEMA = "doc_id long, text string, slab int, n int, words string, marks string"


def plain(rows, length):
    """(doc_id, n_words, n_removed, kept) of rows (doc_id, text)."""
    texts = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    place = lambda i, k: (i is not None, i or 0, k)
    first = {}
    for i, words in texts:
        for k in range(len(words) - length + 1):
            window = tuple(words[k : k + length])
            first[window] = min(first.get(window, place(i, k)), place(i, k))
    out = []
    for i, words in texts:
        gone = set()
        for k in range(len(words) - length + 1):
            if first[tuple(words[k : k + length])] < place(i, k):
                gone.update(range(k, k + length))
        out.append((i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return sorted(out, key=str)


def made(seed, n=80):
    rng = random.Random(seed)
    words = ["a", "b", "Ä", "日本", "x\x1f", "é"]
    blanks = [" ", "  ", "\t", "\n", "\x0b \x0c", "\r\n"]
    passages = [[rng.choice(words) for _ in range(rng.randrange(1, 25))] for _ in range(6)]
    rows = [(None, None), (None, "a b c d e f g h i j k"), (None, "a b c d e f g h i j k"), (7, ""), (7, " \n"), (8, None)]
    for i in range(n):
        parts = [w for _ in range(rng.randrange(4)) for w in (rng.choice(passages) if rng.random() < 0.6 else [f"w{rng.random()}", *rng.choices(words, k=5)])]
        rows.append((rng.choice([None, i, i, i, 3]), rng.choice(["", " "]) + "".join(w + rng.choice(blanks) for w in parts)))
    rows += [(500, "z " * 300), (501, "z " * 40), (500, "z " * 300)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", None) for r in rows], SCHEMA)


@pytest.mark.parametrize(
    ("length", "start", "slab_words", "bucket_windows"),
    [(20, 5, 1 << 20, 1 << 21), (20, 5, 64, 100), (8, 1, 40, 30), (7, 2, 64, 100), (3, 5, 1 << 20, 50), (1, 1, 100, 100)],
)
def test_dedup(spark, length, start, slab_words, bucket_windows):
    rows = made(length + slab_words)
    found = substrings.dedup(frame(spark, rows).repartition(3), length, start, slab_words, bucket_windows)
    assert found.columns == ["doc_id", "n_words", "n_removed", "text"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain(rows, length)


def test_one_passage_in_a_third_of_the_rows(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(i, f"{passage} tail {i}" if i % 3 == 0 else " ".join(f"{i}-{k}" for k in range(40))) for i in range(900)]
    found = substrings.dedup(frame(spark, rows).repartition(4), slab_words=2000, bucket_windows=1000)
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain(rows, 20)


def test_very_long_text(spark):
    body = " ".join(str(k) for k in range(200_000))
    rows = [(2, body), (1, "head " + " ".join(str(k) for k in range(100_000, 100_050))), (3, "w" * 3_000_000)]
    found = {r.doc_id: r for r in substrings.dedup(frame(spark, rows), slab_words=1000).collect()}
    assert [found[i].n_removed for i in (1, 2, 3)] == [0, 50, 0]
    assert found[2].text == " ".join(str(k) for k in range(200_000) if not 100_000 <= k < 100_050)


def test_nothing_repeated_ends_the_search(spark):
    rows = [(i, " ".join(f"{i}-{k}" for k in range(50))) for i in range(5)]
    assert sorted((tuple(r) for r in substrings.dedup(frame(spark, rows)).collect()), key=str) == plain(rows, 20)


def test_empty(spark):
    assert substrings.dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_slabs_are_not_moved_again(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(substrings.dedup(frame(spark, made(1)).repartition(3), slab_words=50))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    physical = plan[plan.index("== Physical Plan") :]
    join = physical[physical.index("SortMergeJoin") :]
    assert "Bucketed: true" in join and "Exchange" not in join[: join.index("spots")]


def test_packing():
    for numbers in (np.array([], np.uint32), np.array([0, 1, 2**31], np.uint32), np.arange(5, dtype=np.uint64) << np.uint64(60)):
        assert unpack(pack(numbers)).tolist() == numbers.tolist()
    assert unpack_words(pack_words([b"", b"a", "é".encode() * 9])) == [b"", b"a", "é".encode() * 9] and unpack_words(pack_words([])) == []
    bits = np.array([True, False, True] * 5)
    assert unpack_bits(pack_bits(bits), 15).tolist() == bits.tolist()


def test_levels():
    assert substrings.levels(20, 5) == [5, 10, 20] and substrings.levels(7, 2) == [2, 4, 7] and substrings.levels(3, 5) == [3]


def test_query(spark, sf):
    assert differences(op12_substring_dedup(spark, sf), sf, SQL["op12_substring_dedup"]) == []
