"""The manifest against a plain tree, on small blocks and with every odd case."""

from __future__ import annotations

import collections
import hashlib

import pytest

from pyspark.sql import functions as F

from ridelake.llm import merkle
from ridelake.llm.queries import MERKLE_COLUMNS, SQL, op13_merkle_manifest
from tests.oracle_check import differences

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, grp int, root string"


def H(*parts):  # noqa: N802
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(nodes, fanout):
    """The root of the nodes and each one's list of (before, after)."""
    proofs, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, at in enumerate(places):
            low = at // fanout * fanout
            proofs[i].append(("".join(nodes[low:at]), "".join(nodes[at + 1 : low + fanout])))
            places[i] = at // fanout
        nodes = [H(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], proofs


def plain(rows, fanout):
    groups = collections.defaultdict(list)
    for r in rows:
        leaf = H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r[:5]))
        groups[r[2]].append(((r[0] is not None, r[0] or 0), leaf, r[0]))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb([x[1] for x in sorted(groups[g], key=lambda x: x[:2])], fanout) for g in order}
    root, above = climb([trees[g][0] for g in order], fanout)
    out = []
    for g, up in zip(order, above):
        for (_, leaf, doc), proof in zip(sorted(groups[g], key=lambda x: x[:2]), trees[g][1]):
            out.append((g, doc, leaf, trees[g][0], root, tuple(proof + up)))
    return sorted(out, key=str)


def rows_of(n):
    langs = [None, "", "de", "é", "z", "de", "de"]
    rows = [(i, f"s{i % 3}", langs[i % 7], i, "wörd " * (i % 5), "x", 1, "y") for i in range(n)]
    return rows + [(None, None, None, None, None, None, None, None), (None, "s", "de", 1, "", None, 1, None), *rows[:3], (2, "s", langs[2], 0, "tie", "x", 1, "y")]


@pytest.mark.parametrize(("n", "fanout", "levels"), [(61, 2, 1), (61, 2, 2), (94, 3, 1), (1, 2, 11)])
def test_manifest(spark, n, fanout, levels):
    rows = rows_of(n) if n > 3 else [(5, "s", "en", 1, "t", "x", 1, "y")]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = merkle.manifest(docs, MERKLE_COLUMNS, "lang", "doc_id", also=["source"], fanout=fanout, levels=levels)
    assert found.columns == ["lang", "doc_id", "source", "leaf", "subroot", "root", "proof"]
    got = [(r.lang, r.doc_id, r.leaf, r.subroot, r.root, tuple((s.before, s.after) for s in r.proof)) for r in found.collect()]
    assert sorted(got, key=str) == plain(rows, fanout)
    assert found.filter(merkle.folded(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert merkle.manifest(docs, MERKLE_COLUMNS, "lang", "doc_id").count() == 0


def test_repeated_keys_over_many_blocks(spark):
    docs = spark.range(3000).selectExpr("id % 3 as doc_id", "'s' as source", "'en' as lang", "id as n_chars", "'t' as text")
    found = merkle.manifest(docs, MERKLE_COLUMNS, "lang", "doc_id", also=["n_chars"], levels=3).collect()
    want = plain([tuple(r) for r in docs.collect()], 2)
    assert sorted((r.leaf, r.root) for r in found) == sorted((w[2], w[4]) for w in want)


def test_query(spark, sf):
    assert differences(op13_merkle_manifest(spark, sf), sf, SQL["op13_merkle_manifest"]) == []
    verdicts = {(r.verified, r.folded_root == r.root) for r in op13_merkle_manifest(spark, sf).collect()}
    assert verdicts == {(True, True), (False, False)}
