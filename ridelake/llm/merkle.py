"""A Merkle manifest of a dataset, with a proof for every row, by butterfly exchange.

Rows are leaves, ordered within a group. An aligned run of leaves is one row of a
table, its block, and a block hashes its own subtree. The roots of the blocks then
meet in rounds: in round r each block swaps the root it has with one member of every
other run of ``fanout ** r`` blocks under the same parent, and all of them hash the
parent, each for itself. So every block ends with the group's root and with the
siblings on its own way up, and nothing is handed down again. The group roots are the
leaves of one more tree of the same kind.

A round is one aggregation over rows of one digest each, at most ``fanout`` to a key;
blocks have a fixed size, however many rows a group holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelake.llm.common import positions, short_batches, stage

FANOUT = 2
#: Levels of the tree that lie within a block.
LEVELS = 11
STEPS = "array<struct<before: string, after: string>>"


def leaf_hash(*columns: Column) -> Column:
    """Digest of a row: of each column the count of its bytes, a colon and its value, or a dash for a null."""
    texts = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda at, step: F.sha2(F.concat(step["before"], at, step["after"]), 256))


def proof_digest(proof: Column) -> Column:
    """Digest of a proof's digests, from leaf to root and left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.concat(step["before"], step["after"])), ""), 256)


def _levels(digests: list[str], fanout: int, levels: int | None) -> list[list[str]]:
    """Nodes by level, the given ones first, for so many levels above them or up to a single node."""
    out = [digests]
    while len(out) <= levels if levels is not None else len(out[-1]) > 1:
        below = out[-1]
        out.append([hashlib.sha256("".join(below[i : i + fanout]).encode()).hexdigest() for i in range(0, len(below), fanout)])
    return out


def _exchange(heads: DataFrame, fanout: int) -> DataFrame:
    """(grp, block, root, upper): the group's root and the steps from the block's own root to it.

    ``heads`` has grp, block, ``blocks`` (of them in the group) and ``node`` (the block's root).
    """
    state, span = heads.withColumn("upper", F.array().cast(STEPS)), 1
    most = heads.agg(F.max("blocks")).first()[0] or 0
    while span < most:
        own, open_ = F.expr(f"block div {span}"), F.col("blocks") > span
        first = F.expr(f"block div {span * fanout} * {fanout}")
        last = F.least(first + fanout - 1, F.expr(f"(blocks - 1) div {span}"))
        shift = F.col("block") % span
        # The last block also answers for the blocks that its run lacks.
        until = F.when(F.col("block") == F.col("blocks") - 1, F.lit(span - 1)).otherwise(shift)
        partners = lambda s: F.sequence(s * span + shift, s * span + until)
        to = F.flatten(F.transform(F.sequence(first, last), lambda s: F.when(s == own, F.array("block")).otherwise(partners(s))))
        to = F.when(open_, F.filter(to, lambda b: b < F.col("blocks"))).otherwise(F.array("block"))
        sent = state.select("grp", "blocks", own.alias("own"), "node", "upper", F.col("block").alias("by"), F.explode(to).alias("block"))
        home = F.col("by") == F.col("block")
        got = sent.groupBy("grp", "block", "blocks").agg(
            F.sort_array(F.collect_list(F.struct("own", "node"))).alias("run"),
            F.max(F.when(home, F.struct("own", "node"))).alias("self"),
            F.first(F.when(home, F.col("upper")), ignorenulls=True).alias("upper"),
        )
        joined = lambda nodes: F.array_join(F.transform(nodes, lambda x: x["node"]), "")
        step = F.struct(
            joined(F.filter("run", lambda x: x["own"] < F.col("self.own"))).alias("before"),
            joined(F.filter("run", lambda x: x["own"] > F.col("self.own"))).alias("after"),
        )
        state = got.select(
            "grp", "block", "blocks",
            F.when(open_, F.sha2(joined(F.col("run")), 256)).otherwise(F.col("self.node")).alias("node"),
            F.when(open_, F.concat("upper", F.array(step))).otherwise(F.col("upper")).cast(STEPS).alias("upper"),
        )
        span *= fanout
    return state.select("grp", "block", F.col("node").alias("root"), "upper")


def _plant(leaves: DataFrame, order: Sequence[str], fanout: int, levels: int) -> tuple[DataFrame, DataFrame]:
    """The blocks of the leaves (grp, block, blocks, leaves) and what each block learns in the exchange."""
    size, kept = fanout**levels, [c for c in leaves.columns if c != "grp"]
    placed = positions(leaves, order).withColumn("block", F.expr(f"pos div {size}"))
    blocks = placed.groupBy("grp", "total", "block").agg(F.sort_array(F.collect_list(F.struct("pos", *kept))).alias("leaves"))
    blocks = stage(blocks.select("grp", "block", F.expr(f"(total - 1) div {size} + 1").alias("blocks"), "leaves"), "blocks")

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, counts = batch.column(3).to_pylist(), batch.column(2).to_pylist()
            tops = [_levels(d, fanout, levels if n > 1 else None)[-1][0] for d, n in zip(digests, counts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(tops, pa.string())], ["grp", "block", "blocks", "node"])

    heads = blocks.select("grp", "block", "blocks", F.col("leaves.digest").alias("digests"))
    heads = stage(heads.mapInArrow(roots, f"grp {dict(blocks.dtypes)['grp']}, block long, blocks long, node string"), "heads")
    return blocks, _exchange(heads, fanout)


def _proofs(blocks: DataFrame, upper: DataFrame, fanout: int, levels: int) -> DataFrame:
    """The leaves of the blocks, each with the steps in its block and then those of its block (``upper``, and its other columns)."""
    others = [c for c in upper.columns if c not in ("grp", "block", "upper")]
    names = {"grp": "g", "block": "b"}
    joined = blocks.join(upper.withColumnsRenamed(names), F.col("grp").eqNullSafe(F.col("g")) & (F.col("block") == F.col("b")))
    joined = joined.select("grp", "blocks", "leaves", "upper", *others)
    fields = [f.name for f in blocks.schema["leaves"].dataType.elementType.fields]
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema["leaves"].dataType.elementType.fields} | dict(joined.dtypes)
    steps = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                leaves, above = row.column("leaves").flatten(), row.column("upper")[0].as_py()
                digests = leaves.field(fields.index("digest")).to_pylist()
                tree, out = _levels(digests, fanout, levels if row.column("blocks")[0].as_py() > 1 else None), []
                for at in range(len(digests)):
                    proof = []
                    for level in tree[:-1]:
                        low = at // fanout * fanout
                        proof.append({"before": "".join(level[low:at]), "after": "".join(level[at + 1 : low + fanout])})
                        at //= fanout
                    out.append(proof + above)
                same = pa.array([0] * len(digests))
                whole = [row.column(c).take(same) for c in ("grp", *others)]
                yield pa.RecordBatch.from_arrays([*whole, *leaves.flatten(), pa.array(out, steps)], ["grp", *others, *fields, "proof"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ("grp", *others, *fields))
    return joined.mapInArrow(run, f"{schema}, proof {STEPS}")


def manifest(
    docs: DataFrame, columns: Sequence[str], group: str, key: str, also: Sequence[str] = (), fanout: int = FANOUT, levels: int = LEVELS
) -> DataFrame:
    """A row for each row of ``docs``: group, key, the columns ``also``, leaf, subroot, root and the proof from leaf to root.

    Leaves are digests of ``columns``. Those of a group ascend by ``key``, nulls first, and then by digest, so
    repeated rows and rows without a key or a group are leaves like any other. Every ``fanout`` consecutive
    nodes, fewer at the end, become their parent until one is left, the subroot. Subroots ascend by group, null
    first and text by its bytes, and make the root in the same way. A proof has a step for each level: the digests
    ``before`` and ``after`` the node on the way, both empty where it is alone. No rows give no rows.
    """
    short_batches(docs.sparkSession)
    leaves = docs.select(
        F.col(group).alias("grp"), F.col(key).alias("key"), leaf_hash(*(F.col(c) for c in columns)).alias("digest"),
        F.struct(F.col(key).alias(f"_{key}"), *also).alias("also"),
    )
    blocks, upper = _plant(leaves, ["key", "digest"], fanout, levels)
    upper = stage(upper, "upper")
    subroots = upper.filter("block = 0").select(F.lit(0).alias("grp"), F.col("grp").alias("key"), F.col("root").alias("digest"))
    top = _proofs(*_plant(subroots, ["key"], fanout, levels), fanout, levels)
    top = top.select(F.col("key").alias("t"), F.col("root").alias("top"), "proof")
    upper = upper.join(top, F.col("grp").eqNullSafe(F.col("t"))).select("grp", "block", F.col("root").alias("subroot"), F.col("top").alias("root"), F.concat("upper", "proof").alias("upper"))
    rows = _proofs(blocks, upper, fanout, levels)
    return rows.select(
        F.col("grp").alias(group), F.col("key").alias(key), *(F.col("also")[c].alias(c) for c in also),
        F.col("digest").alias("leaf"), "subroot", "root", "proof",
    )
