"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors at a cosine of at least t are within a squared distance of 2 - 2t.
After a rotation that spreads it evenly, cut into blocks of dimensions, some block
holds no more than its proportional share of that distance. So vectors meet, within
a label, in each block by a range join: on a grid over the block's first dimensions
whose cells are as wide as the share allows, every vector lives in its cell and
visits the neighbours that lie ahead. Crowded cells are cut into tiles of bounded
size, pairs of chunks, so that no task holds a cell. A tile keeps the pairs within
the block's share, drops those that an earlier block already has, and verifies the
rest by their exact cosine. It returns link counts and a spanning forest of its
links, never all pairs. Equal vectors are one node from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelake.llm.common import components, short_batches, stage

COSINE = 0.93
BLOCKS = 4
#: Dimensions of a block the grid lies over.
GRID = 2
#: Vectors of a cell that are compared in one tile against as many others, fewer if they have over 64 dimensions, and those that are at a time.
CHUNK, STEP = 4096, 512
#: Room for rounding in everything but the final cosine.
SLACK = 1e-9


def rotation(dims: int) -> np.ndarray:
    """A random rotation, the same in every task."""
    return np.linalg.qr(np.random.default_rng(dims).standard_normal((dims, dims)))[0]


def _blocks(dims: int, blocks: int) -> list[tuple[int, int]]:
    ends = np.linspace(0, dims, min(blocks, dims) + 1).astype(int).tolist()
    return list(zip(ends[:-1], ends[1:]))


def _matrix(vectors: pa.ListArray, dims: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _units(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; powers of two keep the squares of very large and very small components in range."""
    vectors = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _copies(nodes: DataFrame, cosine: float, blocks: int, grid: int) -> DataFrame:
    """Each node's copies: (label, dims, block, cell, home, node, weight, vec); at home once a block, else visiting a cell ahead."""
    ahead = [d for d in product((-1, 0, 1), repeat=grid) if d > (0,) * grid]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column("dims").to_numpy()
            for dims in np.unique(every).tolist():
                at = pa.array(np.flatnonzero(every == dims))
                kept = {c: batch.column(c).take(at) for c in ("label", "dims", "node", "weight", "vec")}
                turned, n = _units(_matrix(kept["vec"], dims)) @ rotation(dims), len(at)
                for b, (start, stop) in enumerate(_blocks(dims, blocks)):
                    width = np.sqrt((2 - 2 * cosine) * (stop - start) / dims) + SLACK
                    cells = np.floor(turned[:, start : min(stop, start + grid)] / width).astype(np.int64)
                    steps = [(0,) * cells.shape[1]] + sorted({d[: cells.shape[1]] for d in ahead if d[: cells.shape[1]] > (0,) * cells.shape[1]})
                    for step in steps:
                        names = [",".join(map(str, c)) for c in (cells + np.array(step)).tolist()]
                        columns = [
                            kept["label"], kept["dims"], pa.array(np.full(n, b, np.int32)), pa.array(names), pa.array(np.full(n, not any(step))),
                            kept["node"], kept["weight"], kept["vec"],
                        ]
                        yield pa.RecordBatch.from_arrays(columns, ["label", "dims", "block", "cell", "home", "node", "weight", "vec"])

    kind = "label long, dims int, block int, cell string, home boolean, node string, weight long, vec array<double>"
    return nodes.mapInArrow(run, kind)


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Links that span the components of the links (a, b) among ``n`` places."""
    root, out = list(range(n)), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        u, v = find(x), find(y)
        if u != v:
            root[max(u, v)] = min(u, v)
            out.append((x, y))
    return out


def _tile(rows: pa.Table, cosine: float, blocks: int) -> pa.Table:
    """(node, other, n): links of the tile's nodes, weighted, with ``other`` null; links of its forest with n 0."""
    rows = rows.sort_by("node")
    dims, block = rows.column("dims")[0].as_py(), rows.column("block")[0].as_py()
    first, second = rows.column("first")[0].as_py(), rows.column("second")[0].as_py()
    side, home, weight = (rows.column(c).to_numpy() for c in ("chunk", "home", "weight"))
    nodes = rows.column("node").to_pylist()
    units = _units(_matrix(rows.column("vec").combine_chunks(), dims))
    turned, cuts = units @ rotation(dims), _blocks(dims, blocks)
    budget = 2 - 2 * cosine
    left, right = np.flatnonzero(home & (side == first)), np.flatnonzero(side == second)
    share = lambda c: budget * (c[1] - c[0]) / dims + SLACK

    def gap(cut: tuple[int, int], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return ((turned[i, cut[0] : cut[1]] - turned[j, cut[0] : cut[1]]) ** 2).sum(axis=1)

    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    part = slice(*cuts[block])
    y = turned[right, part]
    for at in range(0, len(left), STEP):
        x = turned[left[at : at + STEP], part]
        near = (x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1)[None] - 2 * x @ y.T <= share(cuts[block]) + 1e-7
        i, j = np.nonzero(near)
        i, j = left[at + i], right[j]
        # Two at home meet once: in their chunk, or with the later chunk on the right.
        keep = np.where(home[j] & (first == second), i < j, True)
        i, j = i[keep], j[keep]
        keep = gap(cuts[block], i, j) <= share(cuts[block])
        for earlier in cuts[:block]:
            keep &= gap(earlier, i, j) > share(earlier)
        i, j = i[keep], j[keep]
        keep = (units[i] * units[j]).sum(axis=1) >= cosine
        found.append((i[keep], j[keep]))
    a, b = (np.concatenate(ends) for ends in zip(*found))
    counts = np.bincount(a, weights=weight[b], minlength=len(nodes)) + np.bincount(b, weights=weight[a], minlength=len(nodes))
    some, spans = np.flatnonzero(counts), _forest(a, b, len(nodes))
    return pa.table({
        "node": pa.array([nodes[k] for k in some] + [nodes[x] for x, _ in spans], pa.string()),
        "other": pa.array([None] * len(some) + [nodes[y] for _, y in spans], pa.string()),
        "n": pa.array([int(counts[k]) for k in some] + [0] * len(spans), pa.int64()),
    })


def near_duplicates(
    vectors: DataFrame, cosine: float = COSINE, blocks: int = BLOCKS, grid: int = GRID, chunk: int = CHUNK
) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of ``vectors`` (vec_id, embedding, label; others are ignored).

    Rows link when their labels are equal and their cosine in double precision is
    at least ``cosine``; vectors of different lengths never do. Rows with a null
    label, or a vector that is null, empty, zero or not finite throughout, link with
    nothing and are kept, and so are rows without an id. Repeated rows count each.
    """
    short_batches(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").cast("long").alias("label"))
    whole = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = rows.withColumn("valid", F.coalesce(whole & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False)))
    label_print = F.concat_ws(":", F.hex(F.xxhash64("label", "vec")), F.hex(F.hash("vec", "label")))
    rows = stage(rows.withColumn("print", F.when(F.col("valid"), label_print)), "vectors")
    nodes = rows.filter("valid").groupBy("label", "vec", "print").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight"))
    nodes = stage(nodes.withColumn("node", F.concat_ws(":", "first", "print")).withColumn("dims", F.size("vec")), "nodes")

    copies = _copies(nodes.select("label", "dims", "node", "weight", "vec"), cosine, blocks, grid)
    cell = ["label", "dims", "block", "cell"]
    crowds = copies.groupBy(*cell).agg(F.count("*").alias("crowd"), F.count_if("home").alias("homes")).filter("crowd > 1 and homes > 0")
    placed = copies.join(crowds, cell).withColumn("chunks", F.ceil(F.col("crowd") * F.greatest(F.lit(1.0), F.col("dims") / 64) / chunk).cast("int"))
    placed = placed.withColumn("chunk", F.pmod(F.hash("node"), F.col("chunks")))
    every, own = F.sequence(F.lit(0), F.col("chunks") - 1), F.col("chunk")
    pair = lambda p, q: F.struct(p.alias("first"), q.alias("second"))
    # Tile (p, q) compares those at home in chunk p with the visitors of chunk q and, if q is not before p, those at home there.
    left, right = F.transform(every, lambda q: pair(own, q)), F.transform(every, lambda p: pair(p, own))
    tiles = F.when(F.col("home"), F.concat(left, F.filter(right, lambda t: t["first"] < t["second"]))).otherwise(right)
    tiled = placed.withColumn("t", F.explode(tiles)).select(*cell, "t.first", "t.second", "chunk", "home", "node", "weight", "vec")
    found = tiled.groupBy(*cell, "first", "second").applyInArrow(lambda t: _tile(t, cosine, blocks), "node string, other string, n long")
    found = stage(found, "links")

    counts = found.filter("other is null").groupBy("node").agg(F.sum("n").alias("n"))
    parts = components(found.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    nodes = nodes.join(counts, "node", "left").join(parts, "node", "left")
    nodes = nodes.withColumn("component", F.coalesce("component", "node"))
    ids = nodes.groupBy("component").agg(F.min("first").alias("component_id"))
    known = nodes.join(ids, "component").select(
        "label", F.col("vec").alias("v"), "print", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"
    )
    out = rows.drop("label").join(known.drop("label"), (rows["print"] == known["print"]) & (rows["vec"] == known["v"]), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
