"""Repeated byte strings by passes over anchors, runs, block cores and margins, in place of a radix sort of suffixes.

No suffix is ordered. Windows of 400 bytes are told apart in passes that each read
a further part of them and drop what has become unique; windows that are still
together at the end are exactly the repeated ones. Parts may be read in any order
that depends on the window alone, and the order here keeps rows few:

1. Every window has an anchor, the run of 128 bytes in it with the smallest hash.
   Neighbouring windows share one, so a pass over anchors has a row per run of
   windows, and anchors that occur once are dropped. Equal runs of one text, many
   where a text repeats itself, are one row with their starts.
2. Runs under one anchor that are equal throughout are repeated as a whole.
3. Where runs under one anchor differ, their windows are cut into blocks of 32. A
   pass over the bytes that all windows of a block have in common, the core, drops
   blocks without a partner; blocks equal throughout are repeated as a whole.
4. Only windows of blocks that share a core but differ at its margins are told
   apart one by one, by the margins.

Rows carry 64-bit anchors with 64-bit digests, and 64-bit digests of cores with margins. No
group is gathered: every pass is an aggregation and a join on its keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelake.llm.common import short_batches, stage

LENGTH = 400
GRAM = 128
BLOCK = 32
#: Windows looked at together; longer texts are cut into overlapping slices.
SLICE = 1 << 19
#: Low bits of a hash that give way to its place, as many for short texts as for full slices.
PLACE_BITS = (SLICE + LENGTH).bit_length()

RUNS = "key binary, starts array<long>, n int, ahead int, anchor long, digest long"
BLOCKS = "key binary, start long, n int, weight long, open boolean, core long, before binary, after binary"

_VALUES = np.random.default_rng(5).integers(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1


def _ranked(hashes: np.ndarray) -> np.ndarray:
    """The hashes with their places as low bits: one order for equal windows, however long their texts are."""
    bits = np.uint64(PLACE_BITS)
    if len(hashes) > 1 << PLACE_BITS:
        raise ValueError("a slice has more places than their bits can tell")
    return (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)


class _Hasher:
    """Rolling hashes of ``gram`` bytes and the smallest of them in every window, for whole arrays."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram = length, gram
        self.powers = self.inverses = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            inverse = pow(_BASE, -1, 1 << 64)
            self.powers, self.inverses = (
                np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, base, dtype=np.uint64)]), dtype=np.uint64) for base in (_BASE, inverse)
            )

    def anchors(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each window start: the place of its anchor, the first of the smallest hashes; and all hashes."""
        self._grow(len(data))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_VALUES[data] * self.powers[: len(data)], dtype=np.uint64)])
        n = len(data) - self.gram + 1
        hashes = (sums[self.gram :] - sums[:n]) * self.inverses[:n]
        hashes ^= hashes >> np.uint64(31)
        hashes *= np.uint64(0xBF58476D1CE4E5B9)
        hashes ^= hashes >> np.uint64(29)
        least = _ranked(hashes)
        width, have = self.length - self.gram + 1, 1
        while 2 * have <= width:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < width:
            least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
        return (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64), hashes


def _slices(data: bytes, length: int, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first window, bytes) of slices that between them have every window once."""
    for start in range(0, max(0, len(data) - length + 1), size):
        yield start, np.frombuffer(data, dtype=np.uint8)[start : start + size + length - 1]


def _runs(data: bytes, hasher: _Hasher, size: int) -> list[tuple]:
    """(starts, n, ahead, anchor, digest) of the runs of windows with one anchor; the anchor is ``ahead`` bytes from the start."""
    out: dict[tuple, list[int]] = {}
    for first, part in _slices(data, hasher.length, size):
        places, hashes = hasher.anchors(part)
        edges = np.flatnonzero(np.diff(places)) + 1
        starts = np.concatenate([[0], edges])
        counts = np.diff(np.concatenate([starts, [len(places)]]))
        at = places[starts]
        names = hashes[at].view(np.int64).tolist()
        for s, n, a, name in zip(starts.tolist(), counts.tolist(), at.tolist(), names):
            begin = first + s
            digest = xxhash.xxh3_64_intdigest(data[begin : begin + n + hasher.length - 1], seed=a - s)
            out.setdefault((n, a - s, name, digest - (1 << 64) if digest >> 63 else digest), []).append(begin)
    return [(starts, *run) for run, starts in out.items()]


def _key(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _all_runs(docs: DataFrame, length: int, gram: int, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher(length, gram)
        kinds = [pa.binary(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        for batch in batches:
            keys, rows = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = _runs(text.as_py().encode(), hasher, size)
                rows += found
                keys += [key] * len(found)
                if len(rows) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip((keys, *zip(*rows)), kinds)], RUNS.replace(",", "").split()[::2])
                    keys, rows = [], []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip((keys, *zip(*rows)), kinds)], RUNS.replace(",", "").split()[::2])

    return docs.mapInArrow(run, RUNS)


def _cut(data: bytes, start: int, n: int, ahead: int, length: int, block: int) -> Iterator[tuple]:
    """(start, n, core, before, after) of the blocks of a run's windows, by the anchor's place in the window."""
    anchor, low = start + ahead, ahead - n + 1
    for j in range(low // block, ahead // block + 1):
        least, most = max(low, j * block), min(ahead, (j + 1) * block - 1)
        core, stop = anchor - j * block, anchor - (j + 1) * block + 1 + length
        begin, end = anchor - most, anchor - least + length
        digest = xxhash.xxh3_64_intdigest(data[core:stop], seed=j)
        yield begin, most - least + 1, digest - (1 << 64) if digest >> 63 else digest, data[begin:core], data[stop:end]


def _blocks(wanted: DataFrame, length: int, block: int) -> DataFrame:
    """Blocks of the runs in ``runs`` (start, n, ahead, weight, open) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = BLOCKS.replace(",", "").split()[::2]
        kinds = [pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary()]
        for batch in batches:
            rows = []
            for key, text, runs in zip(batch.column("key").to_pylist(), batch.column("text"), batch.column("runs")):
                data = text.as_py().encode()
                for r in runs.as_py():
                    cut = _cut(data, r["start"], r["n"], r["ahead"], length, block)
                    rows += [(key, begin, n, r["weight"], r["open"], *rest) for begin, n, *rest in cut]
                if len(rows) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names)

    return wanted.mapInArrow(run, BLOCKS)


def _windows(blocks: DataFrame, length: int, block: int) -> DataFrame:
    """A row for each window of the blocks: ``t``, how many bytes of the margin before the core it has, and its margins."""
    first = F.lit(block - 1) - F.length("after")
    rows = blocks.withColumn("t", F.explode(F.sequence(first, F.length("before"))))
    left = F.expr("substring(before, length(before) - t + 1, t)")
    right = F.expr(f"substring(after, 1, {block - 1} - t)")
    return rows.withColumns({"left": left, "right": right})


def repeated(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK, size: int = SLICE
) -> DataFrame:
    """(key, starts, n): runs of ``n`` repeated windows from each of ``starts``, by the key of the text.

    ``docs`` has key and text; every row counts, so equal texts repeat all their windows.
    """
    runs = stage(_all_runs(docs, length, gram, size), "runs")
    # Pass over anchors.
    anchors = runs.groupBy("anchor").agg(F.sum(F.size("starts")).alias("rows")).filter("rows > 1").select("anchor")
    runs = runs.join(anchors, "anchor")
    # Pass over whole runs.
    same = runs.groupBy("anchor", "digest").agg(F.sum(F.size("starts")).alias("weight"), F.min(F.xxhash64("key")).alias("head"))
    kinds = same.groupBy("anchor").agg(F.min("weight").alias("least"), F.count("*").alias("kinds"))
    same = same.join(kinds, "anchor").select("anchor", "digest", "weight", "head", (F.expr("kinds > 1 and least = 1")).alias("mixed"))
    runs = runs.join(same, ["anchor", "digest"])
    runs = runs.select("key", "starts", "n", "ahead", "weight", (F.xxhash64("key") == F.col("head")).alias("head"), "mixed")
    runs = stage(runs, "anchored")
    whole = runs.filter("weight > 1").select("key", "starts", "n")
    # Pass over cores: single runs, and one text of each repeated run they may share windows with.
    # Sets, here and for the spans: copies of a text have one key and equal runs, however many they are.
    wanted = runs.filter("mixed and (weight = 1 or head)")
    wanted = wanted.groupBy("key").agg(F.collect_set(F.struct(F.get("starts", F.lit(0)).alias("start"), "n", "ahead", "weight", (F.col("weight") == 1).alias("open"))).alias("runs"))
    blocks = stage(_blocks(docs.join(wanted, "key").select("key", "text", "runs"), length, block), "blocks")
    side = ["core", "before", "after"]
    same = blocks.groupBy(*side).agg(F.sum("weight").alias("sum"))
    kinds = same.groupBy("core").agg(F.min("sum").alias("least"), F.count("*").alias("kinds"))
    same = same.join(kinds, "core").select(*side, "sum", F.expr("kinds > 1 and least = 1").alias("mixed"))
    open_blocks = blocks.filter("open").join(same.filter("sum > 1 or mixed"), side)
    equal = open_blocks.filter("sum > 1").select("key", F.array("start").alias("starts"), "n")
    # Pass over single windows, by their margins.
    window = ["core", "t", "left", "right"]
    shared = _windows(same.filter("mixed"), length, block).groupBy(*window).agg(F.sum("sum").alias("w")).filter("w > 1").select(*window)
    single = _windows(open_blocks.filter("sum = 1 and mixed"), length, block).join(shared, window)
    single = single.select("key", F.array(F.col("start") + F.length("before") - F.col("t")).alias("starts"), F.lit(1).alias("n"))
    return whole.unionByName(equal).unionByName(single)


def _union(spans: pa.Scalar, length: int) -> list[tuple[int, int]]:
    """The maximal runs of bytes that the windows cover."""
    if not spans.is_valid:
        return []
    lists, counts = spans.values.field("starts"), spans.values.field("n").to_numpy()
    starts = lists.flatten().to_numpy()
    stops = starts + np.repeat(counts, lists.value_lengths().to_numpy()) + length - 1
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], np.maximum.accumulate(stops[order])
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > stops[:-1]]))
    return list(zip(starts[new].tolist(), stops[np.concatenate([new[1:] - 1, [len(stops) - 1]])].tolist()))


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK, size: int = SLICE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row once its repeated bytes are removed.

    A byte goes if a string of ``length`` bytes over it also starts anywhere else in
    the input, in its own text or another; strings never cross texts. Null texts
    count as empty; rows without an id and repeated rows count like any other; other
    columns are ignored.
    """
    if not 0 < block <= length - gram:
        raise ValueError("blocks must fit beside the anchor")
    short_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text().alias("text")).withColumn("key", _key(F.col("text")))
    docs = docs.select("key", "text", "doc_id")
    found = repeated(docs, length, gram, block, size).groupBy("key").agg(F.collect_set(F.struct("starts", "n")).alias("spans"))
    rows = docs.join(found, "key", "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text"), batch.column("spans")):
                data = text.as_py().encode()
                kept, at, edges = hashlib.sha256(), 0, _union(spans, length)
                for start, stop in edges:
                    kept.update(data[at:start])
                    at = stop
                kept.update(data[at:])
                removed, n = sum(b - a for a, b in edges), len(edges)
                out.append((len(data), removed, n, kept.hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(v, k) for v, k in zip(zip(*out), kinds)]], names)

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
