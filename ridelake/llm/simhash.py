"""SimHash fingerprints of word shingles, linked by Golay-code keys.

A fingerprint is cut into three segments. Of two fingerprints that differ in at
most two bits, one segment is equal, and the next differs in at most two bits, so
the Golay code gives both a common codeword: (segment, its bits, codeword) is the
key they meet under. Keys shared by a few fingerprints are joined and each pair is
verified. Under a crowded key nothing is paired: every fingerprint there is masked
at each two of the bits that may differ, and those that agree under a mask, which
is to say differ in at most those two bits, hang on the smallest of them. That
loses no link and stays in proportion to the fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ridelake.llm import golay
from ridelake.llm.common import components, short_batches, stage

WORDS = 3
SEED = 42
#: Lowest bit and width of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
BITS = 2
#: Fingerprints under one key that are still compared pair by pair.
CROWD = 256


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64 majority bits of the hashes of the text's word shingles, as a signed number; 0 without words.

    A-Z are lower-cased; words are what ASCII white space separates; a text of
    fewer words is one shingle.
    """
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64) + 1) - 1
    n = max(1, len(found) - words + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    stops = ends[min(words, len(found)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for part in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[part : part + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


@F.pandas_udf(LongType())
def fingerprints(texts):
    return texts.map(fingerprint, na_action=None)


# Not to be taken again where a filter or join looks at the result.
fingerprints = fingerprints.asNondeterministic()


def _keys(prints: DataFrame) -> DataFrame:
    """(key, fp): for each segment, its bits and a codeword near the next segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            keys, of = [], []
            for s, (low, width) in enumerate(SEGMENTS):
                other, wide = SEGMENTS[(s + 1) % len(SEGMENTS)]
                place, word = golay.near((fps >> np.uint64(other)) & np.uint64((1 << wide) - 1))
                own = ((fps >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64)
                keys.append((own[place] << 14) | (word << 2) | s)
                of.append(place)
            fp = fps.view(np.int64)[np.concatenate(of)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(fp)], ["key", "fp"])

    return prints.mapInArrow(run, "key long, fp long")


def _masked(crowded: DataFrame, bits: int) -> DataFrame:
    """(mask, value, fp): each fingerprint under a crowded key without any ``bits`` of the bits outside the key's segment."""
    masks = []
    for low, width in SEGMENTS:
        outside = [b for b in range(64) if not low <= b < low + width]
        masks.append(np.array([sum(1 << b for b in c) for c in combinations(outside, bits)], dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment, fp in zip(batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)):
                mask = masks[segment]
                columns = [pa.array(mask.view(np.int64)), pa.array((fp & ~mask).view(np.int64)), pa.array(np.full(len(mask), fp).view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["mask", "value", "fp"])

    return crowded.mapInArrow(run, "mask long, value long, fp long")


def links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links ``(a, b)`` whose components are those of all distinct fingerprints ``fp`` at two bits or less."""
    keys = _keys(prints)
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    few = keys.join(sizes.filter(F.col("n") <= crowd).select("key"), "key")
    near = F.expr(f"a.fp < b.fp and bit_count(a.fp ^ b.fp) <= {BITS}")
    pairs = few.alias("a").join(few.alias("b"), (F.col("a.key") == F.col("b.key")) & near)
    pairs = pairs.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    crowded = keys.join(sizes.filter(F.col("n") > crowd).select("key"), "key")
    masked = _masked(crowded.select((F.col("key") % 4).alias("segment"), "fp").distinct(), BITS)
    heads = masked.groupBy("mask", "value").agg(F.min("fp").alias("head"), F.count("*").alias("n")).filter("n > 1")
    hung = masked.join(heads, ["mask", "value"]).filter("fp != head").select(F.col("head").alias("a"), F.col("fp").alias("b"))
    return pairs.unionByName(hung).distinct()


def clusters(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, fp (signed), component and component_id of each row: the smallest fingerprint and the smallest
    doc_id that links of two bits or less reach.

    Takes doc_id and text of ``docs`` and ignores other columns; one row out per
    row in, repeated ids included. Null and empty texts have fingerprint 0 and link
    like any other; rows without an id link too, and a component of nothing else
    has no id. Equal fingerprints, so all exact copies, are one node.
    """
    short_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprints(F.col("text").cast("string")).alias("fp"))
    docs = stage(docs, "fingerprints")
    nodes = stage(docs.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
    found = components(links(nodes.select("fp"), crowd)).withColumnRenamed("node", "fp")
    nodes = nodes.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    ids = nodes.groupBy("component").agg(F.min("first").alias("component_id"))
    return docs.join(nodes.join(ids, "component").select("fp", "component", "component_id"), "fp")


def near_duplicates(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """The clusters with the fingerprint in 16 hexadecimal digits."""
    return clusters(docs, crowd).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``docs``, all columns, with one row of each component: that with the smallest id.

    Of rows equal in id and fingerprint one stays; a component without any id
    keeps one row. Every row's fingerprint is taken once more, beside its columns.
    """
    rows = docs.withColumn("__fp", fingerprints(F.col("text").cast("string")))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "fp")).alias("m")
    of = clusters(docs, crowd).groupBy("component", "fp").agg(F.min("doc_id").alias("doc_id"))
    keep = of.groupBy("component").agg(first).select(F.col("m.fp").alias("__fp"), F.col("m.doc_id").alias("__id"))
    rows = rows.join(keep, "__fp").filter(F.col("doc_id").eqNullSafe(F.col("__id")))
    return rows.dropDuplicates(["__fp"]).select(*docs.columns)
