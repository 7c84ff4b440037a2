"""Bounded samples of labelled rows, and hashed sets of features as bits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelake.llm.common import remainder


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, rows: int) -> tuple[DataFrame, float]:
    """(doc_id, text, label) of at most ``rows`` documents of each label outside the held-out fold.

    Rows come in the order of their id's hash. Labels other than 0 and 1, ids
    labelled both ways and missing ids are left out; of documents with one id one
    is taken. The chosen ids, at most twice ``rows``, are broadcast. Also returns
    by how much the odds of label 1 in the sample exceed those among all labels.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.filter("doc_id is not null and label in (0, 1)").filter(remainder(F.col("doc_id"), folds) != held)
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most")
    counts = {y: n for y, n in known.groupBy("label").count().collect()}
    odds = 1.0
    if len(counts) == 2:
        odds = min(counts[1], rows) / min(counts[0], rows) * counts[0] / counts[1]
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [known.filter(F.col("label") == y).orderBy(*order).limit(rows).select("doc_id", "label") for y in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]), odds


def bits_of(rows: DataFrame, features, size: int, target: str) -> DataFrame:
    """(key, bits, target) of rows (key, text, target): the features of the text as a set of ``size`` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for text in batch.column("text"):
                mark = np.zeros(size, dtype=bool)
                mark[features(text.as_py())] = True
                packed.append(np.packbits(mark).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(packed, pa.binary()), batch.column(target)], ["key", "bits", target])

    kind = dict(rows.dtypes)[target]
    return rows.select("key", "text", target).mapInArrow(run, f"key long, bits binary, {target} {kind}")


def gathered(rows: DataFrame, fit, target: str) -> bytes | None:
    """The result of ``fit(places, starts, targets)`` on a bounded sample of bits, run in one task; None without rows.

    ``places`` are the set bits of all rows one after the other, ``starts`` where each row's begin.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, targets = [], []
        for batch in batches:
            for bits, y in zip(batch.column("bits").to_pylist(), batch.column(target).to_pylist()):
                places.append(np.flatnonzero(np.unpackbits(np.frombuffer(bits, dtype=np.uint8))).astype(np.int32))
                targets.append(y)
        if targets:
            starts = np.concatenate([[0], np.cumsum([len(p) for p in places])])
            joined = np.concatenate(places)
            places.clear()  # the rows are views of the joined array from here on
            model = fit(joined, starts, np.array(targets, dtype=float))
            yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    rows = rows.repartition(1).sortWithinPartitions("key")
    found = rows.mapInArrow(run, "model binary").collect()
    return bytes(found[0].model) if found else None
