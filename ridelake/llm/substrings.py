"""Repeated windows of words by doubling: those repeated at one length alone are extended to twice that length.

Documents are packed into slabs: their words as numbers into a list of the slab's
distinct words, which takes less room than the texts. At each level a slab asks which of
its windows are repeated anywhere. It sends a hash of each distinct window to the bucket
that the hash names and gets a bit back for each; nothing else of a window travels. A
window of the next level is a candidate only if both windows of this level that it
begins and ends with are repeated, and when none is left the rest of the levels are
left out. Hashes of 32 bits within a bucket do for this, because a window that is taken
for a repeated one by mistake goes no further than the last level, where windows are
told apart by 80 bits and their bucket's number. There a slab also sends the first place
of each window, and learns whether an earlier one exists.

A window that stands a million times in a slab is sent once, so a bucket gets at most
a row from each slab for it. Buckets grow in number with the words, not in size. Slabs
lie in a written table that is dealt out by slab, so that bits are joined to them without
moving them again; a lost executor costs the work since the last written table.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelake.llm.common import new_folder, short_batches, stage
from ridelake.llm.packing import pack, pack_bits, pack_words, unpack, unpack_bits, unpack_words

#: Words of a window, and of a window of the first level.
LENGTH, START = 20, 5
#: Words of a slab, unless a single document has more.
SLAB_WORDS = 1 << 20
#: Windows to a bucket, at most and on average.
BUCKET_WINDOWS = 1 << 21

SLAB = "slab long, n long, doc_ids array<long>, sizes array<long>, spots binary, words binary"
ASKED = "bucket long, slab long, keys binary, twice binary, more binary, docs binary, places binary"
ANSWERS = "slab long, bucket long, bits binary"
NO_ID = np.iinfo(np.int64).min
_LOW, _SHIFT = np.uint64(0xFFFFFFFF), np.uint64(32)
#: Odd numbers with bits well spread.
_ODD = [np.uint64(int(x) | 1) for x in np.random.default_rng(12).integers(1 << 62, 1 << 63, 3)]


def levels(length: int, start: int) -> list[int]:
    """Window lengths from ``start``, each twice the one before and the last one ``length``."""
    out = [min(start, length)]
    while out[-1] < length:
        out.append(min(2 * out[-1], length))
    return out


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _ODD[0] + (b ^ (b >> np.uint64(29))) * _ODD[1]
    x ^= x >> _SHIFT
    x *= _ODD[2]
    x ^= x >> np.uint64(29)
    return x


def _hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all windows of so many words, from hashes of the words, by doubling."""
    if length == 1:
        return words
    half, n = length // 2, max(0, len(words) - length + 1)
    parts = _hashes(words, half)
    out = _mixed(parts[:n], parts[half : half + n])
    return _mixed(out, words[length - 1 : length - 1 + n]) if length % 2 else out


def _slabs(docs: DataFrame, most: int) -> DataFrame:
    """Slabs of at most ``most`` words, or of one document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seq = TaskContext.get().partitionId() << 32, 0

        def fresh():
            known: defaultdict[bytes, int] = defaultdict()
            known.default_factory = known.__len__
            return known, [], [], [], 0

        def close():
            flat = np.concatenate(spots)
            # Frequent words get small numbers, which pack well.
            order = np.argsort(-np.bincount(flat, minlength=len(known)), kind="stable")
            rank = np.empty(len(known), np.uint32)
            rank[order] = np.arange(len(known), dtype=np.uint32)
            names = list(known)
            row = [base + seq, len(flat), ids, sizes, pack(rank[flat]), pack_words([names[i] for i in order])]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], [part.split()[0] for part in SLAB.split(", ")])

        known, ids, sizes, spots, held = fresh()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                parts = (text.as_py() or b"").split()
                if ids and held + len(parts) > most:
                    yield close()
                    seq += 1
                    known, ids, sizes, spots, held = fresh()
                ids.append(doc_id)
                sizes.append(len(parts))
                held += len(parts) + 1
                spots.append(np.fromiter(map(known.__getitem__, parts), dtype=np.uint32, count=len(parts)))
        if ids:
            yield close()

    return docs.mapInArrow(run, SLAB)


class _Slab:
    """A slab's words and the windows of it that are still candidates."""

    def __init__(self, row: dict, length: int, start: int, buckets: int):
        self.levels, self.buckets = levels(length, start), np.uint64(buckets)
        self.sizes = np.array(row["sizes"], np.int64)
        self.doc_ids = np.array([NO_ID if i is None else i for i in row["doc_ids"]], np.int64)
        self.words, self.spots = unpack_words(row["words"]), unpack(row["spots"])
        self.ends = np.cumsum(self.sizes)
        # Words from here to the end of the document, if it has a whole window.
        self.room = np.repeat(self.ends, self.sizes) - np.arange(len(self.spots))
        self.room[np.repeat(self.sizes < length, self.sizes)] = 0

    def _windows(self, k: int, seed: int) -> np.ndarray:
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in self.words), np.uint64, len(self.words))
        return _hashes(hashes[self.spots], self.levels[k])

    def keys(self, k: int, at: np.ndarray) -> np.ndarray:
        """Bucket and hash of the windows at ``at`` on level ``k``."""
        hashes = self._windows(k, 0)[at]
        return (hashes >> _SHIFT) % self.buckets << _SHIFT | hashes & _LOW

    def candidates(self, k: int, answers: dict[int, list]) -> np.ndarray:
        """Places of the candidates of level ``k``, by the answers to the levels before."""
        alive = np.ones(len(self.room), bool)
        for level in range(k + 1):
            ok = self.room >= self.levels[level]
            if level:
                shift = self.levels[level] - self.levels[level - 1]
                n = max(0, len(ok) - shift)
                ok[:n] &= alive[:n] & alive[shift:]
            at = np.flatnonzero(ok)
            if level < k:
                keys, inverse = np.unique(self.keys(level, at), return_inverse=True)
                alive = np.zeros(len(self.room), bool)
                alive[at[self.bits(keys, answers[level])[inverse]]] = True
        return at

    def bits(self, keys: np.ndarray, answers: list) -> np.ndarray:
        """The bits that came back for sorted keys; buckets without an answer have none set."""
        out = np.zeros(len(keys), bool)
        for bucket, packed in answers:
            low, high = self.of_bucket(keys, bucket)
            out[low:high] = unpack_bits(packed, high - low)
        return out

    @staticmethod
    def of_bucket(keys: np.ndarray, bucket: int) -> tuple[int, int]:
        low, high = np.searchsorted(keys, np.array([bucket << 32, (bucket + 1) << 32], np.uint64))
        return int(low), int(high)

    def placed(self, answers: dict[int, list]) -> tuple[np.ndarray, ...]:
        """The last level's candidates in order of window, document and place: keys, further bits, documents, places, their
        starts in the slab, and the number of the window that each belongs to."""
        k = len(self.levels) - 1
        at = self.candidates(k, answers)
        keys, more = self.keys(k, at), self._windows(k, 1)[at] >> np.uint64(16)
        docs = np.repeat(self.doc_ids, self.sizes)[at]
        places = (np.arange(len(self.room)) - np.repeat(self.ends - self.sizes, self.sizes))[at]
        order = np.lexsort((places, docs, more, keys))
        keys, more, docs, places, at = (x[order] for x in (keys, more, docs, places, at))
        return keys, more, docs, places, at, _numbered(keys, more)

    def removed(self, answers: dict[int, list]) -> np.ndarray:
        """Which words a window covers that starts earlier elsewhere."""
        keys, _, docs, places, at, window = self.placed(answers)
        edges = np.zeros(len(self.room) + 1, np.int64)
        if len(at):
            first = np.flatnonzero(np.diff(window, prepend=-1))
            later = (docs != docs[first][window]) | (places != places[first][window])
            later |= self.bits(keys[first], answers[len(self.levels) - 1])[window]
            edges[at[later]] += 1
            edges[at[later] + self.levels[-1]] -= 1
        return np.cumsum(edges)[:-1] > 0


def _numbered(*columns: np.ndarray) -> np.ndarray:
    """Numbers from zero on for runs of equal rows of sorted columns."""
    new = np.zeros(len(columns[0]), bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


def _rows(slabs: DataFrame, answers: list[DataFrame], work: Callable, schema: str) -> DataFrame:
    """``work`` on each slab and the answers it has got, by level."""
    if answers:
        all_ = answers[0].select(F.lit(0).alias("level"), "*")
        for k, more in enumerate(answers[1:], 1):
            all_ = all_.unionByName(more.select(F.lit(k).alias("level"), "*"))
        marks = all_.groupBy("slab").agg(F.collect_list(F.struct("level", "bucket", "bits")).alias("marks"))
        slabs = slabs.join(marks, "slab", "left")
    else:
        slabs = slabs.withColumn("marks", F.lit(None).cast("array<struct<level: int, bucket: long, bits: binary>>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                by_level = defaultdict(list)
                for mark in row["marks"] or ():
                    by_level[mark["level"]].append((mark["bucket"], mark["bits"]))
                yield from work(row, by_level)

    return slabs.mapInArrow(run, schema)


def _batch(schema: str, columns: list[list]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    names = [part.split() for part in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, names)], [name for name, _ in names])


def _asked(slabs: DataFrame, answers: list[DataFrame], length: int, start: int, buckets: int) -> DataFrame:
    """What slabs ask of each bucket on the next level: sorted keys and whether the slab has a window twice; on the last
    level also further bits and the first document and place."""
    k, last = len(answers), len(levels(length, start)) - 1

    def work(row: dict, by_level: dict[int, list]) -> Iterator[pa.RecordBatch]:
        slab, columns = _Slab(row, length, start, buckets), [[] for _ in ASKED.split(", ")]
        if k < last:
            keys, count = np.unique(slab.keys(k, slab.candidates(k, by_level)), return_counts=True)
            twice, others = count > 1, None
        else:
            keys, more, docs, places, _, window = slab.placed(by_level)
            first = np.flatnonzero(np.diff(window, prepend=-1))
            keys, others = keys[first], [more[first], docs[first].view(np.uint64), places[first].astype(np.uint32)]
        used = np.unique(keys >> _SHIFT).tolist()
        for bucket in used:
            low, high = slab.of_bucket(keys, bucket)
            gaps = np.diff((keys[low:high] & _LOW).astype(np.uint32), prepend=np.uint32(0))
            rest = [None, *(pack(x[low:high]) for x in others)] if others else [pack_bits(twice[low:high]), None, None, None]
            for column, value in zip(columns, (bucket, row["slab"], pack(gaps), *rest)):
                column.append(value)
        if used:
            yield _batch(ASKED, columns)

    return _rows(slabs, answers, work, ASKED)


def _answered(asked: DataFrame) -> DataFrame:
    """A bit for each key: whether its window is repeated; on the last level, whether an earlier one exists. All unset: no row."""

    def decide(rows: list[dict]) -> list[np.ndarray]:
        keys = [np.cumsum(unpack(r["keys"]), dtype=np.uint32) for r in rows]
        ends = np.cumsum([len(x) for x in keys])[:-1]
        if rows[0]["more"] is None:
            twice = np.concatenate([unpack_bits(r["twice"], len(x)) for r, x in zip(rows, keys)])
            _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            return np.split((np.bincount(inverse, weights=1 + twice) > 1)[inverse], ends)
        more, docs, places = (np.concatenate([unpack(r[c]) for r in rows]) for c in ("more", "docs", "places"))
        keys, docs = np.concatenate(keys), docs.view(np.int64)
        order = np.lexsort((places, docs, more, keys))
        window = _numbered(keys[order], more[order])
        first = order[np.flatnonzero(np.diff(window, prepend=-1))][window]
        later = np.empty(len(keys), bool)
        later[order] = (docs[order] != docs[first]) | (places[order] != places[first])
        return np.split(later, ends)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def close():
            found = [(r["slab"], r["bucket"], pack_bits(bits)) for r, bits in zip(held, decide(held)) if bits.any()]
            return _batch(ANSWERS, list(zip(*found)) or [[], [], []])

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if held and held[0]["bucket"] != row["bucket"]:
                    yield close()
                    held.clear()
                held.append(row)
        if held:
            yield close()

    return asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, ANSWERS)


def _dealt(df: DataFrame, key: str) -> DataFrame:
    """A copy of ``df`` in the shared folder, dealt out by ``key``: joins on it move the other side only."""
    spark = df.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"llm_{uuid.uuid4().hex}"
    rows = df.repartition(n, key).write.bucketBy(n, key).sortBy(key).format("parquet")
    rows.option("compression", "uncompressed").option("path", new_folder(spark, "slabs")).saveAsTable(name)
    copy = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # The files stay; only the name goes.
    return copy


def dedup(docs: DataFrame, length: int = LENGTH, start: int = START, slab_words: int = SLAB_WORDS, bucket_windows: int = BUCKET_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_removed and text (the kept words, one space between) of each row of ``docs``.

    Takes doc_id (a whole number) and text and ignores other columns. Words are runs of other characters than
    white space in ASCII, taken as they are. A word is removed if a window of ``length`` consecutive words of its
    document covers it whose words also start earlier: in a smaller doc_id, or before it in the same document. Windows are
    judged on the input. Null ids come first. Rows with one id, null or repeated, count as one document in which the
    place in the own text decides, so equal rows keep the same. A null text has no words. No rows give no rows.
    """
    short_batches(docs.sparkSession)
    slabs = _dealt(_slabs(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")), slab_words), "slab")
    words = slabs.agg(F.sum("n")).first()[0] or 0
    buckets, answers = -(-words // bucket_windows) or 1, []
    for _ in levels(length, start):
        answers.append(stage(_answered(_asked(slabs, answers, length, start, buckets)), "answers"))
        if answers[-1].isEmpty():
            break
    schema = "doc_id long, n_words long, n_removed long, text binary"

    def kept(row: dict, by_level: dict[int, list]) -> Iterator[pa.RecordBatch]:
        slab = _Slab(row, length, start, buckets)
        gone = slab.removed(by_level)
        out = [[], [], [], []]
        for doc_id, low, high in zip(row["doc_ids"], (slab.ends - slab.sizes).tolist(), slab.ends.tolist()):
            left = slab.spots[low:high][~gone[low:high]].tolist()
            for column, value in zip(out, (doc_id, high - low, high - low - len(left), b" ".join(map(slab.words.__getitem__, left)))):
                column.append(value)
        yield _batch(schema, out)

    # A level without a repeated window ends the search: the levels after it have no answers, and nothing is removed.
    return _rows(slabs, answers, kept, schema).withColumn("text", F.col("text").cast("string"))
