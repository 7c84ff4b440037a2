"""Byte-level BPE over a whole corpus: each distinct word is encoded once.

Texts are cut into pre-tokens chunk by chunk. A chunk keeps where in its texts
each of its words stands, and sends its distinct words on, dealt by hash into
buckets and packed: a row per word would cost several times the disk. Words meet
by a shuffle of the buckets, every distinct word is encoded once, and the token
ids are joined back to the chunks, which put them together by position. Decoding
looks ids up in the table of token bytes, whose size the vocabulary bounds.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelake.llm.common import short_batches

#: Characters of text in a chunk; a longer text is a chunk of its own.
CHUNK_CHARS = 8 << 20
#: Buckets of words for each shuffle partition.
BUCKETS = 4

CHUNK = "chunk long, doc_ids array<long>, sizes array<int>, spots binary, words binary"
ENCODED = "doc_id long, n_tokens long, ids binary"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def load_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary file: a token in base64 and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge neighbours of the lowest rank, leftmost first, until no pair is a token."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end = list(range(1, n + 1))  # where the part that starts here ends; 0: no part starts here
    before = list(range(-1, n - 1))
    heap = []

    def offer(i: int) -> None:
        j = end[i]
        if j < n and (rank := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (rank, i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != stop:
            continue  # one of the two has changed since
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i : end[i]]])
        i = end[i]
    return ids


def _pack(numbers: np.ndarray) -> bytes:
    """Byte planes, compressed: the upper ones are nearly empty."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def _code(ids: list[int]) -> bytes:
    """Token ids as little-endian 32-bit numbers, held in less memory than as a list."""
    return struct.pack(f"<{len(ids)}I", *ids)


def _pack_words(words: list[bytes]) -> bytes:
    lengths = np.array([len(w) for w in words], dtype="<u4").tobytes()
    head = len(words).to_bytes(8, "little")
    return zstandard.ZstdCompressor(level=3).compress(b"".join((head, lengths, *words)))


def _unpack_words(data: bytes) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(data[:8], "little")
    ends = 8 + 4 * n + np.cumsum(np.frombuffer(data, "<u4", n, 8), dtype=np.int64)
    return [data[a:b] for a, b in zip([8 + 4 * n, *ends[:-1].tolist()], ends.tolist())]


def _dealt(words: list[bytes], buckets: int) -> list[list[int]]:
    """The places of the words of each bucket."""
    places: list[list[int]] = [[] for _ in range(buckets)]
    for i, word in enumerate(words):
        places[zlib.crc32(word) % buckets].append(i)
    return places


def _chunks(docs: DataFrame, pattern: str, chunk_chars: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, seq, base = regex.compile(pattern).findall, 0, TaskContext.get().partitionId() << 32

        def fresh():
            known: defaultdict[str, int] = defaultdict()
            known.default_factory = known.__len__
            return known, [], [], [], 0

        def close():
            flat = np.concatenate(spots) if spots else np.empty(0, np.uint32)
            # Frequent words get small numbers.
            order = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
            rank = np.empty(len(words), np.uint32)
            rank[order] = np.arange(len(words), dtype=np.uint32)
            names = list(words)
            row = [[base + seq], [ids], [sizes], [_pack(rank[flat])], [_pack_words([names[i].encode() for i in order])]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], ["chunk", "doc_ids", "sizes", "spots", "words"])

        words, ids, sizes, spots, held = fresh()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                if ids and held + len(text) > chunk_chars:
                    yield close()
                    seq += 1
                    words, ids, sizes, spots, held = fresh()
                found = np.fromiter(map(words.__getitem__, cut(text)), dtype=np.uint32)
                ids.append(doc_id)
                sizes.append(len(found))
                spots.append(found)
                held += len(text)
        if ids:
            yield close()

    return docs.mapInArrow(run, CHUNK)


def encode(
    docs: DataFrame,
    ranks: dict[bytes, int],
    pattern: str,
    chunk_chars: int = CHUNK_CHARS,
    then: Callable[[pa.Table], pa.Table] = lambda encoded: encoded,
    schema: str = ENCODED,
) -> DataFrame:
    """Token ids of each row's whole text: doc_id, n_tokens and the ids as little-endian 32-bit numbers.

    Takes doc_id and text of ``docs`` and ignores other columns. One row out per
    row in, repeated and null ids included; a null or empty text has no tokens.
    ``then`` takes such a table of a chunk's rows on to one of ``schema`` within
    the worker that put the chunk together: a second step of its own would hold
    a second worker beside it, and the ids on their way.
    """
    spark = docs.sparkSession
    short_batches(spark)
    table = spark.sparkContext.broadcast(ranks)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chunks = _chunks(docs, pattern, chunk_chars)

    buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def distinct_words(chunk: pa.Table) -> pa.Table:
        words = _unpack_words(chunk.column("words")[0].as_py())
        packed = [(b, _pack_words([words[i] for i in places])) for b, places in enumerate(_dealt(words, buckets)) if places]
        return pa.table({
            "chunk": pa.array([chunk.column("chunk")[0].as_py()] * len(packed), pa.int64()),
            "bucket": pa.array([b for b, _ in packed], pa.int32()),
            "words": pa.array([w for _, w in packed], pa.binary()),
        })

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, known = None, {}
        for batch in batches:
            sizes, codes = [], []
            for bucket, packed in zip(batch.column("bucket").to_pylist(), batch.column("words").to_pylist()):
                if bucket != current:
                    current, known = bucket, {}
                words = _unpack_words(packed)
                for word in words:
                    if word not in known:
                        known[word] = _code(encode_word(word, table.value))
                ids = [known[word] for word in words]
                sizes.append(_pack(np.array([len(x) // 4 for x in ids], dtype="<u4")))
                codes.append(_pack(np.frombuffer(b"".join(ids), dtype="<u4")))
            columns = [batch.column("chunk"), batch.column("bucket"), pa.array(sizes, pa.binary()), pa.array(codes, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["chunk", "bucket", "lengths", "codes"])

    def assembled(chunk: pa.Table, found: pa.Table) -> pa.Table:
        """The chunk's texts, position by position."""
        ids, sizes = chunk.column("doc_ids")[0].as_py(), np.array(chunk.column("sizes")[0].as_py(), dtype=np.int64)
        spots, words = _unpack(chunk.column("spots")[0].as_py()), _unpack_words(chunk.column("words")[0].as_py())
        codes, places = [b""] * len(words), _dealt(words, buckets)
        del words
        for bucket, lengths, packed in zip(*(found.column(c).to_pylist() for c in ("bucket", "lengths", "codes"))):
            flat, ends = _unpack(packed).tobytes(), np.cumsum(_unpack(lengths), dtype=np.int64) * 4
            for i, a, b in zip(places[bucket], [0, *ends[:-1].tolist()], ends.tolist()):
                codes[i] = flat[a:b]
        ends = np.cumsum(sizes)
        out = [b"".join(map(codes.__getitem__, spots[e - n : e].tolist())) for e, n in zip(ends, sizes)]
        return then(pa.table({
            "doc_id": pa.array(ids, pa.int64()),
            "n_tokens": pa.array([len(x) // 4 for x in out], pa.int64()),
            "ids": pa.array(out, pa.binary()),
        }))

    words = chunks.groupBy("chunk").applyInArrow(distinct_words, "chunk long, bucket int, words binary")
    words = words.repartition("bucket").sortWithinPartitions("bucket")
    found = words.mapInArrow(encoded, "chunk long, bucket int, lengths binary, codes binary")
    return chunks.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(assembled, schema)


def _bytes_of(ids: bytes, tokens: list[bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, dtype="<i4").tolist()))


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """Add ``bytes``, the text that the ids in ``ids`` stand for; no ids stand for no bytes."""
    table = encoded.sparkSession.sparkContext.broadcast(_by_id(ranks))

    @F.pandas_udf("binary")
    def text_bytes(ids):
        return ids.map(lambda x: _bytes_of(x or b"", table.value))

    return encoded.withColumn("bytes", text_bytes("ids"))


def _by_id(ranks: dict[bytes, int]) -> list[bytes]:
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


def digests(encoded: pa.Table, tokens: list[bytes]) -> pa.Table:
    """doc_id, n_tokens and the SHA-256 of the ids in decimal and of the bytes they decode to, text by text."""
    of_ids, of_bytes = [], []
    for ids in encoded.column("ids"):
        ids = ids.as_py()
        of_ids.append(hashlib.sha256(" ".join(map(str, np.frombuffer(ids, dtype="<i4").tolist())).encode()).hexdigest())
        of_bytes.append(hashlib.sha256(_bytes_of(ids, tokens)).hexdigest())
    return pa.table({
        "doc_id": encoded.column("doc_id"),
        "n_tokens": encoded.column("n_tokens"),
        "ids_sha256": pa.array(of_ids, pa.string()),
        "decoded_sha256": pa.array(of_bytes, pa.string()),
    })


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Encode every whole text, decode the ids, and return the digests of both."""
    ranks = load_ranks(vocabulary)
    tokens = docs.sparkSession.sparkContext.broadcast(_by_id(ranks))
    return encode(docs, ranks, pattern, chunk_chars, lambda encoded: digests(encoded, tokens.value), DIGESTS)
