"""WARC archives: a deterministic sharded writer and a reader that checks what it reads.

Records are sorted by page id and cut into shards of about equal payload; a
shard is written by one task, streaming, and rolled into files by compressed
size. Names, headers, record ids and digests follow from the rows alone, so a
task that runs again writes the same bytes. A file is written under a temporary
name and renamed when it is complete, and only files in the manifest, which is
written after all of them, belong to the archive.
"""

from __future__ import annotations

import gzip
import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridelake.llm.common import new_folder, short_batches, stage

#: Payloads shorter than this are always stored.
REVISIT_BYTES = 100
SHARD_BYTES = 16 << 20
ROLL_BYTES = 32 << 20
#: Id ranges counted at a time while shards are cut.
RANGES = 100_000
DATE = "1970-01-01T00:00:00Z"
LEVEL = 6

MANIFEST = "shard long, seq int, file string, records long, bytes long, sha256 string"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _payload(html: Column) -> Column:
    return F.encode(F.coalesce(html.cast("string"), F.lit("")), "UTF-8")


def _cuts(sizes: DataFrame, target: int) -> list[int]:
    """Smallest ids of the shards after the first, so that a shard holds about ``target`` bytes.

    Bytes are counted by equal ranges of ids, and crowded ranges by finer ones;
    the driver sees a bounded number of ranges, no rows.
    """
    lo, hi, total = sizes.agg(F.min("page_id"), F.max("page_id"), F.sum("n")).first()
    if lo is None or total <= target:
        return []
    span = hi - lo + 1
    width = max(1, math.ceil(span / min(RANGES, 8 * math.ceil(total / target))))
    key = F.expr(f"cast(floor((cast(page_id as decimal(20,0)) - {lo}) / {width}) as bigint)")
    coarse = sizes.filter("page_id is not null").groupBy(key.alias("b")).agg(F.sum("n").alias("n"))
    ranges, crowded = [], []
    for b, n in sorted(map(tuple, coarse.collect())):
        start = lo + b * width
        (crowded if n > target and width > 1 else ranges).append((start, n))
    if crowded:
        fine = {start: max(1, width // min(RANGES // len(crowded) + 1, 8 * math.ceil(n / target))) for start, n in crowded}
        steps = sizes.sparkSession.createDataFrame([((s - lo) // width, s, w) for s, w in fine.items()], "b long, s long, w long")
        inner = sizes.withColumn("b", key).join(F.broadcast(steps), "b")
        inner = inner.groupBy(F.expr("s + floor((page_id - s) / w) * w").cast("long").alias("start")).agg(F.sum("n").alias("n"))
        ranges = sorted(ranges + [tuple(r) for r in inner.collect()])
    cuts, held = [], 0
    for start, n in ranges:
        if held and held + n > target:
            cuts.append(start)
            held = 0
        held += n
    return cuts


def _record(kind: str, record: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", record), ("WARC-Date", DATE), *fields]
    head += [("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{name}: {value}\r\n" for name, value in head)
    return b"".join((b"WARC/1.1\r\n", lines.encode(), b"\r\n", block, b"\r\n\r\n"))


def _record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, ':'.join(map(str, parts)))}>"


def _page_record(page_id, url, payload: bytes, digest: str, copy: int, refers_to) -> bytes:
    target = quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else f"urn:page:{page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha256:{digest}")]
    fields += [("Content-Type", "application/http; msgtype=response")]
    if page_id is not None:
        fields.append(("Page-ID", str(page_id)))
    if url is not None:
        fields.append(("Page-URL-Hex", url.encode().hex()))
    if refers_to is None:
        return _record("response", _record_id(page_id, digest, copy), fields, http + payload)
    fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields += [("WARC-Refers-To", _record_id(refers_to, digest, 0)), ("Refers-To-Page-ID", str(refers_to))]
    return _record("revisit", _record_id(page_id, digest, copy), fields, http)


class _Files:
    """The files of one task: opens, rolls and commits them."""

    def __init__(self, folder: str, roll: int):
        self.fs, self.folder = fs.FileSystem.from_uri(folder)
        self.roll, self.out, self.done = roll, None, []

    def write(self, shard: int, record: bytes) -> None:
        if self.out is None or shard != self.shard or self.size >= self.roll:
            self.open(shard)
        self.put(record)
        self.records += 1

    def put(self, record: bytes) -> None:
        packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)  # a gzip member of its own, without a time
        packed = packer.compress(record) + packer.flush()
        self.out.write(packed)
        self.hash.update(packed)
        self.size += len(packed)

    def open(self, shard: int) -> None:
        seq = self.seq + 1 if self.out is not None and shard == self.shard else 0
        self.close()
        self.shard, self.seq, self.size, self.records, self.hash = shard, seq, 0, 0, hashlib.sha256()
        self.name = f"pages-{shard:06d}-{seq:04d}.warc.gz"
        self.temp = f"{self.folder}/temporary-{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temp)
        info = f"software: ridelake\r\nformat: WARC File Format 1.1\r\nfile: {self.name}\r\n".encode()
        self.put(_record("warcinfo", _record_id(self.name), [("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], info))

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        self.fs.move(self.temp, f"{self.folder}/{self.name}")
        self.done.append((self.shard, self.seq, self.name, self.records, self.size, self.hash.hexdigest()))
        self.out = None


def write_warc(
    pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES
) -> DataFrame:
    """Write ``pages`` (page_id, url, html; other columns are ignored) to WARC files; returns the manifest.

    Null html is an empty payload. Of equal payloads of at least 100 bytes the
    record with the smallest page id is a response and the others revisit it;
    of equal rows the first is the response. Rows without a page id are always
    responses and are never referred to. No pages give an empty manifest. No
    payload crosses the network more than once, and none goes through the driver.
    """
    spark = pages.sparkSession
    short_batches(spark)
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), _payload(F.col("html")).alias("payload"))
    pages = pages.withColumn("digest", F.sha2("payload", 256))
    light = stage(pages.select("page_id", "digest", F.octet_length("payload").cast("long").alias("n")), "warc-sizes")
    cuts = np.array(_cuts(light, shard_bytes), dtype=np.int64)
    sent = spark.sparkContext.broadcast(cuts)

    @F.pandas_udf("long")
    def shard_of(ids):
        # Rows without an id come first, in the shard of the smallest ids.
        return ids.fillna(-(1 << 63)).astype("int64").map(lambda i: int(np.searchsorted(sent.value, i, side="right")))

    shared = light.filter((F.col("n") >= REVISIT_BYTES) & F.col("page_id").isNotNull())
    shared = shared.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    revisits = light.filter(F.col("n") >= REVISIT_BYTES).join(shared, "digest").filter("page_id >= first")
    revisits = revisits.select("page_id", "digest", "first").distinct()
    rows = pages.select("page_id", "url", "payload", "digest", F.lit(None).cast("long").alias("first")).unionByName(
        revisits.withColumns({"url": F.lit(None).cast("string"), "payload": F.lit(None).cast("binary")})
    )
    rows = rows.withColumn("shard", shard_of("page_id")).withColumn("row", F.col("payload").isNotNull())
    rows = rows.repartition(max(1, len(cuts) + 1), "shard").sortWithinPartitions("shard", "page_id", "digest", "row", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, last, copy, first = _Files(folder, roll_bytes), None, 0, None
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("shard", "page_id", "url", "payload", "digest", "first"))
            for shard, page_id, url, payload, digest, refers in zip(*columns):
                if (page_id, digest) != last:
                    last, copy, first = (page_id, digest), 0, None
                if payload is None:
                    first = refers  # the row before its pages says which response they repeat
                    continue
                to = first if first is not None and (page_id != first or copy) else None
                files.write(shard, _page_record(page_id, url, payload, digest, copy, to))
                copy += 1
        files.close()
        rows = list(zip(*files.done)) or [[]] * 6
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        names = ["shard", "seq", "file", "records", "bytes", "sha256"]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows, kinds)], names)

    spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(
        spark._jvm.org.apache.hadoop.fs.Path(folder)
    )
    rows.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def records_of(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of one uncompressed WARC stream."""
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError("not a WARC record")
        head = {}
        while (line := stream.readline()) != b"\r\n":
            name, _, value = line.decode().partition(":")
            head[name] = value.strip()
        block = stream.read(int(head["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n" or f"sha256:{hashlib.sha256(block).hexdigest()}" != head["WARC-Block-Digest"]:
            raise ValueError(f"damaged record {head['WARC-Record-ID']}")
        yield head, block


def _page(head: dict[str, str], block: bytes) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length:")).split(b":")[1])
    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
    if head["WARC-Type"] == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged payload of {head['WARC-Record-ID']}")
    number = lambda name: int(head[name]) if name in head else None
    url = bytes.fromhex(head["Page-URL-Hex"]).decode() if "Page-URL-Hex" in head else None
    return number("Page-ID"), url, length, digest, head["WARC-Type"], number("Refers-To-Page-ID")


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """One row per page record of the files in the manifest; a damaged or missing file is an error."""
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").select("file", "records")
    names = READ.replace(",", "").split()[::2]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for file, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen, rows = 0, []
                with store.open_input_stream(f"{base}/{file}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for head, block in records_of(stream):
                        if head["WARC-Type"] == "warcinfo":
                            continue
                        rows.append(_page(head, block))
                        seen += 1
                        if len(rows) == 1000:
                            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names)
                            rows = []
                if seen != records:
                    raise ValueError(f"{file} has {seen} records, the manifest says {records}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names)

    return files.repartition(max(1, files.count())).mapInArrow(run, READ)


def archived(pages: DataFrame, folder: str | None = None, **sizes: int) -> DataFrame:
    """Write the pages to archives in ``folder`` (a new one in the shared folder if none) and read them back."""
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    write_warc(pages, folder, **sizes)
    return read_warc(spark, folder)
