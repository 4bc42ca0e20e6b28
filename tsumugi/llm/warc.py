"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames; each bundle ends with a seek table in a skippable
frame, and an index maps every record id to its bundle, frame and offset inside the frame.
Of rows with equal payloads of at least ``least_bytes`` the one with the largest id is written
as a response and the others as revisits that refer to it.

Bundles are files in the shared folder, written under a name of their own per attempt and
listed by the manifest, a Parquet table: what a lost or repeated attempt leaves is not listed,
so never read.

Defined results: a null payload is empty; rows with a null id are written under the id
``null`` and never win over an id, though without any id the group is all responses; rows that
repeat the winning id are all responses; an empty table gives no bundle.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsumugi.llm.common import looked_up, scratch, small_batches, written

#: Uncompressed bytes of a frame and of a bundle, about.
FRAME_BYTES, BUNDLE_BYTES, LEVEL = 1 << 18, 64 << 20, 1
#: Tasks that read bundles at most.
READ_TASKS = 20_000
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "2020-01-01T00:00:00Z"
INDEX = "bundle string, record_id string, frame int, offset int, length int"
READ = "record_id string, record_type string, payload_bytes long, payload_digest string, refers_to string, target_uri string, payload binary"


def filesystem(uri: str):
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def record(kind: str, record_id: str, uri: str | None, payload: bytes, digest: str, size: int, refers_to: str | None) -> bytes:
    head = [f"WARC/1.1\r\nWARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{record_id}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    if uri is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in uri))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(data: bytes, at: int) -> tuple[dict, bytes, int]:
    """Headers and block of the record at ``at``, and where the next begins."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no record at {at}")
    head = dict(line.split(": ", 1) for line in lines[1:])
    start = end + 4
    stop = start + int(head["Content-Length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at {at} has no end")
    return head, data[start:stop], stop + 4


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The footer: compressed and plain size of each frame, in a frame that decoders skip."""
    body = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def frame_places(tail: bytes, length: int) -> list[tuple[int, int, int]]:
    """(start, compressed size, plain size) of each frame, from the last bytes of a bundle of ``length`` bytes."""
    n, _, magic = struct.unpack("<IBI", tail[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    entries = tail[-9 - 8 * n : -9]
    out, at = [], 0
    for i in range(n):
        c, d = struct.unpack_from("<II", entries, 8 * i)
        out.append((at, c, d))
        at += c
    if at + 8 + 8 * n + 9 != length:
        raise ValueError("the seek table doesn't fit the bundle")
    return out


class Bundle:
    """Random access to one bundle."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n = struct.unpack("<I", self.file.read_at(9, size - 9)[:4])[0]
        tail = self.file.read_at(9 + 8 * n, size - 9 - 8 * n)
        self.frames = frame_places(tail, size)

    def frame(self, i: int) -> bytes:
        at, size, plain = self.frames[i]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(size, at), max_output_size=plain)

    def record(self, frame: int, offset: int) -> tuple[dict, bytes]:
        return parse(self.frame(frame), offset)[:2]


class BundleWriter:
    def __init__(self, folder: str, stem: str):
        self.fs, path = filesystem(folder)
        self.path, self.uri = f"{path}/{stem}.warc.zst", f"{folder}/{stem}.warc.zst"
        self.fs.create_dir(path, recursive=True)
        self.out = self.fs.open_output_stream(self.path, compression=None)
        self.pack, self.buffer, self.sizes, self.plain, self.index = zstandard.ZstdCompressor(level=LEVEL), bytearray(), [], 0, []

    def add(self, record_id: str, data: bytes) -> None:
        if self.buffer and len(self.buffer) + len(data) > FRAME_BYTES:
            self.end_frame()
        self.index.append((self.uri, record_id, len(self.sizes), len(self.buffer), len(data)))
        self.buffer += data
        self.plain += len(data)

    def end_frame(self) -> None:
        if self.buffer:
            packed = self.pack.compress(bytes(self.buffer))
            self.out.write(packed)
            self.sizes.append((len(packed), len(self.buffer)))
            self.buffer = bytearray()

    def close(self) -> list[tuple]:
        self.end_frame()
        self.out.write(seek_table(self.sizes))
        self.out.close()
        return self.index


def planned(pages: DataFrame, *, key: str = "page_id", payload: str = "html", url: str | None = "url", least_bytes: int = 1000) -> DataFrame:
    """Rows to write: id, uri, body, bytes, digest, refers_to (null: a response)."""
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(key).alias("id"), (F.col(url) if url else F.lit(None)).cast("string").alias("uri"), body.alias("body"), F.octet_length(body).cast("long").alias("bytes"), F.sha1(body.cast("binary")).alias("digest"))
    # copies are found on digests alone, and bodies are dealt out by id: they don't meet in one task because they are equal
    large = rows.filter(F.col("bytes") >= least_bytes).select("id", "digest")
    best, _ = written(large.groupBy("digest").agg(F.max("id").alias("winner"), F.count(F.lit(1)).alias("n")).filter("n > 1 and winner is not null"), "warc-groups")
    refers = looked_up(large, best, "digest", "n", "id").filter(F.col("winner").isNotNull() & ~F.col("id").eqNullSafe(F.col("winner")))
    refers = refers.select(F.col("id").alias("__id"), F.col("digest").alias("__digest"), F.col("winner").cast("string").alias("refers_to")).distinct()
    return rows.join(refers, rows["id"].eqNullSafe(refers["__id"]) & (rows["digest"] == refers["__digest"]), "left").select(*rows.columns, "refers_to")


def write_archives(pages: DataFrame, folder: str, **options) -> DataFrame:
    """Write bundles under ``folder``; returns the index, itself written as Parquet beside them."""
    spark = pages.sparkSession
    small_batches(spark)
    rows = planned(pages, **options).select(F.col("id").cast("string").alias("id"), "uri", "body", "bytes", "digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq, writer = TaskContext.get(), 0, None

        def listed(index):
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in index], pa.string() if i < 2 else pa.int32()) for i in range(5)], names=["bundle", "record_id", "frame", "offset", "length"])

        for batch in batches:
            for r in batch.to_pylist():
                if writer is None:
                    writer = BundleWriter(folder, f"part-{task.partitionId():05d}-{seq:03d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}")
                name, kind = r["id"] or "null", "response" if r["refers_to"] is None else "revisit"
                writer.add(name, record(kind, name, r["uri"], b"" if r["refers_to"] is not None else r["body"].encode(), r["digest"], r["bytes"], r["refers_to"]))
                if writer.plain >= BUNDLE_BYTES:
                    yield listed(writer.close())
                    writer, seq = None, seq + 1
        if writer is not None:
            yield listed(writer.close())

    rows.mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def read_archives(index: DataFrame, *, payloads: bool = True) -> DataFrame:
    """Every record of the bundles that the index lists, payloads checked against their digests."""
    small_batches(index.sparkSession)
    names, _ = written(index.select("bundle").distinct(), "warc-bundles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                bundle = Bundle(name)
                for i in range(len(bundle.frames)):
                    data, at, rows = bundle.frame(i), 0, []
                    while at < len(data):
                        head, block, at = parse(data, at)
                        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        kind, size = head["WARC-Type"], int(head["X-Payload-Length"])
                        if kind == "response" and (len(block) != size or hashlib.sha1(block).hexdigest() != digest):
                            raise ValueError(f"{head['WARC-Record-ID']} in {name} is damaged")
                        bare = lambda x: None if x is None else x.removeprefix("<urn:page:").removesuffix(">")
                        rows.append((bare(head["WARC-Record-ID"]), kind, size, digest, bare(head.get("WARC-Refers-To")), head.get("WARC-Target-URI"), block if payloads else None))
                    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds[c]) for c in range(7)], names=[x.split()[0] for x in READ.split(", ")])

    # dealt out in turn, so a task reads few bundles however small their names are
    return names.repartition(max(1, min(names.count(), READ_TASKS))).mapInArrow(run, READ)


def fetched(index: DataFrame, record_ids: list[str]) -> list[tuple[dict, bytes]]:
    """Single records by id: one frame of one bundle is read for each."""
    found = index.filter(F.col("record_id").isin(record_ids)).collect()
    return [Bundle(r["bundle"]).record(r["frame"], r["offset"]) for r in found]


def round_trip(pages: DataFrame, *, key: str = "page_id", folder: str | None = None, **options) -> DataFrame:
    """Write, then read back: key, payload_bytes, payload_digest, record_type, refers_to."""
    folder = folder or scratch(pages.sparkSession, "warc")
    index = write_archives(pages, folder, key=key, **options)
    kind = pages.schema[key].dataType
    back = read_archives(index, payloads=False)
    return back.select(F.when(F.col("record_id") != "null", F.col("record_id")).cast(kind).alias(key), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
