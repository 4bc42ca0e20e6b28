"""What the operators share: tables, scratch folders, packed chunks and byte-level words."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch; texts may be long, so batches are kept small.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the rows that one Arrow batch holds."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_root(spark: SparkSession) -> str:
    """The folder that every executor shares; one of our own only where none is named."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="tsumugi-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


#: Whether Spark deletes a query's shuffle files at its end; else they stay until the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write to the shared folder and read again: cuts lineage and survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, label)
    held = spark.conf.get(CLEANUP)
    # the shuffle files of this query go with it: nothing reads them again
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, held)
    return spark.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of queries that are over: it does so once the driver collects garbage."""
    spark.sparkContext._jvm.System.gc()


#: Keys that ``looked_up`` broadcasts at most, and the rows from which a key may be one of them.
HOT_KEYS, HOT_ROWS = 1000, 2000
#: Bytes of input that one task of an exchange of chunks takes, about.
TASK_BYTES = 32 << 20


def task_width(spark: SparkSession, size: int) -> int:
    """Tasks for an exchange that moves ``size`` bytes of input: their share stays the same as the input grows."""
    return max(24, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))


def looked_up(rows: DataFrame, facts: DataFrame, on: str, size: str, spread: str) -> DataFrame:
    """``rows`` with the columns of ``facts`` (one row for each value of ``on``; ``size``: how many rows have it).

    A value with more than a thousandth of all rows goes by broadcast, of which there can't be
    more than ``HOT_KEYS``; its rows are dealt out by ``spread`` instead of ``on``.
    """
    total = facts.agg(F.sum(size)).first()[0] or 0
    values = [c for c in facts.columns if c not in (on, size)]
    bound = max(HOT_ROWS, total // HOT_KEYS)
    hot = facts.filter(F.col(size) > bound).select(F.col(on).alias("__hot"), *[F.col(c).alias(f"__{c}") for c in values])
    cold = facts.filter(F.col(size) <= bound).select(F.col(on).alias("__cold"), F.lit(0).cast("long").alias("__zero"), *values)
    marked = rows.join(F.broadcast(hot), F.col(on) == F.col("__hot"), "left")
    away = F.when(F.col("__hot").isNotNull() | F.col(on).isNull(), F.shiftrightunsigned(F.xxhash64(spread), 1) + 1).otherwise(F.lit(0).cast("long"))
    both = marked.withColumn("__salt", away).join(cold, (F.col(on) == F.col("__cold")) & (F.col("__salt") == F.col("__zero")), "left")
    return both.select(*[rows[c] for c in rows.columns], *[F.when(F.col("__hot").isNotNull(), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in values])


def total_bytes(df: DataFrame, column: str) -> int:
    return int(df.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def table_of(lower: bool, keep) -> bytes:
    out = bytearray(256)
    for b in range(256):
        c = b + 32 if lower and 65 <= b <= 90 else b
        out[b] = c if keep(c) else 32
    return bytes(out)


#: A-Z lower-cased; blanks and 0x09-0x0D separate words.
BLANK_WORDS = table_of(True, lambda c: c != 32 and not 9 <= c <= 13)
#: A-Z lower-cased; only digits, letters and bytes of non-ASCII characters form words.
ALNUM_WORDS = table_of(True, lambda c: 48 <= c <= 57 or 97 <= c <= 122 or c >= 128)


def byte_words(data: bytes, kind: bytes) -> list[bytes]:
    """Words of UTF-8 bytes.  bytes.split() cuts at exactly space and 0x09-0x0D."""
    return data.translate(kind).split()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def give_back() -> None:
    """Hand memory that was freed back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow; Python workers outlive their tasks, so each task gives back what it freed."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def squeeze(data: bytes, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack_rows(batch: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(batch)
    return sink.getvalue().to_pybytes()


def unpack_rows(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


def chunked(df: DataFrame, chunk_bytes: int, label: str) -> tuple[DataFrame, str]:
    """Rows packed into chunks of about ``chunk_bytes``, written to the shared folder.

    Returns (chunk_id long, payload binary).  A chunk is fixed once written, so later
    passes see the same rows under the same id, whichever executors are lost.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, size, seq = TaskContext.get().partitionId(), [], 0, 0

        def flush():
            nonlocal held, size, seq
            payload = pack_rows(pa.Table.from_batches(held).combine_chunks())
            out = pa.RecordBatch.from_pydict({"chunk_id": pa.array([(ids << 32) + seq], pa.int64()), "payload": pa.array([payload], pa.binary())})
            held, size, seq = [], 0, seq + 1
            return out

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= chunk_bytes:
                yield flush()
        if any(b.num_rows for b in held):
            yield flush()

    small_batches(df.sparkSession)
    return written(df.mapInArrow(lean(run), "chunk_id long, payload binary"), label)


def local_path(uri: str) -> str | None:
    """The path of a file: URI or plain path, else None."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if "://" not in uri else None


def public_tokenizer(name: str) -> str:
    import public_tokenizers

    return os.path.abspath(public_tokenizers.path(name))
