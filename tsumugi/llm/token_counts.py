"""Token counts with a digest cache.

A text's normalised content and the tokenizer's version each have a SHA-256; their pair is the
key of a stored count.  The version digest covers the vocabulary file, the library's version
and the options.  Texts whose key isn't stored are encoded once per distinct content and their
counts appended to the cache, a Parquet table in the shared folder.

Defined results: null and empty texts have no bytes and no tokens; repeated texts are encoded
once and each row gets the count; an empty table appends nothing.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsumugi.llm.common import expand, looked_up, shared_root, small_batches, squeeze, written

CACHE_SCHEMA = "content_sha256 binary, version_sha256 string, n_tokens long"
#: Texts encoded together: bytes.
ENCODE_BYTES = 2 << 20


@lru_cache(maxsize=4)
def counter(path: str):
    """A function from texts to counts, and one that normalises a text (None: as it is)."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return (lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]), None
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    normal = model.normalizer
    return (lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]), (None if normal is None else normal.normalize_str)


def version_digest(path: str) -> str:
    import sentencepiece
    import tokenizers

    library = f"sentencepiece {sentencepiece.__version__}" if path.endswith(".model") else f"tokenizers {tokenizers.__version__}"
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + library.encode() + b"|no special tokens added").hexdigest()


def read_cache(spark, path: str) -> DataFrame:
    """The stored counts; an absent cache is empty."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.read.schema(CACHE_SCHEMA).parquet(path)
    return spark.createDataFrame([], CACHE_SCHEMA)


def fill_cache(docs: DataFrame, tokenizer: str, cache: str, *, text: str = "text") -> str:
    """Encode the distinct contents that the cache lacks and append their counts; returns the version digest.

    Each task sends a content once, compressed; copies of it meet in one task, which encodes the first.
    """
    spark = docs.sparkSession
    small_batches(spark)
    version = version_digest(tokenizer)
    stored = read_cache(spark, cache).filter(F.col("version_sha256") == version).select("content_sha256")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normal, seen = counter(tokenizer)[1], set()
        for batch in batches:
            keys, texts = [], []
            for x in batch.column(0).to_pylist():
                x = (normal(x or "") if normal else x or "").encode()
                key = hashlib.sha256(x).digest()
                if key not in seen:
                    seen.add(key)
                    keys.append(key)
                    texts.append(squeeze(x))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(texts, pa.binary())], names=["content_sha256", "packed"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, seen = counter(tokenizer)[0], set()
        for batch in batches:
            keys, counts, texts, held = [], [], [], 0
            for key, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key in seen:
                    continue
                seen.add(key)
                keys.append(key)
                texts.append(expand(packed).decode())
                held += len(texts[-1])
                if held >= ENCODE_BYTES:
                    counts += count(texts)
                    texts, held = [], 0
            counts += count(texts) if texts else []
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([version] * len(keys), pa.string()), pa.array(counts, pa.int64())], names=["content_sha256", "version_sha256", "n_tokens"])

    sent = docs.select(F.col(text)).mapInArrow(digests, "content_sha256 binary, packed binary")
    missing = sent.join(stored, "content_sha256", "left_anti").repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 24), "content_sha256")
    missing.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache)
    return version


def token_counts(docs: DataFrame, tokenizer: str, *, cache: str | None = None, text: str = "text", keys: tuple[str, ...] = ("doc_id",), limit: int = 1024) -> DataFrame:
    """keys, n_bytes, n_tokens, over_limit, one row per document."""
    spark = docs.sparkSession
    cache = cache or f"{shared_root(spark)}/token-count-cache"
    version = fill_cache(docs, tokenizer, cache, text=text)
    # a retried or repeated append may have stored a key again
    stored = read_cache(spark, cache).filter(F.col("version_sha256") == version).groupBy("content_sha256").agg(F.max("n_tokens").alias("n_tokens"))
    normal = counter(tokenizer)[1]
    body = F.coalesce(F.col(text), F.lit(""))
    if normal is not None:

        def normalised(batches):
            same = counter(tokenizer)[1]
            for batch in batches:
                rows = [hashlib.sha256(same(x or "").encode()).digest() for x in batch.column(batch.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.binary())], names=[*batch.schema.names, "__key"])

        source = docs.select(*keys, body.alias("__text"))
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields)
        keyed = source.mapInArrow(normalised, kinds + ", __key binary").withColumn("__bytes", F.octet_length("__text").cast("long"))
    else:
        keyed = docs.select(*keys, F.unhex(F.sha2(body, 256)).alias("__key"), F.octet_length(body).cast("long").alias("__bytes"))
    # how many rows share a content decides how they meet its count
    shared = keyed.groupBy("__key").agg(F.count(F.lit(1)).alias("__rows"))
    facts, _ = written(shared.join(stored, F.col("__key") == F.col("content_sha256")).select(F.col("__key").alias("content_sha256"), "__rows", "n_tokens"), "token-count-facts")
    joined = looked_up(keyed.withColumnRenamed("__key", "content_sha256"), facts, "content_sha256", "__rows", keys[0])
    return joined.select(*keys, F.col("__bytes").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
