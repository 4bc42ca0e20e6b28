"""Benchmark decontamination with a broadcast hash set of normalised test n-grams.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.  An item's windows
are its runs of ``n`` consecutive words; an item of fewer words is one window of its own.  The
set is broadcast only while the built index stays below ``max_broadcast_bytes``, which is
computed from the benchmark's words before anything is collected; beyond that the windows of documents and items meet in a shuffle join.

Defined results: null or empty texts have no words and no hits; an item without words has no
windows; items with a null id mark words but are not counted; repeated item ids count once;
repeated documents each get their own row; empty tables give no rows or no hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsumugi.llm.common import ALNUM_WORDS, as_bytes, byte_words, lean, small_batches

WORD = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Bytes that the built index may take, by ``index_bytes``.
MAX_BROADCAST_BYTES = 64 << 20
OUT = "row_key binary, hit_runs array<struct<start: int, end: int>>, n_words long, n_hit long, n_items long, items_sha256 string"


class WindowIndex:
    """Windows of the items by length, in arrays: sorted hashes, the word ids for verification, and the items of each."""

    def __init__(self, items: list[tuple[object, bytes]], n: int):
        self.vocab: dict[bytes, int] = {}
        names: dict[str, int] = {}
        parts: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item, text in items:
            words = byte_words(text, ALNUM_WORDS)
            ids = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words], np.uint32)
            m = min(n, len(ids))
            if m:
                parts.setdefault(m, []).append((np.lib.stride_tricks.sliding_window_view(ids, m), -1 if item is None else names.setdefault(str(item), len(names))))
        self.names = list(names)
        #: length: (hashes, word ids, where the items of each window begin, items)
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for m, own in parts.items():
            rows, place = np.unique(np.concatenate([w for w, _ in own]), axis=0, return_inverse=True)
            hashes = self.hash_of(rows.astype(np.uint64))
            order = np.argsort(hashes, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            pairs = np.unique(np.stack([rank[place.ravel()], np.repeat([i for _, i in own], [len(w) for w, _ in own])], 1), axis=0)
            pairs = pairs[pairs[:, 1] >= 0]
            self.windows[m] = (hashes[order], rows[order], np.searchsorted(pairs[:, 0], np.arange(len(order) + 1)), pairs[:, 1].astype(np.int32))

    @staticmethod
    def hash_of(ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), np.uint64)
        for column in ids.T:
            out = out * np.uint64(0x9E3779B97F4A7C15) + column
        return out

    def scan(self, data: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Words, maximal hit runs of words, and the items found."""
        words = byte_words(data, ALNUM_WORDS)
        n = len(words)
        ids = np.fromiter(map(self.vocab.get, words, repeat(0)), np.uint64, n)
        gaps = np.concatenate(([0], np.cumsum(ids == 0)))
        cover, items = np.zeros(n + 1, np.int64), set()
        for m, (hashes, held, starts, owners) in self.windows.items():
            if n < m:
                continue
            at = np.flatnonzero(gaps[m:] == gaps[:-m])
            if not len(at):
                continue
            rows = ids[at[:, None] + np.arange(m)]
            keys = self.hash_of(rows)
            place = np.searchsorted(hashes, keys)
            open_ = np.flatnonzero(place < len(hashes))
            while len(open_):  # windows of equal hash lie side by side
                open_ = open_[hashes[place[open_]] == keys[open_]]
                same = (held[place[open_]] == rows[open_]).all(1)  # the hash only proposes; the words decide
                np.add.at(cover, at[open_[same]], 1)
                np.add.at(cover, at[open_[same]] + m, -1)
                for p in np.unique(place[open_[same]]).tolist():
                    items.update(owners[starts[p] : starts[p + 1]].tolist())
                open_ = open_[~same]
                place[open_] += 1
                open_ = open_[place[open_] < len(hashes)]
        hit = np.concatenate(([0], (np.cumsum(cover[:-1]) > 0).astype(np.int8), [0]))
        edge = np.flatnonzero(np.diff(hit))
        return n, list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)), {self.names[i] for i in items}


def words_of(column: str) -> F.Column:
    return F.regexp_extract_all(F.translate(F.coalesce(F.col(column), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"))


def index_bytes(items: DataFrame, n: int) -> int:
    """What the index of ``items`` takes at most: for each word a window of ``n`` ids, a hash, a place and an item, and an entry of the dictionary of words."""
    n_words, size = items.agg(F.sum(F.size(words_of("item_text")).cast("long")), F.sum(F.octet_length("item_text").cast("long"))).first()
    return (n_words or 0) * (4 * n + 20 + 120) + (size or 0)


def items_digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def find_hits(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", n: int = 8, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """One row per document: key, hit_runs (word indexes), n_words, n_hit, n_items, items_sha256."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(key).alias("doc_key"), F.col(text).alias("doc_text"))
    items = benchmark.select(F.col(item).alias("item_key"), F.col(item_text).alias("item_text"))
    if index_bytes(items, n) > max_broadcast_bytes:
        return joined_hits(docs, items, n).withColumnRenamed("doc_key", key)
    rows = [(r[0], (r[1] or "").encode()) for r in items.collect()]
    index = spark.sparkContext.broadcast(WindowIndex(rows, n))
    kind = docs.schema["doc_key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = index.value.scan
        for batch in batches:
            found = [scan(x) for x in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([[{"start": a, "end": b} for a, b in x[1]] for x in found], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                    pa.array([x[0] for x in found], pa.int64()),
                    pa.array([sum(b - a for a, b in x[1]) for x in found], pa.int64()),
                    pa.array([len(x[2]) for x in found], pa.int64()),
                    pa.array([items_digest(x[2]) for x in found], pa.string()),
                ],
                names=["doc_key", "hit_runs", "n_words", "n_hit", "n_items", "items_sha256"],
            )

    return docs.mapInArrow(lean(run), OUT.replace("row_key binary", f"doc_key {kind}")).withColumnRenamed("doc_key", key)


def joined_hits(docs: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """The same result for a benchmark of any size: windows are exploded and joined by their words.

    Documents are keyed by content, so repeated rows are scanned once and matched once.
    """
    window = lambda m: F.expr(f"transform(sequence(0, size(w) - {m}), i -> struct(i, array_join(slice(w, i + 1, {m}), ' ') as g))")
    listed = items.select("item_key", words_of("item_text").alias("w")).filter(F.size("w") > 0).withColumn("m", F.least(F.lit(n), F.size("w")))
    listed = listed.withColumn("x", F.explode(F.expr("transform(sequence(0, size(w) - m), i -> array_join(slice(w, i + 1, m), ' '))"))).select("item_key", "m", F.col("x").alias("g")).distinct()
    found = docs.withColumn("row_key", F.unhex(F.sha2(F.coalesce(F.col("doc_text"), F.lit("")), 256))).withColumn("w", words_of("doc_text"))
    distinct = found.select("row_key", "w").dropDuplicates(["row_key"])
    parts = None
    # only lengths that some item has: n, and those of shorter items
    for m in sorted(r["m"] for r in listed.select("m").distinct().collect()):
        part = distinct.filter(F.size("w") >= m).select("row_key", F.explode(window(m)).alias("x")).select("row_key", F.col("x.i").alias("i"), F.col("x.g").alias("g"), F.lit(m).alias("m"))
        part = part.join(listed, ["m", "g"])
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        parts = distinct.filter(F.lit(False)).select("row_key", F.lit(0).alias("i"), F.lit(0).alias("m"), F.lit("").alias("item_key"))
    per_doc = parts.groupBy("row_key").agg(F.array_sort(F.collect_set(F.struct("i", "m"))).alias("at"), F.array_sort(F.collect_set(F.col("item_key").cast("string"))).alias("ids"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                runs: list[dict] = []
                for x in r["at"]:
                    if runs and x["i"] <= runs[-1]["end"]:
                        runs[-1]["end"] = max(runs[-1]["end"], x["i"] + x["m"])
                    else:
                        runs.append({"start": x["i"], "end": x["i"] + x["m"]})
                yield pa.RecordBatch.from_pylist([{"row_key": r["row_key"], "hit_runs": runs, "n_hit": sum(x["end"] - x["start"] for x in runs), "n_items": len(r["ids"]), "items_sha256": items_digest(set(r["ids"]))}], schema=pa.schema([("row_key", pa.binary()), ("hit_runs", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string())]))

    merged = per_doc.mapInArrow(lean(merge), OUT.replace("n_words long, ", ""))
    out = found.select("doc_key", "row_key", F.size("w").cast("long").alias("n_words")).join(merged, "row_key", "left")
    none = F.lit(items_digest(set()))
    return out.select("doc_key", F.coalesce("hit_runs", F.expr("cast(array() as array<struct<start: int, end: int>>)")).alias("hit_runs"), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"))


def cut_runs(text: str, runs: list[tuple[int, int]]) -> str:
    """The text without the words of the runs, nor what stands between them."""
    at = [m.span() for m in WORD.finditer(text.translate({c: c + 32 for c in range(65, 91)}))]
    out, last = [], 0
    for a, b in runs:
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return "".join([*out, text[last:]])


def cut_by_join(docs: DataFrame, items: DataFrame, text: str, n: int, drop_items: int) -> DataFrame:
    """decontaminated() for a benchmark of any size, by joined_hits; documents meet their hits by content."""
    digest = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    distinct = docs.select(digest.alias("doc_key"), F.col(text).alias("doc_text")).dropDuplicates(["doc_key"])
    # texts without hits stay out, so most documents meet nothing
    hits = joined_hits(distinct, items, n).filter(F.size("hit_runs") > 0).select(F.col("doc_key").alias("__digest"), F.col("hit_runs").alias("__runs"), F.col("n_items").alias("__items"))
    both = docs.withColumn("__digest", digest).join(hits, "__digest", "left").filter(F.coalesce("__items", F.lit(0)) < drop_items).select(*docs.columns, "__runs")
    names, place = docs.columns, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            for i, runs in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if runs:
                    texts[i] = cut_runs(texts[i], [(x["start"], x["end"]) for x in runs])
            columns = [pa.array(texts, c.type) if i == place else c for i, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return both.mapInArrow(lean(run), docs.schema)


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", n: int = 8, drop_items: int = 2, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Documents with hits of ``drop_items`` or more items go; from others the hit spans are cut.

    All columns of ``docs`` are kept; ``text`` alone changes.  Works in one scan while the
    benchmark is below the broadcast bound; beyond it the hits of each distinct text are joined.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select("item_id", "text")
    if index_bytes(items.toDF("item_key", "item_text"), n) > max_broadcast_bytes:
        return cut_by_join(docs, items.toDF("item_key", "item_text"), text, n, drop_items)
    index = spark.sparkContext.broadcast(WindowIndex([(r[0], (r[1] or "").encode()) for r in items.collect()], n))
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = index.value.scan
        for batch in batches:
            texts, keep = batch.column(place).to_pylist(), []
            for i, x in enumerate(texts):
                _, runs, found = scan((x or "").encode())
                keep.append(len(found) < drop_items)
                if runs:
                    texts[i] = cut_runs(x, runs)
            columns = [pa.array(texts, batch.column(place).type) if i == place else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
