"""Quality by compression: zstandard dictionaries of good and bad text.

A text is cut into pieces of ``PIECE`` bytes (all of them; nothing is left out), each piece is
compressed with either dictionary, and the difference of the summed sizes is divided by their
sum.  A logistic curve fitted on labelled rows outside the dictionaries' own turns it into a
score from 0 to 1.

The dictionaries and the curve are fitted on at most ``SAMPLE_ROWS`` labelled rows of a class,
taken by a hash of their id, from texts of at most ``SAMPLE_BYTES`` bytes, in one task of an
executor.  Only learning is bounded so; every text is scored whole.

Defined results: null and empty texts have difference 0 and so the curve's score at 0; rows
without a label never teach; with one class or none labelled the score is the share of label 1
(0.5 without labels); repeated rows each get their score; of several texts under one id the
smallest teaches; a null id never teaches and isn't held out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsumugi.llm.common import as_bytes, lean, small_batches

SAMPLE_ROWS, SAMPLE_BYTES = 3000, 1 << 15
DICT_BYTES, PIECE, LEVEL = 112 << 10, 384, 3


@dataclass
class Model:
    good: bytes
    bad: bytes
    slope: float
    offset: float

    def scorer(self):
        if not self.good or not self.bad:
            flat = 1 / (1 + math.exp(-self.offset))
            return lambda data: flat
        pair = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (self.good, self.bad)]

        def score(data: bytes) -> float:
            return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.slope * difference(pair, data) + self.offset))))

        return score


def difference(pair, data: bytes) -> float:
    """(bad size - good size) / (bad size + good size); above 0 where the good dictionary fits better."""
    good = bad = 0
    for i in range(0, len(data), PIECE):
        piece = data[i : i + PIECE]
        good += len(pair[0].compress(piece))
        bad += len(pair[1].compress(piece))
    return (bad - good) / (bad + good) if good + bad else 0.0


def dictionary(texts: list[bytes]) -> bytes:
    pieces = [x[i : i + PIECE] for x in texts for i in range(0, len(x), PIECE)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself serves
        return b"".join(pieces)[-DICT_BYTES:] or b" " * 8


def fit(good: list[bytes], bad: list[bytes], prior: float = 0.5) -> Model:
    """Dictionaries from three quarters of the rows, the curve from the rest; ``prior`` is the share of label 1."""
    if not good or not bad:
        share = (len(good) + 0.5) / (len(good) + len(bad) + 1)
        return Model(b"", b"", 0.0, math.log(share / (1 - share)))
    part = lambda rows: (rows[len(rows) // 4 :] or rows, rows[: len(rows) // 4] or rows)
    (g, g_rest), (b, b_rest) = part(good), part(bad)
    model = Model(dictionary(g), dictionary(b), 1.0, 0.0)
    pair = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (model.good, model.bad)]
    x = np.array([difference(pair, t) for t in g_rest] + [difference(pair, t) for t in b_rest])
    y = np.array([1.0] * len(g_rest) + [0.0] * len(b_rest))
    weight = np.where(y == 1, prior / max(1, y.sum()), (1 - prior) / max(1, (1 - y).sum())) * len(y)
    scale = x.std() or 1.0
    w = np.zeros(2)
    rows = np.stack([x / scale, np.ones_like(x)], 1)
    for _ in range(50):  # Newton's steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        gradient = rows.T @ (weight * (p - y)) + 1e-2 * w
        hessian = (rows * (weight * p * (1 - p))[:, None]).T @ rows + 1e-2 * np.eye(2)
        w = w - np.linalg.solve(hessian, gradient)
    model.slope, model.offset = float(w[0] / scale), float(w[1])
    return model


def is_held_out(key) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = SAMPLE_ROWS) -> Model:
    """Fit on labelled rows that aren't held out; at most ``rows`` of a class meet in the task that learns."""
    pool = labels.select(F.col(key).alias("k"), F.col(label).alias("y")).filter(F.col("y").isin(0, 1) & F.col("k").isNotNull()).filter(~is_held_out("k"))
    pool = pool.groupBy("k").agg(F.min("y").alias("y"), F.max("y").alias("z")).filter("y = z")
    chosen = None
    for y in (1, 0):
        part = pool.filter(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(rows).select("k", "y")
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("x")).filter(F.octet_length("x").between(1, SAMPLE_BYTES))
    got = texts.join(F.broadcast(chosen), "k").groupBy("k").agg(F.min("y").alias("y"), F.min("x").alias("x")).select(F.col("k").cast("string").alias("k"), "y", F.encode("x", "UTF-8").alias("x"))
    share = pool.agg(F.avg("y")).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(((hash_order(k), k, y, x) for b in batches for k, y, x in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: r[:2])
        model = fit([r[3] for r in rows if r[2] == 1], [r[3] for r in rows if r[2] == 0], share)
        yield pa.RecordBatch.from_pydict({"good": [model.good], "bad": [model.bad], "slope": [model.slope], "offset": [model.offset]}, schema=pa.schema([("good", pa.binary()), ("bad", pa.binary()), ("slope", pa.float64()), ("offset", pa.float64())]))

    small_batches(docs.sparkSession)
    found = got.repartition(1).mapInArrow(lean(run), "good binary, bad binary, slope double, offset double").first()
    return Model(bytes(found["good"]), bytes(found["bad"]), found["slope"], found["offset"]) if found else fit([], [])


def hash_order(key) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(str(key).encode())


def scored(docs: DataFrame, model: Model, *, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keys, score double."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*keys, F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]) + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = held.value.scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([score(x) for x in as_bytes(batch.columns[-1])], pa.float64())], names=[*batch.schema.names[:-1], "score"])

    return source.mapInArrow(lean(run), schema)


def kept(docs: DataFrame, model: Model, *, text: str = "text", least: float = 0.5) -> DataFrame:
    """Documents with a score of ``least`` or more, with all their columns."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = held.value.scorer()
        for batch in batches:
            yield batch.filter(pa.array([score(x) >= least for x in as_bytes(batch.column(place))], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
