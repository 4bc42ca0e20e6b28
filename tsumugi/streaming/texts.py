"""The same operators on streams.

Sentences don't depend on each other, so a stream of texts is a row of small batches; each is
written under its own number, and a batch that is repeated after a failure replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tsumugi.functions import chars, kana


def romanised(texts: DataFrame, *, text: str = "text", method: str = "traditional") -> DataFrame:
    """Adds ``romaji`` of texts in kana; stateless, so it runs on a stream as on a table."""
    return texts.withColumn("romaji", kana.romaniser(method)(chars.normalise(F.col(text))))


def sentences(texts: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sent_no, sentence) of whole documents; stateless."""
    return texts.select(key, F.posexplode(chars.sentences(F.col(text))).alias("sent_no", "sentence"))


def written(stream: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, *, once: bool = False) -> StreamingQuery:
    """Run ``work`` on every batch of a stream and write it to ``path/batch=N``; ``once`` stops when what is there is done."""

    def store(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    begun = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (begun.trigger(availableNow=True) if once else begun).start()


def windowed(events: DataFrame, time: str, by: list[str], length: str, *, slide: str | None = None, late: str | None = None) -> DataFrame:
    """(start, end, by, n): events of each window of ``length``, moved on by ``slide``; rows more than ``late`` behind are left out of a stream."""
    rows = events.withWatermark(time, late) if late else events
    counted = rows.groupBy(F.window(time, length, slide) if slide else F.window(time, length), *by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n")


def sessions(events: DataFrame, time: str, by: list[str], gap: str | Column, *, late: str | None = None) -> DataFrame:
    """(start, end, by, n): runs of events with less than ``gap`` between two."""
    rows = events.withWatermark(time, late) if late else events
    counted = rows.groupBy(F.session_window(time, gap), *by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "n")
