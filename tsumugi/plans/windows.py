"""Event windows of the streaming operators, run on the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsumugi.streaming import texts


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")


def seconds(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"start": F.unix_seconds("start"), "end": F.unix_seconds("end")})


def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seconds(texts.windowed(events(spark, sf_dir), "ts", ["event_type"], "10 minutes"))


def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seconds(texts.windowed(events(spark, sf_dir), "ts", ["event_type"], "10 minutes", slide="5 minutes"))


def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seconds(texts.sessions(events(spark, sf_dir), "ts", ["user_id"], "6 hours"))


QUERIES = {f.__name__: f for f in (tumbling_windows, sliding_windows, session_windows)}
_SECONDS = "CAST(floor(epoch(ts)) AS BIGINT)"
ORACLES = {
    "tumbling_windows": f'SELECT {_SECONDS} // 600 * 600 AS start, {_SECONDS} // 600 * 600 + 600 AS "end", event_type, count(*) AS n FROM events GROUP BY 1, 2, 3',
    "sliding_windows": f'SELECT {_SECONDS} // 300 * 300 - o AS start, {_SECONDS} // 300 * 300 - o + 600 AS "end", event_type, count(*) AS n FROM events, (VALUES (CAST(0 AS BIGINT)), (300)) AS t(o) GROUP BY 1, 2, 3',
    "session_windows": """
WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
b AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM a)
SELECT CAST(floor(epoch(min(ts))) AS BIGINT) AS start, CAST(floor(epoch(max(ts) + INTERVAL 6 HOUR)) AS BIGINT) AS "end", user_id, count(*) AS n FROM b GROUP BY user_id, g""",
}
