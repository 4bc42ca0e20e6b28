"""Queries of the Japanese engine on small fixtures, with the expected rows as SQL values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsumugi.functions import chars, kana
from tsumugi.operators import alignment, lattice, patterns

LEXICON = [("今日", 1, 0, 1, "kanji"), ("今", 2, 0, 3, "kanji"), ("日", 3, 0, 5, "kanji"), ("は", 4, 0, 0, "hiragana"), ("良い", 5, 0, 2, "kanji"), ("天気", 6, 0, 2, "kanji"), ("です", 7, 0, 0, "hiragana"), ("学生", 8, 0, 2, "kanji"), ("私", 9, 0, 0, "kanji"), ("が", 10, 0, 0, "hiragana"), ("好き", 11, 0, 1, "kanji"), ("パン", 12, 0, 4, "katakana"), ("で", 13, 0, 0, "hiragana"), ("す", 14, 0, None, "hiragana")]
SENTENCES = [(1, "今日は良い天気です"), (2, "私は学生です"), (3, "パンが好き"), (4, "良いxです")]
SEGMENTED = [(1, "今日|は|良い|天気|です"), (2, "私|は|学生|です"), (3, "パン|が|好き"), (4, "良い|です")]
WORDS = [("がっこう", "gakkou"), ("とうきょう", "toukyou"), ("しんいち", "shin'ichi"), ("マッチ", "matchi"), ("ラーメン", "ramen"), ("じゃない", "janai"), ("日", "日")]
NUMBERS = [("100万", 1000000), ("100万500", 1000500), ("二千二万一", 20020001), ("二千万二万一", 20020001), ("万億", 1000000000000), ("十一", 11), ("百二十三億", 12300000000), ("二〇二〇", 2020)]
READINGS = [("取", "とり", "ja_kun"), ("次", "つぎ", "ja_kun"), ("店", "てん", "ja_on"), ("決", "けつ", "ja_on"), ("心", "しん", "ja_on"), ("北", "ほく", "ja_on"), ("方", "ほう", "ja_on"), ("明", "あ", "ja_kun"), ("時", "じ", "ja_on"), ("計", "けい", "ja_on"), ("人", "ひと", "ja_kun"), ("助", "すけ", "ja_kun")]
ALIGNED = [("取次店", "とりつぎてん", "取:とり:ja_kun 次:つぎ:ja_kun 店:てん:ja_on"), ("決心", "けっしん", "決:けっ:ja_on 心:しん:ja_on"), ("北方", "ほっぽう", "北:ほっ:ja_on 方:ぽう:ja_on"), ("時計", "とけい", "時:と:irr 計:けい:ja_on"), ("助っ人", "すけっと", "助:すけ:ja_kun っ 人:と:irr"), ("人々", "ひとびと", "人:ひと:ja_kun 々:びと:ja_kun"), ("明後日", "あさって", "明:あ:ja_kun 後:さっ:irr 日:て:irr")]
PATTERN = [{"id": "ask-answer", "pattern": {"sequence": [{"token": {"role": "user"}}, {"repeat": {"pattern": {"token": {"role": "assistant"}}, "min": 1, "max": 1000000}}]}}]


def values(rows: list[tuple], names: str) -> str:
    cell = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({names})"


def full_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = spark.createDataFrame(LEXICON, "text string, seq int, ord int, common int, script string")
    texts = spark.createDataFrame(SENTENCES, "sent_id int, text string")
    best = lattice.segment(texts, lexicon, k=1).join(texts, "sent_id")
    return best.select("sent_id", F.expr("array_join(transform(path, p -> substring(text, p.start + 1, p.end - p.start)), '|')").alias("words"))


def romanize_kana(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([w[:1] for w in WORDS], "kana string").select("kana", kana.romanise("kana").alias("romaji"))


def parse_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([n[:1] for n in NUMBERS], "text string").select("text", kana.parse_number("text").alias("value"))


def reading_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spark.createDataFrame([a[:2] for a in ALIGNED], "word string, reading string")
    readings = spark.createDataFrame([(k, i, t, r) for i, (k, r, t) in enumerate(READINGS)], "kanji string, ord int, type string, text string")
    parts = F.transform("parts", lambda p: F.coalesce(p["literal"], F.concat_ws(":", p["kanji"], p["kana"], p["type"])))
    return alignment.align_readings(words, readings).select("word", "reading", F.array_join(parts, " ").alias("parts"))


def analyze_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    ordered = rows.withColumn("i", F.expr("row_number() over (partition by conv_id order by turn, role, text)")).select("conv_id", "i", "role")
    return patterns.find_patterns(ordered, PATTERN, key="conv_id", order="i").select("conv_id", "start", "end")


def char_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", chars.count_class(F.col("text"), "digit").alias("digits"), chars.count_class(F.col("text"), "letter").alias("letters"))


def k_best_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = spark.createDataFrame([(1, 0, 2, 1, 10), (1, 0, 1, 2, 4), (1, 1, 2, 3, 5), (1, 2, 3, 4, 7)], "sent_id int, start int, end int, seq int, score long")
    lengths = spark.createDataFrame([(1, 3)], "sent_id int, n int")
    return lattice.best_paths(hits, lengths, k=3).select("sent_id", "rank", "score")


QUERIES = {f.__name__: f for f in (full_segment, romanize_kana, parse_number, reading_alignment, analyze_patterns, char_class_counts, k_best_path)}
ORACLES = {
    "full_segment": values(SEGMENTED, "sent_id, words"),
    "romanize_kana": values(WORDS, "kana, romaji"),
    "reading_alignment": values(ALIGNED, "word, reading, parts"),
    "parse_number": "SELECT text, CAST(value AS BIGINT) AS value FROM (" + values(NUMBERS, "text, value") + ")",
    "k_best_path": "SELECT sent_id, rank, CAST(score AS BIGINT) AS score FROM (" + values([(1, 1, 17), (1, 2, 16), (1, 3, -488)], "sent_id, rank, score") + ")",
    "char_class_counts": "SELECT doc_id, CAST(length(regexp_replace(text, '[^0-9０-９]', '', 'g')) AS INTEGER) AS digits, CAST(length(regexp_replace(text, '[^A-Za-zＡ-Ｚａ-ｚ]', '', 'g')) AS INTEGER) AS letters FROM documents",
    "analyze_patterns": """
WITH o AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM conversations),
n AS (SELECT o.*, (SELECT min(p.i) FROM o p WHERE p.conv_id = o.conv_id AND p.i > o.i AND p.role <> 'assistant') AS stop, max(i) OVER (PARTITION BY conv_id) AS total FROM o)
SELECT conv_id, CAST(i - 1 AS INTEGER) AS start, CAST(coalesce(stop, total + 1) - 1 AS INTEGER) AS "end" FROM n WHERE role = 'user' AND coalesce(stop, total + 1) > i + 1""",
}
