"""Every registered query against its SQL, and the kernels on fixed cases."""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest

from tsumugi.functions import kana
from tsumugi.plans.registry import ORACLES, QUERIES, flagship

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    """Rows and columns of every registered query; several run at a time, as most are small."""

    def run(name):
        try:
            got = QUERIES[name](spark, SF)
            return got.columns, [tuple(r) for r in got.collect()]
        except Exception as error:
            return error

    with ThreadPoolExecutor(6) as pool:
        return dict(zip(QUERIES, pool.map(run, QUERIES), strict=True))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(results, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    want = con.sql(ORACLES[name])
    if isinstance(results[name], Exception):
        raise results[name]
    names, rows = results[name]
    columns = sorted(want.columns)
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    wanted = want.select(*[f'"{c}"' for c in columns]).fetchall()
    assert wanted and sorted(repr(tuple(r[i] for i in place)) for r in rows) == sorted(map(repr, wanted))


def test_flagship(spark):
    assert flagship(spark, SF).count() > 0


def test_numbers():
    for n in (0, 10001, 20020001, 12423000430, 10**16 + 7):
        assert kana.number_of(kana.kanji_number(n)) == n
    assert kana.number_of("100万500") == 1000500 and kana.number_of("犬") is None


def test_romaji():
    assert kana.romanise_word("しゃしん", "kunrei") == "syasin" and kana.romanise_word(None) is None
    cases = {"hepburn": "toukyou", "simple": "tokyo", "passport": "tohkyoh", "traditional": "tōkyō", "modified": "tōkyō", "kunrei": "tôkyô"}
    assert {m: kana.romanise_word("とうきょう", m) for m in kana.METHODS} == cases
    words = {"マッチ": "matchi", "しんいち": "shin-ichi", "しんぶん": "shimbun", "ファン": "fan", "ティ": "ti", "ウィ": "wi", "ヴァ": "va", "ちゝ": "chichi", "いすゞ": "isuzu", "っ": "!", "ー": "~", "ラーメン": "ramen"}
    assert {w: kana.romanise_word(w, "traditional") for w in words} == words
    assert kana.join_parts(["a", "b", ", ", "c", "", "。", "d"]) == "a b, c。 d"


def test_kana_numbers():
    words = {0: "れい", 300: "さんびゃく", 600: "ろっぴゃく", 8000: "はっせん", 10**4: "いちまん", 10**12: "いっちょう", 1234: "せん にひゃく さんじゅう よん"}
    assert {n: kana.kana_number(n) for n in words} == words
    assert kana.kanji_number(10**7) == "一千万" and kana.kanji_number(1100) == "千百"


def test_chars(spark):
    from pyspark.sql import functions as F

    from tsumugi.functions import chars as c

    one = lambda col: spark.range(1).select(col.alias("x")).first()["x"]
    lit = F.lit
    assert one(c.normalise(lit("ｶﾞｷﾞ１Ａ。"))) == "ガギ1A. "
    assert one(c.mora_length(lit("がっこうー"))) == 3
    assert one(c.rendaku(lit("かみ"))) == "がみ" and one(c.rendaku(lit("ほう"), half=True)) == "ぽう" and one(c.unrendaku(lit("ぽう"))) == "ほう"
    assert one(c.geminate(lit("けつ"))) == "けっ" and one(c.geminate(lit(""))) == ""
    assert one(c.kanji_mask(lit("取り次ぐ"))) == "%り%ぐ" and one(c.kanji_match(lit("食べる"), lit("たべる"))) and not one(c.kanji_match(lit("食べる"), lit("たべた")))
    assert one(c.kanji_cross_match(lit("食べる"), lit("たべる"), lit("食べた"))) == "たべた" and one(c.kanji_cross_match(lit("a"), lit("b"), lit("c"))) is None
    assert one(c.sequential_kanji(lit("今日は良い天気"))) == [1, 6]
    assert one(c.sticky_positions(lit("がっこう"))) == [2] and one(c.sticky_positions(lit("しゃー"))) == [1] and one(c.sticky_positions(lit(""))) == []
    assert one(c.destem(lit("食べる"), 1)) == "食べ" and one(c.destem(lit("食べる"), 3)) == ""
    assert [(x.start, x.end) for x in one(c.class_runs(lit("aカタbナ"), "katakana"))] == [(1, 3), (4, 5)]
    assert [(x.type, x.text) for x in one(c.basic_split(lit("abc今日は12個。")))] == [("misc", "abc"), ("word", "今日は12個"), ("misc", "。")]
    assert one(c.sentences(lit("行く。」来る！ x"))) == ["行く。」", "来る！ ", "x"]


def test_alignment_nulls(spark):
    from tsumugi.operators import alignment

    words = spark.createDataFrame([(None, "か"), ("か", None), ("", ""), ("犬", "いぬ"), ("犬", "いぬ"), ("か", "き")], "word string, reading string")
    readings = spark.createDataFrame([], "kanji string, ord int, type string, text string")
    got = sorted((r.word or "-", r.reading or "-", r.parts and r.parts[0].type) for r in alignment.align_readings(words, readings).collect())
    assert got == sorted([("-", "-", None), ("-", "か", None), ("か", "-", None), ("か", "き", None), ("犬", "いぬ", "irr"), ("犬", "いぬ", "irr")])
    assert alignment.original_reading("ぽう", True, None) == "ほう" and alignment.original_reading("けっ", False, "つ") == "けつ"


def test_sentence_split_whole(spark, tmp_path):
    """Every sentence of a text, however many it has."""
    import re

    texts = [(1, "".join(f"s{i}. " for i in range(40))), (2, "a! b? c"), (3, ""), (4, None), (5, "x\ny. z.. w"), (5, "one. two. three. four")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in QUERIES["sentence_split"](spark, str(tmp_path)).select("doc_id", "i", "s").collect())
    assert got == sorted((d, i, s) for d, t in texts for i, s in enumerate(re.findall(r"[^.!?]+[.!?]?", t or "")))


def most_memory(spark, group):
    """MB of execution memory of the task that took most, over the jobs of a group."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty()
    store, tracker = context._jsc.sc().statusStore(), context.statusTracker()
    last = context._gateway.new_array(context._jvm.double, 1)
    last[0] = 1.0
    stages = {s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds}
    found = [x.get().peakExecutionMemory().apply(0) for x in (store.taskSummary(s, 0, last) for s in stages) if x.isDefined()]
    return max(found) / 1e6


def test_char_usage_memory(spark, tmp_path):
    """A file of one row group is read by one task; what is met of each key must not be held by one."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    n = 300_000
    pq.write_table(pa.table({"p_partkey": range(n), "p_name": ["ab 1é かき犬"] * n}), f"{tmp_path}/part.parquet", row_group_size=n)
    spark.sparkContext.setJobGroup("char usage", "")
    try:
        got = {r["c"]: r["n"] for r in QUERIES["char_usage_distinct"](spark, str(tmp_path)).collect()}
    finally:
        for name in ("spark.jobGroup.id", "spark.job.description"):
            spark.sparkContext.setLocalProperty(name, None)
    assert got == dict.fromkeys("ab 1éかき犬", n)
    assert most_memory(spark, "char usage") < 100


def test_char_usage_odd(spark, tmp_path):
    """Repeated and null keys, several names of a key, characters of one to four bytes and at the ends of their ranges."""
    import duckdb

    ends = "\x00\x01?@\x7f\x80\xbf\xc0߿ࠀ﻿￿\U00010000\U0010ffff"
    rows = [(1, "aab"), (1, "bc"), (1, "aab"), (2, "a\n é"), (2, None), (3, ""), (None, "az"), (None, "𠮷"), (-5, "犬𠮟犬é"), (4, ends), (2**63 - 1, ends[::-1]), *[(7, "hot")] * 500]
    spark.createDataFrame(rows, "p_partkey long, p_name string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = sorted((r["c"], r["n"]) for r in QUERIES["char_usage_distinct"](spark, str(tmp_path)).collect())
    assert got == sorted((c, len({k for k, t in rows if c in (t or "") and k is not None})) for c in {c for _, t in rows for c in t or ""})
    con = duckdb.connect()
    con.sql(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    want = con.sql(ORACLES["char_usage_distinct"]).fetchall()
    assert got == sorted(want)
