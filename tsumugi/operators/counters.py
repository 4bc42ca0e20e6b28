"""Numbers with counters: a table of counters, how number and counter sound together, and their join.

A counter is a row: text, seq, kind, kana, suffix, ordinal, foreign, allowed, numerals, digits,
about.  ``digits`` maps the last digit (or power of ten) to what changes there: ``g`` doubles the
number's end, ``r`` voices the counter, ``h`` half-voices it, ``>x`` makes the counter x, and
other kana take the place of the digit's sound.  Key 0 switches the general rules off.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsumugi.functions.chars import AS_KATA, CLASSES, HALF_VOICED, NUMERAL, VOICED
from tsumugi.functions.kana import DIGIT_KANA, POWER_KANA, kana_number, number_of
from tsumugi.operators.lookup import counter_restrictions

COLUMNS = "text string, seq int, kind string, kana string, suffix string, ordinal boolean, foreign boolean, allowed array<int>, numerals array<int>, digits string, about string"
#: The longest run of digits that is read as one number.
LONGEST = 20
# Entries that count though not marked so, those that don't, suffixes, and counters with sounds of their own.
EXTRA = (1255430, 1606800)
LEFT_OUT = (2426510, 2220370, 2248360, 2423450, 2671670, 2735690, 2838543, 2249290, 2833260, 2833465, 2833466, 2833467)
FOREIGN = (1120410,)
SUFFIXES = {"kan": ("間", "かん", "[duration]"), "kango": ("間後", "かんご", "[after ...]"), "chuu": ("中", "ちゅう", "[among/out of ...]")}
ACCEPTS = {1194480: ("kan",), 1490430: ("kan",), 1333450: ("kan", "kango"), 2084840: ("kan",), 2083110: ("kan",), 2149890: ("chuu",)}
YO, SHICHI, KU = {4: ["よ"]}, {7: ["しち"]}, {9: ["く"]}
THIRD, FOURTH, OFF = {3: ["r"]}, {4: ["h"]}, {0: []}
TWO, THREE = [1, 2], [1, 2, 3]
SPECIAL = (
    (1203020, "plain", "階", "かい", THIRD, None),
    (2020680, "plain", "時", "じ", YO | SHICHI | KU, None),
    (1315920, "plain", "時間", "じかん", YO | KU, None),
    (1658480, "half hour", "時半", "じはん", YO | KU, None),
    (1356740, "plain", "畳", "じょう", YO | SHICHI, None),
    (2258110, "plain", "帖", "じょう", YO | SHICHI, None),
    (1396490, "plain", "膳", "ぜん", YO | SHICHI, None),
    (1427240, "plain", "丁", "ちょう", {}, None),
    (1427240, "ordinal", "丁目", "ちょう", {}, None),
    (1427420, "ordinal", "丁目", "ちょうめ", {}, None),
    (1514050, "plain", "舗", "ほ", FOURTH, None),
    (1522150, "plain", "本", "ほん", THIRD, None),
    (1583370, "plain", "匹 疋", "ひき", THIRD, None),
    (1607310, "plain", "羽", "わ", {3: [">ば"], 6: ["g", ">ぱ"], 10: ["g", ">ぱ"], 100: ["g", ">ぱ"], 1000: [">ば"], 10000: [">ば"]}, None),
    (1607320, "plain", "把", "わ", {3: [">ば"], 7: ["しち"], 10: ["g", ">ぱ"]}, None),
    (1633690, "plain", "段", "だん", SHICHI, None),
    (1901390, "plain", "敗", "はい", FOURTH, None),
    (1919550, "plain", "泊", "はく", FOURTH, None),
    (1994890, "plain", "首", "しゅ", {10: []}, None),
    (1351270, "plain", "章", "しょう", {10: []}, None),
    (2019640, "plain", "杯 盃", "はい", THIRD, None),
    (2078550, "plain", "条", "じょう", SHICHI, None),
    (2078590, "plain", "軒", "けん", THIRD, None),
    (2081610, "plain", "立て たて タテ", "たて", OFF, None),
    (2084840, "plain", "年", "ねん", YO | SHICHI | KU, None),
    (1468900, "plain", "年生", "ねんせい", YO | SHICHI | KU, None),
    (1502840, "plain", "分", "ふん", FOURTH, None),
    (2386360, "plain", "分間", "ふんかん", FOURTH, None),
    (1373990, "plain", "世紀", "せいき", {10: ["じっ"]}, None),
    (2836694, "plain", "傑", "けつ", {10: ["じっ"]}, None),
    (2208060, "plain", "遍", "へん", THIRD, None),
    (1511870, "plain", "編 篇", "へん", THIRD, None),
    (2271620, "plain", "口", "こう", {}, None),
    (2412230, "plain", "足", "そく", THIRD, None),
    (1175570, "plain", "円", "えん", YO, None),
    (1315130, "plain", "字", "じ", YO, None),
    (1487770, "plain", "筆", "ひつ", FOURTH, None),
    (2220330, "tsu", "つ", "つ", {}, None),
    (1208920, "native", "株", "かぶ", {}, TWO),
    (1214060, "native", "竿 棹", "さお", YO | {10: []}, [1, 2, 3, 4, 5]),
    (1260670, "native", "本", "もと", {}, THREE),
    (1275640, "native", "口", "くち", {}, THREE),
    (1299680, "native", "皿 盤", "さら", {}, THREE),
    (1302680, "native", "山", "やま", {}, THREE),
    (1335810, "native", "重ね 襲", "かさね", {}, THREE),
    (1361130, "native", "振り 風", "ふり", OFF, TWO),
    (1366210, "native", "針 鉤 鈎", "はり", OFF, TWO),
    (1379650, "native", "盛り 盛", "もり", {}, TWO),
    (1383800, "native", "切り 限り 限", "きり", YO | {8: []}, THREE),
    (1384840, "native", "切れ", "きれ", YO | {8: []}, THREE),
    (1385780, "native", "折", "おり", {}, TWO),
    (1404450, "native", "束", "たば", {}, TWO),
    (1426480, "native", "柱", "はしら", OFF, TWO),
    (1432920, "native", "通り", "とおり", {100: ["g"]}, TWO),
    (1445150, "native", "度", "たび", OFF, TWO),
    (1448350, "native", "棟", "むね", {}, TWO),
    (1335730, "native only", "重", "え", {}, [1, 2, 3, 5, 7, 8, 9, 10]),
    (2108240, "plain", "重", "じゅう", {4: ["し"]} | SHICHI | KU, None),
    (1482110, "native", "晩", "ばん", YO, THREE),
    (1501110, "native", "腹 肚", "はら", OFF, TWO),
    (1397450, "native only", "組", "くみ", {}, THREE),
    (1397450, "plain", "組", "くみ", {1: []}, None),
    (1519300, "native", "房 総", "ふさ", OFF, TWO),
    (1552890, "native", "粒", "つぶ", {6: ["g"]}, THREE),
    (1564410, "native", "一刎", "はね", OFF, THREE),
    (1585650, "native", "箱 函 匣 筥 筐 凾", "はこ", YO | {1000: [], 10000: []}, TWO),
    (1602800, "native", "船 舟", "ふね", OFF, THREE),
    (1853450, "native", "締め 〆", "しめ", {}, TWO),
    (1215240, "native", "間", "ま", YO, [1, 2, 3, 4, 9]),
    (2243700, "native", "咫", "あた", {}, THREE),
    (2414730, "native", "梱", "こり", {}, TWO),
    (1583470, "native", "品", "しな", YO, THREE),
    (1411070, "native", "袋", "ふくろ", YO | {10: ["じっ", "h"]}, THREE),
    (2707020, "plain", "袋", "たい", {10: ["じっ"]}, None),
    (2800530, "native", "回り 廻り", "まわり", {}, TWO),
    (1047880, "native foreign", "ケース", "ケース", {}, TWO),
    (1214540, "native", "缶", "かん", {}, TWO),
    (1575510, "native", "齣 コマ", "こま", {}, TWO),
    (1253800, "native", "桁", "けた", {}, THREE),
    (1241750, "native", "筋", "すじ", {}, THREE),
    (1515340, "native", "包み", "つつみ", {}, THREE),
    (2452360, "native", "片", "ひら", {}, THREE),
    (2844070, "native", "腰", "こし", {}, THREE),
    (2844196, "native", "緡", "さし", {}, THREE),
    (1175140, "native", "駅", "えき", {}, TWO),
    (2855028, "native", "揃え", "そろえ", {}, TWO),
    (2083110, "days", "日", "か", {}, [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 14, 20, 24, 30]),
    (2083100, "days of the month", "日", "にち", {}, None),
    (1255430, "months", "月", "がつ", {4: ["し"]} | SHICHI | KU, list(range(1, 13))),
    (2149890, "people", "人", "にん", YO | SHICHI, None),
    (1606800, "tenths", "割", "わり", {}, None),
    (1606950, "tenths", "割引", "わりびき", {}, None),
    (1294940, "age", "歳 才", "さい", {}, None),
)
NATIVE = {1: "ひと", 2: "ふた", 3: "み", 4: "よ", 5: "いつ", 6: "む", 7: "なな", 8: "や", 9: "ここの", 10: "と"}
WHOLE = {
    "tsu": {1: "ひとつ", 2: "ふたつ", 3: "みっつ", 4: "よっつ", 5: "いつつ", 6: "むっつ", 7: "ななつ", 8: "やっつ", 9: "ここのつ"},
    "days": {1: "ついたち", 2: "ふつか", 3: "みっか", 4: "よっか", 5: "いつか", 6: "むいか", 7: "なのか", 8: "ようか", 9: "ここのか", 10: "とうか", 14: "じゅうよっか", 20: "はつか", 24: "にじゅうよっか", 30: "みそか"},
    "people": {1: "ひとり", 2: "ふたり"},
    "age": {20: "はたち"},
}
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
#: Rows of kana that a digit's end is doubled before, and digits after which は is half-voiced (with and without doubling).
DOUBLING = {1: "かさた", 6: "かぱ", 8: "かさたぱ", 10: "かさたぱ", 100: "か"}
FOREIGN_DOUBLING = {6: "かぱ", 8: "かさたぱ", 10: "かさたぱ", 100: "か"}
HALF, HALF_ONLY = (1, 6, 8, 10, 100), (3, 1000, 10000)
ROW = {c: row[0] for row in ("かきくけこ", "さしすせそ", "たちつてと", "はひふへほ", "ぱぴぷぺぽ") for c in row}
ROW |= {k.translate(AS_KATA): v for k, v in ROW.items()}


def special_rows() -> list[tuple]:
    """``SPECIAL`` as rows of ``COLUMNS``, a row for each spelling."""
    out = []
    for seq, kind, texts, kana, digits, numerals in SPECIAL:
        only = kind == "native only" or kind in ("days", "months")
        base = kind.split(" ")[0] if kind.startswith("native") else kind
        for text in texts.split(" "):
            ordinal, suffix = kind == "ordinal", "め" if (seq, kind) == (1427240, "ordinal") else ""
            about = "(sets or pairs only)" if (seq, kind) == (1397450, "native only") else ""
            out.append((text, seq, base, kana, suffix, ordinal, kind.endswith("foreign"), numerals if only else None, numerals, json.dumps(digits, ensure_ascii=False), about))
    return out


def counter_table(readings: DataFrame, sense_props: DataFrame) -> DataFrame:
    """The counters of a dictionary: its entries with class ctr, those with sounds of their own, their suffixed and ordinal forms."""
    spark = readings.sparkSession
    tagged = sense_props.filter("tag = 'pos' and text = 'ctr'").select("seq").distinct()
    seqs = tagged.unionByName(spark.createDataFrame([(s,) for s in EXTRA], "seq int")).distinct().filter(~F.col("seq").isin(*LEFT_OUT))
    limits = counter_restrictions(sense_props).groupBy("seq").agg(F.collect_set(F.when(F.col("tag") == "stagk", F.col("text"))).alias("only_k"), F.collect_set(F.when(F.col("tag") == "stagr", F.col("text"))).alias("only_r"))
    only = F.when(F.col("script") == "kanji", F.col("only_k")).otherwise(F.col("only_r"))
    own = readings.join(seqs, "seq").join(limits, "seq", "left").filter(F.coalesce((F.size(only) <= 0) | F.array_contains(only, F.col("text")), F.lit(True)))
    special = spark.createDataFrame(special_rows(), COLUMNS).join(own.select("seq").distinct(), "seq", "left_semi").select(*[c.split(" ")[0] for c in COLUMNS.split(", ")])
    rest = own.join(special.select("seq"), "seq", "left_anti")
    heads = rest.groupBy("seq").agg(F.coalesce(F.min_by(F.when(F.col("script") == "kana", F.col("text")), F.when(F.col("script") == "kana", F.col("ord"))), F.lit("")).alias("kana"), (F.count_if(F.col("script") == "kanji") == 0).alias("no_kanji"))
    rest = rest.join(heads, "seq").withColumn("foreign", F.col("no_kanji") | F.col("seq").isin(*FOREIGN))
    rest = rest.filter((F.col("script") == "kanji") | (F.col("foreign") & F.col("text").rlike(f"^[{CLASSES['katakana']}]+$")))
    none = F.lit(None).cast("array<int>")
    plain = rest.select("text", "seq", F.lit("plain").alias("kind"), "kana", F.lit("").alias("suffix"), ((F.length("text") > 1) & F.col("text").endswith("目")).alias("ordinal"), "foreign", none.alias("allowed"), none.alias("numerals"), F.lit("{}").alias("digits"), F.lit("").alias("about"))
    table = special.unionByName(plain)
    extra = spark.createDataFrame([(seq, *SUFFIXES[s]) for seq, many in ACCEPTS.items() for s in many], "seq int, more string, more_kana string, more_about string")
    longer = table.join(F.broadcast(extra), "seq").withColumns({"text": F.concat("text", "more"), "suffix": F.concat("suffix", "more_kana"), "about": F.trim(F.concat_ws(" ", "more_about", "about"))}).select(table.columns)
    table = table.unionByName(longer)
    ordinals = table.filter(~F.col("ordinal")).withColumns({"text": F.concat("text", F.lit("目")), "suffix": F.concat("suffix", F.lit("め")), "ordinal": F.lit(True)})
    plain_number = spark.createDataFrame([("", None, "number", "", "", False, False, None, None, "{}", "")], COLUMNS)
    whole = table.unionByName(ordinals.join(table.select("text"), "text", "left_anti").select(table.columns)).unionByName(plain_number)
    # a language has some hundred counters: a small table, worked out once
    return spark.createDataFrame(whole.collect(), COLUMNS)


def last_unit(n: int) -> int:
    """The last digit, or the power of ten that the number ends with."""
    if n % 10:
        return n % 10
    return next((p for p in (10, 100, 1000) if n % (10 * p)), 10000 if n % 10**8 else 0)


def voiced(kana: str, table: dict[str, str]) -> str:
    return table.get(kana[:1], kana[:1]) + kana[1:]


def doubled(kana: str) -> str:
    return kana[:-1] + "っ" if kana else kana


def joined(n: int, kana: str, digits: dict[str, list[str]], foreign: bool) -> str:
    """The number's kana and the counter's, with the sounds that change where they meet."""
    unit, number = last_unit(n), kana_number(n)
    if "0" in digits or str(unit) in digits:
        for change in digits.get(str(unit), []) if unit else []:
            if change == "g":
                number = doubled(number)
            elif change in "rh":
                kana = voiced(kana, VOICED if change == "r" else HALF_VOICED)
            elif change[0] == ">":
                kana = change[1:]
            else:
                own = DIGIT_KANA[unit] if unit < 10 else POWER_KANA[len(str(unit)) - 1]
                number = number[: -len(own)] + change
        return number + kana
    row = ROW.get(kana[:1], "")
    if row and row in (FOREIGN_DOUBLING if foreign else DOUBLING).get(unit, ""):
        return doubled(number) + kana
    if row == "は" and not foreign and unit in HALF + HALF_ONLY:
        return (doubled(number) if unit in HALF else number) + voiced(kana, HALF_VOICED)
    return number + kana


def counted_kana(n: int, kind: str, kana: str, suffix: str, foreign: bool, numerals: list[int] | None, digits: str) -> str:
    if n in WHOLE.get(kind, {}):
        out = WHOLE[kind][n]
    elif kind == "native" and numerals is not None and n in numerals:
        out = NATIVE[n] + kana
    elif kind == "number":
        out = kana_number(n)
    else:
        out = joined(n, kana, json.loads(digits), foreign)
    return out + suffix


def fits(n: Column, kind: Column, allowed: Column) -> Column:
    """The counter goes with the number."""
    listed = allowed.isNull() | F.array_contains(allowed, n.cast("int"))
    own = F.when(kind == "tsu", n.between(1, 9)).when(kind == "days of the month", ((n > 10) | (n == 1)) & (n != 20)).otherwise(True)
    return n.isNotNull() & listed & own


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th, ..., 11th, ..."""
    digit, teen = n % 10, (n % 100).between(11, 19)
    return F.concat(n.cast("string"), F.when(teen, "th").when(digit == 1, "st").when(digit == 2, "nd").when(digit == 3, "rd").otherwise("th"))


def value_text(n: Column, kind: Column, is_ordinal: Column, about: Column) -> Column:
    plain = F.concat(F.lit("Value: "), F.when(is_ordinal, ordinal(n)).otherwise(n.cast("string")), F.when(about != "", F.concat(F.lit(" "), about)).otherwise(""))
    month = F.get(F.array(*map(F.lit, MONTHS)), (n - 1).cast("int"))
    return F.when(kind == "half hour", F.concat(n.cast("string"), F.lit(":30"))).when(kind == "months", month).when(kind == "tenths", F.concat((n * 10).cast("string"), F.lit("%"))).otherwise(plain)


@F.pandas_udf(T.LongType())
def number_value(texts: pd.Series) -> pd.Series:
    """The number's value; null where it is none or beyond 64 bits."""
    values = texts.map(number_of, na_action="ignore")
    return values.map(lambda v: v if v is not None and v < 1 << 63 else None, na_action="ignore").astype("Int64")


@F.pandas_udf(T.StringType())
def spoken(rows: pd.DataFrame) -> pd.Series:
    listed = lambda v: None if v is None else [int(x) for x in v]
    return pd.Series([counted_kana(int(r.n), r.kind, r.kana, r.suffix, bool(r.foreign), listed(r.numerals), r.digits) for r in rows.itertuples()], dtype="object")


def counted(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """``pairs`` (number, counter, ...) with n, seq, kana, value and ordinal of each counter that goes with its number."""
    rows = pairs.withColumn("n", number_value("number")).join(table.withColumnRenamed("text", "counter"), "counter").filter(fits(F.col("n"), F.col("kind"), F.col("allowed")))
    said = spoken(F.struct("n", "kind", "kana", "suffix", "foreign", "numerals", "digits"))
    return rows.select(*pairs.columns, "n", "seq", said.alias("said"), value_text(F.col("n"), F.col("kind"), F.col("ordinal"), F.col("about")).alias("value"), "ordinal").withColumnRenamed("said", "kana")


def counter_hits(texts: DataFrame, table: DataFrame, *, key: str = "sent_id", text: str = "text") -> DataFrame:
    """(key, start, end, number, counter, n, seq, kana, value, ordinal): runs of numerals with a counter behind them.

    A run is taken whole, up to ``LONGEST`` numerals; the empty counter gives the number alone.
    """
    parts = F.split(F.regexp_replace(F.col(text), f"([{NUMERAL}]+)", "￾$1￾"), "￾")
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, number: string>>").alias("runs"), F.lit(False).alias("own"))
    step = lambda s, p: F.struct((s["at"] + F.length(p)).alias("at"), F.when(s["own"], F.concat(s["runs"], F.array(F.struct(s["at"].alias("start"), p.alias("number"))))).otherwise(s["runs"]).alias("runs"), (~s["own"]).alias("own"))
    runs = texts.select(key, text, F.explode(F.aggregate(parts, zero, step)["runs"]).alias("r")).select(key, text, "r.start", "r.number").filter(F.length("number") <= LONGEST)
    after = F.col("start") + F.length("number")
    most = table.agg(F.max(F.length("text"))).first()[0] or 0
    tails = runs.withColumn("n", F.explode(F.sequence(F.lit(0), F.least(F.lit(most), F.length(text) - after))))
    pairs = tails.select(key, "start", (after + F.col("n")).alias("end"), "number", F.substring(text, after + 1, F.col("n")).alias("counter"))
    return counted(pairs, table)
