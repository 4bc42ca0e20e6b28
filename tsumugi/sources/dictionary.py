"""Readers of dictionary entries, kanji, place and rule tables.

XML is cut at the closing tag by the text reader, so that one large file is read in splits, and
each piece is parsed on its own; pieces that can't be parsed end up in ``broken``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tsumugi.functions import kana
from tsumugi.functions.chars import as_hiragana, full_width_kana

SENSE_TAGS = ("pos", "misc", "dial", "field", "s_inf", "stagk", "stagr")
ENTRY = (
    "ent_seq string, k_ele array<struct<keb: string, ke_pri: array<string>>>, "
    "r_ele array<struct<reb: string, re_nokanji: string, re_restr: array<string>, re_inf: array<string>, re_pri: array<string>>>, "
    f"sense array<struct<{', '.join(f'{t}: array<string>' for t in SENSE_TAGS)}, gloss: array<string>>>"
)
KANJI = (
    "literal string, radical struct<rad_value: array<struct<_VALUE: int, _rad_type: string>>>, misc struct<grade: int, stroke_count: array<int>, freq: int>, "
    "reading_meaning struct<rmgroup: array<struct<reading: array<struct<_VALUE: string, _r_type: string>>, meaning: array<struct<_VALUE: string, _m_lang: string>>>>>"
)
# Readings of the signs that end a place's name, and their English.
PLACE_READINGS = {"都": ("と",), "府": ("ふ",), "県": ("けん",), "市": ("し",), "町": ("ちょう", "まち"), "村": ("そん", "むら"), "区": ("く",)}
PLACE_WORDS = {"都": "Metropolis", "道": "Prefecture", "府": "Prefecture", "県": "Prefecture", "市": "City", "区": "Ward", "町": "Town", "村": "Village"}


def pieces(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """(xml) of each element ``tag``; entities of the document's own become their names."""
    raw = spark.read.option("lineSep", f"</{tag}>").text(path)
    body = F.regexp_extract("value", rf"(?s)<{tag}>.*", 0)
    named = F.regexp_replace(body, "&(?!amp;|lt;|gt;|quot;|apos;)([A-Za-z0-9-]+);", "$1")
    return raw.filter(body != "").select(F.concat(named, F.lit(f"</{tag}>")).alias("xml"))


def parsed(xml: DataFrame, schema: str) -> DataFrame:
    return xml.select("xml", F.from_xml("xml", schema, {"mode": "PERMISSIVE"}).alias("e"))


def entries(spark: SparkSession, path: str) -> DataFrame:
    """(seq, k_ele, r_ele, sense) of a dictionary file, plain or gzipped; a seq that is no number is null."""
    return entries_of(pieces(spark, path, "entry"))


def entries_of(xml: DataFrame) -> DataFrame:
    """The same of a table of elements (xml)."""
    e = parsed(xml, ENTRY).filter("e.ent_seq is not null")
    return e.select(F.expr("try_cast(e.ent_seq as int)").alias("seq"), *[F.coalesce(f"e.{c}", F.array()).alias(c) for c in ("k_ele", "r_ele", "sense")])


def broken(spark: SparkSession, path: str, tag: str = "entry", key: str = "ent_seq") -> DataFrame:
    """(xml) of the pieces without a key."""
    return parsed(pieces(spark, path, tag), f"{key} string").filter(f"e.{key} is null").select("xml")


def new_entries(found: DataFrame, known: DataFrame, *, overwrite: bool = False) -> DataFrame:
    """``known`` with the entries of ``found``; of a seq in both, ``overwrite`` says which stays."""
    first, second = (found, known) if overwrite else (known, found)
    return first.unionByName(second.join(first.select("seq"), "seq", "left_anti"))


def commonness(tags: Column) -> Column:
    """Null without tags, the number of the last nf tag, else 0."""
    numbers = F.filter(F.transform(tags, lambda t: F.regexp_extract(t, r"^nf(\d+)", 1)), lambda n: n != "")
    return F.when(F.size(tags) > 0, F.coalesce(F.get(numbers, F.size(numbers) - 1).cast("int"), F.lit(0)))


def tag_text(tags: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(tags, lambda t: F.concat(F.lit("["), t, F.lit("]"))), ""), F.lit(""))


def readings(found: DataFrame, script: str) -> DataFrame:
    """(seq, ord, text, common, common_tags, nokanji) of ``script`` kanji or kana.

    Kana readings that only give okurigana are left out, and the order counts without them.
    """
    group, text, pri = ("k_ele", "keb", "ke_pri") if script == "kanji" else ("r_ele", "reb", "re_pri")
    kept = F.col(group) if script == "kanji" else F.filter(group, lambda r: ~F.coalesce(F.array_contains(r["re_inf"], "ok"), F.lit(False)))
    rows = found.select("seq", F.posexplode(kept).alias("ord", "r"))
    nokanji = F.lit(False) if script == "kanji" else F.col("r.re_nokanji").isNotNull()
    return rows.select("seq", "ord", F.col(f"r.{text}").alias("text"), commonness(F.col(f"r.{pri}")).alias("common"), tag_text(F.col(f"r.{pri}")).alias("common_tags"), nokanji.alias("nokanji"))


def restrictions(found: DataFrame) -> DataFrame:
    """(seq, reading, text): the kanji that a kana reading is limited to."""
    return found.select("seq", F.explode("r_ele").alias("r")).select("seq", F.col("r.reb").alias("reading"), F.explode("r.re_restr").alias("text"))


def senses(found: DataFrame) -> DataFrame:
    return found.select("seq", F.posexplode("sense").alias("sense_ord", "s"))


def glosses(found: DataFrame) -> DataFrame:
    """(seq, sense_ord, ord, text)."""
    return senses(found).select("seq", "sense_ord", F.posexplode("s.gloss").alias("ord", "text"))


def sense_props(found: DataFrame) -> DataFrame:
    """(seq, sense_ord, tag, ord, text) of the seven kinds of properties."""
    kinds = F.create_map(*[x for t in SENSE_TAGS for x in (F.lit(t), F.coalesce(f"s.{t}", F.array().cast("array<string>")))])
    return senses(found).select("seq", "sense_ord", F.explode(kinds).alias("tag", "texts")).select("seq", "sense_ord", "tag", F.posexplode("texts").alias("ord", "text"))


def entry_counts(found: DataFrame) -> DataFrame:
    """(seq, n_kanji, n_kana, primary_nokanji)."""
    flags = readings(found, "kana").groupBy("seq").agg(F.count("*").alias("n_kana"), F.max("nokanji").alias("primary_nokanji"))
    return found.select("seq", F.size("k_ele").alias("n_kanji")).join(flags, "seq", "left").select("seq", "n_kanji", F.coalesce("n_kana", F.lit(0)).alias("n_kana"), F.coalesce("primary_nokanji", F.lit(False)).alias("primary_nokanji"))


def kanji(spark: SparkSession, path: str) -> DataFrame:
    """(kanji, radical_c, radical_n, grade, strokes, freq, groups): the radical's classical number is 1 where none is given."""
    return kanji_of(pieces(spark, path, "character"))


def kanji_of(xml: DataFrame) -> DataFrame:
    """The same of a table of elements (xml)."""
    c = parsed(xml, KANJI).filter("e.literal is not null")
    radical = lambda kind: F.coalesce(F.get(F.filter("e.radical.rad_value", lambda r: r["_rad_type"] == kind), 0)["_VALUE"], F.lit(1))
    return c.select(F.col("e.literal").alias("kanji"), radical("classical").alias("radical_c"), radical("nelson_c").alias("radical_n"), F.col("e.misc.grade").alias("grade"), F.get("e.misc.stroke_count", 0).alias("strokes"), F.col("e.misc.freq").alias("freq"), F.coalesce("e.reading_meaning.rmgroup", F.array()).alias("groups"))


def kanji_readings(found: DataFrame) -> DataFrame:
    """(kanji, ord, type, text, okuri, prefix, suffix): on in hiragana, kun cut at its point."""
    rows = found.select("kanji", F.posexplode(F.flatten(F.transform("groups", lambda g: F.coalesce(g["reading"], F.array())))).alias("ord", "r")).filter(F.col("r._r_type").isin("ja_on", "ja_kun"))
    bare = as_hiragana(F.regexp_replace("r._VALUE", "^-|-$", ""))
    parts = F.split(bare, r"\.")
    return rows.select("kanji", "ord", F.col("r._r_type").alias("type"), F.get(parts, 0).alias("text"), F.get(parts, 1).alias("okuri"), F.col("r._VALUE").startswith("-").alias("prefix"), F.col("r._VALUE").endswith("-").alias("suffix")).dropDuplicates(["kanji", "type", "text", "okuri", "prefix", "suffix"])


def kanji_meanings(found: DataFrame) -> DataFrame:
    """(kanji, ord, text) of the English meanings."""
    rows = found.select("kanji", F.posexplode(F.filter(F.flatten(F.transform("groups", lambda g: F.coalesce(g["meaning"], F.array()))), lambda m: m["_m_lang"].isNull())).alias("ord", "m"))
    return rows.select("kanji", "ord", F.col("m._VALUE").alias("text"))


def tab_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A tab-separated table with a header line: word classes, conjugation types or rules."""
    return spark.read.option("sep", "\t").option("header", True).schema(schema).csv(path)


def hiragana_of(col: Column) -> Column:
    return as_hiragana(full_width_kana(col))


def place_word(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in PLACE_WORDS.items() for x in pair])
    return F.coalesce(F.element_at(table, F.right(name, F.lit(1))), F.lit(""))


def short_place(name: Column, reading: Column) -> Column:
    """The name without its last sign, as struct(text, reading); null where the reading has another end."""
    cut = lambda s, n: F.substring(s, F.lit(1), F.length(s) - n)
    ends = [F.when(name.endswith(sign) & reading.endswith(end), F.struct(cut(name, 1).alias("text"), cut(reading, len(end)).alias("reading"))) for sign, many in PLACE_READINGS.items() for end in many]
    return F.coalesce(*ends)


def municipalities(spark: SparkSession, path: str) -> DataFrame:
    """(id, text, reading, kind, full_name): prefectures, municipalities, and these without their last sign."""
    return municipalities_of(spark.read.schema("id string, pref string, name string, pref_kana string, name_kana string").csv(path))


def municipalities_of(raw: DataFrame) -> DataFrame:
    """The same of the file's rows (id, pref, name, pref_kana, name_kana)."""
    own = F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.lit(""))
    is_pref = (own == "") | F.col("name_kana").isNull()
    reading = hiragana_of(F.when(is_pref, F.col("pref_kana")).otherwise(F.col("name_kana")))
    rows = raw.filter("pref is not null").select("id", "pref", is_pref.alias("is_pref"), F.when(is_pref, F.col("pref")).otherwise(own).alias("text"), reading.alias("reading"), hiragana_of(F.col("pref_kana")).alias("pref_reading"))
    geo = lambda c: F.initcap(kana.romanise_simple(c))
    label = F.concat_ws(" ", geo(F.col("reading")), place_word(F.col("text")))
    full = F.when(F.col("is_pref"), label).otherwise(F.concat(label, F.lit(", "), F.concat_ws(" ", geo(F.col("pref_reading")), place_word(F.col("pref")))))
    last = F.right("text", F.lit(1))
    kind = F.when(last == "都", "metropolis").when(F.col("is_pref"), "prefecture").when(last == "町", "town").when(last == "村", "village").otherwise("city")
    all_ = rows.select("id", "is_pref", F.struct("text", "reading").alias("long"), F.when(~F.col("is_pref"), short_place(F.col("text"), F.col("reading"))).alias("short"), kind.alias("kind"), full.alias("full_name"))
    return all_.select("id", F.explode(F.array_compact(F.array("long", "short"))).alias("p"), "kind", "full_name").select("id", "p.text", "p.reading", "kind", "full_name")


def wards(spark: SparkSession, path: str) -> DataFrame:
    """(id, text, reading, city): wards below the last city line before them, without the city's name.

    A line's city is found among the lines of its file; such files have some thousand lines, and
    the order is that of the file.
    """
    raw = spark.read.schema("id string, text string, reading string").csv(path)
    return wards_of(raw.select("*", F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("n")))


def wards_of(rows: DataFrame) -> DataFrame:
    """The same of lines (id, text, reading) of files ``f``, in the order of ``n``."""
    lines = rows.filter("text is not null")
    before = Window.partitionBy("f").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    city = F.when(F.col("text").endswith("市"), F.struct("text", "reading"))
    rows = lines.withColumn("city", F.last(city, ignorenulls=True).over(before)).filter(F.col("text").endswith("区") & F.col("city").isNotNull())
    own = F.col("text").startswith(F.col("city.text"))
    after = lambda c, head: F.when(own, F.substring(c, F.length(head) + 1, F.length(c))).otherwise(F.col(c))
    return rows.select("id", after("text", F.col("city.text")).alias("text"), after("reading", F.col("city.reading")).alias("reading"), F.expr("substring(city.text, 1, length(city.text) - 1)").alias("city"))
