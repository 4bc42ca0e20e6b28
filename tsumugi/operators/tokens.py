"""Tokens for the pattern matcher, from the JSON of a segmentation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENSE = "struct<pos: string, gloss: string, field: string, info: string>"
CONJ = f"struct<prop: array<struct<pos: string, type: string, fml: boolean, neg: boolean>>, reading: string, gloss: array<{SENSE}>, readok: boolean>"
WORD = f"reading: string, text: string, kana: array<string>, score: int, seq: int, suffix: string, compound: array<string>, gloss: array<{SENSE}>, conj: array<{CONJ}>"
#: A token's JSON: alternatives and components are words themselves, one level deep.
INFO = f"struct<{WORD}, alternative: array<struct<{WORD}>>, components: array<struct<{WORD}>>>"
# Particles that are nothing else where the dictionary calls them so.
LONE_PARTICLES = ("か", "が", "を", "は", "も", "に", "で", "と", "の", "や", "へ", "より", "まで", "から", "ね", "よ", "な", "わ", "ぞ", "ぜ", "さ")

#: Families of word classes, as tests of one tag.
FAMILIES: dict[str, Callable[[Column], Column]] = {
    "noun": lambda p: p.isin("n", "pn", "n-suf", "n-pref"),
    "verb": lambda p: p.startswith("v"),
    "adjective": lambda p: p.startswith("adj-") & (p != "adj-pn"),
    "i-adjective": lambda p: p.isin("adj-i", "adj-ix"),
    "na-adjective": lambda p: p == "adj-na",
    "adverb": lambda p: p.isin("adv", "adv-to"),
    "particle": lambda p: p == "prt",
    "auxiliary": lambda p: p.isin("aux", "aux-v", "aux-adj", "cop", "cop-da"),
    "copula": lambda p: p.isin("cop", "cop-da"),
    "prenoun adjective": lambda p: p == "adj-pn",
    "determiner": lambda p: p == "adj-pn",
    "pronoun": lambda p: p == "pn",
}


def families(pos: Column) -> Column:
    """The families that one tag belongs to."""
    return F.array_compact(F.array(*[F.when(F.coalesce(test(pos), F.lit(False)), name) for name, test in FAMILIES.items()]))


def tags_of(pos: Column) -> Column:
    """The tags of a text like [n,vs]."""
    return F.filter(F.transform(F.split(F.regexp_replace(pos, r"[\[\]]", ""), ","), lambda t: F.trim(t)), lambda t: t != "")


def none() -> Column:
    return F.array().cast("array<string>")


def gloss_tags(word: Column) -> Column:
    return F.coalesce(F.flatten(F.transform(F.filter(word["gloss"], lambda g: g["pos"].isNotNull()), lambda g: tags_of(g["pos"]))), none())


def form_tags(conj: Column) -> Column:
    """The tags of one conjugation: of its properties, then of its glosses."""
    props = F.flatten(F.transform(F.filter(conj["prop"], lambda p: p["pos"].isNotNull()), lambda p: tags_of(p["pos"])))
    return F.concat(F.coalesce(props, none()), gloss_tags(conj))


def word_tags(word: Column) -> Column:
    return F.concat(gloss_tags(word), F.coalesce(F.flatten(F.transform(word["conj"], form_tags)), none()))


def pos_of(info: Column) -> Column:
    """A token's word classes: a lone particle's is that alone; a compound's are its own, else its first part's."""
    own = word_tags(info)
    first = F.get(info["components"], 0)
    compound = F.when(F.size(own) > 0, own).otherwise(F.coalesce(word_tags(first), none()))
    others = F.coalesce(F.flatten(F.transform(info["alternative"], word_tags)), none())
    usual = F.when(F.size(info["components"]) > 0, compound).otherwise(F.concat(own, others))
    lone = F.trim(info["text"]).isin(*LONE_PARTICLES) & F.array_contains(gloss_tags(info), "prt")
    return F.when(lone, F.array(F.lit("prt"))).otherwise(F.array_distinct(usual))


def base_reading(text: Column) -> Column:
    """struct(word, reading) of 漢字 【かな】; a reading equal to the word is empty."""
    parts = F.split(text, "【")
    word = F.trim(F.get(parts, 0))
    reading = F.trim(F.replace(F.coalesce(F.get(parts, 1), F.lit("")), F.lit("】"), F.lit("")))
    return F.when(text.contains("【"), F.struct(word.alias("word"), F.when(reading == word, "").otherwise(reading).alias("reading"))).otherwise(F.struct(F.coalesce(text, F.lit("")).alias("word"), F.coalesce(text, F.lit("")).alias("reading")))


def conjugations_of(info: Column) -> Column:
    """array<struct<word, reading, neg, types, pos>>, as the predicates read them."""

    def one(c: Column) -> Column:
        base = base_reading(c["reading"])
        neg = F.when(F.exists(c["prop"], lambda p: F.coalesce(p["neg"], F.lit(False))), True)
        return F.struct(base["word"].alias("word"), base["reading"].alias("reading"), neg.alias("neg"), F.transform(c["prop"], lambda p: p["type"]).alias("types"), F.array_distinct(form_tags(c)).alias("pos"))

    return F.coalesce(F.transform(info["conj"], one), F.array().cast("array<struct<word: string, reading: string, neg: boolean, types: array<string>, pos: array<string>>>"))


def meanings_of(info: Column) -> Column:
    """The distinct glosses of a word, in order."""
    return F.coalesce(F.array_distinct(F.transform(F.filter(info["gloss"], lambda g: g["gloss"].isNotNull()), lambda g: g["gloss"])), none())


def reading_of(info: Column) -> Column:
    """The first kana, where it differs from the text; else the text of an equal alternative's; else empty."""
    own = F.get(info["kana"], 0)
    same = F.get(F.filter(info["alternative"], lambda a: (a["text"] == info["text"]) & (F.get(a["kana"], 0) != info["text"])), 0)
    return F.when(own.isNotNull() & (own != info["text"]), own).otherwise(F.coalesce(F.get(same["kana"], 0), F.lit("")))


def chosen(info: Column) -> Column:
    """The word itself, or the first of its alternatives where it has no score of its own."""
    first = F.get(info["alternative"], 0)
    fields = [f.split(":")[0] for f in ("reading:", "text:", "kana:", "score:", "seq:", "suffix:", "compound:", "gloss:", "conj:")]
    use = info["score"].isNull() & (F.size(info["alternative"]) > 0)
    pick = [F.when(use, first[f]).otherwise(info[f]).alias(f) for f in fields]
    rest = F.when(use, F.slice(info["alternative"], 2, F.greatest(F.size(info["alternative"]) - 1, F.lit(0)))).otherwise(info["alternative"])
    return F.struct(*pick, rest.alias("alternative"), info["components"].alias("components"))


def token_rows(rows: DataFrame, *, key: str, order: str, json: str = "json") -> DataFrame:
    """Tokens with the columns that the predicates read, from (key, order, json); a null JSON is a gap without classes."""
    parsed = rows.withColumn("__info", F.from_json(json, INFO)).withColumn("__w", F.when(F.col("__info").isNotNull(), chosen(F.col("__info"))))
    w = F.col("__w")
    first = F.get(w["components"], 0)
    return parsed.select(
        key, order, *[c for c in rows.columns if c not in (key, order, json, "text")],
        F.coalesce(w["text"], F.col("text") if "text" in rows.columns else F.lit(None)).alias("text"), w["kana"].alias("kana"), F.coalesce(pos_of(w), none()).alias("pos"), conjugations_of(w).alias("conjugations"),
        first["text"].alias("component_text"), w["text"].alias("dict_text"), base_reading(F.get(first["conj"], 0)["reading"])["word"].alias("component_word"),
        reading_of(w).alias("reading"), meanings_of(w).alias("meanings"), w["suffix"].alias("suffix"), F.coalesce(F.size(w["conj"]) <= 0, F.lit(False)).alias("root"),
    )


def alternatives(chunks: DataFrame, *, key: str, chunk: str = "chunk") -> DataFrame:
    """(key, alternative, score, chunk, tokens): readings of a sentence, in which its first word chunk varies and the others stay at their first.

    ``chunks``: key, chunk number, word (boolean), alternative number, score, tokens (array of JSON).  A
    sentence without a word chunk is one reading of score 0.
    """
    first = chunks.filter("word").groupBy(key).agg(F.min(chunk).alias("__first"))
    both = chunks.join(first, key, "left")
    own = F.col(chunk) == F.col("__first")
    choices = both.filter(own).select(key, "alternative", F.col("score").alias("__score")).unionByName(both.filter("__first is null").select(key, F.lit(0).alias("alternative"), F.lit(0).alias("__score")).distinct())
    fixed = both.filter(F.coalesce(~own, F.lit(True)) & (F.col("alternative") == 0)).select(key, chunk, "tokens")
    rest = choices.join(fixed, key).select(key, "alternative", F.col("__score").alias("score"), chunk, "tokens")
    return rest.unionByName(both.filter(own).select(key, "alternative", "score", chunk, "tokens"))
