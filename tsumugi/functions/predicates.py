"""Named predicates of a token, each one boolean column.

A token is a row with the columns of ``TOKEN``; ``complete`` adds those that a table lacks as nulls,
and the text of the token after it.  A predicate that meets nulls is false.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKEN = {
    "text": "string",
    "kana": "array<string>",
    "type": "string",
    "conj": "array<int>",
    "root": "boolean",
    "pos": "array<string>",
    "conjugations": "array<struct<word: string, reading: string, neg: boolean, types: array<string>, pos: array<string>>>",
    "component_word": "string",
    "word": "string",
    "component_text": "string",
    "dict_text": "string",
}

# Particles, tags, endings and nouns that the predicates name.
CASE_PARTICLES = ("は", "が", "を", "に", "で", "も", "と", "へ", "から", "まで", "より", "よりも")
AFTER_PRONOMINAL_NO = ("は", "が", "を", "に", "で", "より", "よりも", "か", "も", "と", "や", "へ", "から", "まで", "だ", "です", "だった", "でした")
PLAIN_LEMMAS = {"為る": "する", "有る": "ある", "在る": "ある", "成る": "なる", "来る": "くる", "無い": "ない", "居る": "いる", "呉れる": "くれる", "下さる": "くださる", "御座る": "ござる", "よい": "いい", "良い": "いい"}
NOUN = ("n", "pn", "n-suf", "n-pref")
I_ADJECTIVE = ("adj-i", "adj-ix")
ADVERB = ("adv", "adv-to")
COPULA = ("cop", "cop-da")
AUXILIARY = ("aux", "aux-v", "aux-adj", *COPULA)
SURU = ("vs", "vs-i", "vs-s", "vs-c")
STEM_SUFFIXES = ("にくい", "やすい", "がたい", "づらい", "すぎる", "たい")
SURU_PARTS = ("しま", "した", "して", "しな", "しよ", "しろ", "せよ")
STEM_ENDINGS = ("り", "い", "き", "し", "ち", "に", "び", "み")
SURU_ENDING = "く[しすせさ][あいうえおんたてますだでだったれろよかっきけくなどもば]"
SPATIAL_NOUNS = (
    "前", "後", "上", "下", "外", "内", "奥", "手前", "端", "先", "横", "隣", "側", "右", "左", "右辺",
    "左辺", "右側", "左側", "向こう側", "両側", "東", "西", "南", "北", "東側", "西側", "南側", "北側", "前部", "後部", "内側",
    "外側", "内部", "外部", "中心", "周り", "隅", "縁", "面", "前面", "後面", "正面", "背面", "表面", "裏面", "側面", "裏",
    "前方", "後方", "方", "方向", "元", "足元", "手元", "近く", "遠く", "辺", "辺り", "そば", "かたわら", "所", "こちら", "そちら",
    "あちら", "どちら", "向こう",
)


def has(*tags: str, of: Column | str = "pos") -> Column:
    return F.arrays_overlap(of, F.array(*map(F.lit, tags)))


def yes(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def any_of(*conditions: Column) -> Column:
    return F.array_contains(F.array(*map(yes, conditions)), True)


def text() -> Column:
    return F.col("text")


def kana(test: Callable[[Column], Column]) -> Column:
    return F.exists("kana", test)


def spelled(test: Callable[[Column], Column]) -> Column:
    """The text or one of the readings passes."""
    return any_of(test(text()), kana(test))


def conjugated(test: Callable[[Column], Column]) -> Column:
    return F.exists("conjugations", test)


def verb() -> Column:
    return F.exists("pos", lambda p: p.startswith("v"))


def adjective() -> Column:
    return F.exists("pos", lambda p: p.startswith("adj-") & (p != "adj-pn"))


def verb_like() -> Column:
    return any_of(verb(), adjective(), has(*AUXILIARY))


def noun_head() -> Column:
    return has(*NOUN, "adj-no")


def conjunctive_of(*tags: str) -> Column:
    return conjugated(lambda c: F.exists(c["types"], lambda t: t.contains("Conjunctive")) & has(*tags, of=c["pos"]))


def plain_lemma(col: Column) -> Column:
    """The kana spelling of common verbs and adjectives that may be written in kanji."""
    table = F.create_map(*[F.lit(x) for pair in PLAIN_LEMMAS.items() for x in pair])
    return F.coalesce(F.element_at(table, col), col)


def lemma() -> Column:
    """Base form: of the conjugation, of a component's, else the word, the component, the entry, the text."""
    chosen = [F.get("conjugations", 0)["word"], F.col("component_word"), F.col("word"), F.col("component_text"), F.col("dict_text")]
    return plain_lemma(F.coalesce(*[F.nullif(c, F.lit("")) for c in chosen], text()))


def matches(col: Column, pattern: str) -> Column:
    """/x/ is found anywhere, a plain pattern must fit the whole string."""
    inner = pattern[1:-1] if len(pattern) > 1 and pattern[0] == pattern[-1] == "/" else f"^{pattern}$"
    return col.rlike(inner)


def base_prefix(suffix: str) -> Column:
    """The base form before ``suffix``, where both its text and its reading end with it."""
    first = F.get("conjugations", 0)
    word = F.coalesce(F.nullif(first["word"], F.lit("")), text())
    reading = F.coalesce(F.nullif(first["reading"], F.lit("")), F.get("kana", 0))
    rest = F.substring(word, F.lit(1), F.length(word) - len(suffix))
    return F.when(word.endswith(suffix) & reading.endswith(suffix), F.nullif(rest, F.lit("")))


def suru() -> Column:
    return any_of(has(*SURU), spelled(lambda s: s.startswith("し")) & verb_like())


def ku_compound() -> Column:
    inside = lambda part: spelled(lambda s: s.contains(part))
    return verb_like() & ~inside("くない") & (inside("くな") | inside("くし"))


def ku_suru_compound() -> Column:
    bare = F.coalesce(F.size("conjugations"), F.lit(0)) <= 0
    linked = F.when(bare, text().rlike(SURU_ENDING)).otherwise(conjugated(lambda c: c["word"] == "する"))
    return verb_like() & spelled(lambda s: s.contains("くし")) & yes(linked)


def stem_or_auxiliary() -> Column:
    ends = lambda s: F.right(s, F.lit(1)).isin(*STEM_ENDINGS)
    suru_noun = spelled(lambda s: s.rlike("|".join(SURU_PARTS)))
    return any_of(has(*AUXILIARY), verb(), spelled(lambda s: s.isin(*STEM_SUFFIXES)), has("n") & suru_noun, has("n") & ends(text()) & ends(F.get("kana", 0)))


def naru() -> Column:
    based = conjugated(lambda c: any_of(c["word"].isin("なる", "成る"), c["reading"] == "なる"))
    return verb() & any_of(based, spelled(lambda s: s.rlike("なる|なり")))


def noun_phrase() -> Column:
    closed = any_of(F.col("next_text").isNull(), F.col("next_text").isin(*AFTER_PRONOMINAL_NO), ~F.col("next_known"), F.col("next_text").rlike("^[。、！？.,!?]$"))
    return any_of(noun_head(), (text() == "の") & has("prt") & closed)


def neg() -> Column:
    return conjugated(lambda c: yes(c["neg"]))


def contains_conj(*numbers: int) -> Column:
    return F.arrays_overlap("conj", F.array(*map(F.lit, numbers)))


PLAIN: dict[str, Callable[[], Column]] = {
    "isCaseParticle": lambda: has("prt") & text().isin(*CASE_PARTICLES),
    "isNegative": neg,
    "isTopicMarker": lambda: any_of(text().isin("は", "って") & has("prt"), text().endswith("は") & has("exp", "prt")),
    "hasVerbalConjugation": lambda: any_of(verb(), F.size("conj") > 0),
    "isAdjective": adjective,
    "isAdverb": lambda: has(*ADVERB),
    "isAdverbModifier": lambda: any_of(has(*ADVERB), contains_conj(13) & has(*I_ADJECTIVE)),
    "isAuxiliary": lambda: has(*AUXILIARY),
    "isIAdjective": lambda: (text() != "な") & has(*I_ADJECTIVE),
    "isNaAdjective": lambda: has("adj-na"),
    "isPredicateHead": lambda: any_of(verb(), adjective(), has(*COPULA)) & any_of(F.col("root"), F.col("conj").isNull()),
    "isPredicate": lambda: any_of(verb_like(), has(*ADVERB)),
    "isNominalHead": noun_head,
    "isNounModifier": lambda: has(*I_ADJECTIVE, "adj-na", "adj-pn", "num", "ctr", "adj-no"),
    "isNounConnector": lambda: (text() == "の") & has("prt"),
    "isNounPhrase": noun_phrase,
    "isParticle": lambda: has("prt"),
    "isQuestionParticle": lambda: (text() == "か") & has("prt"),
    "isCounter": lambda: has("ctr"),
    "isOrdinal": lambda: any_of(text().contains("番目"), text().contains("第") & has("num", "pref")),
    "isIAdjKuForm": lambda: spelled(lambda s: s.endswith("く")) & has(*I_ADJECTIVE, *ADVERB),
    "isIAdjKunaiForm": lambda: conjugated(lambda c: yes(c["neg"]) & has(*I_ADJECTIVE, of=c["pos"])),
    "isIAdjKuteForm": lambda: conjunctive_of(*I_ADJECTIVE),
    "isCopulaDe": lambda: conjunctive_of(*COPULA),
    "isSuruVerb": suru,
    "isIAdjKuVerbCompound": ku_compound,
    "isIAdjKuSuruCompound": ku_suru_compound,
    "isVerbStemOrAuxiliary": stem_or_auxiliary,
    "isNaruVerb": naru,
    "isSpatialNoun": lambda: text().isin(*SPATIAL_NOUNS) & has(*NOUN),
    "isGradableElement": lambda: any_of(verb_like(), has(*ADVERB), contains_conj(13, 50)),
}
WITH_ARGUMENT: dict[str, Callable[[str], Column]] = {
    "text": lambda a: matches(text(), a),
    "kana": lambda a: kana(lambda k: matches(k, a)),
    "pos": lambda a: F.array_contains("pos", a),
    "lemma": lambda a: lemma() == plain_lemma(F.lit(a.strip())),
    "lemmaNeg": lambda a: (lemma() == plain_lemma(F.lit(a.strip()))) & neg(),
    "conj": lambda a: F.col("root") if a == ":root" else F.array_contains("conj", int(a)) if a.isdigit() else F.lit(False),
    "type": lambda a: F.col("type") == a,
}


def predicate(spec: str) -> Column:
    """The boolean column of ``name`` or ``name:argument``; a missing argument is false."""
    name, _, argument = spec.partition(":")
    if name in PLAIN:
        return yes(PLAIN[name]())
    if name in WITH_ARGUMENT:
        return yes(WITH_ARGUMENT[name](argument)) if argument else F.lit(False)
    raise ValueError(f"no such predicate: {spec}")


def complete(tokens: DataFrame, key: str, order: str) -> DataFrame:
    """All columns of ``TOKEN``, and ``next_text`` and ``next_known`` of the token after each."""
    missing = {c: F.lit(None).cast(t) for c, t in TOKEN.items() if c not in tokens.columns}
    after = Window.partitionBy(key).orderBy(order)
    return tokens.withColumns(missing).withColumns({"next_text": F.lead("text").over(after), "next_known": F.lead(F.col("kana").isNotNull()).over(after)})


def with_prefix_pos(tokens: DataFrame, lexicon: DataFrame, name: str, spec: str) -> DataFrame:
    """Adds column ``name``: the base form before the suffix of ``suffix:pos,pos`` is a word of such a tag.

    ``lexicon`` has columns text and pos (an array); the join is on the prefix alone.
    """
    suffix, found, tags = spec.partition(":")
    if not found or ":" in tags:
        raise ValueError(f"prefixHasPos takes suffix:tags, not {spec}")
    known = lexicon.filter(has(*tags.split(","))).select(F.col("text").alias("__prefix")).distinct().withColumn(name, F.lit(True))
    return tokens.withColumn("__prefix", base_prefix(suffix)).join(known, "__prefix", "left").drop("__prefix").withColumn(name, yes(F.col(name)))
