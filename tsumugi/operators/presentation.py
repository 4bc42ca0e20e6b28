"""What a token shows: its readings, senses, conjugations, and the JSON of all these."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsumugi.functions.chars import CLASSES, as_hiragana
from tsumugi.operators import scoring
from tsumugi.operators.conjugation import NAMES
from tsumugi.operators.lookup import joined_glosses

#: Zero-width marks in kana: a part ends here, and は or へ is a particle.
PART_MARK, PARTICLE_MARK = "​", "‌"
# Particles whose kana is said otherwise, and readings of 何 by the kana after it.
PARTICLES = {"は": "わ", "へ": "え"}
NAN_ROWS = "たちつてとだぢづでどなにぬねの"


def reading_string(kanji: Column, kana: Column) -> Column:
    """漢字 【かな】, or the kana alone."""
    return F.when(kanji.isNotNull(), F.concat(kanji, F.lit(" 【"), kana, F.lit("】"))).otherwise(kana)


def entry_readings(readings: DataFrame) -> DataFrame:
    """(seq, reading): the first spelling and the first kana of each entry."""
    first = lambda script: F.min_by(F.when(F.col("script") == script, F.col("text")), F.when(F.col("script") == script, F.col("ord")))
    return readings.groupBy("seq").agg(first("kanji").alias("k"), first("kana").alias("r")).select("seq", reading_string(F.col("k"), F.coalesce("r", F.lit(""))).alias("reading"))


def token_reading(rows: DataFrame) -> DataFrame:
    """Adds ``reading`` to tokens (text, kana array, type, seq, counter): kana is shown with kanji and counters only."""
    shown = (F.col("type") == "kanji") | (F.col("counter").isNotNull() & F.col("seq").isNotNull())
    return rows.withColumn("reading", F.when(shown, reading_string(F.col("text"), F.get("kana", 0))).otherwise(F.col("text")))


def simplified(readings: Column) -> Column:
    """Readings that differ in their spaces alone become one: a space where all have it, ``·`` where some do."""
    bare = lambda r: F.replace(r, F.lit(" "), F.lit(""))

    def places(r: Column) -> Column:
        """For each space the number of other characters before it."""
        at = F.filter(F.sequence(F.lit(1), F.length(r)), lambda i: F.substring(r, i, F.lit(1)) == " ")
        return F.when(F.length(r) > 0, F.transform(at, lambda i, k: i - 1 - k)).otherwise(F.array().cast("array<int>"))

    def merged(key: Column) -> Column:
        own = F.filter(readings, lambda r: bare(r) == key)
        spaces = F.flatten(F.transform(own, places))

        def sign(i: Column) -> Column:
            n = F.size(F.filter(spaces, lambda s: s == i))
            mark = F.when(n == 0, "").when(n == F.size(own), " ").otherwise("·")
            return F.concat(mark, F.substring(key, i + 1, F.lit(1)))

        return F.when(F.length(key) > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.length(key) - 1), sign), "")).otherwise(key)

    return F.transform(F.array_distinct(F.transform(readings, bare)), merged)


def with_marks(kana: Column, places: Column) -> Column:
    """The kana with a part mark before each of ``places`` (0-based)."""
    steps = F.sequence(F.lit(0), F.greatest(F.length(kana) - 1, F.lit(0)))
    return F.array_join(F.transform(steps, lambda i: F.concat(F.when(F.array_contains(places, i), PART_MARK).otherwise(""), F.substring(kana, i + 1, F.lit(1)))), "")


def without_marks(kana: Column) -> Column:
    return F.translate(kana, PART_MARK + PARTICLE_MARK, "")


def spoken_marks(kana: Column) -> Column:
    """Marks become sounds: は and へ behind a particle mark are said わ and え, a part mark is a space."""
    out = kana
    for sign, sound in PARTICLES.items():
        out = F.replace(out, F.lit(PARTICLE_MARK + sign), F.lit(sound))
    return F.trim(F.replace(F.translate(out, PARTICLE_MARK, ""), F.lit(PART_MARK), F.lit(" ")))


def nan_or_nani(tokens: DataFrame, key: str, order: str) -> DataFrame:
    """The kana of 何: なん before た, だ and な rows, else なに; other tokens keep theirs."""
    after = F.lead(F.get("kana", 0)).over(Window.partitionBy(key).orderBy(order))
    nan = F.left(as_hiragana(F.coalesce(after, F.lit(""))), F.lit(1)).rlike(f"^[{NAN_ROWS}]$")
    return tokens.withColumn("kana", F.when(F.col("text") == "何", F.when(nan, F.array(F.lit("なん"))).otherwise(F.array(F.lit("なに")))).otherwise(F.col("kana")))


def senses(glosses: DataFrame, sense_props: DataFrame) -> DataFrame:
    """(seq, sense_ord, pos, gloss, props): ``pos`` as [a,b], of the sense or the last one before it that has any."""
    texts = glosses.groupBy("seq", "sense_ord").agg(joined_glosses().alias("gloss"))
    listed = sense_props.groupBy("seq", "sense_ord", "tag").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda p: p["text"]).alias("texts"))
    props = listed.groupBy("seq", "sense_ord").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tag", "texts")))).alias("props"))
    own = F.element_at("props", F.lit("pos"))
    before = Window.partitionBy("seq").orderBy("sense_ord").rowsBetween(Window.unboundedPreceding, 0)
    rows = texts.join(props, ["seq", "sense_ord"], "left").withColumn("tags", F.last(own, ignorenulls=True).over(before))
    return rows.select("seq", "sense_ord", F.concat(F.lit("["), F.array_join(F.coalesce("tags", F.array().cast("array<string>")), ","), F.lit("]")).alias("pos"), "gloss", F.coalesce("props", F.expr("cast(map() as map<string, array<string>>)")).alias("props"))


def senses_text(rows: DataFrame) -> DataFrame:
    """(seq, text): a numbered line for each sense of ``senses``, with its field and notes."""
    field, info = F.element_at("props", F.lit("field")), F.element_at("props", F.lit("s_inf"))
    number = F.row_number().over(Window.partitionBy("seq").orderBy("sense_ord"))
    line = F.concat(number.cast("string"), F.lit(". "), "pos", F.when(field.isNotNull(), F.concat(F.lit(" {"), F.array_join(field, ","), F.lit("}"))).otherwise(""), F.when(info.isNotNull(), F.concat(F.lit(" 《"), F.array_join(info, "; "), F.lit("》"))).otherwise(""), F.lit(" "), "gloss")
    return rows.withColumn("line", line).groupBy("seq").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sense_ord", "line"))), lambda x: x["line"]), "\n").alias("text"))


def kana_kanji_pairs(readings: DataFrame, restricted: DataFrame) -> DataFrame:
    """(seq, kana, kanji) that go together: not a kana without kanji, and no restriction to other spellings."""
    kana = readings.filter("script = 'kana' and not coalesce(nokanji, false)").select("seq", F.col("text").alias("kana"))
    kanji = readings.filter("script = 'kanji'").select("seq", F.col("text").alias("kanji"))
    limits = restricted.groupBy("seq", F.col("reading").alias("kana")).agg(F.collect_set("text").alias("only"))
    return kana.join(kanji, "seq").join(limits, ["seq", "kana"], "left").filter(F.col("only").isNull() | F.array_contains("only", F.col("kanji"))).select("seq", "kana", "kanji")


def senses_of_reading(rows: DataFrame, words: DataFrame, readings: DataFrame, restricted: DataFrame) -> DataFrame:
    """The senses that a word (seq, text) can have: those limited to other spellings or readings are left out.

    A limit also holds for the word's partner: a kanji fits a limit to a kana that goes with it, and
    the other way round.
    """
    partners = kana_kanji_pairs(readings, restricted)
    both = partners.select("seq", F.col("kana").alias("text"), F.col("kanji").alias("other")).unionByName(partners.select("seq", F.col("kanji").alias("text"), F.col("kana").alias("other")))
    around = words.join(both, ["seq", "text"], "left").groupBy("seq", "text").agg(F.collect_set("other").alias("others"))
    k, r = F.element_at("props", F.lit("stagk")), F.element_at("props", F.lit("stagr"))
    no = F.array().cast("array<string>")
    limit = F.concat(F.coalesce(k, no), F.coalesce(r, no))
    named = F.array_contains(limit, F.col("text")) | F.array_contains(limit, as_hiragana(F.col("text")))
    kana = F.col("text").rlike(f"^[{CLASSES['kana']}]+$")
    by_partner = F.arrays_overlap("others", F.when(kana, F.coalesce(k, no)).otherwise(F.coalesce(r, no)))
    return rows.join(around, "seq").filter((F.size(limit) == 0) | named | by_partner).select("seq", "text", "sense_ord", "pos", "gloss", "props")


def senses_json(rows: DataFrame, *pos: str, by: tuple[str, ...] = ("seq",)) -> DataFrame:
    """(by, senses): each word's senses as JSON objects pos, gloss, field and info; with ``pos`` those of such a class."""
    kept = rows.filter(F.arrays_overlap(F.split(F.expr("substring(pos, 2, length(pos) - 2)"), ","), F.array(*map(F.lit, pos)))) if pos else rows
    field, info = F.element_at("props", F.lit("field")), F.element_at("props", F.lit("s_inf"))
    sense = F.struct("pos", "gloss", F.when(field.isNotNull(), F.concat(F.lit("{"), F.array_join(field, ","), F.lit("}"))).alias("field"), F.array_join(info, "; ").alias("info"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("sense_ord", sense.alias("s")))), lambda x: x["s"])
    return kept.groupBy(*by).agg(F.to_json(listed).alias("senses"))


def short_entries(readings: DataFrame, short: DataFrame) -> DataFrame:
    """(seq, text): reading : gloss."""
    return entry_readings(readings).join(short, "seq", "left").select("seq", F.concat("reading", F.lit(" : "), F.coalesce("gloss", F.lit(""))).alias("text"))


def conjugation_name(kind: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair]), kind)


def property_text(p: Column) -> Column:
    """[pos] type, polarity and politeness where they are set."""
    neg = F.when(p["neg"], " Negative").when(~p["neg"], " Affirmative").otherwise("")
    fml = F.when(p["fml"], " Formal").when(~p["fml"], " Plain").otherwise("")
    return F.concat(F.lit("["), p["pos"], F.lit("] "), conjugation_name(p["conj_type"]), neg, fml)


def property_struct(p: Column) -> Column:
    """pos, type, and the flags that are true."""
    return F.struct(p["pos"].alias("pos"), conjugation_name(p["conj_type"]).alias("type"), F.when(p["fml"], True).alias("fml"), F.when(p["neg"], True).alias("neg"))


def conjugation_text(data: DataFrame, short: DataFrame) -> DataFrame:
    """(seq, text, lines): how each form is conjugated, direct rows where there are any, with the entry it comes from.

    ``data``: the rows of ``lookup.conjugation_data``; ``short``: seq, text of entries.  Passives
    that are really potentials are left out.
    """
    direct = F.min(F.col("via").isNotNull()).over(Window.partitionBy("seq", "text"))
    rows = data.withColumn("__indirect", direct).filter("__indirect = (via is not null)")
    rows = rows.withColumn("props", F.filter("props", lambda p: ~scoring.rare_passive(p, F.col("text"))))
    rows = rows.join(short.select(F.col("seq").alias("from"), F.col("text").alias("__entry")), "from", "left")
    lines = F.concat(F.lit("[ Conjugation: "), F.array_join(F.transform("props", property_text), "\n  Conjugation: "), F.when(F.col("via").isNotNull(), F.lit("\n --(via)--")).otherwise(""), F.lit("\n  "), F.coalesce("__entry", F.lit("")), F.lit(" ]"))
    order = F.struct(F.array_min(F.transform("props", lambda p: F.when(p["conj_type"] == 10, 13).when(p["conj_type"] == 13, 10).otherwise(p["conj_type"]))).alias("t"), F.col("from").alias("f"), lines.alias("l"))
    return rows.groupBy("seq", "text").agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["l"]), "\n").alias("lines"))


def conjugation_json(data: DataFrame, entry_text: DataFrame, senses_of: DataFrame) -> DataFrame:
    """(seq, text, conj): JSON of each form's conjugations: prop, reading, gloss, readok and, over another form, via.

    Of one source entry indirect rows come before direct ones, and rows whose source is spelled out
    before others.  ``entry_text``: seq, reading; ``senses_of``: seq, senses.
    """
    indirect = F.max(F.col("via").isNotNull()).over(Window.partitionBy("seq", "text", "from"))
    rows = data.withColumn("__i", indirect).filter("__i = (via is not null)").withColumn("readok", F.size("sources") > 0)
    rows = rows.withColumn("__any", F.max("readok").over(Window.partitionBy("seq", "text"))).filter("readok = __any")
    rows = rows.join(entry_text.select(F.col("seq").alias("from"), "reading"), "from", "left").join(senses_of.select(F.col("seq").alias("from"), "senses"), "from", "left")
    item = F.struct(F.transform("props", property_struct).alias("prop"), "reading", F.from_json("senses", "array<struct<pos: string, gloss: string, field: string, info: string>>").alias("gloss"), "readok", "via")
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col("via").isNotNull().alias("v"), F.array_min(F.transform("props", lambda p: p["conj_type"])).alias("t"), F.col("from").alias("f"), F.to_json(item).alias("j")))), lambda x: x["j"])
    return rows.groupBy("seq", "text").agg(F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]")).alias("conj"))


def path_tokens(paths: DataFrame, texts: DataFrame, *, key: str = "sent_id", text: str = "text") -> DataFrame:
    """(key, rank, i, start, end, text, seq, type): the tokens of each path, with the stretches that no segment covers as gaps."""
    rows = paths.join(texts.select(key, F.col(text).alias("__t")), key)
    edge = F.struct(F.length("__t").alias("start"), F.length("__t").alias("end"), F.lit(None).cast("int").alias("seq"))
    steps = rows.select(key, "rank", "__t", F.posexplode(F.concat("path", F.array(edge))).alias("p", "x")).select(key, "rank", "__t", "p", "x.*")
    before = F.coalesce(F.lag("end").over(Window.partitionBy(key, "rank").orderBy("p")), F.lit(0))
    none = F.lit(None).cast("int")
    pieces = F.array(F.struct(before.alias("start"), F.col("start").alias("end"), none.alias("seq"), F.lit(True).alias("gap")), F.struct("start", "end", "seq", F.lit(False).alias("gap")))
    cut = steps.withColumn("pieces", pieces).select(key, "rank", "__t", F.explode("pieces").alias("x")).select(key, "rank", "__t", "x.*").filter("end > start")
    piece = F.substring("__t", F.col("start") + 1, F.col("end") - F.col("start"))
    kind = F.when(F.col("gap"), "gap").when(piece.rlike(f"^[{CLASSES['kana']}]+$"), "kana").otherwise("kanji")
    place = F.row_number().over(Window.partitionBy(key, "rank").orderBy("start")) - 1
    return cut.select(key, "rank", place.alias("i"), "start", "end", piece.alias("text"), "seq", kind.alias("type"))


def merged_alternatives(rows: DataFrame, span: list[str]) -> DataFrame:
    """(span, text, kana, score, alternatives, skipped): words of one span that score two thirds of its best or more become one token.

    ``rows``: span columns, text, kana, seq, score.
    """
    every = rows.groupBy(*span).agg(F.count(F.lit(1)).alias("__all"))
    kept = scoring.shown(rows, span)
    order = F.struct((-F.col("score")).alias("o"), "seq", "text", "kana", "score")
    grouped = kept.groupBy(*span).agg(F.array_sort(F.collect_list(order)).alias("w")).join(every, span)
    return grouped.select(*span, F.get("w", 0)["text"].alias("text"), F.array_distinct(F.transform("w", lambda x: x["kana"])).alias("kana"), F.get("w", 0)["score"].alias("score"), F.when(F.size("w") > 1, F.transform("w", lambda x: x["seq"])).alias("alternatives"), (F.col("__all") - F.size("w")).cast("int").alias("skipped"))


def token_json(tokens: DataFrame, senses_of: DataFrame, conj_of: DataFrame) -> DataFrame:
    """Adds ``json`` to tokens (text, kana array, type, seq, score, counter, root): reading, text, kana, score, seq, gloss, conj.

    A root word has glosses, a counter its value and the glosses of its class, a form its conjugations.
    ``senses_of``: seq, senses; ``conj_of``: seq, text, conj.
    """
    rows = token_reading(tokens).join(senses_of, "seq", "left").join(conj_of, ["seq", "text"], "left")
    sense = F.from_json("senses", "array<struct<pos: string, gloss: string, field: string, info: string>>")
    parsed = F.from_json("conj", "array<struct<prop: array<struct<pos: string, type: string, fml: boolean, neg: boolean>>, reading: string, gloss: array<struct<pos: string, gloss: string, field: string, info: string>>, readok: boolean, via: int>>")
    shown = F.when(F.col("root") | F.col("counter").isNotNull(), sense)
    body = F.struct("reading", "text", "kana", "score", "seq", F.col("counter").alias("counter"), shown.alias("gloss"), F.when(~F.col("root"), parsed).alias("conj"))
    return rows.withColumn("json", F.to_json(body)).select(*tokens.columns, "json")


def romanised(tokens: DataFrame, romanise, *, key: str, order: str) -> DataFrame:
    """(key, romaji): a sentence's tokens in a row, each by its readings joined with ``/``; gaps stay as they are.

    ``romanise`` is one of the column functions of ``kana.romaniser``.  A space stands before a word
    unless one is there.
    """
    readings = F.when(F.size("kana") > 0, simplified(F.transform("kana", spoken_marks))).otherwise(F.array("text"))
    rows = tokens.withColumn("r", readings).select(key, order, "type", "text", F.posexplode("r").alias("k", "r"))
    said = F.when(F.col("type") == "gap", F.col("text")).otherwise(F.array_join(F.transform(F.split(F.col("r"), "[ ·]"), lambda x: x), " "))
    rows = rows.withColumn("said", F.when(F.col("type") == "gap", said).otherwise(romanise(said)))
    words = rows.groupBy(key, order).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "said"))), lambda x: x["said"]), "/").alias("w"))
    listed = words.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "w"))), lambda x: x["w"]).alias("ws"))
    joined = F.aggregate("ws", F.lit(""), lambda out, w: F.concat(out, F.when((out == "") | out.rlike(r"\s$") | ~w.rlike("^[a-zA-Z0-9āīūēōâîûêô]"), "").otherwise(" "), w))
    return listed.select(key, joined.alias("romaji"))


def token_infos(tokens: DataFrame, senses_lines: DataFrame, *, key: str, order: str) -> DataFrame:
    """(key, info): ``* word  senses`` blocks of a sentence's words, the last first."""
    rows = tokens.join(senses_lines.withColumnRenamed("text", "__s"), "seq").withColumn("block", F.concat(F.lit("* "), "text", F.lit("  "), "__s"))
    listed = F.transform(F.reverse(F.array_sort(F.collect_list(F.struct(order, "block")))), lambda x: x["block"])
    return rows.groupBy(key).agg(F.array_join(listed, "\n\n").alias("info"))
